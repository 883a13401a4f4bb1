"""Embedding near-duplicates by an exact metric range join.

Vectors are scaled to length one; a cosine of at least c is then a Euclidean distance of at most sqrt(2 - 2c). Pivots
partition the vectors by nearest pivot. A vector is also copied to another cell if it can have a partner among that
cell's own vectors: by the triangle inequality it must lie within the distance of the plane between the two pivots, and
its distance to every pivot must be within the distance of the range that the cell's vectors have. Cells then join
independently, large ones in blocks, and give link counts and a forest of links, never all pairs.

Equal vectors are one vector with a count. Pivots are a bounded, hashed sample of the vectors, and their number is the
one of least estimated cost on that sample (vectors sent and vectors compared): they steer the work and not the result.
Vectors without any structure leave little to prune in many dimensions; then few pivots are best and most cells meet. Every test leaves a margin for rounding, and the cosine that decides is computed in double precision.

Defined results: vectors link with vectors of their own length only, each length is joined on its own (the plan grows with
the number of lengths); vectors that are null, zero, or hold null or non-finite members link with nothing and are components of their own; rows with null vec_id likewise, with component null; rows that
repeat a vec_id count as vectors of their own, with one result each; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.llm.common import pick
from wirefold.llm.components import components
from wirefold.session import cut_lineage

MAX_PIVOTS = 1024
BLOCK_NUMBERS = 1 << 19  # numbers in the left half of a block; the right half holds twice as many
MOVE = 1000  # comparisons that cost as much as sending a vector
MARGIN = 1e-9
ROUNDING = 1e-4  # of cosines in single precision


def prepared(vectors: DataFrame) -> DataFrame:
    """row vec_id, size, unit (array<double>, null if it can have no link) and key, equal for equal vectors."""
    def run(batches):
        for batch in batches:
            column = batch["embedding"]
            units, sizes, keys = [], [], []
            offs = np.append(column.offsets.to_numpy(), 0)[:len(column) + 1]
            flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            null = column.is_null().to_numpy(zero_copy_only=False)
            for i in range(len(column)):
                v = flat[offs[i]:offs[i + 1]]
                top = np.abs(v).max() if not null[i] and len(v) and np.isfinite(v).all() else 0.0
                if not top:
                    units.append(None)
                    sizes.append(None)
                    keys.append(None)
                    continue
                w = v / top  # keeps very large and very small vectors within range
                units.append(w / math.sqrt(float(w @ w)))
                sizes.append(len(v))
                keys.append((v + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([
                batch["vec_id"], pa.array(sizes, pa.int32()), pa.array(units, pa.list_(pa.float64())),
                pa.array(keys, pa.binary())], ["vec_id", "size", "unit", "raw"])

    v = pick(vectors, vec_id="vec_id", embedding="embedding").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return v.mapInArrow(run, "vec_id long, size int, unit array<double>, raw binary").withColumn(
        "key", F.sha2("raw", 256)).drop("raw")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ pivots.T), 0.0))


def block_rows(dim: int) -> tuple[int, int]:
    left = max(16, BLOCK_NUMBERS // max(dim, 1))
    return left, 2 * left


def meets_here(k: int) -> np.ndarray:
    """[home, other]: whether a vector of `home` goes to `other` for the pair of cells, rather than the reverse; the
    lower cell takes it where the numbers have the same parity, so that no cell takes all."""
    i = np.arange(k)
    same = (i[:, None] + i[None, :]) % 2 == 0
    return np.where(same, i[None, :] < i[:, None], i[None, :] > i[:, None])


def planes(d: np.ndarray, cell: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Lower bound of the distance from each vector to the vectors of each other cell."""
    near = d[np.arange(len(d)), cell]
    return (np.square(d) - np.square(near)[:, None]) / (2.0 * between[cell])


def choose_pivots(sample: np.ndarray, count: int, cosine: float, most: int) -> np.ndarray:
    """The first rows of the sample, as many as have the least estimated cost per vector of its other half."""
    eps = math.sqrt(2.0 - 2.0 * cosine) + MARGIN
    left, _ = block_rows(sample.shape[1])
    rest, best, k = sample[len(sample) // 2:], None, 4
    while k <= min(most, len(sample) // 2, max(4, count // 8)):
        p = sample[:k]
        d = _to_pivots(rest, p)
        cell = d.argmin(1)
        between = np.maximum(_to_pivots(p, p), 1e-12)
        copies = ((planes(d, cell, between) <= eps) & meets_here(k)[cell]).sum(1).mean()
        cost = MOVE * copies * math.ceil(count / k / left) + count / k * (1 + copies)
        if best is None or cost < best[0]:
            best = cost, k
        k *= 2
    return sample[:best[1] if best else max(1, min(4, len(sample)))]


def link_table(units: DataFrame, dim: int, cosine: float, pivots: np.ndarray) -> DataFrame:
    """(id, n_links, root) of units (id, n, unit), ids unique: weighted links, in parts, and links of a forest."""
    eps = math.sqrt(2.0 - 2.0 * cosine) + MARGIN
    k = len(pivots)
    between = np.maximum(_to_pivots(pivots, pivots), 1e-12)
    here = meets_here(k)

    def home(batches):
        for batch in batches:
            x = _matrix(batch["unit"], dim)
            d = _to_pivots(x, pivots)
            cell = d.argmin(1)
            # ranges of distances per cell, in parts
            for c in np.unique(cell):
                mine = d[cell == c]
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(c)], pa.int32()), pa.array([len(mine)], pa.int64()), pa.array(
                        [mine.min(0)], pa.list_(pa.float64())), pa.array([mine.max(0)], pa.list_(pa.float64()))],
                    ["cell", "n", "low", "high"])

    def merge(key, group):
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "n": pa.array(
            [pa.compute.sum(group["n"]).as_py()], pa.int64()),
            "low": pa.array([_matrix(group["low"], k).min(0)], pa.list_(pa.float64())),
            "high": pa.array([_matrix(group["high"], k).max(0)], pa.list_(pa.float64()))})

    shape = "cell int, n long, low array<double>, high array<double>"
    found = units.mapInArrow(home, shape).groupBy("cell").applyInArrow(merge, shape).collect()  # one row per pivot
    low, high, own = np.full((k, k), np.inf), np.full((k, k), -np.inf), np.zeros(k, np.int64)
    for r in found:
        low[r["cell"]], high[r["cell"]], own[r["cell"]] = r["low"], r["high"], r["n"]

    def reach(d: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of copies; each pair of cells meets once."""
        row, to = np.nonzero((planes(d, cell, between) <= eps) & here[cell] & (own > 0))
        ok = np.zeros(len(row), bool)
        for a in range(0, len(row), 4096):
            r, t = row[a:a + 4096], to[a:a + 4096]
            ok[a:a + 4096] = ((d[r] >= low[t] - eps) & (d[r] <= high[t] + eps)).all(1)
        return row[ok], to[ok]

    def parts(batch: pa.RecordBatch):
        for a in range(0, len(batch), 512):
            part = batch.slice(a, 512)
            d = _to_pivots(_matrix(part["unit"], dim), pivots)
            cell = d.argmin(1)
            yield part, cell, *reach(d, cell)

    def count(batches):
        for batch in batches:
            for _, _, _, to in parts(batch):
                c, n = np.unique(to, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(n)], ["cell", "n"])

    copies = np.zeros(k, np.int64)
    for r in units.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        copies[r["cell"]] = r["n"]
    left_rows, right_rows = block_rows(dim)
    left, right = -(-own // left_rows), -(-(own + copies) // right_rows)

    def deal(batches):
        """Own vectors as left and right rows, copies as right rows, over the blocks of their cells."""
        for batch in batches:
            for part, cell, row, to in parts(batch):
                h = np.array(part["id"].to_pylist(), np.int64) % 1_000_003
                out: list[tuple[int, str, bool]] = []
                for i, c in enumerate(cell.tolist()):
                    lb, rb = int(h[i] % left[c]), int(h[i] % right[c])
                    out += [(i, f"{c}:{lb}:{j}", True, False) for j in range(right[c])]
                    out += [(i, f"{c}:{j}:{rb}", False, True) for j in range(left[c])]
                for i, c in zip(row.tolist(), to.tolist()):
                    rb = int(h[i] % right[c])
                    out += [(i, f"{c}:{j}:{rb}", False, False) for j in range(left[c])]
                at = pa.array([o[0] for o in out], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array([o[1] for o in out]), pa.array([o[2] for o in out]), pa.array([o[3] for o in out]),
                    part["id"].take(at), part["n"].take(at), part["unit"].take(at)],
                    ["block", "is_left", "own", "id", "n", "unit"])

    def join(key, group):
        is_left = group["is_left"].to_numpy()
        ids, n, x = group["id"].to_numpy(), group["n"].to_numpy(), _matrix(group["unit"], dim)
        own_row = group["own"].to_numpy()
        li, ri = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        links = np.zeros(len(ids), np.int64)
        root = {}

        def find(a: int) -> int:
            while root.get(a, a) != a:
                root[a] = root.get(root[a], root[a])
                a = root[a]
            return a

        single = x.astype(np.float32)
        right = single[ri].T
        for a in range(0, len(li), 256):
            rows = li[a:a + 256]
            i, j = np.nonzero(single[rows] @ right >= cosine - ROUNDING)  # single precision finds, double decides
            i, j = rows[i], ri[j]
            keep = ids[i] != ids[j]
            i, j = i[keep], j[keep]
            keep = np.concatenate([(x[i[b:b + 4096]] * x[j[b:b + 4096]]).sum(1) for b in range(0, len(i), 4096)] or [
                np.zeros(0)]) >= cosine
            i, j = i[keep], j[keep]
            np.add.at(links, i, n[j])
            copied = ~own_row[j]  # an own row counts where it stands on the left
            np.add.at(links, j[copied], n[i[copied]])
            for p, q in zip(ids[i].tolist(), ids[j].tolist()):
                p, q = find(p), find(q)
                if p != q:
                    root[max(p, q)] = min(p, q)
        some = np.flatnonzero(links)
        return pa.table({"id": ids[some], "n_links": links[some], "root": np.array(
            [find(int(i)) for i in ids[some]], np.int64)})

    return units.mapInArrow(deal, "block string, is_left boolean, own boolean, id long, n long, unit array<double>") \
        .groupBy("block").applyInArrow(join, "id long, n_links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = cut_lineage(prepared(vectors))
    able = F.col("size").isNotNull() & F.col("vec_id").isNotNull()
    sizes = [r["size"] for r in rows.filter(able).groupBy("size").count().orderBy("size").collect()]
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.col("vec_id").isNotNull().alias("kept"))
    by_key = None
    for dim in sizes:  # vectors of different lengths have no cosine: each length is a join of its own
        part = _by_key(rows.filter(able & (F.col("size") == dim)), int(dim), cosine, max_pivots)
        by_key = part if by_key is None else by_key.unionByName(part)
    ok = rows.withColumn("key", F.when(able, F.concat_ws(":", "size", "key")))
    got = ok.join(by_key, "key", "left")
    return got.select("vec_id", F.coalesce(F.col("others") + F.col("n") - 1, F.lit(0)).alias("n_links"),
                      F.coalesce("component_id", "vec_id").alias("component_id"),
                      F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"))


def _by_key(rows: DataFrame, dim: int, cosine: float, max_pivots: int) -> DataFrame:
    """key (with the length before it), n, others and component_id of the different vectors of one length."""
    units = cut_lineage(rows.groupBy("key").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("unit").alias("unit")))
    count = units.count()
    # a bounded sample: pivots from its first half, their number judged on the other
    sample = np.array([r["unit"] for r in units.orderBy("key").limit(2 * max_pivots).select("unit").collect()])
    # two different vectors can share their smallest vec_id only where vec_ids repeat: number them by key
    pivots = choose_pivots(sample, count, cosine, max_pivots)
    numbered = units.withColumn("id", F.xxhash64("key"))
    found = cut_lineage(link_table(numbered.select("id", "n", "unit"), dim, cosine, pivots))
    total = found.groupBy("id").agg(F.sum("n_links").alias("others"))
    forest = found.select(F.col("id").alias("a"), F.col("root").alias("b"))
    comp = components(forest).select(F.col("node").alias("id"), "component")
    by_key = numbered.join(total, "id", "left").join(comp, "id", "left").select(
        "key", "n", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("component", "id").alias("component"))
    by_key = by_key.join(units.select("key", F.col("id").alias("least")), "key")
    named = by_key.groupBy("component").agg(F.min("least").alias("component_id"))
    return cut_lineage(by_key.join(named, "component").select(
        F.concat_ws(":", F.lit(dim), "key").alias("key"), "n", "others", "component_id"))
