"""Exact top-k search by inner product, a block of documents at a time.

Vectors become whole numbers (`vectors.floored`) and every dimension is a term. Documents are ordered so that near ones
stand together: by nearest pivot over the tasks, by halving the widest dimension inside a task. A task's documents are
a segment, cut into blocks of at most BLOCK documents. A block keeps its documents' numbers (its forward index) and each
term's largest and smallest value. For a query, the sum over terms of the larger product bounds the score of every
document in the block. Blocks are taken by falling bound and scored through their forward index until the bound falls
below the kth best score. The kth best of the query's own segment is its floor everywhere else, so a segment returns
only what can still be among the k best, and the last step merges at most k rows per query and segment.

Queries travel to the segments, one narrow row each; documents are dealt out twice: when they are ordered, and when
they meet the queries. A task holds one segment (about NUMBERS numbers) and a batch of queries.

Defined results: vectors of another length than the query's are no candidates. Rows without a vec_id and vectors that
`floored` leaves out take no part. Rows that repeat a vec_id are candidates, and queries, of their own. Ties go to the
smaller vec_id. Scores outside the range of long count as its ends. An empty table gives no rows. Pivots are a bounded
sample of PIVOTS vectors; like all settings here they steer the work and not the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirefold.llm.vectors import floored, lists, matrix
from wirefold.session import scratch_path

BLOCK = 32
NUMBERS = 1 << 20  # numbers in a segment
PIVOTS = 64
QUERIES = 512  # queries scored together
STEP = 64  # blocks taken at once, at most
EXACT = 2.0 ** 53
LEAST, MOST = -(1 << 63), (1 << 63) - 1
INDEX = ("kind int, segment int, dim int, ids array<long>, cells array<double>, high array<double>, "
         "low array<double>, place int, floor double")


def halve(x: np.ndarray, block: int = BLOCK) -> list[np.ndarray]:
    """The rows of x in parts of at most `block`, by cutting the dimension of widest range in the middle again and again:
    in the middle of its range, which keeps clusters whole, or of its rows where that would split off a few only."""
    parts, todo = [], [np.arange(len(x))] if len(x) else []
    while todo:
        rows = todo.pop()
        if len(rows) <= block:
            parts.append(rows)
            continue
        part = x[rows]
        along = part[:, int(np.argmax(part.max(0) - part.min(0)))]
        upper = along > (along.max() + along.min()) / 2
        if not block // 2 <= np.count_nonzero(upper) <= len(rows) - block // 2:
            upper = np.zeros(len(rows), bool)
            upper[np.argpartition(along, len(rows) // 2)[len(rows) // 2:]] = True
        todo += [rows[upper], rows[~upper]]
    return parts


class Segment:
    """Blocks of documents of one length, with the bounds of each term."""

    def __init__(self, ids: list[np.ndarray], cells: list[np.ndarray], high: np.ndarray, low: np.ndarray):
        self.ids, self.x = np.concatenate(ids), np.concatenate(cells)
        self.starts = np.r_[0, np.cumsum([len(i) for i in ids])]
        self.high, self.low = high, low
        self.widest = float(max(np.abs(high).max(), np.abs(low).max()))

    def best(self, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best scores and vec_ids per query, leaving out the document at place `own`. Free places have the score
        -inf; scores below `floor` may be missing."""
        if len(q) and float(np.abs(q).max()) * self.widest * q.shape[1] >= EXACT:
            return self.best_wide(q, own, k)
        bounds = np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
        order = np.argsort(-bounds, axis=1, kind="stable")
        bounds = np.take_along_axis(bounds, order, 1)
        score, ids = np.full((len(q), k), -np.inf), np.full((len(q), k), MOST)
        live, at, step = np.arange(len(q)), 0, 1
        while at < order.shape[1]:  # one block first, then twice as many each time
            least = np.maximum(score[live, -1], floor[live])
            keep = bounds[live, at] >= least
            live, least = live[keep], least[keep]
            if not len(live):
                break
            some = slice(at, at + step)
            row, place, found = self._scored(q[live], own[live], order[live, some], bounds[live, some] >= least[:, None], k)
            self._merge(score, ids, live, row, place, found)
            at, step = at + step, min(2 * step, STEP)
        return score, ids

    def _scored(self, q, own, blocks, wanted, k) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, score) of the documents of the wanted blocks that are among the k best of these."""
        widest = int(np.diff(self.starts).max())
        out = np.full((*blocks.shape, widest), -np.inf)
        row, col = np.nonzero(wanted)
        block = blocks[row, col]
        by = np.argsort(block, kind="stable")
        row, col, block = row[by], col[by], block[by]
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for i, j in zip(cuts, np.r_[cuts[1:], len(block)]):
            a, b = self.starts[block[i]:][:2]
            r, c = row[i:j], col[i:j]
            found = q[r] @ self.x[a:b].T
            self_here = np.flatnonzero((own[r] >= a) & (own[r] < b))
            found[self_here, own[r][self_here] - a] = -np.inf
            out[r, c, :b - a] = found
        flat = out.reshape(len(q), -1)
        least = np.full(len(q), -np.inf)
        if flat.shape[1] > k:
            least = np.partition(flat, flat.shape[1] - k, axis=1)[:, flat.shape[1] - k]
        r, e = np.nonzero((flat >= least[:, None]) & (flat > -np.inf))
        return r, self.starts[blocks[r, e // widest]] + e % widest, flat[r, e]

    def _merge(self, score, ids, live, row, place, found) -> None:
        """Puts the scored documents among the best so far."""
        k = score.shape[1]
        row = np.r_[np.repeat(np.arange(len(live)), k), row]
        found = np.r_[score[live].ravel(), found]
        names = np.r_[ids[live].ravel(), self.ids[place]]
        by = np.lexsort((names, -found, row))
        row, found, names = row[by], found[by], names[by]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        top = rank < k
        score[live[row[top]], rank[top]], ids[live[row[top]], rank[top]] = found[top], names[top]

    def best_wide(self, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """As `best` where double precision would round: sums of whole numbers of any size, block by block."""
        whole = np.frompyfunc(int, 1, 1)
        score, ids = np.full((len(q), k), -np.inf, object), np.full((len(q), k), MOST)
        for n, row in enumerate(q):
            w, top = whole(row), []
            for a, b in zip(self.starts[:-1], self.starts[1:]):
                found = whole(self.x[a:b]).dot(w)
                top += [(-min(max(s, LEAST), MOST), int(self.ids[a + i])) for i, s in enumerate(found) if a + i != own[n]]
                top = sorted(top)[:k]
            for i, (s, name) in enumerate(top):
                score[n, i], ids[n, i] = -s, name
        return score, ids


def _block_rows(segment: int, dim: int, ids: np.ndarray, x: np.ndarray, asks: np.ndarray, k: int):
    """Rows of the index for a task's documents of one length: its blocks, and its queries with their floors."""
    parts = halve(x)
    order = np.concatenate(parts)
    high, low = np.array([x[p].max(0) for p in parts]), np.array([x[p].min(0) for p in parts])
    for p, h, m, at in zip(parts, high, low, np.cumsum([0, *map(len, parts)])):
        yield (0, segment, dim, ids[p], x[p].ravel(), h, m, int(at), None)
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    here = Segment([ids[p] for p in parts], [x[p] for p in parts], high, low)
    rows = np.flatnonzero(asks)
    for a in range(0, len(rows), QUERIES):
        some = rows[a:a + QUERIES]
        score, _ = here.best(x[some], place[some], np.full(len(some), -np.inf), k)
        for r, s in zip(some, score[:, -1]):
            # a floor that double precision rounds would be no bound
            yield (1, segment, dim, ids[r:r + 1], x[r], None, None, int(place[r]),
                   float(s) if abs(s) < EXACT else None)


def build_index(vectors: DataFrame, is_query: Column, k: int, scale: int = 256) -> DataFrame:
    """The index as a written table: kind 0 rows are blocks with the place of their first document in the segment, kind 1
    rows are queries with place and floor.

    `is_query` is a condition on vec_id.
    """
    spark = vectors.sparkSession
    rows = floored(vectors, scale).filter("vec_id is not null")
    n, numbers = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("dim"), F.lit(0))).first()
    sample: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect():
        sample.setdefault(r["dim"], []).append(r["cells"])
    pivots = {d: np.array(v) / (np.linalg.norm(v, axis=1, keepdims=True) + 1.0) for d, v in sample.items()}

    def deal(batches):
        for batch in batches:
            flat, offs = lists(batch["cells"])
            cell, wide = np.zeros(len(batch), np.int32), np.zeros(len(batch), bool)
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = flat[(offs[at][:, None] + np.arange(dim)).ravel()].reshape(-1, dim)
                wide[at] = np.abs(x).max(1) ** 2 * dim >= EXACT  # kept apart: these need whole numbers of any size
                if dim in pivots:
                    cell[at] = np.argmax(x @ pivots[dim].T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(wide), pa.array(cell)],
                                             [*batch.schema.names, "wide", "cell"])

    def index(batches):
        segment, held = TaskContext.get().partitionId(), list(batches)
        if not sum(len(b) for b in held):
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        dims = rows["dim"].to_numpy()
        for dim in np.unique(dims).tolist():
            part = rows.filter(pa.array(dims == dim))
            out = _block_rows(segment, dim, part["vec_id"].to_numpy(), matrix(part["cells"], dim),
                              part["asks"].to_numpy().astype(bool), k)
            made = []
            for row in out:
                made.append(row)
                if len(made) == 256:
                    yield _batch(made)
                    made = []
            if made:
                yield _batch(made)

    parts = max(-(-int(numbers) // NUMBERS), min(spark.sparkContext.defaultParallelism, -(-n // 1024)), 1)
    dealt = rows.mapInArrow(deal, "vec_id long, dim int, cells array<double>, wide boolean, cell int")
    dealt = dealt.withColumn("asks", F.coalesce(is_query, F.lit(False))).withColumn(
        "row", F.monotonically_increasing_id())  # many rows may share a vec_id; the range must still split them
    path = scratch_path(spark, "block-index")
    dealt.repartitionByRange(parts, "dim", "wide", "cell", "row").mapInArrow(index, INDEX).write.parquet(path)
    return spark.read.parquet(path)


_TYPES = [("kind", pa.int32()), ("segment", pa.int32()), ("dim", pa.int32()), ("ids", pa.list_(pa.int64())),
          ("cells", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("low", pa.list_(pa.float64())),
          ("place", pa.int32()), ("floor", pa.float64())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*rows), _TYPES)],
                                      [n for n, _ in _TYPES])


def _runs(keys: list[np.ndarray]) -> list[tuple[int, int]]:
    """Bounds of the runs of rows that are equal in all keys."""
    n = len(keys[0])
    cut = np.zeros(n, bool)
    cut[:1] = True
    for k in keys:
        cut[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(cut)
    return list(zip(starts.tolist(), np.append(starts[1:], n).tolist()))


def search(index: DataFrame, k: int) -> DataFrame:
    """home and place (the query's row), query_id, vec_id and score: the candidates that segments return."""
    last = index.agg(F.max("segment")).first()[0]
    blocks = index.filter("kind = 0").withColumn("home", F.col("segment"))
    queries = index.filter("kind = 1").withColumn("home", F.col("segment")).withColumn(
        "segment", F.explode(F.sequence(F.lit(0), F.lit(last or 0))))

    def meet(batches):
        at, held, here = None, [], None
        for batch in batches:
            keys = [batch[c].to_numpy() for c in ("segment", "dim", "kind")]
            for a, b in _runs(keys):
                key, part = (int(keys[0][a]), int(keys[1][a])), batch.slice(a, b - a)
                dim = key[1]
                if key != at:
                    at, held, here = key, [], None
                if keys[2][a] == 0:
                    held.append(part)
                    continue
                if not held and here is None:
                    continue  # no document of this length in the segment
                if here is None:
                    t = pa.Table.from_batches(held).combine_chunks()
                    ids = t["ids"].combine_chunks()
                    offs = ids.offsets.to_numpy()
                    flat, x = ids.values.to_numpy(), t["cells"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
                    base = offs[0]
                    here = Segment([flat[i:j] for i, j in zip(offs[:-1], offs[1:])],
                                   [x[i - base:j - base] for i, j in zip(offs[:-1], offs[1:])],
                                   matrix(t["high"], dim), matrix(t["low"], dim))
                    held = []
                for s in range(0, len(part), QUERIES):
                    some = part.slice(s, QUERIES)
                    home, place = some["home"].to_numpy(), some["place"].to_numpy()
                    own = np.where(home == key[0], place, -1)
                    floor = np.nan_to_num(some["floor"].to_numpy(zero_copy_only=False), nan=-np.inf)
                    score, ids = here.best(matrix(some["cells"], dim), own, floor, k)
                    row, col = np.nonzero((score != -np.inf) & (score >= floor[:, None]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(home[row]), pa.array(place[row]), some["ids"].flatten().take(pa.array(row)),
                         pa.array(ids[row, col]), pa.array([int(v) for v in score[row, col]], pa.int64())],
                        ["home", "place", "query_id", "vec_id", "score"])

    both = blocks.unionByName(queries)
    parts = max((last or 0) + 1, 1)
    return both.repartition(parts, "segment").sortWithinPartitions("segment", "dim", "kind", "place").mapInArrow(
        meet, "home int, place int, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of every query."""
    found = search(build_index(vectors, is_query, k, scale), k)
    order = Window.partitionBy("home", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
