"""Whitening of embeddings from exact cross-products.

Entries become whole numbers x. The cross-products of a slice of rows come from bits: every dimension is shifted by its
smallest value in the slice, its bit planes are packed across rows into machine words, and the number of rows where two
planes both have a one, weighted by the planes' powers of two, adds up to the sum of products. The shifts are undone in
whole numbers, so sums over tasks do not depend on how rows are cut. The driver gets one sum per pair of dimensions,
centres as n * sum(x y) - sum(x) * sum(y), still in whole numbers, and only then divides and takes eigenvectors.

A task holds a slice of ROWS rows and one matrix of sums per vector length. Nothing but these sums is shuffled.

Defined results: vectors of different lengths are fits of their own, each with its n. Rows without a usable vector
(null, empty, a null or non-finite entry) are left out, and so are those with an entry whose x is no long. A null vec_id
stays, repeated rows count each, an empty table gives no rows. A component whose eigenvalue is nothing but rounding
(equal rows, fewer rows than dimensions) cannot be scaled to variance one and is left out. `deviation` is null where it
is too large for a long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.llm.vectors import floored, lists

SCALE, SHIFT, KEEP = 64, 1_000_000, 32
ROWS = 4096  # rows whose planes are packed together
LIMB, LIMBS = 40, 5  # sums travel as whole numbers of LIMB bits; the last one has the sign
LONG = 1 << 63
NOISE = 1e-12  # of the largest eigenvalue, per dimension: what double precision cannot tell from zero
OUT = "dim int, vec_id long, component int, n long, deviation long, whitened double, explained double"


def whole_vectors(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, dim and x (array<long>, floor(scale * entry) + shift) of the rows that take part."""
    cells = floored(vectors, scale)
    room = float(LONG - 2 * shift)
    fits = F.forall("cells", lambda c: (c > -room) & (c < room))
    return cells.filter(fits).select("vec_id", "dim", F.transform(
        "cells", lambda c: c.cast("long") + F.lit(shift).cast("long")).alias("x"))


def _planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of the columns of y (uint64) packed across rows, with the column and the power of each plane."""
    bits = max(int(y.max()).bit_length(), 1)
    packed, column, power = [], [], []
    width = -(-len(y) // 64) * 8
    for b in range(bits):
        plane = ((y >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T
        some = np.flatnonzero(plane.any(1))
        rows = np.zeros((len(some), width), np.uint8)
        part = np.packbits(plane[some], axis=1)
        rows[:, :part.shape[1]] = part
        packed.append(rows.view(np.uint64))
        column += some.tolist()
        power += [b] * len(some)
    return np.concatenate(packed), np.array(column, np.int64), np.array(power, np.int64)


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of the columns of whole numbers, exact, as Python integers."""
    n, dim = x.shape
    least = x.min(0)
    words, column, power = _planes(x.astype(np.uint64) - least.astype(np.uint64))  # modulo 2^64: the true difference
    small = n << (2 * (int(power.max(initial=0)) + 1)) < LONG
    kind = np.int64 if small else object
    cross, total = np.zeros((dim, dim), kind), np.zeros(dim, kind)
    np.add.at(total, column, np.bitwise_count(words).sum(1, dtype=np.int64).astype(kind) << power.astype(kind))
    for i in range(len(words)):
        common = np.bitwise_count(words[i] & words[i:]).sum(1, dtype=np.int64).astype(kind)
        weight = common << (power[i:] + power[i]).astype(kind)
        row = np.zeros(dim, kind)
        np.add.at(row, column[i:], weight)
        cross[column[i]] += row
        row[:] = 0
        np.add.at(row, column[i + 1:], weight[1:])
        cross[:, column[i]] += row
    low = np.array([int(v) for v in least], object)
    y = total.astype(object)
    products = cross.astype(object) + np.outer(low, y) + np.outer(y, low) + n * np.outer(low, low)
    return y + n * low, products


def limbs(v: int) -> list[int]:
    out = [(v >> (LIMB * k)) & ((1 << LIMB) - 1) for k in range(LIMBS - 1)]
    return [*out, v >> (LIMB * (LIMBS - 1))]


def from_limbs(parts) -> int:
    return sum(int(p) << (LIMB * k) for k, p in enumerate(parts))


_LIMB_NAMES = [f"l{k}" for k in range(LIMBS)]


def sums(whole: DataFrame) -> DataFrame:
    """dim, i, j and the limbs of the exact sum of products of entries i >= j over all rows; j = -1 has the sum of entry
    i, and i = -1 the number of rows."""
    def add(batches):
        held: dict[int, list] = {}
        for batch in batches:
            dims, (flat, offs) = batch["dim"].to_numpy(), _longs(batch["x"])
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                for a in range(0, len(at), ROWS):
                    some = at[a:a + ROWS]
                    total, cross = scatter(flat[(offs[some][:, None] + np.arange(dim)).ravel()].reshape(-1, dim))
                    if dim in held:
                        held[dim] = [held[dim][0] + len(some), held[dim][1] + total, held[dim][2] + cross]
                    else:
                        held[dim] = [len(some), total, cross]
        for dim, (n, total, cross) in held.items():
            i, j = np.tril_indices(dim)
            first = [-1, *range(dim), *i.tolist()]
            second = [-1] * (dim + 1) + j.tolist()
            values = [limbs(int(v)) for v in (n, *total, *cross[i, j])]
            for a in range(0, len(first), 1 << 16):
                part = list(zip(*values[a:a + (1 << 16)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim] * len(part[0]), pa.int32()), pa.array(first[a:a + (1 << 16)], pa.int32()),
                     pa.array(second[a:a + (1 << 16)], pa.int32()), *[pa.array(p, pa.int64()) for p in part]],
                    ["dim", "i", "j", *_LIMB_NAMES])

    parts = whole.select("dim", "x").mapInArrow(add, "dim int, i int, j int, " + ", ".join(f"{c} long" for c in _LIMB_NAMES))
    return parts.groupBy("dim", "i", "j").agg(*[F.sum(c).alias(c) for c in _LIMB_NAMES])


def _longs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.values.to_numpy(), column.offsets.to_numpy().astype(np.int64)


@dataclass
class Fit:
    """The components of all vectors of one length."""

    n: int
    total: list[int]  # sum of each entry
    values: np.ndarray
    vectors: np.ndarray  # one column per component
    trace: float

    def whiten(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The whitened components of rows x, and each row's deviation as a whole number of any size."""
        top = max(abs(int(x.max())), abs(int(x.min())), 1)
        if self.n * top + max(abs(t) for t in self.total) < LONG:
            centred = x * np.int64(self.n) - np.array(self.total, np.int64)
        else:
            centred = x.astype(object) * self.n - np.array(self.total, object)
        apart = (centred / self.n).astype(np.float64)
        if int(np.abs(centred).max()) ** 2 * x.shape[1] >= LONG:
            centred = centred.astype(object)
        far = (centred * centred).sum(1)
        return apart @ self.vectors / np.sqrt(self.values), far


def fit(whole: DataFrame, keep: int = KEEP) -> dict[int, Fit]:
    """One fit per vector length. What comes to the driver is a number per pair of dimensions."""
    found: dict[int, dict] = {}
    for r in sums(whole).collect():
        found.setdefault(r["dim"], {})[r["i"], r["j"]] = from_limbs([r[c] for c in _LIMB_NAMES])
    out = {}
    for dim, of in found.items():
        n, total = of[-1, -1], [of[i, -1] for i in range(dim)]
        v = np.zeros((dim, dim))
        for i in range(dim):
            for j in range(i + 1):
                v[i, j] = v[j, i] = (n * of[i, j] - total[i] * total[j]) / (n * n)  # rounded once, from whole numbers
        trace = sum(n * of[i, i] - total[i] ** 2 for i in range(dim)) / (n * n)
        e, u = np.linalg.eigh(v)
        e, u = e[::-1][:keep], u[:, ::-1][:, :keep]
        able = e > NOISE * dim * max(e[0], 0.0)
        out[dim] = Fit(n, total, e[able], np.ascontiguousarray(u[:, able]), trace)
    return out


def _by_length(batch: pa.RecordBatch, fits: dict[int, Fit], rows: int):
    """(fit, vec_ids, matrix) of a few rows of one length at a time."""
    dims, (flat, offs) = batch["dim"].to_numpy(), _longs(batch["x"])
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        for a in range(0, len(at), rows):
            some = at[a:a + rows]
            yield fits[dim], batch["vec_id"].take(pa.array(some)), flat[
                (offs[some][:, None] + np.arange(dim)).ravel()].reshape(-1, dim)


def whiten(whole: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """dim, vec_id, component, n, deviation, whitened and explained: a row per row and component."""
    def run(batches):
        for batch in batches:
            for f, ids, x in _by_length(batch, fits, 1024):
                k = len(f.values)
                if not k:
                    continue
                w, far = f.whiten(x)
                far = pa.array([int(v) if v < LONG else None for v in far], pa.int64())
                row = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), x.shape[1], np.int32)), ids.take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(len(row), f.n, np.int64)), far.take(row), pa.array(w.ravel()),
                     pa.array(np.tile(f.values / f.trace, len(x)))],
                    ["dim", "vec_id", "component", "n", "deviation", "whitened", "explained"])

    return whole.mapInArrow(run, OUT)


def identity_errors(whole: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Per vector length the largest absolute entry of the whitened rows' covariance less the identity, measured on the
    whitened rows themselves. Tasks return products around their own mean, which the last step brings together."""
    def add(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for f, _, x in _by_length(batch, fits, ROWS):
                w = f.whiten(x)[0]
                n, mean = len(w), w.mean(0)
                m2 = (w - mean).T @ (w - mean)
                if x.shape[1] in held:
                    n0, mean0, m20 = held[x.shape[1]]
                    step = mean - mean0
                    m2 = m20 + m2 + np.outer(step, step) * (n0 * n / (n0 + n))
                    mean = mean0 + step * (n / (n0 + n))
                    n += n0
                held[x.shape[1]] = [n, mean, m2]
        for dim, (n, mean, m2) in held.items():
            i, j = np.tril_indices(len(mean))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                 pa.array(m2[i, j] + n * mean[i] * mean[j]), pa.array(n * mean[i]), pa.array(n * mean[j])],
                ["dim", "i", "j", "m", "a", "b"])

    got = whole.mapInArrow(add, "dim int, i int, j int, m double, a double, b double").groupBy("dim", "i", "j").agg(
        F.sum("m").alias("m"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    out: dict[int, float] = {}
    for r in got.collect():
        n = fits[r["dim"]].n
        cov = (r["m"] - r["a"] * r["b"] / n) / n
        out[r["dim"]] = max(out.get(r["dim"], 0.0), abs(cov - (r["i"] == r["j"])))
    return out


def whitened_table(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT, keep: int = KEEP) -> DataFrame:
    """The rows of `whiten`, fitted to all rows, with identity_error."""
    whole = whole_vectors(vectors, scale, shift)
    fits = fit(whole, keep)
    errors = identity_errors(whole, fits)
    got = whiten(whole, fits)
    if not errors:
        return got.withColumn("identity_error", F.lit(None).cast("double")).drop("dim")
    of_length = F.create_map(*[F.lit(v) for pair in errors.items() for v in pair])
    return got.withColumn("identity_error", of_length[F.col("dim")]).drop("dim")
