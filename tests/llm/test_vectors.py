"""Top-k search and whitening against their definitions in whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirefold.llm import topk_search, vectors, whitening

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType())])


def sample(seed, n, dim=8, clusters=5):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(clusters, dim))
    x = (centre[r.integers(clusters, size=n)] + 0.1 * r.normal(size=(n, dim))).astype(np.float32)
    return [(i, [float(v) for v in row], i % 3) for i, row in enumerate(x)]


def tricky(seed=1):
    rows = sample(seed, 400)
    rows[100:160] = [(i, rows[7][1], 1) for i in range(100, 160)]  # many equal vectors: ties
    rows[200:230] = [(50, rows[8][1], 1)] * 30  # one id on many rows, a query's
    rows[0] = (0, rows[7][1], 0)
    return rows + [(1000, None, 0), (1001, [], 0), (1002, [1.0, None] + [0.0] * 6, 0), (1003, [float("nan")] * 8, 0),
                   (1004, [float("inf")] * 8, 0), (None, [1.0] * 8, 0), (1050, [0.5] * 3, 0), (1051, [0.25] * 3, 1),
                   (1100, [0.0] * 8, None), (1150, [-1.0] * 5, 0), (1152, [3e38, -3e38] + [1.0] * 6, 0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def scaled(v, scale):
    if not v or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(np.float64(np.float32(x)) * scale) for x in v]


def brute_top(rows, k, every=50):
    ok = [(n, i, x) for n, (i, v, _) in enumerate(rows) if i is not None and (x := scaled(v, 256))]
    out = []
    for n, i, x in ok:
        if i % every == 0:
            best = sorted((-max(min(sum(a * b for a, b in zip(x, y)), topk_search.MOST), topk_search.LEAST), j)
                          for m, j, y in ok if m != n and len(y) == len(x))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("numbers", [1 << 20, 256])
def test_top_k_equals_brute_force(spark, monkeypatch, numbers):
    monkeypatch.setattr(topk_search, "NUMBERS", numbers)
    rows = tricky()
    got = topk_search.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, 5, 256)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 5)


def test_blocks_are_skipped():
    """On clusters far apart most blocks fall below the bound, and the result is that of all scores."""
    r = np.random.default_rng(3)
    x = np.floor(256 * (np.repeat(np.eye(8), 400, 0) * 4 + 0.05 * r.normal(size=(3200, 8))))
    parts = topk_search.halve(x)
    assert max(map(len, parts)) <= topk_search.BLOCK and sorted(np.concatenate(parts)) == list(range(3200))
    ids = np.arange(3200)
    seg = topk_search.Segment([ids[p] for p in parts], [x[p] for p in parts], np.array([x[p].max(0) for p in parts]),
                              np.array([x[p].min(0) for p in parts]))
    q, scored = x[:40], []
    seg.x = Counting(seg.x, scored)
    score, found = seg.best(q, np.full(40, -1), np.full(40, -np.inf), 5)
    want = q @ x.T
    for i in range(40):
        order = np.lexsort((ids, -want[i]))[:5]
        assert (found[i] == order).all() and (score[i] == want[i][order]).all()
    assert sum(scored) < 0.5 * 3200


class Counting:
    """A matrix that notes how many different rows are read."""

    def __init__(self, x, seen):
        self.x, self.seen, self.rows = x, seen, set()

    def __getitem__(self, key):
        if key.start not in self.rows:
            self.rows.add(key.start)
            self.seen.append(key.stop - key.start)
        return self.x[key]


def test_top_k_on_odd_tables(spark):
    none = topk_search.top_k(frame(spark, [])[["vec_id", "embedding", "label"]], F.col("vec_id") % 50 == 0)
    assert none.collect() == []
    lone = topk_search.top_k(frame(spark, [(50, [1.0, 2.0], 1)]), F.col("vec_id") % 50 == 0)
    assert lone.collect() == []
    rows = sample(4, 60)
    clash = frame(spark, rows).select("*", F.lit(1).alias("dim"), F.lit("x").alias("cells"), F.lit(0).alias("segment"), F.lit(0).alias("asks"))
    got = topk_search.top_k(clash, F.col("vec_id") % 50 == 0, 3)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 3)


def test_no_segment_holds_a_hot_id(spark, monkeypatch):
    """A third of all rows have one id and one vector; segments stay near their size."""
    monkeypatch.setattr(topk_search, "NUMBERS", 1024)
    rows = sample(5, 900)
    rows[:300] = [(7, rows[7][1], 0)] * 300
    index = topk_search.build_index(frame(spark, rows), F.col("vec_id") % 50 == 0, 5)
    sizes = [r["n"] for r in index.filter("kind = 0").groupBy("segment").agg(F.sum(F.size("ids")).alias("n")).collect()]
    assert sum(sizes) == 900 and max(sizes) <= 3 * 1024 // 8


@pytest.mark.parametrize("wide", [1, 60, 1 << 58])
def test_scatter_is_exact(wide):
    r = random.Random(wide)
    x = np.array([[r.randrange(-wide, wide + 1) + 10 ** 6 for _ in range(5)] for _ in range(131)], np.int64)
    total, cross = whitening.scatter(x)
    rows = [[int(v) for v in row] for row in x]
    assert total.tolist() == [sum(row[i] for row in rows) for i in range(5)]
    assert cross.tolist() == [[sum(row[i] * row[j] for row in rows) for j in range(5)] for i in range(5)]
    for v in (0, -1, 5, -(1 << 130), (1 << 130) + 12345):
        assert whitening.from_limbs(whitening.limbs(v)) == v


def brute_white(rows, keep):
    """(vec_id, component) -> n, deviation, whitened up to sign, explained; per vector length."""
    out = {}
    by = {}
    for i, v, _ in rows:
        x = scaled(v, 64)
        if x:
            by.setdefault(len(x), []).append((i, [a + 1_000_000 for a in x]))
    for dim, group in by.items():
        n, s = len(group), [sum(x[d] for _, x in group) for d in range(dim)]
        far = np.array([[n * a - t for a, t in zip(x, s)] for _, x in group], object)
        c = (far / n).astype(float)
        v = c.T @ c / n
        e, u = np.linalg.eigh(v)
        e, u = e[::-1][:keep], u[:, ::-1][:, :keep]
        able = e > 1e-9 * max(e[0], 0)
        w = c @ u[:, able] / np.sqrt(e[able])
        out[dim] = ([i for i, _ in group], n, [sum(int(a) ** 2 for a in row) for row in far], w, e[able] / np.trace(v))
    return out


def test_whitening_equals_brute_force(spark):
    rows = [r for r in tricky(2) if r[0] != 1152]
    got = whitening.whitened_table(frame(spark, rows), keep=6).toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    want = brute_white(rows, 6)
    assert len(got) == sum(len(v[0]) * v[3].shape[1] for v in want.values())
    assert got["identity_error"].max() < 1e-9 and got["component"].max() == 6
    ids, n, far, w, share = want[8]
    part = got[got["n"] == n]
    assert len(part) == len(ids) * 6
    for c in range(6):
        one = part[part["component"] == c + 1]
        pairs = sorted((-1 if i != i else i, d, abs(x)) for i, d, x in zip(one["vec_id"], one["deviation"], one["whitened"]))
        right = sorted((-1 if i is None else i, d, abs(x)) for i, d, x in zip(ids, far, w[:, c]))
        assert [p[:2] for p in pairs] == [p[:2] for p in right]
        assert np.allclose([p[2] for p in pairs], [p[2] for p in right], rtol=1e-6, atol=1e-8)
        assert np.isclose(one["explained"].iloc[0], share[c], rtol=1e-9)


def test_whitening_on_odd_tables(spark):
    assert whitening.whitened_table(frame(spark, [])).collect() == []
    same = whitening.whitened_table(frame(spark, [(1, [1.0, 2.0], 0)] * 5))
    assert same.collect() == []  # no variance, no component
    few = whitening.whitened_table(frame(spark, sample(6, 4))).toPandas()
    assert sorted(few["component"].unique()) == [1, 2, 3] and few["identity_error"].max() < 1e-9
    far = whitening.whitened_table(frame(spark, [(1, [1e15, 0.0], 0), (2, [-1e15, 1.0], 0), (3, [0.0, 5.0], 0),
                                                 (4, [3e38, 0.0], 0)])).toPandas()
    assert set(far["vec_id"]) == {1, 2, 3} and far["deviation"].isna().any()


def test_sums_do_not_depend_on_slices(spark, monkeypatch):
    rows = sample(7, 500)
    a = whitening.fit(whitening.whole_vectors(frame(spark, rows)))
    monkeypatch.setattr(whitening, "ROWS", 7)
    b = whitening.fit(whitening.whole_vectors(frame(spark, rows).repartition(11)))
    assert a[8].total == b[8].total and (a[8].values == b[8].values).all() and (a[8].vectors == b[8].vectors).all()


def test_floored_keeps_order_of_members(spark):
    got = {r["vec_id"]: r["cells"] for r in vectors.floored(frame(spark, tricky()), 256).collect() if r["vec_id"]}
    for i, v, _ in tricky():
        if i and i != 50 and i < 1152:
            assert got.get(i) == scaled(v, 256)
