"""Thresholds, curves, distances and ordering helpers against direct definitions."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wirefold.operators import bootstrap as bs
from wirefold.operators import drift as dr
from wirefold.operators import ordering as od
from wirefold.operators import redraw as rd
from wirefold.operators import thresholds as th


def frame(spark, y, s, g="g"):
    return spark.createDataFrame(pd.DataFrame({"g": g, "y_true": y, "y_score": s}))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 4000)
    s = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 3)
    return y, s, frame(spark, y, s).cache()


def at(y, s, t):
    p = s >= t
    return int((p & (y == 1)).sum()), int((p & (y == 0)).sum())


def test_sweep_is_brute_force(data):
    y, s, df = data
    got = {r.step: (r.tp, r.fp) for r in th.sweep(df, ["g"]).collect()}
    assert got == {i: at(y, s, i * 0.005) for i in range(201)}


def test_best_f1_takes_lowest_on_ties(spark):
    r = th.best_f1(th.sweep(frame(spark, [1, 0], [0.9, 0.1]), ["g"]), ["g"]).first()
    assert r.f1 == 1.0 and r.threshold == pytest.approx(0.105)


@pytest.mark.parametrize("mode", ["lowest", "highest"])
def test_fixed_fpr(data, mode):
    y, s, df = data
    for r in th.fixed_fpr(df, ["g"], [0.01, 0.05, 0.2], mode).collect():
        ok = [t for t in np.unique(s) if at(y, s, t)[1] / (y == 0).sum() <= r.target_fpr]
        want = min(ok) if mode == "lowest" else max(ok)
        assert r.threshold == pytest.approx(want, abs=1e-12) and (r.tp, r.fp) == at(y, s, want)


def test_fixed_fpr_edges(spark):
    r = th.fixed_fpr(frame(spark, [0, 1], [1.0, 0.2]), ["g"], [0.01]).first()
    assert r.threshold > 1.0 and r.tp == 0 and r.note
    assert th.fixed_fpr(frame(spark, [1, 1], [0.3, 0.2]), ["g"]).count() == 0
    with pytest.raises(ValueError):
        th.fixed_fpr(frame(spark, [1], [0.3]), ["g"], mode="middle")


def test_inclusive_threshold(spark):
    assert th.metrics_at(frame(spark, [1, 0], [0.5, 0.4999]), ["g"]).first().tp == 1


def auc(y, s):
    p, n = s[y == 1], s[y == 0]
    return ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))


def test_areas(spark, data):
    y, s, df = data
    r = th.ranking_metrics(df, ["g"]).first()
    assert r.roc_auc == pytest.approx(auc(y, s))
    ts = np.unique(s)[::-1]
    tp = np.array([at(y, s, t)[0] for t in ts])
    pr = tp / np.array([sum(at(y, s, t)) for t in ts])
    assert r.pr_auc == pytest.approx((np.diff(np.concatenate(([0], tp))) / (y == 1).sum() * pr).sum())
    flipped = th.ranking_metrics(df.withColumn("y_score", 1 - F.col("y_score")), ["g"]).first()
    assert flipped.roc_auc == pytest.approx(1 - r.roc_auc)


def test_areas_need_both_classes(spark):
    r = th.ranking_metrics(frame(spark, [1, 1], [0.1, 0.2]), ["g"]).first()
    assert r.roc_auc is None and r.pr_auc is None
    r = th.ranking_metrics(frame(spark, [1, 0, 1], [0.5, 0.5, 0.5]), ["g"]).first()
    assert r.roc_auc == 0.5


def test_distances(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 1, 3000).round(2), rng.normal(0.5, 2, 2000).round(2)
    df = spark.createDataFrame(pd.DataFrame({"f": "x", "v": np.concatenate((a, b)), "src": [True] * 3000 + [False] * 2000}))
    r = dr.distances(df, ["f"], "v", F.col("src")).first()
    grid = np.unique(np.concatenate((a, b)))
    d = np.abs(np.searchsorted(np.sort(a), grid, "right") / 3000 - np.searchsorted(np.sort(b), grid, "right") / 2000)
    assert r.ks == pytest.approx(d.max()) and r.w1 == pytest.approx((d[:-1] * np.diff(grid)).sum())
    back = dr.distances(df, ["f"], "v", ~F.col("src")).first()
    assert back.ks == pytest.approx(r.ks) and 0 <= r.ks <= 1
    one = dr.distances(df.where("src"), ["f"], "v", F.col("src")).first()
    assert one.ks is None


def test_percentiles_and_numbering(spark):
    rng = np.random.default_rng(5)
    v = rng.exponential(1, 5000)
    v[:2000] = 0.25
    df = spark.createDataFrame(pd.DataFrame({"g": rng.integers(0, 3, 5000), "v": v, "id": np.arange(5000)}))
    pdf = df.toPandas()
    got = {r.g: (r.a, r.b) for r in od.percentiles(df, ["g"], "v", {"a": 0.25, "b": 0.9}).collect()}
    for g, p in pdf.groupby("g"):
        assert got[g] == pytest.approx((np.quantile(p.v, 0.25), np.quantile(p.v, 0.9)))
    assert od.percentiles(df, [], "v", {"m": 0.5}).first().m == pytest.approx(np.median(v))
    num = od.numbered(df, ["g"], "v", ["id"], "rn").toPandas().set_index("id").rn
    want = pdf.sort_values(["v", "id"]).groupby("g").cumcount() + 1
    assert (num.sort_index() == want.sort_index()).all()
    assert od.percentiles(df.where("v < 0"), ["g"], "v", {"a": 0.5}).count() == 0


def test_bootstrap_areas_centre_on_the_point(data):
    y, s, df = data
    reps = bs.bootstrap_areas(df, ["g"], 200).toPandas()
    point = th.ranking_metrics(df, ["g"]).first()
    assert len(reps) == 200 and reps.roc_auc.mean() == pytest.approx(point.roc_auc, abs=0.004)
    assert reps.pr_auc.mean() == pytest.approx(point.pr_auc, abs=0.008) and reps.roc_auc.std() > 0.001
    again = bs.bootstrap_areas(df, ["g"], 200).toPandas()
    assert np.allclose(reps.sort_values("replicate").pr_auc, again.sort_values("replicate").pr_auc)


def test_bootstrap_f1_covers_the_point(data):
    r = bs.bootstrap_f1(data[2], ["g"], replicates=500).first()
    assert r.f1_lo < r.f1_pe < r.f1_hi and r.n_test == 4000


def test_paired_bootstrap(spark, data):
    y, s, df = data
    w = df.withColumns({"a": F.col("y_score"), "b": F.rand(1)})
    r = bs.paired_bootstrap(w, ["g"], th.predicted("a", F.lit(0.5)), th.predicted("b", F.lit(0.5)), 400).first()
    assert r.significant and r.delta_in_interval and r.p_value_raw == 0.0
    r = bs.paired_bootstrap(w, ["g"], th.predicted("a", F.lit(0.5)), th.predicted("a", F.lit(0.5)), 100).first()
    assert not r.significant and r.p_value_raw == 1.0


def test_holm(spark):
    t = spark.createDataFrame([("f", 0.01), ("f", 0.04), ("f", 0.03), ("f", 0.9)], "fam string, p_value_raw double")
    got = [(r.p_value_raw, round(r.p_value_adj, 6)) for r in bs.holm(t, "fam").orderBy("p_value_raw").collect()]
    assert got == [(0.01, 0.04), (0.03, 0.09), (0.04, 0.09), (0.9, 0.9)]


def test_seed_stability_uses_sample_deviation(spark):
    t = spark.createDataFrame([("m", 0.684), ("m", 0.444), ("m", 0.805)], "method string, f1 double")
    r = bs.seed_stability(t, ["method"], ["f1"]).first()
    assert round(r.std_f1, 4) == 0.1837 and r.stability == "not_citable"


def test_hashed_redraw_weighs_every_row(spark):
    """Each row has its own weight in each replicate: the md5 of 'replicate:id', row by row."""
    rows = [(None if i % 7 == 0 else "ab"[i % 2], [i * 37, 10 ** 12 + i, -i, 5, None][i % 5], i % 3 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, id long, hit boolean")
    cells = {"hit": F.col("hit"), "miss": ~F.col("hit"), "none": F.lit(None).cast("boolean")}

    def weight(replicate, i):
        if i is None:
            return len(rd.POISSON_CDF)
        u = int(hashlib.md5(f"{replicate}:{i}".encode()).hexdigest()[:8], 16) / 2 ** 32
        return sum(u >= v for v in rd.POISSON_CDF)

    want = {}
    for g, i, hit in rows:
        for k in range(120):
            pair = want.setdefault((g, k), [0, 0])
            pair[0 if hit else 1] += weight(k, i)
    got = bs.hashed_counts(df, ["g"], "id", cells, 120).collect()
    assert {(r.g, r.replicate): [r.hit, r.miss] for r in got} == want
    assert all(r.none == 0 for r in got) and len(got) == len(want)
    total = bs.hashed_counts(df, [], "id", cells, 120).agg(F.sum("hit"), F.sum("miss")).first()
    assert list(total) == [sum(p[j] for p in want.values()) for j in (0, 1)]


def test_no_join_by_group_alone(spark):
    """Totals of a group come with its bucket totals: the cells of a group are never brought together by the group."""
    df = spark.createDataFrame([(g, float(v % 13), v % 3 == 0) for g in "ab" for v in range(90)], "g string, v double, s boolean")
    for out in (dr.distances(df, ["g"], "v", F.col("s")), od.percentiles(df, ["g"], "v", {"m": 0.5})):
        joins = [ln for ln in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in ln]
        assert len(joins) == 1 and "_bucket" in joins[0]
        assert {r.g for r in out.collect()} == {"a", "b"}
