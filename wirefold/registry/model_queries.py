"""Registered queries: scaler, classifiers, transfer and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirefold.operators import features as ft
from wirefold.operators import models as md
from wirefold.operators import splits as sp
from wirefold.operators import thresholds as th
from wirefold.operators.overlap import stack_methods
from wirefold.plans.fixtures import table
from wirefold.registry.feature_queries import _EXPR, CLEAN, SPLIT
from wirefold.registry.label_queries import labelled, with_labels
from wirefold.registry.threshold_queries import rnd, scores
from wirefold.registry import oracle as o
from wirefold.schemas import FEATURES
from wirefold.session import cut_lineage

def training_table(spark, sf):
    """Clean labelled flows with features, split by day; stored once, because every fit reads it many times."""
    lab = labelled(spark, sf).withColumn("flow_id", F.col("start_us"))
    f = ft.extract_features(lab.withColumn("flow_id", F.col("start_us")))
    return cut_lineage(ft.with_label_bit(ft.clean_labelled(sp.with_day_split(f))))


def scaler_stats(spark, sf):
    t = training_table(spark, sf).where("split = 'train'")
    s = md.scaler_table(t)
    return s.select("feature", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max")])


def _scored(spark, sf, kind):
    t = training_table(spark, sf)
    m = md.fit(t.where("split = 'train'"), kind)
    return md.score(m, t, kind).select("model_name", "pcap_file", "flow_id", "split", "y", "y_score")


def lr_scores(spark, sf):
    return _scored(spark, sf, "logistic_regression")


def rf_scores(spark, sf):
    return _scored(spark, sf, "random_forest")


def gbt_scores(spark, sf):
    return _scored(spark, sf, "boosted_trees")


def baseline_metrics(spark, sf):
    """Train, score and evaluate the three baselines on the test days. Scores are stored: the metrics pass over them three
    times, and a pass sends every row through some 500 trees."""
    p = md.run_baselines(training_table(spark, sf)).where("split = 'test'")
    p = cut_lineage(p.select("model_name", "y", "y_score"))
    k = ["model_name"]
    return rnd(th.metrics_at(p, k, y="y").join(th.ranking_metrics(p, k, y="y").drop("n_pos", "n_neg"), k))


def _datasets(spark, sf):
    t = training_table(spark, sf)
    return t.withColumn("dataset", F.when(F.col("is_tcp") == 1, "tcp_net").otherwise("udp_net"))


def transfer_scores(spark, sf):
    """Model, scaler and thresholds from TCP flows applied unchanged to UDP flows."""
    d = _datasets(spark, sf)
    r = md.transfer(d.where("dataset = 'tcp_net'"), d.where("dataset = 'udp_net'"), "logistic_regression")
    return r.select("dataset", "pcap_file", "flow_id", "y", "y_score", "pred_label_default", "pred_label_val_tuned",
                    "pred_label_fixed_fpr")


def multisource_training_set(spark, sf):
    """Two sources in one tagged training set with a pooled validation part."""
    d = _datasets(spark, sf)
    c = md.combine_sources({"tcp": d.where("dataset = 'tcp_net'"), "udp": d.where("dataset = 'udp_net'")})
    return c.groupBy("source", "split").agg(F.count("*").alias("n"), F.sum("y").alias("n_attack"))


def _pooled(spark, sf):
    d = _datasets(spark, sf)
    return md.pooled_tiers({"tcp": d.where("dataset = 'tcp_net'"), "udp": d.where("dataset = 'udp_net'")},
                           "logistic_regression")


def multisource_scores(spark, sf):
    """Test rows under the model of both sources and its three thresholds from the pooled validation rows."""
    return _pooled(spark, sf).where("split = 'test'").select(
        "source", "pcap_file", "flow_id", "y", "y_score", "pred_label_default", "pred_label_val_tuned", "pred_label_fixed_fpr",
        "threshold_val_tuned", "threshold_fixed_fpr")


def prediction_sidecar(spark, sf):
    t = training_table(spark, sf).withColumn("global_flow_id", F.col("flow_id"))
    s = md.score(md.fit(t.where("split = 'train'"), "logistic_regression"), t, "lr")
    return md.prediction_sidecar(s, md.source_thresholds(s.where("split = 'val'")))


def _calibrated(spark, sf, kind, digits):
    """Every method calibrated on its own."""
    out = None
    for m in ("lr", "rf", "xgb"):
        s = scores(spark, sf).where(F.col("method") == m)
        c = md.calibrate(s.where("file_no = 3"), s.where("file_no >= 4"), kind)
        c = c.select("method", "event_id", "y_true", "y_score", F.round("calibrated", digits).alias("calibrated"))
        out = c if out is None else out.unionByName(c)
    return out


def calibrated_isotonic(spark, sf):
    return _calibrated(spark, sf, "isotonic", 6)


def calibrated_platt(spark, sf):
    return _calibrated(spark, sf, "platt", 4)


def method_union(spark, sf):
    """Per-model predictions stacked into one long table."""
    s = stack_methods(table(spark, sf, "scores"), ["event_id", "y_true"], ["lr", "rf", "xgb"])
    return s.groupBy("method", "y_true").agg(F.count("*").alias("n"), F.round(F.sum("y_score"), 4).alias("score_sum"))


QUERIES = {f.__name__: f for f in (
    scaler_stats, lr_scores, rf_scores, gbt_scores, baseline_metrics, transfer_scores, multisource_training_set,
    multisource_scores, prediction_sidecar, calibrated_isotonic, calibrated_platt, method_union)}

_TR = "tr as (select " + ", ".join(f"({_EXPR.get(c, c)})::double as {c}" for c in FEATURES) \
      + ", * exclude (" + ", ".join(c for c in FEATURES if c not in _EXPR) + ") from clean where split = 'train')"

# Pooled means by the max-min formula: a cell's value is the largest, over cells at or before it, of the smallest mean of
# any run from there to a cell at or after it. Scores between two cells lie on a line between their values.
_ISO = """val as (select method, y_score as x, count(*) as n, sum(y_true) as pos from long_scores where file_no = 3 group by 1, 2),
cum as (select method, x, row_number() over w as i, sum(n) over w as cn, sum(pos) over w as cp, n, pos from val
  window w as (partition by method order by x rows between unbounded preceding and current row)),
runs as (select a.method, a.i as a, b.i as b, (b.cp - a.cp + a.pos)::double / (b.cn - a.cn + a.n) as mean
  from cum a join cum b on a.method = b.method and b.i >= a.i),
least as (select method, a, b as k, min(mean) over (partition by method, a order by b desc) as m from runs),
fitted as (select method, x, v from (select method, k, max(m) as v from least group by 1, 2) f
  join cum using (method) where cum.i = f.k),
asked as (select * from long_scores where file_no >= 4),
sides as (select s.*, l.x as lx, l.v as lv from asked s asof left join fitted l on s.method = l.method and s.y_score >= l.x),
both_sides as (select s.*, h.x as hx, h.v as hv from sides s asof left join fitted h on s.method = h.method and s.y_score <= h.x)"""

ORACLE = {
    "scaler_stats": with_labels(" union all ".join(
        f"select '{c}' as feature, round(avg({c}), 4) as mean, round(stddev_pop({c}), 4) as std, "
        f"round(min({c}), 4) as min, round(max({c}), 4) as max from tr" for c in FEATURES), SPLIT, CLEAN, _TR),
    "multisource_training_set": with_labels("""select case protocol when 6 then 'tcp' else 'udp' end as source, split,
        count(*) as n, count(*) filter (binary_label = 'attack') as n_attack from clean group by 1, 2""", SPLIT, CLEAN),
    "calibrated_isotonic": o.sql(["long_scores"], """select method, event_id, y_true, y_score, round(case when lx is null then hv
        when hx is null or lx = hx then lv else lv + (hv - lv) * (y_score - lx) / (hx - lx) end, 6) as calibrated
        from both_sides""", _ISO),
    "method_union": o.sql(["long_scores"], """select method, y_true, count(*) as n, round(sum(y_score), 4) as score_sum
        from long_scores group by 1, 2"""),
}
