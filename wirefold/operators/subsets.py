"""Metrics on protocol and volume subsets against the full test set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirefold.functions import rules
from wirefold.functions.columns import safe_divide
from wirefold.operators.ordering import percentiles, running_totals
from wirefold.operators.thresholds import has_score, rates
from wirefold.session import cut_lineage


def attack_quartiles(df: DataFrame, by: list[str], columns: dict[str, str], y: str = "y_true") -> DataFrame:
    """Exact 75th percentile over the attacks of each group, of every column (name -> column) in one pass."""
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("v"))
                                 for n, c in columns.items()]))
    long = df.where(F.col(y) == 1).select(*by, values.alias("_e")).select(*by, "_e.name", "_e.v")
    q = percentiles(long, [*by, "name"], "v", {"q": 0.75})
    return q.groupBy(*by).agg(*[F.max(F.when(F.col("name") == n, F.col("q"))).alias(n) for n in columns])


def memberships(volume: str, rate: str | None, y: str) -> dict[str, Column]:
    """Which subsets a row belongs to: full test, TCP, UDP, and all benign plus attacks at or above the attacks' 75th
    percentile of volume (and of rate when given)."""
    benign = F.col(y) == 0
    out = {"full_test": F.lit(True), "tcp_only": F.col("protocol") == 6, "udp_only": F.col("protocol") == 17,
           "high_vol_atk_q75": benign | (F.col(volume) >= F.col("q_volume"))}
    if rate:
        out["high_pps_atk_q75"] = benign | (F.col(rate) >= F.col("q_rate"))
    return out


def subset_cells(df: DataFrame, by: list[str], volume: str = "bytes_total", rate: str | None = None,
                 score: str = "y_score", y: str = "y_true") -> tuple[DataFrame, list[str]]:
    """One row per (group, score) with positives and negatives of every subset as columns pos_<i> and neg_<i>, and the
    subsets' names. Rows are never copied to the subsets they belong to."""
    q = attack_quartiles(df, by, {"q_volume": volume, **({"q_rate": rate} if rate else {})}, y)
    # One row per group: stored once, and broadcast by size at run time.
    j = df.where(has_score(score)).join(cut_lineage(q), by, "left")
    parts, t = memberships(volume, rate, y), F.col(y) == 1
    cells = j.groupBy(*by, F.col(score).alias("score")).agg(*[
        F.count_if(on & cls).alias(f"{k}_{i}") for i, on in enumerate(parts.values()) for k, cls in (("pos", t), ("neg", ~t))])
    return cells, list(parts)


def subset_degradation(df: DataFrame, by: list[str], threshold: float = 0.5, volume: str = "bytes_total",
                       rate: str | None = None, score: str = "y_score", y: str = "y_true") -> DataFrame:
    """Metrics and ROC area per subset and their change against the full test set; empty subsets give no row."""
    cells, names = subset_cells(df, by, volume, rate, score, y)
    cells = cut_lineage(cells)
    sums = [f"{k}_{i}" for i in range(len(names)) for k in ("pos", "neg")]
    pts, hit = running_totals(cells, by, "score", sums, descending=True), F.col("score") >= threshold
    aggs = []
    for i in range(len(names)):
        pos, neg = F.col(f"pos_{i}"), F.col(f"neg_{i}")
        aggs += [F.sum(F.when(hit, pos).otherwise(0)).alias(f"tp_{i}"), F.sum(F.when(hit, neg).otherwise(0)).alias(f"fp_{i}"),
                 F.sum(pos).alias(f"p_{i}"), F.sum(neg).alias(f"n_{i}"),
                 F.sum(pos.cast("double") * (F.col(f"cum_neg_{i}") - neg / 2)).alias(f"lost_{i}")]
    g = pts.groupBy(*by).agg(*aggs)
    c = F.col
    rows = F.explode(F.array(*[F.struct(
        F.lit(name).alias("subset_type"), c(f"tp_{i}").alias("tp"), c(f"fp_{i}").alias("fp"),
        (c(f"p_{i}") - c(f"tp_{i}")).alias("fn"), (c(f"n_{i}") - c(f"fp_{i}")).alias("tn"),
        F.when((c(f"p_{i}") > 0) & (c(f"n_{i}") > 0), 1 - F.try_divide(
            c(f"lost_{i}"), c(f"p_{i}").cast("double") * c(f"n_{i}"))).alias("roc_auc")) for i, name in enumerate(names)]))
    recall = [safe_divide("tp_0", "p_0").alias("_recall"), safe_divide(c("tp_0") * 2, c("tp_0") + c("fp_0") + c("p_0")).alias("_f1"),
              F.when((c("p_0") > 0) & (c("n_0") > 0), 1 - F.try_divide(c("lost_0"), c("p_0").cast("double") * c("n_0"))).alias("_roc")]
    m = rates(g.select(*by, *recall, rows.alias("_e")).select(*by, "_recall", "_f1", "_roc", "_e.*"))
    m = m.withColumns({"threshold": F.lit(threshold), "n_samples": c("tp") + c("fp") + c("fn") + c("tn"),
                       "n_attacks": c("tp") + c("fn")}).where("n_samples > 0")
    d_f1, d_rec = c("f1") - c("_f1"), c("recall") - c("_recall")
    return m.withColumns({
        "delta_f1_vs_full": d_f1, "delta_recall_vs_full": d_rec,
        "interpretation": rules.subset_interpretation("subset_type", d_rec, d_f1, "roc_auc", "_roc"),
    }).drop("_f1", "_recall", "_roc", "tp", "fp", "fn", "tn")
