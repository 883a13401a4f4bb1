"""Report tables computed from metric rows: matrices, rankings, shares and comparisons.

Inputs are metric tables (one row per source, target, method and tier), so these are small joins and pivots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirefold.functions import rules
from wirefold.functions.columns import context_name


def best_f1_matrix(results: DataFrame, targets: list[str]) -> DataFrame:
    """Best F1 of every source on every target; the diagonal is in-domain."""
    return results.groupBy("source").pivot("target", targets).agg(F.max("f1"))


def auc_matrix(results: DataFrame, targets: list[str]) -> DataFrame:
    return results.groupBy("method", "source").pivot("target", targets).agg(F.max("roc_auc"))


def recall_matrix(breakdown: DataFrame, methods: list[str], group: str = "family") -> DataFrame:
    return breakdown.groupBy(group).pivot("method", methods).agg(F.max("recall"))


def method_ranking(results: DataFrame) -> DataFrame:
    """Mean F1 over the transfer directions present; a missing F1 counts as 0."""
    x = results.where("source <> target")
    g = x.groupBy("method").agg(F.avg(F.coalesce("f1", F.lit(0.0))).alias("mean_f1"), F.count("*").alias("n_directions"))
    return g.withColumn("method_rank", F.row_number().over(
        Window.partitionBy(F.lit(1)).orderBy(F.desc("mean_f1"), F.asc("method"))))


def best_method(results: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("f1"), F.asc("method"))
    return results.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def degradation(results: DataFrame) -> DataFrame:
    """In-domain against cross-domain F1 of the same source and method."""
    ind = results.where("source = target").select("source", "method", F.col("f1").alias("in_domain_f1"))
    x = results.where("source <> target").join(ind, ["source", "method"])
    return x.withColumn("delta_f1", F.col("f1") - F.col("in_domain_f1"))


def portability_counts(classified: DataFrame) -> DataFrame:
    """Counts and share of every class by (setting, tier), with margins over both."""
    g = classified.cube("setting", "tier", "classification").agg(
        F.count("*").alias("n"), F.grouping_id().alias("gid"))
    g = g.where(F.col("gid").bitwiseAND(1) == 0)
    w = Window.partitionBy("setting", "tier", "gid")
    return g.withColumn("share", F.col("n") / F.sum("n").over(w)).drop("gid")


def source_share(train: DataFrame, source: str = "source") -> DataFrame:
    g = train.groupBy(source).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def multisource_gain(multi: DataFrame, single: DataFrame) -> DataFrame:
    """Every multi-source row against the best constituent single source with the same method, tier and target.

    `multi` has `sources` (array) and `target`; the best single source is the one with the largest F1.
    """
    s = single.select(F.col("source").alias("single_source"), "target", "method", "tier",
                      F.struct("f1", "recall", "fpr").alias("_s"))
    parts = multi.withColumn("single_source", F.explode("sources"))
    best = (parts.join(s, ["single_source", "target", "method", "tier"])
            .groupBy("combo", "target", "method", "tier")
            .agg(F.max_by(F.struct("single_source", "_s.f1", "_s.recall", "_s.fpr"),
                          F.struct("_s.f1", "single_source")).alias("_b")))
    j = multi.join(best, ["combo", "target", "method", "tier"], "left")
    d_f1 = F.col("f1") - F.col("_b.f1")
    return j.withColumns({
        "best_single": F.col("_b.single_source"), "delta_f1": d_f1, "delta_recall": F.col("recall") - F.col("_b.recall"),
        "delta_fpr": F.col("fpr") - F.col("_b.fpr"),
        "improvement": rules.multisource_outcome("tier", "threshold", d_f1)}).drop("_b")


def ci_lookup(results: DataFrame, intervals: DataFrame, context: str = "context") -> DataFrame:
    """Confidence limits by normalised context name ('A → B' reads as 'a_to_b') and method."""
    i = intervals.withColumn("_ctx", context_name(context)).drop(context)
    return results.withColumn("_ctx", context_name(context)).join(i, ["_ctx", "method"], "left").drop("_ctx")
