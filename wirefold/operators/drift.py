"""Distribution and score drift between two populations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirefold.functions import rules
from wirefold.functions.columns import safe_divide
from wirefold.operators.ordering import depth_cuts, running_totals
from wirefold.operators.thresholds import area_sums, areas, curve, has_score, score_cells
from wirefold.session import cut_lineage


def unpivot(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """(keep, feature, value) rows, one narrow pass."""
    e = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"))
                            for f in features]))
    return df.select(*keep, e.alias("_e")).select(*keep, "_e.feature", "_e.value")


def distances(df: DataFrame, by: list[str], value: str, in_source) -> DataFrame:
    """Kolmogorov-Smirnov and Wasserstein-1 distance per group between rows where `in_source` holds and the rest.

    Values collapse to counts; the two running distributions come from bucketed totals, so no value range or group is
    ever sorted in one task. NULL when a side is empty.
    """
    src = df.where(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double")).withColumn("_src", in_source)
    cells = src.groupBy(*by, "_v").agg(F.count_if("_src").alias("a"), F.count_if(~F.col("_src")).alias("b"))
    run = running_totals(cells, by, "_v", ["a", "b"], cuts=depth_cuts(src, "_v"), next_out="_next", totals=True)
    j = run.withColumnsRenamed({"all_a": "n_source", "all_b": "n_target"})
    diff = F.abs(F.try_divide(F.col("cum_a"), F.col("n_source")) - F.try_divide(F.col("cum_b"), F.col("n_target")))
    return (j.withColumn("_d", diff).groupBy(*by, "n_source", "n_target")
            .agg(F.max("_d").alias("ks"), F.sum(F.col("_d") * (F.col("_next") - F.col("_v"))).alias("w1"))
            .withColumn("severity", rules.ks_severity("ks")))


def top_drifted(dist: DataFrame, block: list[str], n: int = 10) -> DataFrame:
    """The `n` features with the largest KS of every block (a block has one row per feature)."""
    w = Window.partitionBy(*block).orderBy(F.desc("ks"), F.asc("feature"))
    return dist.withColumn("drift_rank", F.row_number().over(w)).where(F.col("drift_rank") <= n)


def drift_summary(top: DataFrame, block: list[str]) -> DataFrame:
    return top.groupBy(*block).agg(F.avg("ks").alias("mean_ks"), F.max("ks").alias("max_ks"))


def calibration(df: DataFrame, by: list[str], score: str = "y_score", y: str = "y_true", bins: int = 10) -> DataFrame:
    """Expected calibration error on equal-width bins, and Brier score."""
    df = df.where(has_score(score))
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).alias("_bin")
    sq = (F.col(score) - F.col(y)) * (F.col(score) - F.col(y))
    g = df.groupBy(*by, b).agg(F.count("*").alias("n"), F.sum(score).alias("s"), F.sum(y).alias("p"),
                               F.sum(sq).alias("q"))
    return g.groupBy(*by).agg((F.sum(F.abs(F.col("s") - F.col("p"))) / F.sum("n")).alias("ece"),
                              (F.sum("q") / F.sum("n")).alias("brier"))


def score_profile(df: DataFrame, by: list[str], threshold: float = 0.5, score: str = "y_score",
                  y: str = "y_true", bins: int = 10) -> DataFrame:
    """Per group: mean and exact 90th percentile by class, ROC and PR area, calibration, F1 and positives above t.

    The scores are read once, into score cells. Their running counts give areas and percentiles, their sums the rest.
    """
    cells = cut_lineage(score_cells(df, by, score, y))
    s, pos, neg = F.col("score"), F.col("pos"), F.col("neg")
    b = F.least(F.floor(s * bins), F.lit(bins - 1)).alias("_bin")
    per_bin = cells.groupBy(*by, b).agg(F.sum(pos + neg).alias("n"), F.sum(s * (pos + neg)).alias("s"), F.sum(pos).alias("p"),
                                        F.sum(pos * (s - 1) * (s - 1) + neg * s * s).alias("q"))
    cal = per_bin.groupBy(*by).agg((F.sum(F.abs(F.col("s") - F.col("p"))) / F.sum("n")).alias("ece"),
                                   (F.sum("q") / F.sum("n")).alias("brier"))
    pts = curve(cells, by).withColumnsRenamed({"n_pos": "_np", "n_neg": "_nn"})
    hit = s >= threshold
    sums = [*area_sums(), F.sum(s * pos).alias("_sp"), F.sum(s * neg).alias("_sn"), F.sum(F.when(hit, pos).otherwise(0)).alias("tp"),
            F.sum(F.when(hit, neg).otherwise(0)).alias("fp")]
    for k, n, above, own in (("pos", "_np", "tp", pos), ("neg", "_nn", "fp", neg)):
        upto, rank = F.col(n) - F.col(above) + own, 0.9 * (F.col(n) - 1)  # rows of the class at or below the score
        for end, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            sums.append(F.min(F.when((own > 0) & (upto >= at + 1), s)).alias(f"_{k}_{end}"))
    g = pts.groupBy(*by).agg(*sums)

    def p90(k, n):
        rank = F.lit(0.9) * (F.col(n) - 1)
        return F.col(f"_{k}_lo") + (F.col(f"_{k}_hi") - F.col(f"_{k}_lo")) * (rank - F.floor(rank))

    g = g.select(
        *by, F.try_divide("_sp", "n_pos").alias("pos_mean"), F.try_divide("_sn", "n_neg").alias("neg_mean"),
        safe_divide("tp", "n_pos").alias("pos_above"), p90("pos", "n_pos").alias("pos_p90"),
        p90("neg", "n_neg").alias("neg_p90"), *areas(),
        safe_divide(F.col("tp") * 2, F.col("tp") + F.col("fp") + F.col("n_pos")).alias("f1"))
    return g.join(cal, by)


def score_drift(profile: DataFrame, method: str = "method", domain: str = "domain",
                threshold: float = 0.5) -> DataFrame:
    """Every (source, target) pair of a method's profiles with threshold position and degradation mode.

    Works on the profile table: one row per (method, domain).
    """
    src = profile.select(method, *[F.col(c).alias(f"source_{c}") for c in profile.columns if c != method])
    tgt = profile.select(method, *[F.col(c).alias(f"target_{c}") for c in profile.columns if c != method])
    j = src.join(tgt, method).where(F.col(f"source_{domain}") != F.col(f"target_{domain}"))
    return j.withColumns({
        "threshold_position": rules.threshold_position(F.lit(threshold), "target_pos_above"),
        "degradation_mode": rules.degradation_mode("source_roc_auc", "target_roc_auc", "target_f1")})
