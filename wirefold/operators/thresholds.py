"""Metrics at thresholds, threshold selection, ROC and precision-recall areas.

Score tables reduce first to score cells - one row per (group, score) with positive and negative counts - by a
map-side-combined aggregate. Everything else works on cells: a sweep needs at most 201 rows per group, and the exact
scans use running totals over depth buckets (see `ordering`), never one sorted window over a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirefold.functions.columns import _c, safe_divide
from wirefold.operators.ordering import depth_cuts, running_totals
from wirefold.session import cut_lineage

DEFAULT_THRESHOLD = 0.5
SWEEP_STEPS = 200
# False-positive-rate budgets.
BUDGETS = [0.01, 0.005, 0.001]


def predicted(score, threshold) -> Column:
    return (_c(score) >= _c(threshold)).cast("int")


def label_tiers(scores: DataFrame, default: float, val_tuned: float, fixed_fpr: float,
                score: str = "pred_score") -> DataFrame:
    return scores.withColumns({"pred_label_default": predicted(score, F.lit(default)),
                               "pred_label_val_tuned": predicted(score, F.lit(val_tuned)),
                               "pred_label_fixed_fpr": predicted(score, F.lit(fixed_fpr))})


def has_score(score) -> Column:
    return _c(score).isNotNull() & ~F.isnan(_c(score))


def unscored_counts(df: DataFrame, by: list[str], score: str = "y_score") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_if(~has_score(score)).alias("n_unscored"))


def confusion(df: DataFrame, by: list[str], pred: Column, y: str = "y_true") -> DataFrame:
    p, t = pred.cast("boolean"), F.col(y) == 1
    return df.groupBy(*by).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"),
                               F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))


def rates(df: DataFrame) -> DataFrame:
    """precision, recall, f1 and fpr from tp, fp, fn, tn; 0 for an empty denominator."""
    return df.withColumns({
        "precision": safe_divide("tp", F.col("tp") + F.col("fp")),
        "recall": safe_divide("tp", F.col("tp") + F.col("fn")),
        "f1": safe_divide(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn")),
        "fpr": safe_divide("fp", F.col("fp") + F.col("tn"))})


def extended_rates(df: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    tpr, tnr = safe_divide(tp, tp + fn), safe_divide(tn, tn + fp)
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return rates(df).withColumns({
        "accuracy": safe_divide(tp + tn, tp + fp + fn + tn), "fnr": safe_divide(fn, tp + fn),
        "balanced_accuracy": (tpr + tnr) / 2, "mcc": safe_divide(tp * tn - fp * fn, den)})


def metrics_at(df: DataFrame, by: list[str], threshold: float = DEFAULT_THRESHOLD, score: str = "y_score",
               y: str = "y_true") -> DataFrame:
    c = confusion(df.where(has_score(score)), by, predicted(score, F.lit(threshold)), y)
    return rates(c).withColumn("threshold", F.lit(threshold))


def score_cells(df: DataFrame, by: list[str], score: str = "y_score", y: str = "y_true") -> DataFrame:
    t = F.col(y) == 1
    return df.where(has_score(score)).groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(t).alias("pos"), F.count_if(~t).alias("neg"))


def _grid(i, steps: int) -> Column:
    return _c(i).cast("double") * F.lit(1.0 / steps)


def _step(s: Column, steps: int) -> Column:
    """Grid cell of the largest threshold not above the score, corrected by one where floating-point rounding puts it
    next door; -1 below the grid."""
    i = F.least(F.greatest(F.floor(s * steps), F.lit(-1)), F.lit(steps)).cast("int")
    return F.when((i < steps) & (_grid(i + 1, steps) <= s), i + 1).when((i >= 0) & (_grid(i, steps) > s), i - 1).otherwise(i)


def sweep(df: DataFrame, by: list[str], steps: int = SWEEP_STEPS, score: str = "y_score",
          y: str = "y_true") -> DataFrame:
    """Metrics at steps+1 equally spaced thresholds in [0, 1]: counts per grid cell, summed from the top."""
    t = F.col(y) == 1
    cells = df.where(has_score(score)).groupBy(*by, _step(F.col(score), steps).alias("step")).agg(
        F.count_if(t).alias("pos"), F.count_if(~t).alias("neg"))
    return _swept(cells, by, steps)


def sweep_cells(cells: DataFrame, by: list[str], steps: int = SWEEP_STEPS) -> DataFrame:
    """`sweep` of score cells."""
    return _swept(cells.groupBy(*by, _step(F.col("score"), steps).alias("step")).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), by, steps)


def _swept(cells: DataFrame, by: list[str], steps: int) -> DataFrame:
    tot = cells.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    grid = tot.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    w = Window.partitionBy(*by).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    g = grid.join(cells, [*by, "step"], "left").fillna(0, ["pos", "neg"])
    g = g.withColumns({"tp": F.sum("pos").over(w), "fp": F.sum("neg").over(w)})
    g = g.withColumns({"fn": F.col("n_pos") - F.col("tp"), "tn": F.col("n_neg") - F.col("fp")})
    return rates(g.select(*by, "step", _grid("step", steps).alias("threshold"), "tp", "fp", "fn", "tn"))


def best_f1(swept: DataFrame, by: list[str]) -> DataFrame:
    """Row with the highest F1; the lowest threshold wins a tie."""
    cols = ["step", "threshold", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "fpr"]
    best = F.max_by(F.struct(*cols), F.struct(F.col("f1"), -F.col("step")))
    return swept.groupBy(*by).agg(best.alias("_b")).select(*by, *[f"_b.{c}" for c in cols if c != "step"])


def roc_points(cells: DataFrame, by: list[str], cuts: list[float] | None = None) -> DataFrame:
    """Cells with tp and fp counts at `score` as inclusive threshold; `cuts` from the raw scores save a shuffle."""
    r = running_totals(cells, by, "score", ["pos", "neg"], cuts=cuts, descending=True)
    return r.withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp"})


def class_totals(cells: DataFrame, by: list[str]) -> DataFrame:
    return cells.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
                                  F.max("score").alias("max_score"))


def fixed_fpr(df: DataFrame, by: list[str], budgets: list[float] = BUDGETS, mode: str = "lowest",
              score: str = "y_score", y: str = "y_true") -> DataFrame:
    """Threshold whose false-positive rate stays within each budget.

    `lowest` keeps the most recall; `highest` is the first hit when scanning from the top score. When even the top
    score exceeds the budget the threshold is placed just above it and noted. Groups without negatives give no row.
    """
    cells = score_cells(df, by, score, y)
    return fixed_fpr_cells(curve(cells, by, depth_cuts(df, score)), by, budgets, mode)


def curve(cells: DataFrame, by: list[str], cuts: list[float] | None = None) -> DataFrame:
    """Score cells with tp and fp at their score and the totals of their group."""
    return roc_points(cells, by, cuts).join(class_totals(cells, by), by)


def fixed_fpr_cells(points: DataFrame, by: list[str], budgets: list[float] = BUDGETS, mode: str = "lowest") -> DataFrame:
    """`fixed_fpr` of a curve: one aggregate that picks a cell per budget."""
    if mode not in ("lowest", "highest"):
        raise ValueError(f"unknown mode: {mode}")
    key = -F.col("score") if mode == "lowest" else F.col("score")
    share = F.col("fp") / F.col("n_neg")
    picks = [F.max_by(F.struct("score", "tp", "fp"), F.when(share <= float(b), key)).alias(f"_p{i}")
             for i, b in enumerate(budgets)]
    g = points.where("n_neg > 0").groupBy(*by, "n_pos", "n_neg", "max_score").agg(*picks)
    g = g.select(*by, "n_pos", "n_neg", "max_score", F.explode(F.array(*[
        F.struct(F.lit(float(b)).alias("target_fpr"), F.col(f"_p{i}").alias("p")) for i, b in enumerate(budgets)])).alias("_e"))
    found = F.col("_e.p").isNotNull()
    g = g.select(*by, "_e.target_fpr",
                 F.when(found, F.col("_e.p.score")).otherwise(F.col("max_score") + 1e-9).alias("threshold"),
                 F.coalesce("_e.p.tp", F.lit(0)).alias("tp"), F.coalesce("_e.p.fp", F.lit(0)).alias("fp"),
                 "n_pos", "n_neg", F.when(~found, "budget not reachable; threshold set above the top score").alias("note"))
    g = g.withColumns({"fn": F.col("n_pos") - F.col("tp"), "tn": F.col("n_neg") - F.col("fp")}).drop("n_pos", "n_neg")
    return rates(g)


def analyze(df: DataFrame, by: list[str], budgets: list[float] = BUDGETS, mode: str = "lowest",
            score: str = "y_score", y: str = "y_true") -> DataFrame:
    """Default, best-F1 and fixed-FPR operating points of every group in one table.

    The scores are read once, into score cells; every operating point comes from these.
    """
    cells = cut_lineage(score_cells(df, by, score, y))
    cols = [*by, "threshold_type", "threshold", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "fpr"]
    at = F.col("score") >= DEFAULT_THRESHOLD
    d = rates(cells.groupBy(*by).agg(*[_count(c, on).alias(n) for n, c, on in (
        ("tp", "pos", at), ("fp", "neg", at), ("fn", "pos", ~at), ("tn", "neg", ~at))]))
    d = d.withColumns({"threshold": F.lit(DEFAULT_THRESHOLD), "threshold_type": F.lit("default")})
    b = best_f1(sweep_cells(cells, by), by).withColumn("threshold_type", F.lit("best_f1"))
    f = fixed_fpr_cells(curve(cells, by), by, budgets, mode).withColumn(
        "threshold_type", F.concat(F.lit("fixed_fpr_"), F.col("target_fpr").cast("string")))
    return d.select(*cols).unionByName(b.select(*cols)).unionByName(f.select(*cols))


def _count(c: str, on: Column) -> Column:
    return F.coalesce(F.sum(F.when(on, F.col(c))), F.lit(0).cast("bigint"))


def at_points(df: DataFrame, points: DataFrame, by: list[str], score: str = "y_score", y: str = "y_true") -> DataFrame:
    """Metrics of df at thresholds found elsewhere: one row per row of `points` (by, threshold_type, threshold).

    Scores are counted per distinct value before they meet the few points of their group.
    """
    cells = score_cells(df, by, score, y).join(points.select(*by, "threshold_type", "threshold"), by)
    hit = F.col("score") >= F.col("threshold")
    c = cells.groupBy(*by, "threshold_type", "threshold").agg(
        _count("pos", hit).alias("tp"), _count("neg", hit).alias("fp"), _count("pos", ~hit).alias("fn"),
        _count("neg", ~hit).alias("tn"))
    return rates(c).select(*by, "threshold_type", "threshold", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "fpr")


def ranking_metrics(df: DataFrame, by: list[str], score: str = "y_score", y: str = "y_true") -> DataFrame:
    """roc_auc (Mann-Whitney with half credit for ties) and pr_auc (average precision); NULL unless both classes occur."""
    g = roc_points(score_cells(df, by, score, y), by, depth_cuts(df, score)).groupBy(*by).agg(*area_sums())
    return g.select(*by, "n_pos", "n_neg", *areas())


def area_sums() -> list[Column]:
    """Aggregates over a curve from which `areas` reads both areas."""
    # Pairs won by each positive: negatives strictly below, i.e. all negatives minus those at or above.
    return [F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
            F.sum(F.col("pos").cast("double") * (F.col("fp") - F.col("neg") / 2)).alias("_lost"),
            F.sum(F.col("pos") * safe_divide("tp", F.col("tp") + F.col("fp"))).alias("_ap")]


def areas() -> list[Column]:
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return [F.when(both, 1 - F.try_divide(F.col("_lost"), F.col("n_pos").cast("double") * F.col("n_neg"))).alias("roc_auc"),
            F.when(both, F.try_divide(F.col("_ap"), F.col("n_pos"))).alias("pr_auc")]


def recall_at_fpr(df: DataFrame, by: list[str], budget: float = 0.01, **kw) -> DataFrame:
    return fixed_fpr(df, by, [budget], **kw).select(*by, F.col("recall").alias("recall_at_fpr"), "threshold")


def group_breakdown(df: DataFrame, by: list[str], group: str, threshold: float = DEFAULT_THRESHOLD,
                    score: str = "y_score", y: str = "y_true") -> DataFrame:
    """n_flows, n_attacks, recall and precision per target group; the benign group stays in."""
    c = confusion(df.where(has_score(score)), [*by, group], predicted(score, F.lit(threshold)), y)
    return c.select(*by, group, (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n_flows"),
                    (F.col("tp") + F.col("fn")).alias("n_attacks"),
                    safe_divide("tp", F.col("tp") + F.col("fn")).alias("recall"),
                    safe_divide("tp", F.col("tp") + F.col("fp")).alias("precision"))

