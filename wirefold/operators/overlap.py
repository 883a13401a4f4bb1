"""Agreement of two detectors on the same rows, and simple fusions of their verdicts."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirefold.functions import rules
from wirefold.operators.thresholds import rates


def align_predictions(long: DataFrame, row_id: list[str], methods: list[str], method: str = "method",
                      score: str = "y_score") -> DataFrame:
    """Long predictions to one row per `row_id` with a score column per method; rows lacking a method are dropped."""
    g = long.groupBy(*row_id).agg(*[F.max(F.when(F.col(method) == m, F.col(score))).alias(f"s_{m}") for m in methods])
    ok = F.lit(True)
    for m in methods:
        ok = ok & F.col(f"s_{m}").isNotNull()
    return g.where(ok)


def stack_methods(wide: DataFrame, keep: list[str], methods: list[str]) -> DataFrame:
    """Wide scores to long: (keep, method, y_score)."""
    e = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"s_{m}").alias("y_score")) for m in methods]))
    return wide.select(*keep, e.alias("_e")).select(*keep, "_e.method", "_e.y_score")


def _div(a, b):
    return F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))


def joint_cells(wide: DataFrame, by: list[str], methods: list[str], threshold: float, y: str) -> DataFrame:
    """Rows per combination of verdicts: `by`, `_y`, a verdict `p_<method>` each, the verdict `p_mean` of the mean score,
    and `n`. Everything about agreement and fusion reads these few cells, the rows are read once."""
    mean = sum((F.col(f"s_{m}") for m in methods[1:]), F.col(f"s_{methods[0]}")) / len(methods)
    return wide.groupBy(*by, F.col(y).alias("_y"), *[(F.col(f"s_{m}") >= threshold).alias(f"p_{m}") for m in methods],
                        (mean >= threshold).alias("p_mean")).agg(F.count("*").alias("n"))


def pair_overlap(wide: DataFrame, by: list[str], methods: list[str], threshold: float = 0.5,
                 y: str = "y_true") -> DataFrame:
    """Shared and exclusive true and false positives of every method pair, from joint cells."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(a).alias("method_a"), F.lit(b).alias("method_b"), F.col(f"p_{a}").alias("pa"),
                 F.col(f"p_{b}").alias("pb")) for a, b in combinations(methods, 2)]))
    x = joint_cells(wide, by, methods, threshold, y).select(*by, "_y", "n", pairs.alias("_p")).select(*by, "_y", "n", "_p.*")
    pos, a, b = F.col("_y") == 1, F.col("pa"), F.col("pb")

    def rows(on):
        return F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0).cast("bigint"))

    g = x.groupBy(*by, "method_a", "method_b").agg(
        rows(pos).alias("n_attacks"), rows(~pos).alias("n_benign"),
        rows(pos & a).alias("tp_a"), rows(pos & b).alias("tp_b"), rows(pos & a & b).alias("tp_shared"),
        rows(pos & a & ~b).alias("tp_a_only"), rows(pos & ~a & b).alias("tp_b_only"),
        rows(~pos & a).alias("fp_a"), rows(~pos & b).alias("fp_b"),
        rows(~pos & a & b).alias("fp_shared"), rows(~pos & a & ~b).alias("fp_a_only"),
        rows(~pos & ~a & b).alias("fp_b_only"))
    for k in ("tp", "fp"):
        g = g.withColumn("_u", F.col(f"{k}_shared") + F.col(f"{k}_a_only") + F.col(f"{k}_b_only")).withColumns({
            f"{k}_jaccard": _div(f"{k}_shared", "_u"), f"{k}_overlap_ratio_a": _div(f"{k}_shared", f"{k}_a"),
            f"{k}_overlap_ratio_b": _div(f"{k}_shared", f"{k}_b")}).drop("_u")
    return g.withColumn("degenerate_note", F.when((F.col("tp_a") == 0) | (F.col("tp_b") == 0),
                                                  "a method has no true positive"))


def mean_jaccard(pairs: DataFrame, regime: str) -> DataFrame:
    return pairs.groupBy(regime).agg(F.count("*").alias("n_pairs"), F.avg("tp_jaccard").alias("mean_tp_jaccard"))


def fusion(wide: DataFrame, by: list[str], methods: list[str], threshold: float = 0.5, y: str = "y_true") -> DataFrame:
    """OR and AND of every pair and of all, majority vote and score average, against the best single method (by F1).

    Rules are applied to joint cells, so what is multiplied by the number of rules does not grow with the rows.
    """
    p = {m: F.col(f"p_{m}").cast("int") for m in methods}
    rule: dict[str, object] = {f"single({m})": p[m] for m in methods}
    groups = [*combinations(methods, 2), *([tuple(methods)] if len(methods) > 2 else [])]
    for g in groups:
        name = "+".join(g)
        rule[f"or({name})"] = F.greatest(*[p[m] for m in g])
        rule[f"and({name})"] = F.least(*[p[m] for m in g])
    if len(methods) > 2:
        name = "+".join(methods)
        votes = sum((p[m] for m in methods[1:]), p[methods[0]])
        rule[f"majority_vote({name})"] = (votes * 2 > len(methods)).cast("int")
        rule[f"score_average({name})"] = F.col("p_mean").cast("int")
    e = F.explode(F.array(*[F.struct(F.lit(k).alias("fusion"), v.alias("pred")) for k, v in rule.items()]))
    x = joint_cells(wide, by, methods, threshold, y).select(*by, "_y", "n", e.alias("_e")).select(
        *by, "_y", "n", "_e.fusion", (F.col("_e.pred") == 1).alias("_p"))
    hit, attack = F.col("_p"), F.col("_y") == 1

    def rows(on):
        return F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0).cast("bigint"))

    m = rates(x.groupBy(*by, "fusion").agg(rows(hit & attack).alias("tp"), rows(hit & ~attack).alias("fp"),
                                           rows(~hit & attack).alias("fn"), rows(~hit & ~attack).alias("tn")))
    single = F.col("fusion").startswith("single(")
    best = F.max_by(F.struct("fusion", "f1", "recall", "fpr"), F.when(single, F.struct("f1", "fusion")))
    j = m.withColumn("_b", best.over(Window.partitionBy(*by))).where(~single)  # a row per rule in each group
    d = {c: F.col(c) - F.col(f"_b.{c}") for c in ("f1", "recall", "fpr")}
    return j.withColumns({"best_single": F.col("_b.fusion"), "delta_f1": d["f1"], "delta_recall": d["recall"],
                          "delta_fpr": d["fpr"],
                          "gain_type": rules.fusion_gain(d["f1"], d["recall"], d["fpr"])}).drop("_b")
