"""Registered queries: thresholds, metrics and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirefold.functions import rules
from wirefold.functions.columns import report_round
from wirefold.operators import thresholds as th
from wirefold.plans.fixtures import table
from wirefold.registry import oracle as o

BY = ["domain", "method"]
RATES = ["precision", "recall", "f1", "fpr"]


def scores(spark, sf):
    return table(spark, sf, "long_scores")


def rnd(df, cols=RATES, digits=6):
    return df.withColumns({c: report_round(c, digits) for c in cols if c in df.columns})


def confusion(spark, sf):
    return rnd(th.metrics_at(scores(spark, sf), BY))


def label_tiers(spark, sf):
    s = th.label_tiers(scores(spark, sf), 0.5, 0.35, 0.8, "y_score")
    return s.groupBy(*BY).agg(*[F.sum(f"pred_label_{t}").alias(t) for t in ("default", "val_tuned", "fixed_fpr")])


def extended_metrics(spark, sf):
    c = th.confusion(scores(spark, sf), BY, th.predicted("y_score", F.lit(0.5)))
    return rnd(th.extended_rates(c), [*RATES, "accuracy", "fnr", "balanced_accuracy", "mcc"])


def sweep(spark, sf):
    return rnd(th.sweep(scores(spark, sf), BY), [*RATES, "threshold"])


def best_f1(spark, sf):
    return rnd(th.best_f1(th.sweep(scores(spark, sf), BY), BY), [*RATES, "threshold"])


def fixed_fpr_lowest(spark, sf):
    return rnd(th.fixed_fpr(scores(spark, sf), BY, [*th.BUDGETS, 0.05], "lowest"), [*RATES, "threshold"], 9)


def fixed_fpr_highest(spark, sf):
    return rnd(th.fixed_fpr(scores(spark, sf), BY, th.BUDGETS, "highest"), [*RATES, "threshold"], 9)


def model_thresholds(spark, sf):
    return rnd(th.analyze(scores(spark, sf), ["method"]), [*RATES, "threshold"])


def roc_pr_auc(spark, sf):
    return rnd(th.ranking_metrics(scores(spark, sf), BY), ["roc_auc", "pr_auc"])


def recall_at_fpr(spark, sf):
    return rnd(th.recall_at_fpr(scores(spark, sf), BY, 0.05), ["recall_at_fpr", "threshold"], 9)


def family_recall(spark, sf):
    return rnd(th.group_breakdown(scores(spark, sf), BY, "family"))


def threshold_class(spark, sf):
    """Classes of default, very high and fixed-FPR thresholds per domain and method."""
    s = scores(spark, sf)
    rows = None
    for t in (0.5, 0.95, 0.99):
        r = th.metrics_at(s, BY, t)
        rows = r if rows is None else rows.unionByName(r)
    cls = rules.threshold_class("threshold", "recall", "f1")
    return rnd(rows.select(*BY, "threshold", "f1", "recall", cls.alias("classification"),
                           rules.eligible("threshold").alias("eligible"),
                           rules.threshold_class_text(cls).alias("interpretation"),
                           rules.false_alarm_note("threshold").alias("note")))


def _gappy(spark, sf):
    """Scores of which every 7th is missing and every 11th is no number."""
    gap = F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double")).when(F.col("event_id") % 11 == 0, float("nan"))
    return scores(spark, sf).withColumn("y_score", gap.otherwise(F.col("y_score")))


def unscored_rows(spark, sf):
    """Rows without a score are counted apart and take part in no metric, whichever way it is computed."""
    s = _gappy(spark, sf)
    at = th.metrics_at(s, BY).select(*BY, "tp", "fp", "fn", "tn")
    swept = th.sweep(s, BY).where("step = 100").select(*BY, *[F.col(c).alias(f"sweep_{c}") for c in ("tp", "fp", "fn", "tn")])
    areas = th.ranking_metrics(s, BY).select(*BY, "n_pos", "n_neg")
    return th.unscored_counts(s, BY).join(at, BY).join(swept, BY).join(areas, BY)


def running_confusion(spark, sf):
    cells = th.score_cells(scores(spark, sf), BY)
    return th.roc_points(cells, BY).select(*BY, F.round("score", 9).alias("score"), "tp", "fp")


QUERIES = {f.__name__: f for f in (
    confusion, label_tiers, extended_metrics, sweep, best_f1, fixed_fpr_lowest, fixed_fpr_highest, model_thresholds,
    roc_pr_auc, recall_at_fpr, family_recall, threshold_class, unscored_rows,
    running_confusion)}


def rates_sql(digits: int = 6) -> str:
    """Rates from tp, fp, fn, tn, 0 when the denominator is empty."""
    def d(a, b):
        return f"round(coalesce({a}::double / nullif({b}, 0), 0), {digits})"
    return (f"{d('tp', '(tp + fp)')} as precision, {d('tp', '(tp + fn)')} as recall, "
            f"{d('2 * tp', '(2 * tp + fp + fn)')} as f1, {d('fp', '(fp + tn)')} as fpr")


CONF = ("count(*) filter ({p} and y_true = 1) as tp, count(*) filter ({p} and y_true = 0) as fp, "
        "count(*) filter (not ({p}) and y_true = 1) as fn, count(*) filter (not ({p}) and y_true = 0) as tn")


def conf(p: str) -> str:
    return CONF.format(p=p)


# Brute force: every distinct score is tried as a threshold by counting rows at or above it.
PTS = """cells as (select domain, method, y_score as score, count(*) filter (y_true = 1) as pos,
  count(*) filter (y_true = 0) as neg from long_scores group by 1, 2, 3),
pts as (select *, cast(sum(pos) over w as bigint) as tp, cast(sum(neg) over w as bigint) as fp,
  cast(sum(pos) over g as bigint) as n_pos, cast(sum(neg) over g as bigint) as n_neg, max(score) over g as max_score
  from cells window w as (partition by domain, method order by score desc),
  g as (partition by domain, method))"""
SWEEP = """grid as (select range as step, range * 0.005::double as threshold from range(0, 201)),
hist as (select domain, method, y_score, count(*) filter (y_true = 1) as pos, count(*) filter (y_true = 0) as neg
  from long_scores group by 1, 2, 3),
sw as (select domain, method, step, threshold, cast(sum(case when y_score >= threshold then pos else 0 end) as bigint) as tp,
  cast(sum(case when y_score >= threshold then neg else 0 end) as bigint) as fp,
  cast(sum(case when y_score < threshold then pos else 0 end) as bigint) as fn,
  cast(sum(case when y_score < threshold then neg else 0 end) as bigint) as tn
  from hist, grid group by 1, 2, 3, 4)"""
SWEEP_M = SWEEP.replace("domain, method", "method").replace("1, 2, 3, 4", "1, 2, 3").replace("group by 1, 2, 3),", "group by 1, 2),")
PTS_M = PTS.replace("domain, method", "method").replace("group by 1, 2, 3", "group by 1, 2")


def _fixed(pts_by: str, budgets: list[float], best: str, digits: int = 9) -> str:
    return f"""select {pts_by}, target_fpr, round(threshold, {digits}) as threshold, tp, fp, fn, tn, note,
      {rates_sql(digits)} from (select {pts_by}, target_fpr,
        coalesce({best}(score) filter (ok), any_value(max_score) + 1e-9) as threshold,
        coalesce({'max' if best == 'min' else 'min'}(tp) filter (ok), 0) as tp,
        coalesce({'max' if best == 'min' else 'min'}(fp) filter (ok), 0) as fp,
        any_value(n_pos) - coalesce({'max' if best == 'min' else 'min'}(tp) filter (ok), 0) as fn,
        any_value(n_neg) - coalesce({'max' if best == 'min' else 'min'}(fp) filter (ok), 0) as tn,
        case when count(*) filter (ok) = 0 then 'budget not reachable; threshold set above the top score' end as note
      from (select *, fp::double / n_neg <= target_fpr as ok from pts,
        (select unnest({[float(b) for b in budgets]}::double[]) as target_fpr) where n_neg > 0)
      group by {pts_by}, target_fpr)"""


_LS = ["long_scores"]
_EXT = """round((tp + tn)::double / (tp + fp + fn + tn), 6) as accuracy,
  round(coalesce(fn::double / nullif(tp + fn, 0), 0), 6) as fnr,
  round((coalesce(tp::double / nullif(tp + fn, 0), 0) + coalesce(tn::double / nullif(tn + fp, 0), 0)) / 2, 6) as balanced_accuracy,
  round(coalesce((tp::double * tn - fp::double * fn) / nullif(sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) as mcc"""
_BEST = """select * from (select *, row_number() over (partition by {by} order by f1r desc, step) as rn from (
  select *, coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0) as f1r from sw)) where rn = 1"""

ORACLE = {
    "confusion": o.sql(_LS, f"""select domain, method, tp, fp, fn, tn, {rates_sql()}, 0.5::double as threshold
        from (select domain, method, {conf('y_score >= 0.5')} from long_scores group by 1, 2)"""),
    "label_tiers": o.sql(_LS, """select domain, method, count(*) filter (y_score >= 0.5) as "default",
        count(*) filter (y_score >= 0.35) as val_tuned, count(*) filter (y_score >= 0.8) as fixed_fpr
        from long_scores group by 1, 2"""),
    "extended_metrics": o.sql(_LS, f"""select domain, method, tp, fp, fn, tn, {rates_sql()}, {_EXT}
        from (select domain, method, {conf('y_score >= 0.5')} from long_scores group by 1, 2)"""),
    "sweep": o.sql(_LS, f"""select domain, method, cast(step as int) as step, round(threshold, 6) as threshold, tp, fp,
        fn, tn, {rates_sql()} from sw""", SWEEP),
    "best_f1": o.sql(_LS, f"""select domain, method, round(threshold, 6) as threshold, tp, fp, fn, tn, {rates_sql()}
        from ({_BEST.format(by='domain, method')})""", SWEEP),
    "fixed_fpr_lowest": o.sql(_LS, _fixed("domain, method", [*th.BUDGETS, 0.05], "min"), PTS),
    "fixed_fpr_highest": o.sql(_LS, _fixed("domain, method", th.BUDGETS, "max"), PTS),
    "model_thresholds": o.sql(_LS, f"""select method, 'default' as threshold_type, 0.5::double as threshold, tp, fp, fn,
        tn, {rates_sql()} from (select method, {conf('y_score >= 0.5')} from long_scores group by 1)
        union all by name select method, 'best_f1' as threshold_type, round(threshold, 6) as threshold, tp, fp, fn, tn,
        {rates_sql()} from ({_BEST.format(by='method')})
        union all by name select method, concat('fixed_fpr_', target_fpr) as threshold_type,
        round(threshold, 6) as threshold, tp, fp, fn, tn, round(precision, 6) as precision, round(recall, 6) as recall,
        round(f1, 6) as f1, round(fpr, 6) as fpr from ({_fixed('method', th.BUDGETS, 'min', 12)})""", SWEEP_M, PTS_M),
    "roc_pr_auc": o.sql(_LS, """select domain, method, any_value(n_pos) as n_pos, any_value(n_neg) as n_neg,
        case when any_value(n_pos) > 0 and any_value(n_neg) > 0 then round(sum(pos::double * (n_neg - fp + neg / 2.0::double))
          / (any_value(n_pos)::double * any_value(n_neg)), 6) end as roc_auc,
        case when any_value(n_pos) > 0 and any_value(n_neg) > 0 then round(sum(pos * tp::double / (tp + fp))
          / any_value(n_pos), 6) end as pr_auc from pts group by 1, 2""", PTS),
    "recall_at_fpr": o.sql(_LS, "select domain, method, recall as recall_at_fpr, threshold from ("
                           + _fixed("domain, method", [0.05], "min") + ")", PTS),
    "family_recall": o.sql(_LS, f"""select domain, method, family, tp + fp + fn + tn as n_flows, tp + fn as n_attacks,
        recall, precision from (select domain, method, family, tp, fp, fn, tn, {rates_sql()} from (select domain,
        method, family, {conf('y_score >= 0.5')} from long_scores group by 1, 2, 3))"""),
    "threshold_class": o.sql(_LS, f"""select domain, method, threshold, f1, recall, classification, threshold < 0.99 as eligible,
        case classification when 'degenerate_threshold' then 'threshold lies above nearly all scores'
          when 'observed_true_zero' then 'threshold is usable but finds no attacks'
          else 'threshold carries over with some detection' end as interpretation,
        case when threshold >= 0.99 then 'degenerate threshold: every flow is called benign' end as note
        from (select *, case when threshold >= 0.99 and recall < 0.02 then 'degenerate_threshold'
          when f1 < 0.002 then 'observed_true_zero' else 'observed_nonzero' end as classification
        from (select domain, method, threshold, {rates_sql()} from (select domain, method, threshold,
        {conf('y_score >= threshold')} from long_scores, (select unnest([0.5, 0.95, 0.99]::double[]) as threshold)
        group by 1, 2, 3)))"""),
    "unscored_rows": o.sql(_LS, f"""select *, tp as sweep_tp, fp as sweep_fp, fn as sweep_fn, tn as sweep_tn, tp + fn as n_pos,
        fp + tn as n_neg from (select domain, method, count(*) as n_rows,
        count(*) filter (gap) as n_unscored, {conf('y_score >= 0.5').replace("filter (", "filter (not gap and ")}
        from (select *, event_id % 7 = 0 or event_id % 11 = 0 as gap from long_scores) group by 1, 2)"""),
    "running_confusion": o.sql(_LS, "select domain, method, round(score, 9) as score, tp, fp from pts", PTS),
}
