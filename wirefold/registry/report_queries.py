"""Registered queries: bootstrap, significance, stability and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirefold.functions import rules
from wirefold.operators import bootstrap as bs
from wirefold.operators import redraw as rd
from wirefold.operators import reports as rp
from wirefold.operators import thresholds as th
from wirefold.plans.fixtures import table
from wirefold.registry import oracle as o
from wirefold.registry.threshold_queries import BY, conf, rates_sql, rnd, scores
from wirefold.session import cut_lineage

REPS = 1000


METHODS = ("lr", "rf", "xgb")


def bootstrap_hashed(spark, sf):
    """Replicates drawn by row hash: every weight can be recomputed in SQL. A row's weights serve all methods."""
    cells = {(m, n): c for m in METHODS for n, c in bs.confusion_cells(th.predicted(f"s_{m}", F.lit(0.5))).items()}
    wide = bs.hashed_counts(table(spark, sf, "scores"), [], "event_id", {f"{m}_{n}": c for (m, n), c in cells.items()}, REPS)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), *[F.col(f"{m}_{n}").alias(n) for k, n in cells if k == m])
                               for m in METHODS])).alias("_m")
    reps = th.rates(wide.select("replicate", each).select("replicate", "_m.*"))
    # Cuts, cells and sizes of the percentiles all read the replicates, and a replicate reads every row.
    return rnd(bs.interval(cut_lineage(reps), ["method"], "f1"), ["f1_lo", "f1_hi"])


def paired_bootstrap_hashed(spark, sf):
    """Paired delta by the row hash of `bootstrap_hashed`: both methods get the same rows in a replicate."""
    w = table(spark, sf, "scores")
    a, b = th.predicted("s_lr", F.lit(0.5)), th.predicted("s_rf", F.lit(0.5))
    reps = cut_lineage(bs.f1_delta(bs.hashed_counts(w, ["domain"], "event_id", bs.joint_cells(a, b), REPS)))
    point = bs.f1_delta(bs.joint_counts(w, ["domain"], a, b))
    return rnd(bs.summarise_delta(point, reps, ["domain"]), ["point_delta", "delta_lo", "delta_hi", "p_value_raw"])


def bootstrap_ci(spark, sf):
    """1000 multinomial redraws of the confusion counts of every domain and method."""
    return rnd(bs.bootstrap_f1(scores(spark, sf), BY), ["f1_pe", "f1_lo", "f1_hi"], 4)


def bootstrap_area_ci(spark, sf):
    reps = bs.bootstrap_areas(scores(spark, sf), ["method"])
    return rnd(bs.interval(reps, ["method"], "roc_auc").join(bs.interval(reps, ["method"], "pr_auc"), ["method"]),
               ["roc_auc_lo", "roc_auc_hi", "pr_auc_lo", "pr_auc_hi"], 4)


def paired_bootstrap(spark, sf):
    w = table(spark, sf, "scores")
    r = bs.paired_bootstrap(w, ["domain"], th.predicted("s_lr", F.lit(0.5)), th.predicted("s_rf", F.lit(0.5)))
    return rnd(r, ["point_delta", "delta_lo", "delta_hi", "p_value_raw"], 4)


def holm(spark, sf):
    """One test per (file, method): share of rows above 0.5 as raw p, families by method."""
    t = scores(spark, sf).groupBy("method", "file_no", "domain").agg(
        (F.count_if(F.col("y_score") >= 0.8) / F.count("*") / 10).alias("p_value_raw"))
    return rnd(bs.holm(t, "method", order=["file_no", "domain"]), ["p_value_raw", "p_value_adj"])


def seed_stability(spark, sf):
    s = scores(spark, sf).withColumn("seed", (F.col("event_id") % 3 + 42).cast("int"))
    per = th.metrics_at(s, [*BY, "seed"]).join(th.ranking_metrics(s, [*BY, "seed"]).drop("n_pos", "n_neg"), [*BY, "seed"])
    cols = [f"{a}_{m}" for m in ("f1", "roc_auc") for a in ("mean", "std", "min", "max")]
    return rnd(bs.seed_stability(per, BY, ["f1", "roc_auc"]), cols)


def _results(spark, sf):
    """Transfer results: the score domain is the target; methods' sources follow from the file number."""
    s = scores(spark, sf).withColumns({"source": F.when(F.col("file_no") < 2, "a").when(F.col("file_no") < 4, "b")
                                       .otherwise("c"), "target": F.col("domain")})
    k = ["source", "target", "method"]
    return th.metrics_at(s, k).join(th.ranking_metrics(s, k).drop("n_pos", "n_neg"), k)


def transfer_matrix(spark, sf):
    return rnd(rp.best_f1_matrix(_results(spark, sf), ["a", "b", "c"]), ["a", "b", "c"])


def auc_matrix(spark, sf):
    return rnd(rp.auc_matrix(_results(spark, sf), ["a", "b", "c"]), ["a", "b", "c"])


def family_method_recall(spark, sf):
    b = th.group_breakdown(scores(spark, sf), ["method"], "family")
    return rnd(rp.recall_matrix(b, ["lr", "rf", "xgb"]), ["lr", "rf", "xgb"])


def method_ranking(spark, sf):
    return rnd(rp.method_ranking(_results(spark, sf)), ["mean_f1"])


def best_method(spark, sf):
    return rnd(rp.best_method(_results(spark, sf), ["source", "target"]).select("source", "target", "method", "f1"))


def transfer_degradation(spark, sf):
    d = rp.degradation(_results(spark, sf))
    return rnd(d.select("source", "target", "method", "f1", "in_domain_f1", "delta_f1"), ["f1", "in_domain_f1", "delta_f1"])


def _tiered(spark, sf):
    s = scores(spark, sf).withColumns({"source": F.when(F.col("file_no") < 2, "a").when(F.col("file_no") < 4, "b")
                                       .otherwise("c"), "target": F.col("domain")})
    k, out = ["source", "target", "method"], None
    for tier, t in (("default", 0.5), ("val_tuned", 0.35), ("fixed_fpr", 0.995)):
        part = th.metrics_at(s, k, t).withColumn("tier", F.lit(tier))
        out = part if out is None else out.unionByName(part)
    return out


def threshold_portability(spark, sf):
    t = _tiered(spark, sf)
    c = t.withColumns({"setting": F.when(F.col("source") == F.col("target"), "in_domain").otherwise("cross_domain"),
                       "classification": rules.threshold_class("threshold", "recall", "f1")})
    return rnd(rp.portability_counts(c), ["share"])


def multisource_gain(spark, sf):
    single = _tiered(spark, sf)
    s = scores(spark, sf).withColumns({"source": F.when(F.col("file_no") < 2, "a").when(F.col("file_no") < 4, "b")
                                       .otherwise("c"), "target": F.col("domain")}).where("source <> target")
    out = None
    for tier, t in (("default", 0.5), ("val_tuned", 0.35), ("fixed_fpr", 0.995)):
        part = th.metrics_at(s, ["target", "method"], t).withColumn("tier", F.lit(tier))
        out = part if out is None else out.unionByName(part)
    sources = F.filter(F.array(F.lit("a"), F.lit("b"), F.lit("c")), lambda x: x != F.col("target"))
    multi = out.withColumn("sources", sources).withColumn("combo", F.array_join("sources", "+"))
    g = rp.multisource_gain(multi, single)
    return rnd(g.select("combo", "target", "method", "tier", "f1", "best_single", "delta_f1", "delta_recall",
                        "delta_fpr", "improvement"), ["f1", "delta_f1", "delta_recall", "delta_fpr"])


def source_share(spark, sf):
    s = table(spark, sf, "scores").where("file_no < 3").withColumnRenamed("domain", "source")
    return rnd(rp.source_share(s), ["share"])


def ci_lookup(spark, sf):
    r = _results(spark, sf).withColumn("context", F.concat(F.upper("source"), F.lit(" → "), F.upper("target")))
    i = _results(spark, sf).where("source <> 'c'").select(
        F.concat("source", F.lit("_to_"), "target").alias("context"), "method", (F.col("f1") - 0.01).alias("f1_lo"),
        (F.col("f1") + 0.01).alias("f1_hi"))
    return rnd(rp.ci_lookup(r, i).select("context", "method", "f1", "f1_lo", "f1_hi"), ["f1", "f1_lo", "f1_hi"])


QUERIES = {f.__name__: f for f in (
    bootstrap_hashed, paired_bootstrap_hashed, bootstrap_ci, bootstrap_area_ci, paired_bootstrap, holm, seed_stability,
    transfer_matrix, auc_matrix, family_method_recall, method_ranking, best_method, transfer_degradation,
    threshold_portability, multisource_gain, source_share, ci_lookup)}

_LS, _SC = ["long_scores"], ["scores"]
_CDF = " ".join(f"when u < {v!r}::double then {k}" for k, v in enumerate(rd.POISSON_CDF))


def _weights(src: str, keep: str) -> str:
    """A weight `w` for every row of `src` in every replicate, as `wt`."""
    return f"""wt as (select {keep}, replicate, case {_CDF} else {len(rd.POISSON_CDF)} end as w from (select {keep}, replicate,
      ('0x' || substr(md5(replicate || ':' || event_id), 1, 8))::bigint / 4294967296.0::double as u
      from {src}, (select range as replicate from range(0, {REPS}))))"""


def _horner(coefficients, x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r}))"
    return out


def draws_sql(src: str, keep: str) -> str:
    """Weights `w` of the rows (group_no, cell_no, n) of `src` for every replicate, as `wt`: the arithmetic of `redraw`."""
    steps = str(rd.POLYNOMIAL[0])
    for c in rd.POLYNOMIAL[1:]:
        steps = f"(({steps} * z + {c}) % {rd.PRIME})"
    tail = "sqrt(-2 * ln(least(u, 1 - u)))"
    outer = f"{_horner(rd.QUANTILE_C, 't')} / {_horner((*rd.QUANTILE_D, 1.0), 't')}"
    inner = f"{_horner(rd.QUANTILE_A, 'q')} * (u - 0.5) / {_horner((*rd.QUANTILE_B, 1.0), 'q')}"
    return f"""pois as (select n, 0 as k, exp(-n::double) as p, exp(-n::double) as c from (select range::bigint as n from range(1, {rd.EXACT_N + 1}))
  union all select n, k + 1, p * n / (k + 1), c + p * n / (k + 1) from pois where k < floor(n + 7 * sqrt(n::double) + 12)),
tables as (select n, list(c order by k) as cs from pois group by n),
zs as (select {keep}, n, replicate, (group_no + (cell_no::bigint % {rd.PRIME}) * {rd.CELL_STEP}::bigint + replicate * {rd.REPLICATE_STEP}) % {rd.PRIME} as z
  from {src}, (select range as replicate from range(0, {REPS})) where n > 0),
us as (select {keep}, n, replicate, ({steps} + 0.5::double) / {rd.PRIME}::double as u from zs),
qs as (select *, {tail} as t, (u - 0.5) * (u - 0.5) as q from us),
ns as (select {keep}, n, replicate, u, case when n > {rd.EXACT_N} then case when u < {rd.TAIL} then {outer}
  when u > {1 - rd.TAIL!r} then -({outer}) else {inner} end end as x from qs),
wt as (select {keep}, replicate, case when ns.n <= {rd.EXACT_N} then len(list_filter(cs, lambda c: c <= u))::double
  else greatest(floor(ns.n + sqrt(ns.n::double) * x + (x * x - 1) / 6 + 0.5), 0) end as w from ns left join tables on tables.n = ns.n)"""


def _group_no(key: str) -> str:
    return f"('0x' || substr(md5({key}), 1, 7))::bigint"


_RES = f"""src as (select *, case when file_no < 2 then 'a' when file_no < 4 then 'b' else 'c' end as source, domain as target
  from long_scores),
cl as (select source, target, method, y_score as score, count(*) filter (y_true = 1) as pos, count(*) filter (y_true = 0) as neg
  from src group by all),
au as (select source, target, method, sum(pos::double * (n_neg - fp + neg / 2.0::double)) / any_value(n_pos::double * n_neg) as roc_auc
  from (select *, sum(neg) over (partition by source, target, method order by score desc) as fp,
    sum(pos) over (partition by source, target, method) as n_pos, sum(neg) over (partition by source, target, method) as n_neg
    from cl) group by all),
res as (select *, {rates_sql(15)} from (select source, target, method, {conf('y_score >= 0.5')} from src group by all)
  join au using (source, target, method))"""
_TIERS = f"""tr as (select *, {rates_sql(15)} from (select source, target, method, tier, threshold, {conf('y_score >= threshold')}
  from src, (values ('default', 0.5::double), ('val_tuned', 0.35), ('fixed_fpr', 0.995)) v(tier, threshold) group by all))"""
_PIV = ", ".join(f"round(max({{c}}) filter (target = '{t}'), 6) as {t}" for t in "abc")

ORACLE = {
    "bootstrap_hashed": o.sql(_LS, """select method, round(quantile_cont(f1, 0.025), 6) as f1_lo,
        round(quantile_cont(f1, 0.975), 6) as f1_hi from (select method, replicate,
          coalesce(2.0::double * sum(w) filter (p and y_true = 1) / nullif(2 * sum(case when p and y_true = 1 then w else 0 end)
            + sum(case when p and y_true = 0 or not p and y_true = 1 then w else 0 end), 0), 0) as f1 from wt group by 1, 2) group by 1""",
                              "ls as (select *, y_score >= 0.5 as p from long_scores)",
                              _weights("ls", "method, p, y_true")),
    "paired_bootstrap_hashed": o.sql(_SC, """select domain, round(pd, 6) as point_delta, round(lo, 6) as delta_lo,
        round(hi, 6) as delta_hi, round(least(2 * least(below, above), 1), 6) as p_value_raw, lo > 0 or hi < 0 as significant,
        pd >= lo and pd <= hi as delta_in_interval from (select domain, quantile_cont(d, 0.025) as lo,
          quantile_cont(d, 0.975) as hi, avg((d <= 0)::int) as below, avg((d >= 0)::int) as above from rp group by 1)
        join (select domain, 2.0::double * count(*) filter (a and y_true = 1) / (count(*) filter (a) + count(*) filter (y_true = 1))
          - 2.0::double * count(*) filter (b and y_true = 1) / (count(*) filter (b) + count(*) filter (y_true = 1)) as pd
          from ws group by 1) using (domain)""", "ws as (select *, s_lr >= 0.5 as a, s_rf >= 0.5 as b from scores)",
                                     _weights("(select * from ws where a is not null and b is not null)", "domain, a, b, y_true"),
                                     """rp as (select domain, replicate,
          coalesce(2.0::double * sum(w) filter (a and y_true = 1) / (sum(case when a then w else 0 end) + sum(case when y_true = 1 then w else 0 end)), 0)
          - coalesce(2.0::double * sum(w) filter (b and y_true = 1) / (sum(case when b then w else 0 end) + sum(case when y_true = 1 then w else 0 end)), 0) as d
          from wt group by 1, 2)"""),
    "bootstrap_area_ci": o.sql(_LS, """select method, round(quantile_cont(roc, 0.025), 4) as roc_auc_lo,
        round(quantile_cont(roc, 0.975), 4) as roc_auc_hi, round(quantile_cont(pr, 0.025), 4) as pr_auc_lo,
        round(quantile_cont(pr, 0.975), 4) as pr_auc_hi from (
          select method, replicate, 1 - sum(wp * (fp - wn / 2)) / (sum(wp) * sum(wn)) as roc,
            sum(wp * tp / nullif(tp + fp, 0)) / sum(wp) as pr from (
            select *, sum(wp) over v as tp, sum(wn) over v as fp from (
              select method, replicate, cell, coalesce(sum(w) filter (cls = 0), 0) as wp,
                coalesce(sum(w) filter (cls = 1), 0) as wn from wt group by 1, 2, 3)
            window v as (partition by method, replicate order by cell)) group by 1, 2) group by 1""",
                               """cl as (select method, y_score, count(*) filter (y_true = 1) as pos, count(*) filter (y_true = 0) as neg
          from long_scores group by 1, 2)""", """cs as (select *, cast(sum(pos + neg) over (partition by method
          order by y_score desc) as bigint) as cell from cl)""", f"""src as (select method, cell, 0 as cls, 2 * cell as cell_no, pos as n,
          {_group_no('method')} as group_no from cs union all select method, cell, 1, 2 * cell + 1, neg, {_group_no('method')} from cs)""",
                               draws_sql("src", "method, cell, cls")),
    "holm": o.sql(_LS, """select method, file_no, domain, round(p, 6) as p_value_raw,
        round(least(max(p * (m - r + 1)) over (partition by method order by r), 1), 6) as p_value_adj from (select *,
          count(*) over (partition by method) as m, row_number() over (partition by method order by p, file_no, domain) as r
          from (select method, file_no, domain, count(*) filter (y_score >= 0.8)::double / count(*) / 10 as p
          from long_scores group by all))"""),
    "seed_stability": o.sql(_LS, f"""select domain, method, count(*) as n_seeds, """ + ", ".join(
        f"round({f}({m}), 6) as {n}_{m}" for m in ("f1", "roc_auc")
        for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))) + f""",
        case when stddev_samp(f1) > 0.1 then 'not_citable' when stddev_samp(f1) > 0.02 then 'moderate' else 'stable' end as stability
        from (select *, {rates_sql(15)} from (select domain, method, seed, {conf('y_score >= 0.5')} from sd group by all)
        join (select domain, method, seed, sum(pos::double * (n_neg - fp + neg / 2.0::double)) / any_value(n_pos::double * n_neg) as roc_auc
          from (select *, sum(neg) over (partition by domain, method, seed order by score desc) as fp,
            sum(pos) over (partition by domain, method, seed) as n_pos, sum(neg) over (partition by domain, method, seed) as n_neg
            from cl) group by all) using (domain, method, seed)) group by 1, 2""",
                            "sd as (select *, event_id % 3 + 42 as seed from long_scores)",
                            """cl as (select domain, method, seed, y_score as score, count(*) filter (y_true = 1) as pos,
        count(*) filter (y_true = 0) as neg from sd group by all)"""),
    "transfer_matrix": o.sql(_LS, "select source, " + _PIV.format(c="f1") + " from res group by 1", _RES),
    "auc_matrix": o.sql(_LS, "select method, source, " + _PIV.format(c="roc_auc") + " from res group by 1, 2", _RES),
    "family_method_recall": o.sql(_LS, "select family, " + ", ".join(
        f"round(max(recall) filter (method = '{m}'), 6) as {m}" for m in ("lr", "rf", "xgb")) + f"""
        from (select *, {rates_sql(15)} from (select method, family, {conf('y_score >= 0.5')} from long_scores group by all))
        group by 1"""),
    "method_ranking": o.sql(_LS, """select method, round(m, 6) as mean_f1, n as n_directions,
        row_number() over (order by m desc, method) as method_rank from (select method, avg(f1) as m, count(*) as n
        from res where source <> target group by 1)""", _RES),
    "best_method": o.sql(_LS, """select source, target, method, round(f1, 6) as f1 from res
        qualify row_number() over (partition by source, target order by f1 desc, method) = 1""", _RES),
    "transfer_degradation": o.sql(_LS, """select x.source, x.target, x.method, round(x.f1, 6) as f1,
        round(i.f1, 6) as in_domain_f1, round(x.f1 - i.f1, 6) as delta_f1 from res x join res i on i.source = x.source
        and i.method = x.method and i.target = i.source where x.source <> x.target""", _RES),
    "threshold_portability": o.sql(_LS, """select setting, tier, classification, n,
        round(n::double / sum(n) over (partition by setting, tier, g), 6) as share from (select setting, tier, classification,
          count(*) as n, grouping(setting, tier) as g from (select tier,
          case when source = target then 'in_domain' else 'cross_domain' end as setting,
          case when threshold >= 0.99 and recall < 0.02 then 'degenerate_threshold' when f1 < 0.002 then 'observed_true_zero'
            else 'observed_nonzero' end as classification from tr)
          group by cube (setting, tier), classification)""", _RES, _TIERS),
    "multisource_gain": o.sql(_LS, f"""select combo, target, method, tier, round(f1, 6) as f1, best_single,
        round(f1 - bf, 6) as delta_f1, round(recall - br, 6) as delta_recall, round(fpr - bp, 6) as delta_fpr,
        case when tier = 'fixed_fpr' and threshold >= 0.99 then 'blocked_or_not_applicable'
          when f1 - bf >= 0.03 then 'clear_multisource_gain' when f1 - bf <= -0.03 then 'worse_than_best_single'
          else 'no_material_change' end as improvement
        from (select *, case target when 'a' then 'b+c' when 'b' then 'a+c' else 'a+b' end as combo, {rates_sql(15)}
          from (select target, method, tier, threshold, {conf('y_score >= threshold')} from src,
          (values ('default', 0.5::double), ('val_tuned', 0.35), ('fixed_fpr', 0.995)) v(tier, threshold)
          where source <> target group by all))
        join (select target, method, tier, source as best_single, f1 as bf, recall as br, fpr as bp from tr
          where source <> target qualify row_number() over (partition by target, method, tier order by f1 desc, source desc) = 1)
        using (target, method, tier)""", _RES, _TIERS),
    "source_share": o.sql(_SC, """select domain as source, count(*) as n,
        round(count(*)::double / sum(count(*)) over (), 6) as share from scores where file_no < 3 group by 1"""),
    "ci_lookup": o.sql(_LS, """select upper(source) || ' → ' || upper(target) as context, method, round(f1, 6) as f1,
        case when source <> 'c' then round(f1 - 0.01, 6) end as f1_lo, case when source <> 'c' then round(f1 + 0.01, 6) end as f1_hi
        from res""", _RES),
}
