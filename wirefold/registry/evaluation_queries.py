"""Registered queries: drift, overlap, fusion, subsets, false alarms."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirefold.operators import alarms as am
from wirefold.operators import drift as dr
from wirefold.operators import overlap as ov
from wirefold.operators import sequences as sq
from wirefold.operators import subsets as ss
from wirefold.functions import columns as cl
from wirefold.plans.fixtures import table
from wirefold.registry import oracle as o
from wirefold.registry.join_queries import FLOW, STEPS, _steps
from wirefold.registry.threshold_queries import BY, conf, rates_sql, rnd, scores

M = ["lr", "rf", "xgb"]


def prediction_alignment(spark, sf):
    long = scores(spark, sf)
    return ov.align_predictions(long, ["event_id", "domain", "y_true"], M)


def overlap(spark, sf):
    j = [f"{k}_{c}" for k in ("tp", "fp") for c in ("jaccard", "overlap_ratio_a", "overlap_ratio_b")]
    return rnd(ov.pair_overlap(table(spark, sf, "scores"), ["domain"], M), j)


def mean_jaccard(spark, sf):
    p = ov.pair_overlap(table(spark, sf, "scores"), ["domain"], M)
    regime = F.when(F.col("domain") == "a", "in_domain").otherwise("cross_domain")
    return rnd(ov.mean_jaccard(p.withColumn("regime", regime), "regime"), ["mean_tp_jaccard"])


def fusion(spark, sf):
    f = ov.fusion(table(spark, sf, "scores"), ["domain"], M)
    return rnd(f, ["precision", "recall", "f1", "fpr", "delta_f1", "delta_recall", "delta_fpr"])


def score_profile(spark, sf):
    p = dr.score_profile(scores(spark, sf), BY)
    return rnd(p, [c for c in p.columns if c not in BY])


def score_drift(spark, sf):
    d = dr.score_drift(dr.score_profile(scores(spark, sf), BY))
    return d.select("method", "source_domain", "target_domain", "threshold_position", "degradation_mode",
                    F.round("source_roc_auc", 6).alias("source_roc_auc"), F.round("target_f1", 6).alias("target_f1"))


def ks_drift(spark, sf):
    """Packet length, TCP against UDP, per capture file."""
    p = table(spark, sf, "packets").where("protocol in (6, 17)")
    return rnd(dr.distances(p, ["pcap_file"], "ip_len", F.col("protocol") == 6), ["ks", "w1"])


def wasserstein(spark, sf):
    li = table(spark, sf, "lineitem")
    long = dr.unpivot(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_linestatus"])
    d = dr.distances(long, ["feature"], "value", F.col("l_linestatus") == "O")
    return rnd(dr.top_drifted(d, [], 4).drop("severity"), ["ks"], 6).withColumn("w1", F.round("w1", 3))


def feature_drift_summary(spark, sf):
    p = table(spark, sf, "scores")
    long = dr.unpivot(p, ["s_lr", "s_rf", "s_xgb", "bytes_total"], ["domain", "y_true"])
    d = dr.distances(long, ["y_true", "feature"], "value", F.col("domain") == "a")
    return rnd(dr.drift_summary(dr.top_drifted(d, ["y_true"], 4), ["y_true"]), ["mean_ks", "max_ks"])


def sequence_channel_drift(spark, sf):
    """Mean per flow and channel over the kept packets, train days against the others."""
    means = sq.channel_means(sq.to_sequences(_steps(spark, sf), [*FLOW, "split"]), FLOW)
    d = dr.distances(means, ["channel"], "value", F.col("split") == "train")
    return rnd(d.select("channel", "n_source", "n_target", "ks"), ["ks"], 5)


def embedding_channel_drift(spark, sf):
    e = table(spark, sf, "embeddings")
    x = e.select("label", F.posexplode("embedding").alias("channel", "value"))
    return rnd(dr.distances(x, ["channel"], "value", F.col("label") < 5), ["ks", "w1"])


def calibration(spark, sf):
    return rnd(dr.calibration(scores(spark, sf), BY), ["ece", "brier"])


def _rated(spark, sf):
    return scores(spark, sf).withColumn("pps", (F.col("event_id") % 977).cast("double") / 7)


def subset_degradation(spark, sf):
    d = ss.subset_degradation(_rated(spark, sf), BY, rate="pps")
    return rnd(d, ["precision", "recall", "f1", "fpr", "roc_auc", "delta_f1_vs_full", "delta_recall_vs_full"])


def _benign(spark, sf):
    p = table(spark, sf, "packets").select("event_id", "ts_us", "dst_port")
    s = scores(spark, sf).where("y_true = 0").join(p, "event_id")
    return s.withColumns({"start_us": F.col("ts_us"), "end_us": F.col("ts_us") + 1_000_000})


def benign_alarm(spark, sf):
    a = am.alarm_metrics(_benign(spark, sf), BY)
    return rnd(a, ["fpr", "capture_duration_hours", "alerts_per_hour", "alerts_per_1000_flows"], 4)


def alarm_patterns(spark, sf):
    return rnd(am.alarm_patterns(_benign(spark, sf), BY), ["share_of_alerts"])


def source_stability(spark, sf):
    return rnd(am.source_stability(am.alarm_metrics(_benign(spark, sf), BY)), ["mean_fpr"])


def service_and_band(spark, sf):
    p = table(spark, sf, "packets")
    return p.groupBy(cl.service_name("dst_port").alias("service"), cl.byte_band("ip_len").alias("band"),
                     cl.proto_id("protocol").alias("proto_id")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    prediction_alignment, overlap, mean_jaccard, fusion, score_profile, score_drift, ks_drift, wasserstein,
    feature_drift_summary, sequence_channel_drift, embedding_channel_drift, calibration, subset_degradation,
    benign_alarm, alarm_patterns, source_stability, service_and_band)}

_LS, _SC = ["long_scores"], ["scores"]
PAIRS = "pr as (" + " union all ".join(
    f"select domain, y_true, '{a}' as method_a, '{b}' as method_b, s_{a} >= 0.5 as a, s_{b} >= 0.5 as b from scores"
    for a, b in (("lr", "rf"), ("lr", "xgb"), ("rf", "xgb"))) + """),
ov as (select domain, method_a, method_b, count(*) filter (y_true = 1) as n_attacks,
  count(*) filter (y_true = 0) as n_benign, """ + ", ".join(
    f"count(*) filter (y_true = {y} and a) as {k}_a, count(*) filter (y_true = {y} and b) as {k}_b, "
    f"count(*) filter (y_true = {y} and a and b) as {k}_shared, "
    f"count(*) filter (y_true = {y} and a and not b) as {k}_a_only, "
    f"count(*) filter (y_true = {y} and b and not a) as {k}_b_only" for k, y in (("tp", 1), ("fp", 0))) \
    + " from pr group by 1, 2, 3)"
_JAC = ", ".join(f"round({k}_shared::double / nullif({k}_shared + {k}_a_only + {k}_b_only, 0), 6) as {k}_jaccard, "
                 f"round({k}_shared::double / nullif({k}_a, 0), 6) as {k}_overlap_ratio_a, "
                 f"round({k}_shared::double / nullif({k}_b, 0), 6) as {k}_overlap_ratio_b" for k in ("tp", "fp"))
_P = {m: f"(s_{m} >= 0.5)" for m in M}
_RULES = {f"single({m})": f"p_{m}" for m in M}
for _g in (("lr", "rf"), ("lr", "xgb"), ("rf", "xgb"), tuple(M)):
    _RULES[f"or({'+'.join(_g)})"] = " or ".join(f"p_{m}" for m in _g)
    _RULES[f"and({'+'.join(_g)})"] = " and ".join(f"p_{m}" for m in _g)
_RULES["majority_vote(lr+rf+xgb)"] = " + ".join(f"p_{m}::int" for m in M) + " >= 2"
_RULES["score_average(lr+rf+xgb)"] = "p_mean"
# The verdicts of all rules are a list per combination of verdicts; each is counted over the few combinations.
FUSE = f"""jc as (select domain, y_true, {', '.join(f'{v} as p_{m}' for m, v in _P.items())},
  (s_lr + s_rf + s_xgb) / 3 >= 0.5 as p_mean, count(*) as n from scores group by all),
fu as (select domain, fusion, coalesce(sum(n) filter (v and y_true = 1), 0)::bigint as tp,
  coalesce(sum(n) filter (v and y_true = 0), 0)::bigint as fp, coalesce(sum(n) filter (not v and y_true = 1), 0)::bigint as fn,
  coalesce(sum(n) filter (not v and y_true = 0), 0)::bigint as tn from (select domain, y_true, n,
    unnest([{', '.join(repr(k) for k in _RULES)}]) as fusion, unnest([{', '.join(f'({v})' for v in _RULES.values())}]) as v from jc)
  group by 1, 2),
fr as (select *, {rates_sql(15)} from fu),
fb as (select domain, fusion as best_single, f1 as bf, recall as br, fpr as bp from (select *, row_number() over (
  partition by domain order by f1 desc, fusion desc) as best from fr where fusion like 'single(%') where best = 1),
fd as (select fr.*, best_single, f1 - bf as d1, recall - br as d2, fpr - bp as d3 from fr join fb using (domain)
  where fusion not like 'single(%')"""
PROFILE = f"""cells as (select domain, method, y_score as score, count(*) filter (y_true = 1) as pos,
  count(*) filter (y_true = 0) as neg from long_scores group by 1, 2, 3),
pts as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over g as n_pos, sum(neg) over g as n_neg
  from cells window w as (partition by domain, method order by score desc), g as (partition by domain, method)),
auc as (select domain, method, sum(pos::double * (n_neg - fp + neg / 2.0::double)) / any_value(n_pos::double * n_neg) as roc_auc,
  sum(pos * tp::double / (tp + fp)) / any_value(n_pos) as pr_auc from pts group by 1, 2),
cal as (select domain, method, sum(abs(s - p)) / sum(n) as ece, sum(q) / sum(n) as brier from (select domain, method,
  least(floor(y_score * 10), 9) as b, count(*) as n, sum(y_score) as s, sum(y_true) as p,
  sum((y_score - y_true) * (y_score - y_true)) as q from long_scores group by 1, 2, 3) group by 1, 2),
prof as (select domain, method, avg(y_score) filter (y_true = 1) as pos_mean, avg(y_score) filter (y_true = 0) as neg_mean,
  coalesce(count(*) filter (y_true = 1 and y_score >= 0.5)::double / nullif(count(*) filter (y_true = 1), 0), 0) as pos_above,
  quantile_cont(y_score, 0.9) filter (y_true = 1) as pos_p90, quantile_cont(y_score, 0.9) filter (y_true = 0) as neg_p90,
  any_value(roc_auc) as roc_auc, any_value(pr_auc) as pr_auc, any_value(ece) as ece, any_value(brier) as brier,
  coalesce(2.0::double * count(*) filter (y_true = 1 and y_score >= 0.5) / nullif(count(*) filter (y_score >= 0.5)
    + count(*) filter (y_true = 1), 0), 0) as f1
  from long_scores join auc using (domain, method) join cal using (domain, method) group by 1, 2)"""
_PC = ["pos_mean", "neg_mean", "pos_above", "pos_p90", "neg_p90", "roc_auc", "pr_auc", "ece", "brier", "f1"]


def dist_sql(by: str, src: str, value: str, flag: str) -> str:
    return f"""dv as (select {by}, {value}::double as v, count(*) filter ({flag}) as a, count(*) filter (not ({flag})) as b
  from {src} group by all),
dist as (select {by}, any_value(na) as n_source, any_value(nb) as n_target, max(d) as ks, sum(d * (nx - v)) as w1,
  case when max(d) < 0.15 then 'low' when max(d) < 0.3 then 'moderate' when max(d) < 0.5 then 'high' else 'severe' end as severity
  from (select *, abs(ca::double / na - cb::double / nb) as d from (select *, sum(a) over w as ca, sum(b) over w as cb,
    cast(sum(a) over g as bigint) as na, cast(sum(b) over g as bigint) as nb, lead(v) over w as nx from dv
    window w as (partition by {by} order by v), g as (partition by {by}))) group by {by})"""


def _unp(src: str, feats: list[str], keep: str) -> str:
    return "un as (" + " union all ".join(f"select {keep}, '{f}' as feature, {f}::double as value from {src}"
                                          for f in feats) + ")"


_SUB = f"""rated as (select *, (event_id % 977)::double / 7 as pps from long_scores),
q as (select domain, method, quantile_cont(bytes_total, 0.75) as qv, quantile_cont(pps, 0.75) as qr from rated
  where y_true = 1 group by 1, 2),
tag as (select r.*, t.subset_type from rated r join q using (domain, method), (select unnest(['full_test', 'tcp_only',
  'udp_only', 'high_vol_atk_q75', 'high_pps_atk_q75']) as subset_type) t
  where case subset_type when 'full_test' then true when 'tcp_only' then protocol = 6 when 'udp_only' then protocol = 17
    when 'high_vol_atk_q75' then y_true = 0 or bytes_total >= qv else y_true = 0 or pps >= qr end),
sc as (select domain, method, subset_type, y_score as score, count(*) filter (y_true = 1) as pos,
  count(*) filter (y_true = 0) as neg from tag group by all),
sa as (select domain, method, subset_type, sum(pos::double * (n_neg - fp + neg / 2.0::double)) / any_value(n_pos::double * n_neg) as auc
  from (select *, sum(neg) over (partition by domain, method, subset_type order by score desc) as fp,
    sum(pos) over (partition by domain, method, subset_type) as n_pos,
    sum(neg) over (partition by domain, method, subset_type) as n_neg from sc) group by all),
sm as (select *, {rates_sql(15)} from (select domain, method, subset_type, {conf('y_score >= 0.5')} from tag group by 1, 2, 3)
  join sa using (domain, method, subset_type)),
sd as (select m.*, m.f1 - f.f1 as df, m.recall - f.recall as dr, f.auc as full_auc from sm m
  join sm f on f.domain = m.domain and f.method = m.method and f.subset_type = 'full_test')"""
_BEN = """ben as (select s.*, p.ts_us, p.dst_port from long_scores s join packets p using (event_id) where y_true = 0)"""
_SERVICE = """case dst_port when 21 then 'ftp' when 22 then 'ssh' when 53 then 'dns' when 80 then 'http' when 443 then 'https'
  when 631 then 'ipp' when 2049 then 'nfs' else 'port' || dst_port end"""


def _band(x: str) -> str:
    return (f"case when {x} < 100 then '<100B' when {x} < 1000 then '100B-1KB' when {x} < 10000 then '1KB-10KB' "
            f"when {x} < 100000 then '10KB-100KB' else '>100KB' end")


_PAT = f"""hit as (select * from ben where y_score >= 0.5),
pc as (select domain, method, 1 as block, case protocol when 6 then 'TCP' else 'UDP' end as v, 0 as bp, count(*) as n from hit group by 1, 2, 4
  union all select domain, method, 2, {_SERVICE} as v, 0, count(*) from hit group by 1, 2, v
  union all select h.domain, h.method, 3, b.v, b.bp, count(*) filter ({_band('h.bytes_total')} = b.v) from hit h,
    (values ('<100B', 0), ('100B-1KB', 1), ('1KB-10KB', 2), ('10KB-100KB', 3), ('>100KB', 4)) b(v, bp) group by 1, 2, 4, 5),
pk as (select *, row_number() over (partition by domain, method, block order by n desc, bp, v) as r from pc
  qualify block <> 2 or r <= 10)"""
_AM = """am as (select domain, method, count(*) as total_flows, count(*) filter (y_score >= 0.5) as alerted_flows,
  (max(ts_us) + 1000000 - min(ts_us)) / 3.6e9 as hours from ben group by 1, 2)"""

ORACLE = {
    "prediction_alignment": o.sql(_SC, "select event_id, domain, y_true, s_lr, s_rf, s_xgb from scores"),
    "overlap": o.sql(_SC, f"""select * exclude (degenerate_note), degenerate_note from (select *, {_JAC},
        case when tp_a = 0 or tp_b = 0 then 'a method has no true positive' end as degenerate_note from ov)""", PAIRS),
    "mean_jaccard": o.sql(_SC, """select case domain when 'a' then 'in_domain' else 'cross_domain' end as regime,
        count(*) as n_pairs, round(avg(tp_shared::double / nullif(tp_shared + tp_a_only + tp_b_only, 0)), 6) as mean_tp_jaccard
        from ov group by 1""", PAIRS),
    "fusion": o.sql(_SC, """select domain, fusion, tp, fp, fn, tn, round(precision, 6) as precision,
        round(recall, 6) as recall, round(f1, 6) as f1, round(fpr, 6) as fpr, best_single, round(d1, 6) as delta_f1,
        round(d2, 6) as delta_recall, round(d3, 6) as delta_fpr,
        case when d1 > 0.01 and d3 <= 0.02 then 'true_tp_complementarity' when d1 > 0.01 then 'tradeoff_not_worth_it'
          when d1 < -0.01 and d3 > 0 then 'mostly_fp_relaxation' when d2 < -0.01 and d3 <= 0 then 'tradeoff_not_worth_it'
          else 'no_material_gain' end as gain_type from fd""", FUSE),
    "score_profile": o.sql(_LS, "select domain, method, " + ", ".join(f"round({c}, 6) as {c}" for c in _PC)
                           + " from prof", PROFILE),
    "score_drift": o.sql(_LS, """select s.method, s.domain as source_domain, t.domain as target_domain,
        case when t.pos_above < 0.05 then 'threshold_above_most_target_positives'
          when t.pos_above < 0.3 then 'threshold_above_majority_target_positives'
          when t.pos_above < 0.6 then 'threshold_in_target_positive_range'
          else 'threshold_below_majority_target_positives' end as threshold_position,
        case when s.roc_auc - t.roc_auc > 0.2 then 'rank_signal_weakened'
          when t.roc_auc >= 0.6 and t.f1 < 0.1 then 'rank_signal_preserved_threshold_failed' else 'mixed' end as degradation_mode,
        round(s.roc_auc, 6) as source_roc_auc, round(t.f1, 6) as target_f1
        from prof s join prof t on s.method = t.method and s.domain <> t.domain""", PROFILE),
    "ks_drift": o.sql(["packets"], """select pcap_file, n_source, n_target, round(ks, 6) as ks, round(w1, 6) as w1,
        severity from dist""", "acc as (select * from packets where protocol in (6, 17))",
                      dist_sql("pcap_file", "acc", "ip_len", "protocol = 6")),
    "wasserstein": o.sql([], """select feature, n_source, n_target, round(ks, 6) as ks, round(w1, 3) as w1,
        row_number() over (order by ks desc, feature) as drift_rank from dist qualify drift_rank <= 4""",
                         _unp("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "l_linestatus"),
                         dist_sql("feature", "un", "value", "l_linestatus = 'O'")),
    "feature_drift_summary": o.sql(_SC, """select y_true, round(avg(ks), 6) as mean_ks, round(max(ks), 6) as max_ks
        from (select *, row_number() over (partition by y_true order by ks desc, feature) as r from dist qualify r <= 4)
        group by 1""", _unp("scores", ["s_lr", "s_rf", "s_xgb", "bytes_total"], "domain, y_true"),
                                   dist_sql("y_true, feature", "un", "value", "domain = 'a'")),
    "sequence_channel_drift": o.assigned("select channel, n_source, n_target, round(ks, 5) as ks from dist", STEPS,
                                         f"""cm as (select {', '.join(FLOW)}, split, avg(signed_len::float::double) as c0,
        avg(direction) as c1, sum(delta_t::float::double) / count(*) as c2, avg(protocol_id) as c3 from steps
        where pos <= {sq.K_MAX} group by all),
        cu as (select split, 0 as channel, c0 as value from cm union all select split, 1, c1 from cm
          union all select split, 2, c2 from cm union all select split, 3, c3 from cm)""",
                                         dist_sql("channel", "cu", "value", "split = 'train'")),
    "embedding_channel_drift": o.sql([], """select channel, n_source, n_target, round(ks, 6) as ks,
        round(w1, 6) as w1, severity from dist""", """emb as (select label, cast(i as int) - 1 as channel, embedding[i] as value
        from (select *, unnest(range(1, len(embedding) + 1)) as i from embeddings))""", dist_sql("channel", "emb", "value", "label < 5")),
    "calibration": o.sql(_LS, "select domain, method, round(ece, 6) as ece, round(brier, 6) as brier from cal", PROFILE),
    "subset_degradation": o.sql(_LS, """select domain, method, subset_type, 0.5::double as threshold,
        tp + fp + fn + tn as n_samples, tp + fn as n_attacks, round(precision, 6) as precision, round(recall, 6) as recall,
        round(f1, 6) as f1, round(fpr, 6) as fpr, round(auc, 6) as roc_auc, round(df, 6) as delta_f1_vs_full,
        round(dr, 6) as delta_recall_vs_full, case when subset_type = 'full_test' then 'baseline'
          when subset_type in ('tcp_only', 'udp_only') then case when dr > 0.02 then 'protocol_dominant_recall_gain'
            when dr < -0.02 then 'protocol_dominant_recall_loss' else 'protocol_neutral' end
          when df < 0 and auc > full_auc then 'rank_signal_preserved_volume_threshold_issue'
          when dr > 0.05 then 'high_volume_easier' when dr < -0.05 then 'high_volume_harder'
          else 'high_volume_neutral' end as interpretation from sd""", _SUB),
    "benign_alarm": o.sql(["long_scores", "packets"], """select domain, method, total_flows, alerted_flows,
        round(hours, 4) as capture_duration_hours, round(alerted_flows::double / total_flows, 4) as fpr,
        round(alerted_flows / hours, 4) as alerts_per_hour,
        round(1000.0::double * alerted_flows / total_flows, 4) as alerts_per_1000_flows, true as eligible,
        null::varchar as notes from am""", _BEN, _AM),
    "alarm_patterns": o.sql(["long_scores", "packets"], """select domain, method,
        row_number() over (partition by domain, method order by block, r) as pattern_rank,
        case block when 1 then 'protocol' when 2 then 'dst_port' else 'bytes_band' end as pattern_type,
        case block when 1 then v else 'any' end as protocol, case block when 1 then 'any' else v end as dst_port_or_service,
        n as count, round(n::double / sum(case when block = 3 then n end) over (partition by domain, method), 6) as share_of_alerts
        from pk""", _BEN, _PAT),
    "source_stability": o.sql(["long_scores", "packets"], """select domain, round(avg(f), 6) as mean_fpr,
        first(method order by f, method) as best_method, first(method order by f desc, method desc) as worst_method,
        count(*) as n_methods from (select *, alerted_flows::double / total_flows as f from am) group by 1""", _BEN, _AM),
    "service_and_band": o.sql(["packets"], f"""select {_SERVICE} as service, {_band('ip_len')} as band,
        case protocol when 6 then 0 when 17 then 1 end as proto_id, count(*) as n from packets group by 1, 2, 3"""),
}
