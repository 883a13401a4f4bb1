"""Registered queries: features and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirefold.functions.columns import capture_day, contains_any, not_benign_bit
from wirefold.operators import features as ft
from wirefold.operators import splits as sp
from wirefold.plans.fixtures import table
from wirefold.registry import oracle as o
from wirefold.registry.flow_queries import flows_of
from wirefold.registry.label_queries import labelled, with_labels
from wirefold.schemas import FEATURES, META_COLS
from wirefold.session import cut_lineage
from wirefold.sources import tables as tb

REAL = [c for c in FEATURES if c not in ("packet_count_total", "bytes_total", "packet_count_fwd", "packet_count_bwd",
                                         "bytes_fwd", "bytes_bwd", "protocol", "is_tcp", "is_udp")]


def rounded(df, cols=REAL, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols if c in df.columns})


def flow_features(spark, sf):
    lab = labelled(spark, sf).withColumn("flow_id", F.col("start_us"))
    return rounded(ft.extract_features(lab).withColumns({c: F.round(c, 6) for c in ("start_time", "end_time")}))


def feature_repair(spark, sf):
    """NaN, infinity and NULL planted in two feature columns are counted before the repair."""
    return ft.repair_counts(_damaged(spark, sf))


def repaired_totals(spark, sf):
    f = ft.repair(_damaged(spark, sf))
    return f.agg(F.count("*").alias("n"), F.round(F.sum("duration_s"), 3).alias("sum_duration"),
                 F.round(F.sum("bytes_per_packet"), 3).alias("sum_bytes_per_packet"))


def _damaged(spark, sf):
    f = ft.extract_features(flows_of(spark, sf).withColumn("flow_id", F.col("start_us")))
    return f.withColumns({
        "duration_s": F.when(F.col("flow_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("duration_s")),
        "bytes_per_packet": F.when(F.col("flow_id") % 11 == 0, F.lit(float("inf")))
        .when(F.col("flow_id") % 13 == 0, F.lit(None).cast("double")).otherwise(F.col("bytes_per_packet"))})


def missing_strategies(spark, sf):
    d = _damaged(spark, sf).select("flow_id", "duration_s", "bytes_per_packet")
    d = d.withColumn("bytes_per_packet", F.when(F.col("bytes_per_packet") == float("inf"), None)
                     .otherwise(F.col("bytes_per_packet")))
    cols, out = ["duration_s", "bytes_per_packet"], None
    for s in ("zero", "median", "drop"):
        part = ft.fill_missing(d, cols, s).agg(
            F.lit(s).alias("strategy"), F.count("*").alias("n"), F.round(F.sum("duration_s"), 3).alias("sum_duration"),
            F.round(F.sum("bytes_per_packet"), 3).alias("sum_bytes_per_packet"))
        out = part if out is None else out.unionByName(part)
    return out


def clean_filter(spark, sf):
    return ft.clean_counts(labelled(spark, sf))


def label_encode(spark, sf):
    c = ft.with_label_bit(ft.clean_labelled(labelled(spark, sf))).withColumn("y_seq", not_benign_bit())
    return c.groupBy("original_label", "y", "y_seq").agg(F.count("*").alias("n"))


def capture_days(spark, sf):
    return table(spark, sf, "packets").groupBy(capture_day().alias("day")).agg(F.count("*").alias("n"))


def test_mask(spark, sf):
    return (table(spark, sf, "packets").groupBy(contains_any("pcap_file", ["FRIDAY", "thurs"]).alias("is_test"))
            .agg(F.count("*").alias("n")))


def _split(spark, sf):
    return sp.with_day_split(labelled(spark, sf))


def _clean_split(spark, sf):
    return ft.clean_labelled(_split(spark, sf))


def day_stats(spark, sf):
    return sp.day_stats(_clean_split(spark, sf))


def split_rollup(spark, sf):
    return sp.split_rollup(_clean_split(spark, sf))


def split_day_totals(spark, sf):
    return sp.split_day_totals(_clean_split(spark, sf))


def attack_types_by_day(spark, sf):
    return sp.attack_types(_clean_split(spark, sf))


def class_balance(spark, sf):
    return ft.class_balance(ft.with_label_bit(_clean_split(spark, sf)), ["split"])


def document_quality_balance(spark, sf):
    lab = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return ft.class_balance(lab.where("quality is not null"), ["source"], "quality")


def feature_audit(spark, sf):
    lab = labelled(spark, sf).withColumn("flow_id", F.col("start_us"))
    return ft.audit(ft.extract_features(lab))


def feature_audit_tables(spark, sf):
    """Three feature tables: one whole, one with a column moved, one without a column."""
    f = ft.extract_features(labelled(spark, sf).withColumn("flow_id", F.col("start_us")))
    moved = f.select(*[c for c in f.columns if c != "bytes_fwd"], "bytes_fwd")
    a = ft.audit_tables({"whole": f, "moved": moved, "shorter": f.drop("is_udp")})
    return a.select("pcap_file", "table_name", "schema_agrees", "n_rows", "total_columns", "feature_columns")


def all_missing_log(spark, sf):
    """Rows in which every one of the two damaged features is missing."""
    d = _damaged(spark, sf).select("flow_id", "duration_s", "bytes_per_packet")
    return ft.all_missing_rows(d, ["duration_s", "bytes_per_packet"]).select("flow_id")


def split_leakage(spark, sf):
    """Units found in two splits: none by file; by source address, since hosts recur over days."""
    s = _split(spark, sf)
    return (sp.split_leaks(s, "pcap_file").withColumnRenamed("pcap_file", "unit")
            .unionByName(sp.split_leaks(s, "src_ip").withColumnRenamed("src_ip", "unit")))


def split_health(spark, sf):
    return sp.split_health(_split(spark, sf), table(spark, sf, "label_ref"))


def family_disjoint(spark, sf):
    return sp.family_disjoint(_split(spark, sf))


def unseen_families(spark, sf):
    return sp.unseen_families(_split(spark, sf).where("not (split = 'train' and coarse_family = 'brute_force')"))


def file_order_split(spark, sf):
    s = sp.file_order_split(flows_of(spark, sf), 2, 1)
    return s.groupBy("pcap_file", "file_index", "split").agg(F.count("*").alias("n"))


def scenario_split(spark, sf):
    """Source host as scenario, by a plan of three hosts; the fourth is in no plan."""
    f = flows_of(spark, sf).withColumn("scenario", F.col("src_ip"))
    plan = tb.scenario_plan(spark, [("10.0.0.0", "test", "dos_ddos", "attack"), ("10.0.0.1", "val", "web_attack", "attack"),
                                    ("10.0.0.2", "train", "brute_force", "attack")])
    return sp.scenario_split(f, plan).groupBy("scenario", "split", "family").agg(F.count("*").alias("n"))


def split_sidecar(spark, sf):
    f = sp.with_day_split(flows_of(spark, sf, number=True))
    return sp.sidecar(f)


def _master(spark, sf):
    """The numbered flow table, stored once as the read-only master that side tables refer to."""
    return cut_lineage(sp.with_day_split(flows_of(spark, sf, number=True)))


def sidecar_join(spark, sf):
    f = _master(spark, sf)
    return (sp.join_sidecar(f.drop("day", "split"), sp.sidecar(f), check=False)
            .groupBy("day", "split").agg(F.count("*").alias("n"), F.sum("bytes_total").alias("bytes")))


def sidecar_mismatch(spark, sf):
    f = _master(spark, sf)
    side = sp.sidecar(f)
    damaged = (side.where("global_flow_id % 10 <> 0")
               .unionByName(side.where("global_flow_id % 25 = 1"))
               .unionByName(side.where("global_flow_id % 100 = 3").withColumn("global_flow_id", -F.col("global_flow_id"))))
    return sp.sidecar_mismatch(f, damaged)


def endpoint_recovery(spark, sf):
    f = _master(spark, sf)
    feats = ft.extract_features(f)
    return (sp.recover_endpoints(feats, f).groupBy("pcap_file", "src_ip", "dst_port")
            .agg(F.count("*").alias("n"), F.sum("bytes_total").alias("bytes")))


QUERIES = {f.__name__: f for f in (
    flow_features, feature_repair, repaired_totals, missing_strategies, clean_filter, label_encode, capture_days,
    test_mask, day_stats, split_rollup, split_day_totals, attack_types_by_day, class_balance,
    document_quality_balance, feature_audit, feature_audit_tables,
    all_missing_log, split_leakage, split_health, family_disjoint, unseen_families,
    file_order_split, scenario_split, split_sidecar, sidecar_join, sidecar_mismatch, endpoint_recovery)}


def _div(a, b):
    return f"case when coalesce({b}, 0) = 0 or {a} is null then 0.0::double else {a}::double / {b}::double end"


_EXPR = {
    "duration_s": "duration_us / 1e6", "is_tcp": "cast(protocol = 6 as int)", "is_udp": "cast(protocol = 17 as int)",
    "bytes_per_packet": _div("bytes_total", "packet_count_total"),
    "bytes_per_packet_fwd": _div("bytes_fwd", "packet_count_fwd"),
    "bytes_per_packet_bwd": _div("bytes_bwd", "packet_count_bwd"),
    "packets_per_second": _div("packet_count_total", "(duration_us / 1e6)"),
    "bytes_per_second": _div("bytes_total", "(duration_us / 1e6)"),
    "fwd_packet_ratio": _div("packet_count_fwd", "packet_count_total"),
    "bwd_packet_ratio": _div("packet_count_bwd", "packet_count_total"),
    "fwd_byte_ratio": _div("bytes_fwd", "bytes_total"), "bwd_byte_ratio": _div("bytes_bwd", "bytes_total"),
}
FEATURE_SQL = ", ".join((f"round({_EXPR[c]}, 6)" if c in REAL else _EXPR.get(c, c)) + f" as {c}" for c in FEATURES)
_DAY = """case when lower(pcap_file) like '%monday%' then 'Monday' when lower(pcap_file) like '%tuesday%' then 'Tuesday'
  when lower(pcap_file) like '%wednesday%' then 'Wednesday' when lower(pcap_file) like '%thursday%' then 'Thursday'
  when lower(pcap_file) like '%friday%' then 'Friday' else 'Unknown' end"""
_ROLE = """case day when 'Monday' then 'train' when 'Tuesday' then 'train' when 'Wednesday' then 'train'
  when 'Thursday' then 'val' when 'Friday' then 'test' else 'unassigned' end"""


def _split_cte(src: str, name: str = "s") -> str:
    return f"{name} as (select *, {_ROLE} as split from (select *, {_DAY} as day from {src}))"


SPLIT = _split_cte("labelled")
CLEAN = "clean as (select * from s where matched_flag and not ambiguous_flag and binary_label in ('benign', 'attack'))"
NUMBERED = """nf as (select *, row_number() over (partition by pcap_file order by start_us, src_ip, src_port, dst_ip,
  dst_port, protocol) as flow_id, row_number() over (order by start_us, pcap_file, src_ip, src_port, dst_ip, dst_port,
  protocol) as global_flow_id from flows)"""
DAMAGED = f"""base as (select start_us as flow_id, {', '.join(f'{_EXPR.get(c, c)} as {c}' for c in FEATURES)} from flows),
d as (select * replace (case when flow_id % 7 = 0 then 'nan'::double else duration_s end as duration_s,
  case when flow_id % 11 = 0 then 'inf'::double when flow_id % 13 = 0 then null else bytes_per_packet end as bytes_per_packet)
  from base)"""
_BA = "count(*) filter (binary_label = 'benign') as benign, count(*) filter (binary_label = 'attack') as attack"
_META = [c for c in META_COLS if c not in ("flow_id", "start_time", "end_time")]

ORACLE = {
    "flow_features": with_labels(f"select start_us as flow_id, {', '.join(_META)}, "
                                 "round(start_us / 1e6, 6) as start_time, round(end_us / 1e6, 6) as end_time, "
                                 f"{FEATURE_SQL} from labelled"),
    "feature_repair": o.flows("""select count(*) as n_rows, count(*) filter (isnan(duration_s))
        + count(*) filter (bytes_per_packet is null) as nan_filled,
        count(*) filter (isinf(bytes_per_packet)) as inf_replaced from d""", DAMAGED),
    "repaired_totals": o.flows("""select count(*) as n,
        round(sum(case when isnan(duration_s) then 0 else duration_s end), 3) as sum_duration,
        round(sum(case when bytes_per_packet is null or isinf(bytes_per_packet) then 0 else bytes_per_packet end), 3)
        as sum_bytes_per_packet from d""", DAMAGED),
    "missing_strategies": o.flows("""select strategy, count(*) as n, round(sum(a), 3) as sum_duration,
        round(sum(b), 3) as sum_bytes_per_packet from (
          select 'zero' as strategy, coalesce(a, 0) as a, coalesce(b, 0) as b from c
          union all select 'median', coalesce(a, (select quantile_cont(a, 0.5) from c)),
            coalesce(b, (select quantile_cont(b, 0.5) from c)) from c
          union all select 'drop', a, b from c where a is not null and b is not null) group by 1""", DAMAGED,
                                  """c as (select case when not isnan(duration_s) then duration_s end as a,
          case when not isinf(bytes_per_packet) then bytes_per_packet end as b from d)"""),
    "clean_filter": with_labels("""select count(*) as total_raw_rows, count(*) filter (ok) as total_clean_rows,
        count(*) filter (not ok) as dropped from (select matched_flag and not ambiguous_flag
        and coalesce(binary_label in ('benign', 'attack'), false) as ok from labelled)"""),
    "label_encode": with_labels("""select original_label, cast(binary_label = 'attack' as int) as y,
        cast(original_label <> 'BENIGN' as int) as y_seq, count(*) as n from clean group by 1, 2, 3""", SPLIT, CLEAN),
    "capture_days": o.sql(["packets"], f"select {_DAY} as day, count(*) as n from packets group by 1"),
    "test_mask": o.sql(["packets"], """select lower(pcap_file) like '%friday%' or lower(pcap_file) like '%thurs%'
        as is_test, count(*) as n from packets group by 1"""),
    "day_stats": with_labels(f"""select day, split, count(*) as total, {_BA},
        round(100.0::double * count(*) filter (binary_label = 'attack') / count(*), 4) as attack_pct
        from clean group by 1, 2""", SPLIT, CLEAN),
    "split_rollup": with_labels(f"""select split, string_agg(distinct day, ',' order by day) as days,
        count(*) as total, {_BA}, case split when 'train' then 1 when 'val' then 2 when 'test' then 3 else 4 end
        as split_order from clean group by split""", SPLIT, CLEAN),
    "split_day_totals": with_labels("""select split, day, count(*) as total,
        count(*) filter (binary_label = 'attack') as attack from clean group by rollup (split, day)""", SPLIT, CLEAN),
    "attack_types_by_day": with_labels("""select day, original_label, count(*) as n from clean
        where binary_label = 'attack' group by 1, 2""", SPLIT, CLEAN),
    "class_balance": with_labels(f"""select split, p as n_pos, q as n_neg, {_div('q', 'p')} as pos_weight,
        {_div('n', '(2 * p)')} as weight_pos, {_div('n', '(2 * q)')} as weight_neg from (select split, count(*) as n,
        count(*) filter (binary_label = 'attack') as p, count(*) filter (binary_label = 'benign') as q
        from clean group by 1)""", SPLIT, CLEAN),
    "document_quality_balance": f"""select source, p as n_pos, q as n_neg, {_div('q', 'p')} as pos_weight,
        {_div('n', '(2 * p)')} as weight_pos, {_div('n', '(2 * q)')} as weight_neg from (select source, count(*) as n,
        count(*) filter (quality = 1) as p, count(*) filter (quality = 0) as q from labels join documents using (doc_id)
        where quality is not null group by 1)""",
    "feature_audit": with_labels("""select pcap_file, count(*) as n_rows, 28 as total_columns, 19 as feature_columns,
        0::bigint as nan_count, 0::bigint as inf_count, count(*) filter (binary_label = 'benign') as benign,
        count(*) filter (binary_label = 'attack') as attack, count(*) filter (binary_label is null) as no_label,
        count(*) filter (matched_flag) as matched, count(*) filter (ambiguous_flag) as ambiguous, 0 as missing_meta
        from labelled group by 1""").replace("28 as total", "29 as total"),
    "split_leakage": with_labels("""select pcap_file as unit from s group by 1 having count(distinct split) > 1
        union all select src_ip from s group by 1 having count(distinct split) > 1""", SPLIT),
    "split_health": with_labels("""select split, pcap_file, n_flows, n_matched,
        round(100.0::double * n_matched / n_flows, 4) as join_rate,
        round(case when l1 = l0 or l1 is null then 0.0::double
          else 100.0::double * greatest(least(f1, l1) - greatest(f0, l0), 0) / (l1 - l0) end, 4) as time_cover,
        nb > 0 and na > 0 as both_classes
        from (select split, pcap_file, count(*) as n_flows, count(*) filter (matched_flag) as n_matched,
          count(*) filter (binary_label = 'benign') as nb, count(*) filter (binary_label = 'attack') as na,
          min(start_us) as f0, max(end_us) as f1 from s group by 1, 2)
        left join (select pcap_file, min(ts_us) as l0, max(ts_us) as l1 from label_ref group by 1) using (pcap_file)""",
                                SPLIT),
    "family_disjoint": with_labels("""select coarse_family as family, bool_or(split = 'train') as in_train,
        bool_or(split = 'test') as in_test, bool_or(split = 'train') and bool_or(split = 'test') as shared
        from s where coarse_family is not null group by 1""", SPLIT),
    "unseen_families": with_labels("""select distinct coarse_family from s where split = 'test'
        and coarse_family is not null and coarse_family not in (select coarse_family from s where split = 'train'
        and coarse_family is not null and coarse_family <> 'brute_force')""", SPLIT),
    "file_order_split": o.flows("""select pcap_file, file_index, case when file_index <= 2 then 'train'
        when file_index <= 3 then 'val' else 'test' end as split, n from (select pcap_file, count(*) as n,
        row_number() over (order by min(start_us), pcap_file) as file_index from flows group by 1)"""),
    "scenario_split": o.flows("""select src_ip as scenario, case src_ip when '10.0.0.0' then 'test'
        when '10.0.0.1' then 'val' when '10.0.0.2' then 'train' else 'unassigned' end as split, case src_ip
        when '10.0.0.0' then 'dos_ddos' when '10.0.0.1' then 'web_attack' when '10.0.0.2' then 'brute_force' end as family,
        count(*) as n from flows group by 1, 2, 3"""),
    "all_missing_log": o.flows("select flow_id from d where isnan(duration_s) and bytes_per_packet is null", DAMAGED),
    "feature_audit_tables": with_labels("""select pcap_file, table_name, schema_agrees, count(*) as n_rows,
        case table_name when 'shorter' then 28 else 29 end as total_columns,
        case table_name when 'shorter' then 18 else 19 end as feature_columns
        from labelled, (values ('whole', true), ('moved', false), ('shorter', false)) t(table_name, schema_agrees)
        group by 1, 2, 3"""),
    "split_sidecar": o.flows("select global_flow_id, day, split from s", NUMBERED, _split_cte("nf")),
    "sidecar_join": o.flows("""select day, split, count(*) as n, cast(sum(bytes_total) as bigint) as bytes from s
        group by 1, 2""", _split_cte("flows")),
    "sidecar_mismatch": o.flows("""select count(*) filter (s = 0) as missing, count(*) filter (m = 0) as orphan,
        count(*) filter (s > 1 or m > 1) as repeated from (select id, sum(m) as m, sum(s) as s from (
          select global_flow_id as id, 1 as m, 0 as s from nf
          union all select global_flow_id, 0, 1 from nf where global_flow_id % 10 <> 0
          union all select global_flow_id, 0, 1 from nf where global_flow_id % 25 = 1
          union all select -global_flow_id, 0, 1 from nf where global_flow_id % 100 = 3) group by 1)""", NUMBERED),
    "endpoint_recovery": o.flows("""select pcap_file, src_ip, dst_port, count(*) as n,
        cast(sum(bytes_total) as bigint) as bytes from flows group by 1, 2, 3"""),
}
