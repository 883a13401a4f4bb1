"""Registered queries: label lookup, label join and its reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirefold.operators import labeling as lb
from wirefold.plans.fixtures import table
from wirefold.registry import oracle as o
from wirefold.registry.flow_queries import IDENT, flows_of

KEYS = ["k_lo_ip", "k_lo_port", "k_hi_ip", "k_hi_port", "k_protocol"]
TIME_TOL_US = 5_000_000_000


def flows_with_gaps(spark, sf):
    """Flows in which every start divisible by 101 lost its source port, so that `no_key` occurs."""
    return flows_of(spark, sf).withColumn("src_port", F.when(F.col("start_us") % 101 != 0, F.col("src_port")))


def labelled(spark, sf, **kw):
    return lb.align_labels(flows_with_gaps(spark, sf), table(spark, sf, "label_ref"),
                           table(spark, sf, "label_mapping"), "demo", **kw)


LABEL_COLS = [*IDENT, "matched_flag", "ambiguous_flag", "label_match_method", "original_label", "binary_label",
              "coarse_family", "exclusion_reason"]


def label_lookup(spark, sf):
    return lb.label_lookup(table(spark, sf, "label_ref"))


def label_lookup_raw_conflict(spark, sf):
    return lb.label_lookup(table(spark, sf, "label_ref"), compat_raw_conflict=True)


def ambiguous_label_sets(spark, sf):
    return lb.label_sets(table(spark, sf, "label_ref")).withColumn("labels", F.array_join("labels", "|"))


def label_align(spark, sf):
    return labelled(spark, sf).select(*LABEL_COLS)


def label_align_raw_conflict(spark, sf):
    return labelled(spark, sf, compat_raw_conflict=True, apply_keep=False).select(*LABEL_COLS)


def mapping_order(spark, sf):
    """Every label mapped twice, by rows whose order says that the second entry counts; the table itself is reversed."""
    m = table(spark, sf, "label_mapping")
    first = m.withColumns({"binary_label": F.lit("benign"), "keep_or_exclude": F.lit("keep"), "row_order": F.lit(1)})
    both = first.unionByName(m.withColumn("row_order", F.lit(2))).orderBy(F.desc("row_order"))
    lab = lb.align_labels(flows_with_gaps(spark, sf), table(spark, sf, "label_ref"), both, "demo")
    return lab.groupBy("label_match_method", "original_label", "binary_label", "exclusion_reason").agg(F.count("*").alias("n"))


def accounting(spark, sf):
    return lb.accounting(labelled(spark, sf))


def align_report(spark, sf):
    return lb.alignment_report(labelled(spark, sf))


def exclusion_log(spark, sf):
    return lb.exclusion_log(labelled(spark, sf))


def ambiguous_log(spark, sf):
    return lb.ambiguous_log(labelled(spark, sf)).drop("original_label")


def run_summary(spark, sf):
    s = lb.run_summary(labelled(spark, sf))
    pick = {c: F.get_json_object("summary_json", f"$.{c}").cast("bigint").alias(c) for c in ("total", *lb.OUTCOMES)}
    return s.select("pcap_file", *pick.values(), F.get_json_object("summary_json", "$.match_rate").cast("double")
                    .alias("match_rate"), F.get_json_object("summary_json", "$.labels.BENIGN").cast("bigint")
                    .alias("benign_label_rows"))


def label_top_values(spark, sf):
    return lb.top_values(table(spark, sf, "label_ref"), "label")


def document_top_sources(spark, sf):
    return lb.top_values(table(spark, sf, "documents"), "source")


def label_mapping_check(spark, sf):
    return lb.mapping_check(table(spark, sf, "label_ref"), table(spark, sf, "label_mapping"), "demo")


def label_mapping_report(spark, sf):
    return lb.mapping_report(table(spark, sf, "label_ref"), table(spark, sf, "label_mapping"), "demo")


def unmapped_labels(spark, sf):
    return lb.unmapped_labels(table(spark, sf, "label_ref"), table(spark, sf, "label_mapping"), "demo")


def join_check(spark, sf):
    return lb.join_check(flows_with_gaps(spark, sf), table(spark, sf, "label_ref"))


def shared_keys(spark, sf):
    return lb.shared_keys(flows_with_gaps(spark, sf), table(spark, sf, "label_ref"))


def sample_label_times(spark, sf):
    return lb.sample_times(table(spark, sf, "label_ref"))


def label_file_summary(spark, sf):
    return lb.label_summary(table(spark, sf, "label_ref"))


def time_label_join(spark, sf):
    j = lb.time_label_join(flows_with_gaps(spark, sf), table(spark, sf, "label_ref"), TIME_TOL_US)
    return j.select(*IDENT, "label_match_method", "original_label", "n_candidates")


QUERIES = {f.__name__: f for f in (
    label_lookup, label_lookup_raw_conflict, ambiguous_label_sets, label_align, label_align_raw_conflict, mapping_order,
    accounting,
    align_report, exclusion_log, ambiguous_log, run_summary, label_top_values, document_top_sources,
    label_mapping_check, label_mapping_report, unmapped_labels, join_check, shared_keys, sample_label_times,
    label_file_summary, time_label_join)}

NORM = "regexp_replace(trim({x}), '[\u0096–—−]', '-', 'g')"


def _norm(x):
    return NORM.format(x=x)


LABEL_KEYED = """label_keyed as (
  select *, case when (source_ip, source_port) <= (destination_ip, destination_port) then source_ip else destination_ip end as k_lo_ip,
    case when (source_ip, source_port) <= (destination_ip, destination_port) then source_port else destination_port end as k_lo_port,
    case when (source_ip, source_port) <= (destination_ip, destination_port) then destination_ip else source_ip end as k_hi_ip,
    case when (source_ip, source_port) <= (destination_ip, destination_port) then destination_port else source_port end as k_hi_port,
    protocol as k_protocol, """ + _norm("label") + """ as norm from label_ref where label is not null)"""


def _lookup(cmp: str, out: str) -> str:
    return f"""lookup as (select k_lo_ip, k_lo_port, k_hi_ip, k_hi_port, k_protocol,
      count(distinct {cmp}) > 1 as ambiguous, case when count(distinct {cmp}) = 1 then min({out}) end as label,
      count(*) as n_label_rows from label_keyed group by 1, 2, 3, 4, 5)"""


LOOKUP = _lookup("norm", "norm")
LOOKUP_RAW = _lookup("trim(label)", "trim(label)")
GAP_FLOWS = """gap_flows as (select * replace (case when start_us % 101 <> 0 then src_port end as src_port) from flows)"""
MAPPED = """mapped as (select """ + _norm("original_label") + """ as norm, binary_label,
  nullif(trim(coarse_family), '') as coarse_family, keep_or_exclude <> 'exclude' as keep from label_mapping
  where dataset_name = 'demo')"""


def _labelled(keep: bool = True) -> str:
    excl = "when not m.keep then 'excluded_label'" if keep else ""

    def blank(c: str) -> str:
        """A label that the mapping excludes has no class."""
        return f"case when m.keep or f.src_port is null or l.ambiguous then m.{c} end as {c}" if keep else f"m.{c}"

    return f"""labelled as (
  select f.*, f.src_port is not null and l.ambiguous is not null and not l.ambiguous as matched_flag,
    f.src_port is not null and coalesce(l.ambiguous, false) as ambiguous_flag,
    case when f.src_port is null then 'no_key' when l.ambiguous then 'ambiguous_canonical_5tuple'
         when l.ambiguous is null then 'unmatched' else 'canonical_5tuple' end as label_match_method,
    l.label as original_label, {blank('binary_label')}, {blank('coarse_family')},
    case when f.src_port is null then 'parse_fail' when l.ambiguous then 'ambiguous_5tuple'
         when l.ambiguous is null then 'unmatched' when m.binary_label is null then 'unmapped_label' {excl} end as exclusion_reason
  from gap_flows f
  left join lookup l on f.src_ip = l.k_lo_ip and f.src_port = l.k_lo_port and f.dst_ip = l.k_hi_ip
    and f.dst_port = l.k_hi_port and f.protocol = l.k_protocol
  left join mapped m on {_norm('l.label')} = m.norm)"""


def with_labels(body: str, *ctes: str, raw: bool = False, keep: bool = True, extra: list[str] = ()) -> str:
    return o.flows(body, LABEL_KEYED, LOOKUP_RAW if raw else LOOKUP, GAP_FLOWS, MAPPED, _labelled(keep), *ctes,
                   extra=["label_ref", "label_mapping", *extra])


_COLS = ", ".join(LABEL_COLS)
_K = ", ".join(KEYS)
_CNT = ", ".join(f"count(*) filter (coalesce(exclusion_reason, 'matched') = '{x}') as {x}" for x in lb.OUTCOMES)
_LR = ["label_ref"]
_LM = ["label_ref", "label_mapping"]
_JOINKEYS = """k as (
  select 'directional' as strategy, src_ip as a, src_port as b, dst_ip as c, dst_port as d, protocol as e, 1 as side
    from gap_flows where src_port is not null
  union select 'directional', source_ip, source_port, destination_ip, destination_port, protocol, 2 from label_ref
  union select 'canonical', src_ip, src_port, dst_ip, dst_port, protocol, 1 from gap_flows where src_port is not null
  union select 'canonical', k_lo_ip, k_lo_port, k_hi_ip, k_hi_port, k_protocol, 2 from label_keyed),
per as (select strategy, a, b, c, d, e, bool_or(side = 1) as in_flow, bool_or(side = 2) as in_label from k group by all)"""

ORACLE = {
    "label_lookup": o.sql(_LR, f"select {_K}, ambiguous, label, n_label_rows from lookup", LABEL_KEYED, LOOKUP),
    "label_lookup_raw_conflict": o.sql(_LR, f"select {_K}, ambiguous, label, n_label_rows from lookup", LABEL_KEYED,
                                       LOOKUP_RAW),
    "ambiguous_label_sets": o.sql(_LR, f"select {_K}, string_agg(norm, '|' order by norm) as labels from (select "
                                  f"distinct {_K}, norm from label_keyed) group by {_K} having count(*) > 1",
                                  LABEL_KEYED),
    "label_align": with_labels(f"select {_COLS} from labelled"),
    "label_align_raw_conflict": with_labels(f"select {_COLS} from labelled", raw=True, keep=False),
    "mapping_order": with_labels("""select label_match_method, original_label, binary_label, exclusion_reason, count(*) as n
        from labelled group by all"""),
    "accounting": with_labels(f"select pcap_file, count(*) as total, {_CNT}, true as balanced from labelled group by 1"),
    "align_report": with_labels("""select count(*) as flow_rows, count(*) filter (matched_flag) as matched,
        count(*) filter (ambiguous_flag) as ambiguous,
        count(*) filter (not matched_flag and not ambiguous_flag) as unmatched,
        count(*) filter (binary_label = 'benign') as benign, count(*) filter (binary_label = 'attack') as attack,
        round(100.0::double * count(*) filter (matched_flag) / count(*), 4) as match_rate from labelled"""),
    "sample_label_times": o.sql(["label_ref"], "select ts_us from label_ref where ts_us is not null order by 1 limit 5"),
    "exclusion_log": with_labels(f"select {', '.join(lb.LOG_COLS)} from labelled where exclusion_reason is not null"),
    "ambiguous_log": with_labels("select " + ", ".join(c for c in lb.LOG_COLS if c != "original_label")
                                 + " from labelled where ambiguous_flag"),
    "run_summary": with_labels(f"""select pcap_file, count(*) as total, {_CNT},
        round(100.0::double * count(*) filter (exclusion_reason is null) / count(*), 4) as match_rate,
        count(*) filter (original_label = 'BENIGN') as benign_label_rows from labelled group by 1"""),
    "label_top_values": o.sql(_LR, "select label as value, count(*) as n from label_ref group by 1 "
                              "order by n desc, value limit 10"),
    "document_top_sources": "select source as value, count(*) as n from documents group by 1 "
                            "order by n desc, value limit 10",
    "label_mapping_check": o.sql(_LM, """select k.norm, count(*) as n_rows, count(distinct label) as n_spellings,
        m.norm is not null as mapped, m.binary_label, m.coarse_family from label_keyed k
        left join mapped m on k.norm = m.norm group by 1, 4, 5, 6""", LABEL_KEYED, MAPPED),
    "label_mapping_report": o.sql(_LM, """select count(*) as labelled_rows,
        count(distinct label) as unique_raw_labels,
        (select string_agg(distinct k2.norm, '|' order by k2.norm) from label_keyed k2 where k2.norm in (select norm from mapped)) as matched_labels,
        (select string_agg(distinct k2.norm, '|' order by k2.norm) from label_keyed k2 where k2.norm not in (select norm from mapped)) as unmatched_labels,
        count(*) filter (m.binary_label = 'benign') as benign_rows,
        count(*) filter (m.binary_label = 'attack') as attack_rows,
        count(*) filter (m.coarse_family is not null) as family_rows,
        count(*) filter (m.norm is null) as unmatched_rows
        from label_keyed k left join mapped m on k.norm = m.norm""", LABEL_KEYED, MAPPED),
    "unmapped_labels": o.sql(_LM, "select distinct norm from label_keyed except select norm from mapped", LABEL_KEYED,
                             MAPPED),
    "join_check": o.flows("""select strategy, count(*) filter (in_flow) as flow_unique_keys,
        count(*) filter (in_label) as label_unique_keys, count(*) filter (in_flow and in_label) as matched_keys,
        round(100.0::double * count(*) filter (in_flow and in_label) / count(*) filter (in_flow), 4) as match_rate_of_flow_keys,
        round(100.0::double * count(*) filter (in_flow and in_label) / count(*) filter (in_label), 4) as match_rate_of_label_keys
        from per group by 1""", LABEL_KEYED, GAP_FLOWS, _JOINKEYS, extra=_LR),
    "shared_keys": o.flows("""select distinct src_ip as k_lo_ip, src_port as k_lo_port, dst_ip as k_hi_ip,
        dst_port as k_hi_port, protocol as k_protocol from gap_flows where src_port is not null intersect
        select k_lo_ip, k_lo_port, k_hi_ip, k_hi_port, k_protocol from label_keyed""", LABEL_KEYED, GAP_FLOWS,
                           extra=_LR),
    "label_file_summary": o.sql(_LR, """select pcap_file, label, n, label_rank, file_rows, n_labels from (select
        pcap_file, label, n, row_number() over (partition by pcap_file order by n desc, label) as label_rank,
        cast(sum(n) over (partition by pcap_file) as bigint) as file_rows,
        count(*) over (partition by pcap_file) as n_labels
        from (select pcap_file, label, count(*) as n from label_ref group by 1, 2)) where label_rank <= 10"""),
    "time_label_join": o.flows(f"""select f.pcap_file, f.src_ip, f.src_port, f.dst_ip, f.dst_port, f.protocol, f.start_us,
        case when f.src_port is null then 'no_key' when l.ambiguous is null then 'unmatched'
             when not l.ambiguous then 'canonical_5tuple' when c.k = 0 or c.k is null then 'no_label_in_window'
             when c.k = 1 then 'time_disambiguated' else 'ambiguous_in_window' end as label_match_method,
        case when not l.ambiguous then l.label when c.k = 1 then c.label end as original_label,
        coalesce(c.n, 0) as n_candidates
        from gap_flows f left join lookup l on f.src_ip = l.k_lo_ip and f.src_port = l.k_lo_port
          and f.dst_ip = l.k_hi_ip and f.dst_port = l.k_hi_port and f.protocol = l.k_protocol
        left join (select f.pcap_file, f.src_ip, f.src_port, f.dst_ip, f.dst_port, f.protocol, f.start_us,
            count(distinct t.norm) as k, min(t.norm) as label, count(*) as n
          from gap_flows f join lookup l on f.src_ip = l.k_lo_ip and f.src_port = l.k_lo_port
            and f.dst_ip = l.k_hi_ip and f.dst_port = l.k_hi_port and f.protocol = l.k_protocol and l.ambiguous
          join (select distinct k_lo_ip, k_lo_port, k_hi_ip, k_hi_port, k_protocol, norm, ts_us from label_keyed) t
            on t.k_lo_ip = f.src_ip and t.k_lo_port = f.src_port and t.k_hi_ip = f.dst_ip and t.k_hi_port = f.dst_port
            and t.k_protocol = f.protocol and abs(f.start_us - t.ts_us) < {TIME_TOL_US}
          group by all) c using (pcap_file, src_ip, src_port, dst_ip, dst_port, protocol, start_us)""",
                               LABEL_KEYED, LOOKUP, GAP_FLOWS, extra=_LR),
}
