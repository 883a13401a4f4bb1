"""Label join outcomes, mapping rules and the accounting identity on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from wirefold.operators import features as ft
from wirefold.operators import labeling as lb
from wirefold.operators import splits as sp

FLOW = ("pcap_file string, start_us long, end_us long, src_ip string, src_port int, dst_ip string, dst_port int, "
        "protocol int")
REF = ("source_ip string, source_port int, destination_ip string, destination_port int, protocol int, label string, "
       "ts_us long")
MAP = "dataset_name string, original_label string, binary_label string, coarse_family string, keep_or_exclude string"


@pytest.fixture(scope="module")
def tables(spark):
    flows = spark.createDataFrame([
        ("Monday.pcap", 0, 1, "a", 1, "b", 2, 6), ("Monday.pcap", 1, 2, "a", 1, "b", 3, 6),
        ("Monday.pcap", 2, 3, "a", 1, "b", 4, 6), ("Monday.pcap", 3, 4, "a", 1, "b", 5, 6),
        ("Friday.pcap", 4, 5, "a", 1, "b", 6, 6), ("Friday.pcap", 5, 6, "a", None, "b", 7, 6),
        ("Friday.pcap", 6, 7, "a", 1, "b", 8, 6), ("Friday.pcap", 7, 8, None, 1, "b", 2, 6)], FLOW)
    ref = spark.createDataFrame([
        ("b", 2, "a", 1, 6, "BENIGN", 0), ("a", 1, "b", 3, 6, " DoS – X ", 0), ("a", 1, "b", 3, 6, "DoS - X", 0),
        ("a", 1, "b", 4, 6, "BENIGN", 0), ("b", 4, "a", 1, 6, "DoS - X", 10_000_000), ("a", 1, "b", 5, 6, "New", 0),
        ("a", 1, "b", 6, 6, "Noise", 0), (None, 1, "b", 8, 6, "BENIGN", 0), ("a", 1, "b", 8, 6, None, 0)], REF)
    mapping = spark.createDataFrame([
        ("d", "BENIGN", "attack", "x", "keep"), ("d", "BENIGN", "benign", " ", "keep"),
        ("d", "DoS − X", "attack", "dos", "keep"), ("d", "Noise", "attack", "", "exclude"),
        ("other", "New", "attack", "x", "keep")], MAP).coalesce(1)
    return flows, ref, mapping


def by_port(df, col):
    return {r.start_us: r[col] for r in df.collect()}


def test_the_lookup_counts_rows_before_it_compares_text(spark):
    rows = [("a", 1, "b", 2, 6, "BENIGN", 0)] * 300 + [("b", 2, "a", 1, 6, " BENIGN", 0)] * 200 + [
        (None, 1, "b", 2, 6, "BENIGN", 0), ("a", 1, "b", 2, None, "BENIGN", 0), ("a", 1, "b", 2, 6, None, 0)]
    out = lb.label_lookup(spark.createDataFrame(rows, REF))
    assert [(r.label, r.ambiguous, r.n_label_rows) for r in out.collect()] == [("BENIGN", False, 500)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and plan.index("min(") < plan.rindex("Aggregate") < plan.rindex("count(1)")


def test_the_join_meets_a_stored_lookup(tables):
    flows, ref, mapping = tables
    plan = lb.align_labels(flows, ref, mapping, "d")._jdf.queryExecution().optimizedPlan().toString()
    assert "min(" not in plan and "source_ip" not in plan


def test_outcomes(tables):
    out = lb.align_labels(*tables, "d").cache()
    assert by_port(out, "label_match_method") == {
        0: "canonical_5tuple", 1: "canonical_5tuple", 2: "ambiguous_canonical_5tuple", 3: "canonical_5tuple",
        4: "canonical_5tuple", 5: "no_key", 6: "unmatched", 7: "no_key"}
    assert by_port(out, "binary_label") == {0: "benign", 1: "attack", 2: None, 3: None, 4: None, 5: None, 6: None,
                                           7: None}
    assert by_port(out, "exclusion_reason") == {0: None, 1: None, 2: "ambiguous_5tuple", 3: "unmapped_label",
                                               4: "excluded_label", 5: "parse_fail", 6: "unmatched", 7: "parse_fail"}
    acc = {r.pcap_file: r for r in lb.accounting(out).collect()}
    assert acc["Monday.pcap"].total == 4 and acc["Friday.pcap"].parse_fail == 2 and acc["Friday.pcap"].balanced
    rep = lb.alignment_report(out).first()
    assert (rep.matched, rep.ambiguous, rep.unmatched) == (4, 1, 3)


def test_compatibility_switches(tables):
    raw = lb.align_labels(*tables, "d", apply_keep=False, compat_raw_conflict=True)
    assert by_port(raw, "label_match_method")[1] == "ambiguous_canonical_5tuple"
    assert by_port(raw, "exclusion_reason")[4] is None


def test_accounting_fails_when_broken(tables):
    broken = lb.align_labels(*tables, "d").withColumn("exclusion_reason", F.lit("other"))
    with pytest.raises(Exception, match="accounting identity"):
        lb.accounting(broken).collect()


def test_empty_mapping_and_last_wins(tables):
    assert lb.mapping_for(tables[2], "none").count() == 0
    m = {r.norm: r.binary_label for r in lb.mapping_for(tables[2], "d").collect()}
    assert m["BENIGN"] == "benign" and m["DoS - X"] == "attack"


def test_time_disambiguation(tables):
    j = lb.time_label_join(tables[0], tables[1], 5_000_000)
    got = by_port(j, "label_match_method")
    assert got[2] == "time_disambiguated" and by_port(j, "original_label")[2] == "BENIGN"
    wide = by_port(lb.time_label_join(tables[0], tables[1], 60_000_000), "label_match_method")
    assert wide[2] == "ambiguous_in_window"
    edge = by_port(lb.time_label_join(tables[0], tables[1], 2), "label_match_method")
    assert edge[2] == "no_label_in_window"


def test_guards(spark, tables):
    with pytest.raises(ValueError, match="leak"):
        ft.feature_columns(tables[0].withColumn("day", F.lit("x")), strict=False)
    with pytest.raises(ValueError, match="missing"):
        ft.feature_columns(tables[0])
    s = sp.with_day_split(tables[0])
    assert sp.require_no_leak(s, "pcap_file") is s
    with pytest.raises(ValueError, match="src_ip"):
        sp.require_no_leak(s, "src_ip")
    m = tables[0].withColumn("global_flow_id", F.col("start_us"))
    side = sp.sidecar(sp.with_day_split(m))
    assert sp.join_sidecar(m, side).count() == 8
    with pytest.raises(ValueError, match="sidecar"):
        sp.join_sidecar(m, side.where("global_flow_id > 0"))


def test_hot_label_key(spark):
    """One key with most rows and one conflicting row stays one lookup row."""
    ref = spark.range(50_000).select(
        F.lit("a").alias("source_ip"), F.lit(1).alias("source_port"), F.lit("b").alias("destination_ip"),
        F.lit(2).alias("destination_port"), F.lit(6).alias("protocol"),
        F.when(F.col("id") == 49_999, "X").otherwise("BENIGN").alias("label"))
    r = lb.label_lookup(ref).collect()
    assert len(r) == 1 and r[0].ambiguous and r[0].n_label_rows == 50_000
