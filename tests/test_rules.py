"""Every branch of the classification rules, and the scalar functions."""

import pytest
from pyspark.sql import functions as F

from wirefold.functions import columns as c
from wirefold.functions import rules as r


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


L = F.lit


@pytest.mark.parametrize("t, recall, f1, want", [
    (0.99, 0.019, 0.5, "degenerate_threshold"), (0.99, 0.02, 0.5, "observed_nonzero"),
    (0.9899, 0.0, 0.0019, "observed_true_zero"), (0.5, 0.0, 0.0020, "observed_nonzero"),
    (1.0, 0.0497, 0.1, "observed_nonzero")])
def test_threshold_class(spark, t, recall, f1, want):
    assert value(spark, r.threshold_class(L(t), L(recall), L(f1))) == want


@pytest.mark.parametrize("src, tgt, f1, want", [
    (0.9, 0.69, 0.5, "rank_signal_weakened"), (0.9, 0.8, 0.05, "rank_signal_preserved_threshold_failed"),
    (0.9, 0.8, 0.5, "mixed"), (0.6, 0.55, 0.05, "mixed")])
def test_degradation_mode(spark, src, tgt, f1, want):
    assert value(spark, r.degradation_mode(L(src), L(tgt), L(f1))) == want


@pytest.mark.parametrize("t, share, want", [
    (0.99, 0.9, "degenerate_all_benign"), (0.5, 0.049, "threshold_above_most_target_positives"),
    (0.5, 0.05, "threshold_above_majority_target_positives"), (0.5, 0.3, "threshold_in_target_positive_range"),
    (0.5, 0.6, "threshold_below_majority_target_positives")])
def test_threshold_position(spark, t, share, want):
    assert value(spark, r.threshold_position(L(t), L(share))) == want


@pytest.mark.parametrize("subset, dr, df, rs, rf, want", [
    ("full_test", 0.0, 0.0, 0.5, 0.5, "baseline"), ("tcp_only", 0.03, 0.0, 0.5, 0.5, "protocol_dominant_recall_gain"),
    ("udp_only", -0.03, 0.0, 0.5, 0.5, "protocol_dominant_recall_loss"), ("udp_only", 0.0, -0.5, 0.9, 0.5, "protocol_neutral"),
    ("high_vol_atk_q75", 0.2, -0.1, 0.9, 0.8, "rank_signal_preserved_volume_threshold_issue"),
    ("high_vol_atk_q75", 0.06, 0.1, 0.9, 0.8, "high_volume_easier"),
    ("high_pps_atk_q75", -0.06, 0.1, 0.9, 0.8, "high_volume_harder"),
    ("high_pps_atk_q75", 0.05, 0.1, 0.9, 0.8, "high_volume_neutral")])
def test_subset(spark, subset, dr, df, rs, rf, want):
    assert value(spark, r.subset_interpretation(L(subset), L(dr), L(df), L(rs), L(rf))) == want


@pytest.mark.parametrize("tier, t, d, want", [
    ("fixed_fpr", 0.99, 0.5, "blocked_or_not_applicable"), ("default", 0.99, 0.03, "clear_multisource_gain"),
    ("default", 0.5, -0.03, "worse_than_best_single"), ("default", 0.5, 0.0, "no_material_change")])
def test_multisource(spark, tier, t, d, want):
    assert value(spark, r.multisource_outcome(L(tier), L(t), L(d))) == want


@pytest.mark.parametrize("f, rec, p, want", [
    (0.02, 0.0, 0.02, "true_tp_complementarity"), (0.02, 0.0, 0.03, "tradeoff_not_worth_it"),
    (-0.02, 0.0, 0.01, "mostly_fp_relaxation"), (0.0, -0.02, 0.0, "tradeoff_not_worth_it"),
    (0.0, 0.0, 0.0, "no_material_gain")])
def test_fusion_gain(spark, f, rec, p, want):
    assert value(spark, r.fusion_gain(L(f), L(rec), L(p))) == want


def test_small_rules(spark):
    assert [value(spark, r.ks_severity(L(x))) for x in (0.1, 0.15, 0.3, 0.5)] == ["low", "moderate", "high", "severe"]
    assert [value(spark, r.seed_stability_class(L(x))) for x in (0.11, 0.1, 0.01)] == ["not_citable", "moderate", "stable"]
    assert value(spark, r.eligible(L(0.99))) is False and value(spark, r.false_alarm_note(L(0.5))) is None
    got = [value(spark, r.exclusion_reason(L(m), L(mp), L(k))) for m, mp, k in (
        ("no_key", True, True), ("ambiguous_canonical_5tuple", True, True), ("unmatched", True, True),
        ("canonical_5tuple", False, True), ("canonical_5tuple", True, False), ("canonical_5tuple", True, True))]
    assert got == ["parse_fail", "ambiguous_5tuple", "unmatched", "unmapped_label", "excluded_label", None]


def test_columns(spark):
    assert value(spark, c.normalise_label(L(" Web \u0096 XSS "))) == "Web - XSS"
    assert value(spark, c.normalise_label(L("a−b—c–d"))) == "a-b-c-d"
    assert value(spark, c.blank_to_null(L("  "))) is None
    for a, b, want in ((1, 0, 0.0), (None, 2, 0.0), (float("nan"), 2, 0.0), (float("inf"), 2, 0.0), (3, 2, 1.5)):
        assert value(spark, c.safe_divide(L(a).cast("double"), L(b).cast("double"))) == want
    assert value(spark, c.capture_day(L("x_FRIDAY_monday.pcap"))) == "Monday"
    assert value(spark, c.capture_day(L("x.pcap"))) == "Unknown"
    assert [value(spark, c.byte_band(L(x))) for x in (99, 100, 999, 1000, 10000, 100000)] == [
        "<100B", "100B-1KB", "100B-1KB", "1KB-10KB", "10KB-100KB", ">100KB"]
    assert value(spark, c.service_name(L(631))) == "ipp" and value(spark, c.service_name(L(8080))) == "port8080"
    assert value(spark, c.context_name(L("CIC → IoT"))) == "cic_to_iot"
    assert value(spark, c.proto_number(L(" UDP "))) == 17 and value(spark, c.proto_number(L("icmp"))) is None
    assert value(spark, c.proto_id(L(1))) is None
