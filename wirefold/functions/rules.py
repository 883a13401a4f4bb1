"""Classification rules for result rows, as column expressions. Cut values are parameters with stated defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirefold.functions.columns import _c


def eligible(threshold, cut: float = 0.99) -> Column:
    """A threshold at or above the cut calls everything benign and is not citable."""
    return _c(threshold) < cut


def false_alarm_note(threshold, cut: float = 0.99) -> Column:
    return F.when(_c(threshold) >= cut, F.lit("degenerate threshold: every flow is called benign"))


def threshold_class(threshold, recall, f1, true_zero_f1: float = 0.002, recall_cut: float = 0.02) -> Column:
    return (F.when((_c(threshold) >= 0.99) & (_c(recall) < recall_cut), "degenerate_threshold")
            .when(_c(f1) < true_zero_f1, "observed_true_zero").otherwise("observed_nonzero"))


def threshold_class_text(cls) -> Column:
    return (F.when(_c(cls) == "degenerate_threshold", "threshold lies above nearly all scores")
            .when(_c(cls) == "observed_true_zero", "threshold is usable but finds no attacks")
            .otherwise("threshold carries over with some detection"))


def degradation_mode(roc_source, roc_target, f1_default, drop: float = 0.20, roc_floor: float = 0.60,
                     f1_floor: float = 0.10) -> Column:
    return (F.when(_c(roc_source) - _c(roc_target) > drop, "rank_signal_weakened")
            .when((_c(roc_target) >= roc_floor) & (_c(f1_default) < f1_floor),
                  "rank_signal_preserved_threshold_failed")
            .otherwise("mixed"))


def threshold_position(threshold, share_pos_above) -> Column:
    s = _c(share_pos_above)
    return (F.when(_c(threshold) >= 0.99, "degenerate_all_benign")
            .when(s < 0.05, "threshold_above_most_target_positives")
            .when(s < 0.30, "threshold_above_majority_target_positives")
            .when(s < 0.60, "threshold_in_target_positive_range")
            .otherwise("threshold_below_majority_target_positives"))


def subset_interpretation(subset, d_recall, d_f1, roc_subset, roc_full) -> Column:
    s, dr, df = _c(subset), _c(d_recall), _c(d_f1)
    proto = s.isin("tcp_only", "udp_only")
    return (F.when(s == "full_test", "baseline")
            .when(proto & (dr > 0.02), "protocol_dominant_recall_gain")
            .when(proto & (dr < -0.02), "protocol_dominant_recall_loss")
            .when(proto, "protocol_neutral")
            .when((df < 0) & (_c(roc_subset) > _c(roc_full)), "rank_signal_preserved_volume_threshold_issue")
            .when(dr > 0.05, "high_volume_easier")
            .when(dr < -0.05, "high_volume_harder")
            .otherwise("high_volume_neutral"))


def multisource_outcome(tier, threshold, d_f1, margin: float = 0.03) -> Column:
    return (F.when((_c(tier) == "fixed_fpr") & (_c(threshold) >= 0.99), "blocked_or_not_applicable")
            .when(_c(d_f1) >= margin, "clear_multisource_gain")
            .when(_c(d_f1) <= -margin, "worse_than_best_single")
            .otherwise("no_material_change"))


def fusion_gain(d_f1, d_recall, d_fpr) -> Column:
    f, r, p = _c(d_f1), _c(d_recall), _c(d_fpr)
    return (F.when((f > 0.01) & (p <= 0.02), "true_tp_complementarity")
            .when(f > 0.01, "tradeoff_not_worth_it")
            .when((f < -0.01) & (p > 0), "mostly_fp_relaxation")
            .when((r < -0.01) & (p <= 0), "tradeoff_not_worth_it")
            .otherwise("no_material_gain"))


def ks_severity(ks) -> Column:
    k = _c(ks)
    return F.when(k < 0.15, "low").when(k < 0.30, "moderate").when(k < 0.50, "high").otherwise("severe")


def seed_stability_class(f1_std, unstable: float = 0.10, stable: float = 0.02) -> Column:
    s = _c(f1_std)
    return F.when(s > unstable, "not_citable").when(s > stable, "moderate").otherwise("stable")


def exclusion_reason(method, mapped, keep) -> Column:
    """Why a flow is left out; NULL when it stays."""
    m = _c(method)
    return (F.when(m == "no_key", "parse_fail")
            .when(m == "ambiguous_canonical_5tuple", "ambiguous_5tuple")
            .when(m == "unmatched", "unmatched")
            .when(~_c(mapped), "unmapped_label")
            .when(~_c(keep), "excluded_label"))
