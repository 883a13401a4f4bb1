"""Detector alerts joined to flows by key and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirefold.functions.columns import epoch_micros, percent, proto_number, report_round
from wirefold.operators.flows import US
from wirefold.operators.intervals import points_in_intervals
from wirefold.operators.labeling import NKEY, with_canonical

TOLERANCE_S = 2.0
FLOW_REF = ["pcap_file", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "start_us"]


def correct_time(alerts: DataFrame, offset_s: float = 0.0, col: str = "alert_ts_us") -> DataFrame:
    """Adds `t_us`, the alert time less the clock offset of its dataset; no offset is assumed."""
    return alerts.withColumn("t_us", F.col(col) - round(offset_s * US))


def from_log(alerts: DataFrame) -> DataFrame:
    """Adds `alert_id` and `alert_ts_us` to flattened log events, which carry a text time and no id: the id is a hash
    of the event and, among equal events, of their number."""
    t = epoch_micros(F.try_to_timestamp("timestamp"))
    same = Window.partitionBy("_h").orderBy("_h")
    a = alerts.withColumns({"alert_ts_us": t, "_h": F.xxhash64(*alerts.columns)})
    return a.withColumn("alert_id", F.xxhash64("_h", F.row_number().over(same))).drop("_h")


def _keyed_alerts(alerts: DataFrame) -> DataFrame:
    a = alerts.withColumn("_proto", proto_number("proto"))
    return with_canonical(a, ("src_ip", "src_port", "dest_ip", "dest_port"), "_proto").drop("_proto")


def candidates(alerts: DataFrame, flows: DataFrame, tolerance_s: float = TOLERANCE_S, active_s: float = 120.0,
               same_day: bool = False) -> DataFrame:
    """(alert_id, flow) pairs: equal key, start - T <= t <= end + T; `same_day` also asks for the same `day` value."""
    tol = round(tolerance_s * US)
    keys = [*NKEY] + (["day"] if same_day else [])
    a = _keyed_alerts(alerts).where(F.col("k_protocol").isNotNull()).select(*keys, "alert_id", "t_us")
    f = (with_canonical(flows).where(F.col("k_protocol").isNotNull())
         .select(*keys, F.struct(*FLOW_REF).alias("flow"), (F.col("start_us") - tol).alias("_lo"),
                 (F.col("end_us") + tol).alias("_hi")))
    return points_in_intervals(a, f, keys, "t_us", "_lo", "_hi", round(active_s * US) + 2 * tol)


def match_status(alerts: DataFrame, cand: DataFrame) -> DataFrame:
    """Every alert with its number of candidate flows and status; no alert is lost."""
    n = cand.groupBy("alert_id").agg(F.count("*").alias("n_candidates"), F.min("flow").alias("_flow"))
    j = alerts.join(n, "alert_id", "left").withColumn(
        "n_candidates", F.coalesce("n_candidates", F.lit(0).cast("bigint")))
    return with_status(j, F.col("_flow")).drop("_flow")


def with_status(counted: DataFrame, flow: Column) -> DataFrame:
    """Adds the status that follows from `n_candidates`, and the flow where it is the only one."""
    status = (F.when(F.col("n_candidates") == 0, "alert_unmatched")
              .when(F.col("n_candidates") == 1, "matched_unique").otherwise("matched_ambiguous"))
    return counted.withColumn("match_status", status).withColumn("flow", F.when(F.col("n_candidates") == 1, flow))


def status_rates(matched: DataFrame) -> DataFrame:
    return matched.agg(
        F.count("*").alias("n_alerts"), F.count_if(F.col("match_status") == "matched_unique").alias("n_unique"),
        F.count_if(F.col("match_status") == "matched_ambiguous").alias("n_ambiguous"),
        F.count_if(F.col("match_status") == "alert_unmatched").alias("n_unmatched")).withColumn(
        "match_rate", report_round(percent(F.col("n_unique") + F.col("n_ambiguous"), "n_alerts")))


def flow_verdicts(flows: DataFrame, alerts: DataFrame, cand: DataFrame) -> DataFrame:
    """attack when at least one uniquely matched alert points to the flow; ambiguous alerts are only counted.

    Candidate pairs are counted per alert, then per flow; both aggregates combine map-side.
    """
    per_alert = cand.groupBy("alert_id").agg(F.count("*").alias("k"))
    per_flow = (cand.select("alert_id", "flow").join(per_alert, "alert_id").groupBy("flow")
                .agg(F.count_if(F.col("k") == 1).alias("alert_count_unique"),
                     F.count_if(F.col("k") > 1).alias("alert_count_ambiguous")))
    zero = F.lit(0).cast("bigint")
    j = flows.withColumn("flow", F.struct(*FLOW_REF)).join(per_flow, "flow", "left").drop("flow")
    j = j.withColumns({"alert_count_unique": F.coalesce("alert_count_unique", zero),
                       "alert_count_ambiguous": F.coalesce("alert_count_ambiguous", zero)})
    return j.withColumn("alert_pred", F.when(F.col("alert_count_unique") > 0, "attack").otherwise("benign"))
