"""Session windows, alarm rates and the live alert join; every function works on batch and streaming input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.functions.columns import safe_divide
from wirefold.operators.alerts import FLOW_REF, _keyed_alerts, candidates, match_status, with_status
from wirefold.operators.flows import KEY, US
from wirefold.operators.labeling import NKEY, with_canonical
from wirefold.operators.packets import accept, with_key
from wirefold.streaming.run import open_groups


def session_flows(packets: DataFrame, idle_s: float = 60.0, time_col: str = "ts", delay: str | None = None) -> DataFrame:
    """Idle-only flows by session windows. With `spark.sql.sessionWindow.merge.sessions.in.local.partition`, which
    `build_session` sets, sessions merge inside every map task, so a hot key sends its sessions and not its packets."""
    pk = with_key(accept(packets))
    if delay:
        pk = pk.withWatermark(time_col, delay)
    g = pk.groupBy(F.session_window(time_col, f"{round(idle_s * US)} microseconds").alias("w"), *KEY).agg(
        F.count("*").alias("packet_count_total"), F.sum("ip_len").cast("bigint").alias("bytes_total"),
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))
    return g.drop("w")


def alarm_counts(scores: DataFrame, by: list[str], threshold: float = 0.5, time_col: str = "ts", width: str = "1 hour",
                 slide: str | None = None, delay: str | None = None, score: str = "y_score") -> DataFrame:
    """Flows and alerts per window `w`; tumbling, or sliding when `slide` is given."""
    s = scores.withWatermark(time_col, delay) if delay else scores
    win = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    return s.groupBy(win.alias("w"), *by).agg(F.count("*").alias("n_flows"),
                                              F.count_if(F.col(score) >= threshold).alias("n_alerts"))


def rates(counts: DataFrame, by: list[str]) -> DataFrame:
    return counts.select(
        F.unix_micros("w.start").alias("window_start_us"), F.unix_micros("w.end").alias("window_end_us"), *by, "n_flows",
        "n_alerts", safe_divide("n_alerts", "n_flows").alias("alarm_share"))


def alarm_rate(scores: DataFrame, by: list[str], **how) -> DataFrame:
    """Alerts per window and their share of the flows; `how` as for `alarm_counts`."""
    return rates(alarm_counts(scores, by, **how), by)


def open_alarm_counts(spark: SparkSession, checkpoint: str, by: list[str]) -> DataFrame:
    """The end-of-input flush: windows that a finished `alarm_counts` stream holds open, with their counts so far."""
    return open_groups(spark, checkpoint, ["w", *by], ["n_flows", "n_alerts"])


def live_alert_join(alerts: DataFrame, flows: DataFrame, tolerance_s: float, active_s: float,
                    delay: str = "1 minute") -> DataFrame:
    """Stream-stream left outer join of alerts and flows on key, time bucket and interval: a row per candidate, and one
    row with a NULL flow for an alert without any.

    `alerts` carries event time `alert_ts` with `t_us`; `flows` carries `end_ts` with start and end in microseconds.
    Flows are copied to the buckets they touch; an alert has one bucket, so it is put out as unmatched once, when the
    watermark has passed every flow that could hold it. Alerts without a full key match nothing and come out the same
    way. The time-range condition lets both sides drop state behind the watermarks.
    """
    tol, width = round(tolerance_s * US), round(active_s * US) + 2 * round(tolerance_s * US)
    a = _keyed_alerts(alerts).withWatermark("alert_ts", delay).select(
        *NKEY, "alert_id", "t_us", "alert_ts", F.floor(F.col("t_us") / width).alias("bucket"))
    f = with_canonical(flows).withWatermark("end_ts", delay).where(F.col("k_protocol").isNotNull()).select(
        *[F.col(k).alias(f"f_{k}") for k in NKEY], F.struct(*FLOW_REF).alias("flow"),
        (F.col("start_us") - tol).alias("lo"), (F.col("end_us") + tol).alias("hi"), "end_ts")
    f = f.withColumn("f_bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    back, ahead = (f"interval {us} microseconds" for us in (round(active_s * US) + tol, tol))
    on = (F.col("bucket") == F.col("f_bucket")) & (F.col("t_us") >= F.col("lo")) & (F.col("t_us") <= F.col("hi")) & F.expr(
        f"alert_ts >= end_ts - {back} and alert_ts <= end_ts + {ahead}")
    for k in NKEY:
        on = on & (F.col(k) == F.col(f"f_{k}"))
    return a.join(f, on, "left_outer").select("alert_id", "alert_ts", "flow")


def live_alert_status(alerts: DataFrame, flows: DataFrame, tolerance_s: float, active_s: float,
                      delay: str = "1 minute") -> DataFrame:
    """Every alert once, with its number of candidate flows, its status and its flow if that is unique, as soon as the
    watermark rules out another candidate."""
    j = live_alert_join(alerts, flows, tolerance_s, active_s, delay)
    n = j.groupBy("alert_id", "alert_ts").agg(F.count("flow").alias("n_candidates"), F.min("flow").alias("first_flow"))
    return with_status(n, F.col("first_flow")).drop("first_flow", "alert_ts")


def settle_alerts(done: DataFrame, alerts: DataFrame, flows: DataFrame, tolerance_s: float, active_s: float) -> DataFrame:
    """The end-of-input flush: the statuses that the stream has put out, and those of the alerts that it still holds,
    from the same tables."""
    rest = alerts.join(done.select("alert_id"), "alert_id", "left_anti")
    late = match_status(rest, candidates(rest, flows, tolerance_s, active_s))
    return done.unionByName(late.select(*done.columns))
