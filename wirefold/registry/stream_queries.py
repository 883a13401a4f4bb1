"""Registered queries: streaming operators run over the whole event table until it is used up."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from wirefold.operators import alerts as al
from wirefold.plans.fixtures import ACTIVE_S, IDLE_S, table, text
from wirefold.registry import oracle as o
from wirefold.registry.flow_queries import IDENT, TOTALS, flows_of
from wirefold.registry.flow_queries import ORACLE as _FLOW_ORACLE
from wirefold.registry.join_queries import OFFSET_S, TOL_S
from wirefold.registry.join_queries import ORACLE as _JOIN_ORACLE
from wirefold.session import scratch_path
from wirefold.streaming import flows as st
from wirefold.streaming import run as rn
from wirefold.streaming import windows as sw

DELAY_S = 10
METHODS = ("lr", "rf", "xgb")
RATE_BY = ["domain", "method"]
START_US, SLICE_US = 1_704_067_200_000_000, 432_000_000_000  # arrival files: slices of five days
ROW_GROUP_BYTES = 4 << 20  # as much as Spark reads at least per task


def _typed(base, name):
    """The named stand-in over an events frame, with its event time `ts`."""
    sql = text(name, "spark").replace("from events", "from {events}")
    return base.sparkSession.sql(sql.replace("select event_id", "select cast(ts as timestamp) as ts, event_id", 1), events=base)


def _stream(spark, sf, name):
    """The named stand-in over a streaming scan of the events table."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return _typed(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf), name)


def _pieces(spark, sf):
    path = scratch_path(spark, "stream-flows")
    out, progress = rn.drain_to(st.stream_pieces(_stream(spark, sf, "packets"), IDLE_S, ACTIVE_S, f"{DELAY_S} seconds"),
                                path, ["kind"])
    return out, progress, f"{path}/state"


def stream_flows(spark, sf):
    """Flows closed by the watermark, and those that the end of the input leaves open in state."""
    out, _, state = _pieces(spark, sf)
    return st.closed_flows(out).unionByName(st.open_flows(spark, state, IDLE_S, ACTIVE_S)).select(*IDENT, "end_us", *TOTALS)


def stream_progress(spark, sf):
    """What the progress of the flow stream adds up to: rows read, and rows that the engine dropped."""
    _, progress, _ = _pieces(spark, sf)
    c = progress.counters()
    return spark.createDataFrame([(c["input_rows"], c["late_rows"])], "input_rows long, dropped_rows long")


def _arrivals(spark, sf):
    """The events in files by arrival: every slice of time one file, every 50th event two files late.

    A micro-batch is one file, so its row groups are small: tasks share them. The slices are parted in one pass beforehand.
    """
    path, parted = scratch_path(spark, "arrivals"), scratch_path(spark, "arrivals-parted")
    ev = table(spark, sf, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    at = F.floor((us - START_US) / SLICE_US) + F.when(F.col("event_id") % 50 == 7, 2).otherwise(0)
    ev.withColumn("arrival", at).write.partitionBy("arrival").parquet(parted)
    slices = spark.read.schema(ev.withColumn("arrival", at).schema).parquet(parted)
    for i in [r[0] for r in slices.select("arrival").distinct().orderBy("arrival").collect()]:
        one = slices.where(F.col("arrival") == i).drop("arrival").coalesce(1)
        one.write.mode("append").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
        time.sleep(0.02)  # the file source takes files in the order of their times
    return spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _late_run(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = scratch_path(spark, "stream-late")
    out, _ = rn.drain_to(st.stream_pieces(_typed(_arrivals(spark, sf), "packets"), IDLE_S, ACTIVE_S, f"{DELAY_S} seconds"),
                         path, ["kind"])
    return out, f"{path}/state"


def stream_late_packets(spark, sf):
    """Packets that arrive behind the watermark, kept as they were sent."""
    return st.late_packets(_late_run(spark, sf)[0])


def stream_on_time(spark, sf):
    """What the flows of the same run hold, with the late packets beside them: together the whole input."""
    out, state = _late_run(spark, sf)
    flows = st.closed_flows(out).unionByName(st.open_flows(spark, state, IDLE_S, ACTIVE_S))
    n = flows.agg(F.sum("packet_count_total").alias("n"), F.sum("bytes_total").alias("bytes")).withColumn(
        "side", F.lit("on_time"))
    return n.unionByName(st.late_packets(out).agg(F.count("*").alias("n"), F.coalesce(F.sum("ip_len"), F.lit(0)).alias(
        "bytes")).withColumn("side", F.lit("late")))


def session_window_flows(spark, sf):
    p = table(spark, sf, "packets").withColumn("ts", F.timestamp_micros("ts_us"))
    s = sw.session_flows(p, IDLE_S)
    return s.withColumnsRenamed({"lo_ip": "src_ip", "lo_port": "src_port", "hi_ip": "dst_ip", "hi_port": "dst_port"})


def _timed_scores(spark, sf):
    ev = table(spark, sf, "packets").select("event_id", F.timestamp_micros("ts_us").alias("ts"))
    return table(spark, sf, "scores").join(ev, "event_id")


def _by_method(scores):
    """One row per method and score; a narrow step, on streams too."""
    return scores.withColumn("m", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"s_{m}").alias("y_score"))
                                                      for m in METHODS]))).select("ts", "domain", "m.*")


def _shares(r):
    return r.withColumn("alarm_share", F.round("alarm_share", 6))


def alarm_rate_hourly(spark, sf):
    """The hourly rate of every method."""
    return _shares(sw.alarm_rate(_by_method(_timed_scores(spark, sf)), RATE_BY))


def alarm_rate_sliding(spark, sf):
    return _shares(sw.alarm_rate(_by_method(_timed_scores(spark, sf)), RATE_BY, width="6 hours", slide="2 hours"))


def stream_alarm_rate(spark, sf):
    """Windows that the watermark has closed, and those that the end of the input leaves open."""
    path = scratch_path(spark, "stream-alarms")
    counts = sw.alarm_counts(_by_method(_stream(spark, sf, "scores")), RATE_BY, delay=f"{DELAY_S} seconds")
    out, _ = rn.drain_to(counts, path)
    still = sw.open_alarm_counts(spark, f"{path}/state", RATE_BY)
    return _shares(sw.rates(out.unionByName(still), RATE_BY))


def _live_alerts(spark, sf):
    """Flow and alert tables written once and read back as streams; the run's statuses and both tables."""
    fp, ap = scratch_path(spark, "flows"), scratch_path(spark, "alerts")
    f = flows_of(spark, sf).select(*IDENT, "end_us").withColumn("end_ts", F.timestamp_micros("end_us"))
    a = al.correct_time(table(spark, sf, "alerts"), OFFSET_S).withColumn("alert_ts", F.timestamp_micros("t_us"))
    f.write.parquet(fp)
    a.write.parquet(ap)
    live = sw.live_alert_status(spark.readStream.schema(a.schema).parquet(ap),
                                spark.readStream.schema(f.schema).parquet(fp), TOL_S, ACTIVE_S)
    return rn.drain(live, "stream-alerts")[0], spark.read.parquet(ap), spark.read.parquet(fp)


def stream_alert_status(spark, sf):
    """Every alert with its status: put out by the stream, or by the flush at the end of the input."""
    m = sw.settle_alerts(*_live_alerts(spark, sf), TOL_S, ACTIVE_S)
    return m.select("alert_id", "n_candidates", "match_status", F.col("flow.start_us").alias("flow_start_us"))


QUERIES = {f.__name__: f for f in (
    stream_flows, stream_progress, stream_late_packets, stream_on_time, session_window_flows, alarm_rate_hourly,
    alarm_rate_sliding, stream_alarm_rate, stream_alert_status)}

_ID = ", ".join(IDENT)
H = 3_600_000_000
_RATE = "window_start_us, window_end_us, domain, method, n_flows, n_alerts, alarm_share"


def _rates(width: int, slide: int) -> str:
    """The rate of every method, as `rate`."""
    each = " union all ".join(f"select event_id, domain, '{m}' as method, s_{m} as y_score from scores" for m in METHODS)
    return f"""rate as (select ws as window_start_us, ws + {width} as window_end_us, domain, method, count(*) as n_flows,
      count(*) filter (y_score >= 0.5) as n_alerts,
      round(count(*) filter (y_score >= 0.5)::double / count(*), 6) as alarm_share
      from (select s.*, (p.ts_us // {slide} - i) * {slide} as ws from ({each}) s join packets p using (event_id),
        (select range as i from range(0, {width // slide}))) group by all)"""


# Arrival by file; the watermark of a file is the latest time of the files before it, in milliseconds, less the delay.
_ARRIVALS = [f"""arrived as (select k.*, (ts_us - {START_US}) // {SLICE_US} + case when event_id % 50 = 7 then 2 else 0 end
    as arrival from keyed k)""", f"""seen as (select arrival, max(top) over (order by arrival rows between unbounded
    preceding and 1 preceding) // 1000 * 1000 - {DELAY_S * 1_000_000} as wm from (select (ts_us - {START_US}) // {SLICE_US}
    + case when event_id % 50 = 7 then 2 else 0 end as arrival, max(ts_us) as top from keyed group by 1))""",
             "judged as (select a.*, coalesce(ts_us < wm, false) as late from arrived a join seen using (arrival))"]
ORACLE = {
    "stream_flows": o.flows(f"select {_ID}, end_us, {', '.join(TOTALS)} from flows"),
    "stream_progress": "select count(*) as input_rows, 0::bigint as dropped_rows from events",
    "stream_late_packets": o.keyed("""select pcap_file, src_ip, src_port, dst_ip, dst_port, protocol, ts_us, ip_len
        from judged where late""", *_ARRIVALS),
    "stream_on_time": o.keyed("""select case when late then 'late' else 'on_time' end as side, count(*) as n,
        sum(ip_len)::bigint as bytes from judged group by 1""", *_ARRIVALS),
    "session_window_flows": _FLOW_ORACLE["flows_idle"],
    "alarm_rate_hourly": o.sql(["scores", "packets"], f"select {_RATE} from rate", _rates(H, H)),
    "alarm_rate_sliding": o.sql(["scores", "packets"], f"select {_RATE} from rate", _rates(6 * H, 2 * H)),
    "stream_alarm_rate": o.sql(["scores", "packets"], f"select {_RATE} from rate", _rates(H, H)),
    "stream_alert_status": _JOIN_ORACLE["alert_flow_match"],
}
