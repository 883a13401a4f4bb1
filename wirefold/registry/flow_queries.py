"""Registered queries: packets and flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirefold.operators import flows as fl
from wirefold.operators import packets as pk
from wirefold.plans.fixtures import ACTIVE_S, IDLE_S, table
from wirefold.registry import oracle as o

TOTALS = ["packet_count_total", "bytes_total", "packet_count_fwd", "packet_count_bwd", "bytes_fwd", "bytes_bwd"]
IDENT = ["pcap_file", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "start_us"]


def flows_of(spark, sf, **kw):
    return fl.build_flows(table(spark, sf, "packets"), IDLE_S, ACTIVE_S, **kw)


def packet_rejects(spark, sf):
    return pk.reject_counts(table(spark, sf, "packets"))


def packet_scan(spark, sf):
    return table(spark, sf, "packets").select(
        "event_id", (F.col("ts_us") / 1e6).alias("timestamp"), "src_ip", "dst_ip", "src_port", "dst_port",
        "protocol", "ip_len")


def canonical_key(spark, sf):
    return (pk.with_key(pk.accept(table(spark, sf, "packets")))
            .select("event_id", "lo_ip", "lo_port", "hi_ip", "hi_port", "protocol", "fwd"))


def skip_cap_packets(spark, sf):
    return pk.skip_and_cap(table(spark, sf, "packets"), 100, 500).select("pcap_file", "event_id", "packet_index")


def flows_idle(spark, sf):
    s = fl.idle_sessions(table(spark, sf, "packets"), IDLE_S)
    return s.withColumnsRenamed({"lo_ip": "src_ip", "lo_port": "src_port", "hi_ip": "dst_ip", "hi_port": "dst_port"})


def flows(spark, sf):
    return flows_of(spark, sf).select(*IDENT, "end_us", "duration_us", *TOTALS)


def flows_hot_keys(spark, sf):
    """Same flows with every key above 20 packets cut into time chunks: the skew path gives the same answer."""
    return flows_of(spark, sf, hot_rows=20).select(*IDENT, "end_us", *TOTALS)


def flow_numbering(spark, sf):
    return flows_of(spark, sf, number=True).select(*IDENT, "flow_id", "global_flow_id")


def flow_statistics(spark, sf):
    f = flows_of(spark, sf, stats=True)
    # A mean of few integers often ends in an exact 5, so means are cut to whole microseconds and not rounded.
    return f.select(*IDENT, "size_min", "size_max", "iat_min_us", "iat_max_us",
                    F.round("size_mean", 6).alias("size_mean"), F.round("size_std", 4).alias("size_std"),
                    F.floor("iat_mean_us").alias("iat_mean_us"),
                    F.round(F.col("iat_std_us") / 1e6, 3).alias("iat_std_s"))


def tcp_flag_counts(spark, sf):
    return flows_of(spark, sf, flags=True).select(*IDENT, *[f"{n}_count" for n in fl.TCP_FLAGS])


def packet_deltas(spark, sf):
    a = fl.assign_flows(table(spark, sf, "packets"), IDLE_S, ACTIVE_S)
    return a.select("event_id", "flow_start_us", "delta_us", "opens")


QUERIES = {f.__name__: f for f in (
    packet_scan, packet_rejects, canonical_key, skip_cap_packets, flows_idle, flows, flows_hot_keys, flow_numbering,
    flow_statistics, tcp_flag_counts, packet_deltas)}

_ID = ", ".join(IDENT)
_TOT = ", ".join(TOTALS)
_NUM = "src_ip, src_port, dst_ip, dst_port, protocol"

ORACLE = {
    "packet_scan": o.sql(["packets"], "select event_id, ts_us / 1e6 as timestamp, src_ip, dst_ip, src_port, dst_port, "
                         "protocol, ip_len from packets"),
    "packet_rejects": o.sql(["packets"], """select case when src_ip is null or dst_ip is null then 'skipped_no_ip'
        when protocol not in (6, 17) then 'skipped_no_transport' else 'accepted' end as outcome,
        count(*) as n_packets from packets group by 1"""),
    "canonical_key": o.keyed("select event_id, lo_ip, lo_port, hi_ip, hi_port, protocol, "
                             "(src_ip = lo_ip and src_port = lo_port) as fwd from keyed"),
    "skip_cap_packets": o.sql(["packets"], """select pcap_file, event_id, packet_index from (select pcap_file,
        event_id, row_number() over (partition by pcap_file order by event_id) as packet_index from packets)
        where packet_index > 100 and packet_index <= 600"""),
    "flows_idle": o.keyed(f"""select pcap_file, lo_ip as src_ip, lo_port as src_port, hi_ip as dst_ip,
        hi_port as dst_port, protocol, min(ts_us) as start_us, max(ts_us) as end_us, count(*) as packet_count_total,
        cast(sum(ip_len) as bigint) as bytes_total from (select *, sum(case when gap is null or gap > {o.IDLE_US}
        then 1 else 0 end) over (partition by pcap_file, lo_ip, lo_port, hi_ip, hi_port, protocol
        order by ts_us, event_id) as session from (select *, ts_us - lag(ts_us) over (partition by pcap_file, lo_ip,
        lo_port, hi_ip, hi_port, protocol order by ts_us, event_id) as gap from keyed))
        group by pcap_file, lo_ip, lo_port, hi_ip, hi_port, protocol, session"""),
    "flows": o.flows(f"select {_ID}, end_us, duration_us, {_TOT} from flows"),
    "flows_hot_keys": o.flows(f"select {_ID}, end_us, {_TOT} from flows"),
    "flow_numbering": o.flows(f"""select {_ID},
        row_number() over (partition by pcap_file order by start_us, {_NUM}) as flow_id,
        row_number() over (order by start_us, pcap_file, {_NUM}) as global_flow_id from flows"""),
    "flow_statistics": o.assigned("""select pcap_file, lo_ip as src_ip, lo_port as src_port, hi_ip as dst_ip,
        hi_port as dst_port, protocol, flow_start_us as start_us, min(ip_len) as size_min, max(ip_len) as size_max,
        min(delta_us) filter (not opens) as iat_min_us, max(delta_us) filter (not opens) as iat_max_us,
        round(avg(ip_len), 6) as size_mean, round(stddev_samp(ip_len), 4) as size_std,
        cast(floor(avg(delta_us) filter (not opens)) as bigint) as iat_mean_us,
        round(stddev_samp(delta_us) filter (not opens) / 1e6, 3) as iat_std_s from walk
        group by pcap_file, lo_ip, lo_port, hi_ip, hi_port, protocol, flow_start_us"""),
    "tcp_flag_counts": o.assigned("""select pcap_file, lo_ip as src_ip, lo_port as src_port, hi_ip as dst_ip,
        hi_port as dst_port, protocol, flow_start_us as start_us, """ + ", ".join(
        f"count(*) filter ((tcp_flags & {bit}) <> 0) as {n}_count" for n, bit in fl.TCP_FLAGS.items()) + """
        from walk group by pcap_file, lo_ip, lo_port, hi_ip, hi_port, protocol, flow_start_us"""),
    "packet_deltas": o.assigned("select event_id, flow_start_us, delta_us, opens from walk"),
}
