"""Flow building: boundaries, conservation, direction, and hot-key chunks against a plain fold."""

import random

import pytest
from pyspark.sql import functions as F

from wirefold.operators import flows as fl

S = 1_000_000


def packets(spark, rows):
    """rows: (event_id, seconds, src, sport, dst, dport, proto, size)"""
    data = [(i, round(t * S), "f.pcap", s, sp, d, dp, pr, n) for i, t, s, sp, d, dp, pr, n in rows]
    return spark.createDataFrame(data, "event_id long, ts_us long, pcap_file string, src_ip string, src_port int, "
                                       "dst_ip string, dst_port int, protocol int, ip_len long")


def one_key(spark, times):
    return packets(spark, [(i, t, "10.0.0.1", 5, "10.0.0.2", 80, 6, 100) for i, t in enumerate(times)])


def starts(df):
    return sorted((r.start_us / S, r.packet_count_total) for r in df.collect())


@pytest.mark.parametrize("times, want", [
    ([0, 60], [(0, 2)]),
    ([0, 60.000001], [(0, 1), (60.000001, 1)]),
    ([0, 50, 100, 120], [(0, 4)]),
    ([0, 50, 100, 120.000001], [(0, 3), (120.000001, 1)]),
    ([0, 60, 120, 180.5], [(0, 3), (180.5, 1)]),
    ([0, 50, 100, 150, 200, 250, 300], [(0, 3), (150, 3), (300, 1)]),
    ([5], [(5, 1)]),
    ([1, 1, 1], [(1, 3)]),
])
def test_timeout_boundaries(spark, times, want):
    assert starts(fl.build_flows(one_key(spark, times))) == want


def test_direction_and_text_order(spark):
    df = packets(spark, [(1, 0, "10.0.0.2", 80, "10.0.0.10", 9, 6, 7), (2, 1, "10.0.0.10", 9, "10.0.0.2", 80, 6, 11),
                         (3, 2, "10.0.0.5", 7, "10.0.0.5", 7, 17, 5), (4, 3, "10.0.0.5", 9, "10.0.0.5", 8, 17, 5)])
    rows = {(r.src_ip, r.src_port, r.dst_port): r for r in fl.build_flows(df).collect()}
    r = rows[("10.0.0.10", 9, 80)]
    assert (r.packet_count_fwd, r.packet_count_bwd, r.bytes_fwd, r.bytes_bwd) == (1, 1, 11, 7)
    assert rows[("10.0.0.5", 7, 7)].packet_count_fwd == 1
    r = rows[("10.0.0.5", 8, 9)]
    assert (r.packet_count_fwd, r.packet_count_bwd) == (0, 1)


def test_rejects_and_empty(spark):
    df = packets(spark, [(1, 0, None, 80, "b", 9, 6, 7), (2, 1, "a", 9, "b", 80, 1, 11)])
    assert fl.build_flows(df).count() == 0
    assert fl.build_flows(df.limit(0)).count() == 0


def plain(rows, idle=60 * S, active=120 * S):
    """The definition, packet by packet."""
    out, cur = {}, {}
    for i, t, key in sorted(rows, key=lambda r: (r[1], r[0])):
        st = cur.get(key)
        if st is None or t - st[1] > idle or t - st[0] > active:
            st = [t, t]
        st[1] = t
        cur[key] = st
        out[i] = st[0]
    return out


@pytest.mark.parametrize("seed, step, hot", [(1, 3.0, 25), (2, 30.0, 10), (3, 0.7, 100), (4, 11.0, 40), (5, 58.0, 12)])
def test_hot_chunks_match_definition(spark, seed, step, hot):
    """Random, periodic and bursty traffic; small chunks force carries over many chunk edges."""
    rng = random.Random(seed)
    rows, raw, i = [], [], 0
    for k in range(4):
        t = 0.0
        for _ in range(600 if k == 0 else 60):
            t += step if k == 0 and seed % 2 else rng.expovariate(1 / step)
            i += 1
            rows.append((i, round(t, 6), f"h{k}", 1, "z", 2, 6, 10))
            raw.append((i, round(round(t, 6) * S), k))
    want = plain(raw)
    for bucket in (step * 2, 60.0):
        got = fl.assign_flows(packets(spark, rows), hot_rows=hot, chunk_bucket_s=bucket)
        assert {r.event_id: r.flow_start_us for r in got.select("event_id", "flow_start_us").collect()} == want
    got = fl.assign_flows(packets(spark, rows), hot_rows=None)
    assert {r.event_id: r.flow_start_us for r in got.select("event_id", "flow_start_us").collect()} == want


def test_small_arrow_batches(spark):
    """Runs that span many Arrow batches keep their open flow."""
    rows = [(i, i * 0.9, "a", 1, "b", 2, 6, 10) for i in range(500)]
    want = plain([(i, round(i * 0.9 * S), 0) for i in range(500)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for hot in (None, 90):
            got = fl.assign_flows(packets(spark, rows), hot_rows=hot).select("event_id", "flow_start_us").collect()
            assert {r.event_id: r.flow_start_us for r in got} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_conservation(spark, sf):
    from wirefold.operators.packets import accept
    from wirefold.plans.fixtures import ACTIVE_S, IDLE_S, table
    p = table(spark, sf, "packets")
    f = fl.build_flows(p, IDLE_S, ACTIVE_S).agg(F.sum("packet_count_total"), F.sum("bytes_total"),
                                               F.sum(F.col("packet_count_fwd") + F.col("packet_count_bwd"))).first()
    a = accept(p).agg(F.count("*"), F.sum("ip_len")).first()
    assert (f[0], f[1], f[2]) == (a[0], a[1], a[0])


def test_swap_direction_keeps_keys(spark, sf):
    from wirefold.plans.fixtures import ACTIVE_S, IDLE_S, table
    p = table(spark, sf, "packets").where("src_ip is not null")
    q = p.select(*[c for c in p.columns if c not in ("src_ip", "src_port", "dst_ip", "dst_port")],
                 F.col("dst_ip").alias("src_ip"), F.col("dst_port").alias("src_port"), F.col("src_ip").alias("dst_ip"),
                 F.col("src_port").alias("dst_port"))
    k = ["pcap_file", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "start_us", "packet_count_total"]
    a, b = (fl.build_flows(x, IDLE_S, ACTIVE_S).select(*k) for x in (p, q))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_maps_of_short_chunks_stay_within_the_packets(spark, monkeypatch):
    """Chunks much shorter than the active timeout: maps held at one level have no more edges than there are packets."""
    rng, edges, cut = random.Random(7), [], fl.cut_lineage

    def watched(df):
        out = cut(df)
        if "edge" in out.columns:
            edges.append(out.agg(F.sum(F.size("edge"))).first()[0])
        return out

    df = one_key(spark, sorted(rng.uniform(0, 600) for _ in range(3000))).cache()
    want = starts(fl.build_flows(df, hot_rows=None))
    monkeypatch.setattr(fl, "cut_lineage", watched)
    assert starts(fl.build_flows(df, hot_rows=20)) == want
    assert edges and max(edges) <= 3000
