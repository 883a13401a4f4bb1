"""Streaming results against batch on ordered, shuffled and late input."""

import glob
import os
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from wirefold.operators import alerts as al
from wirefold.operators import flows as fl
from wirefold.registry import stream_queries
from wirefold.streaming import flows as st
from wirefold.streaming import run as rn
from wirefold.streaming import windows as sw

S = 1_000_000
COLS = ["pcap_file", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "start_us", "end_us", "packet_count_total",
        "bytes_total", "packet_count_fwd", "packet_count_bwd", "bytes_fwd", "bytes_bwd"]
DDL = ("event_id long, ts_us long, pcap_file string, src_ip string, src_port int, dst_ip string, dst_port int, "
       "protocol int, ip_len long")


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """A micro-batch costs a task per partition and operator, whatever it holds."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def rows(n):
    out, t = [], 0.0
    for i in range(n):
        t += [0.5, 3.0, 40.0, 61.0, 7.0][i % 5] / (1 + i % 3)
        a, b = ("h0", "h1") if i % 4 else ("h1", "h0")
        out.append((i, round(t * S), "f.pcap", a, 5, b, 6 if i % 7 else 5, 6, 40 + i % 9))
    return out


def hot_rows(seed, n):
    """Nine packets in ten have one key; long runs without a gap, equal times, and some idle gaps."""
    r, out, t = random.Random(seed), [], 0
    for i in range(n):
        t += r.choice([0, 1, 7, S // 3, 2 * S, 5 * S, 5 * S]) + (r.random() < 0.02) * r.choice([60, 61, 200, 400]) * S
        b = "h1" if r.random() < 0.9 else f"h{r.randrange(2, 6)}"
        src, dst = ("h0", b) if r.random() < 0.6 else (b, "h0")
        out.append((i, t, "f.pcap", src, 5, dst, 5, 6, r.randrange(40, 1500)))
    return out


def write(spark, path, parts):
    """One file per part, in arrival order."""
    for p in parts:
        df = spark.createDataFrame(p, DDL).withColumn("ts", F.timestamp_micros("ts_us"))
        df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def cut(data, files):
    size = -(-len(data) // files)
    return [data[i:i + size] for i in range(0, len(data), size)]


def run(spark, tmp_path, schema, delay, chunk_s=None):
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    pieces = st.stream_pieces(src, 60, 120, delay, chunk_s=chunk_s)
    out, progress = rn.drain_to(pieces, str(tmp_path / "out"), ["kind"])
    return out, st.open_flows(spark, str(tmp_path / "out/state"), 60, 120, chunk_s), progress


def same(a, b):
    a, b = a.select(*COLS), b.select(*COLS)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


@pytest.mark.parametrize("shuffled", [False, True])
def test_stream_equals_batch(spark, tmp_path, shuffled):
    sent = rows(200)
    if shuffled:
        for i in range(0, 200, 4):
            sent[i:i + 4] = reversed(sent[i:i + 4])
    schema = write(spark, str(tmp_path / "in"), cut(sent, 3))
    out, still, progress = run(spark, tmp_path, schema, "10 minutes")
    closed = st.closed_flows(out)
    assert closed.count() > 10 and st.late_packets(out).count() == 0
    same(closed.unionByName(still), fl.build_flows(spark.read.schema(schema).parquet(str(tmp_path / "in"))))
    c = progress.counters()
    assert c["input_rows"] == 200 and c["late_rows"] == 0 and c["batches"] >= 3


@pytest.mark.parametrize("chunk_s", [None, 7])
def test_hot_key_equals_batch(spark, tmp_path, chunk_s):
    data = hot_rows(3, 1500)
    schema = write(spark, str(tmp_path / "in"), cut(data, 3))
    out, still, _ = run(spark, tmp_path, schema, "20 seconds", chunk_s)
    same(st.closed_flows(out).unionByName(still), fl.build_flows(spark.createDataFrame(data, DDL)))
    # what stays in state: chunks that the watermark has not passed, and one row of totals per key
    state = str(tmp_path / "out/state")
    held = st._state(spark, state, "held").option("flattenCollectionTypes", True).load(state)
    spans = [int(r["n"]) for r in held.groupBy("key").agg(F.count("*").alias("n")).collect()]
    assert max(spans, default=0) <= 4  # one packed row per batch and chunk
    opened = st._state(spark, state, "open_flow").load(state)
    assert opened.count() == opened.select("key").distinct().count() <= 5


def test_late_packets_are_kept(spark, tmp_path):
    data = hot_rows(5, 900)
    late = [r for r in data if r[0] % 11 == 3 and r[0] < 400]
    parts = cut([r for r in data if r not in late], 3)
    parts[2] = parts[2] + late
    schema = write(spark, str(tmp_path / "in"), parts)
    out, still, progress = run(spark, tmp_path, schema, "10 seconds")
    kept = st.late_packets(out)
    wm = max(r[1] for p in parts[:2] for r in p) // 1000 * 1000 - 10 * S
    behind = {r[0] for r in parts[2] if r[1] < wm} | {r[0] for r in parts[1] if r[1] < max(
        x[1] for x in parts[0]) // 1000 * 1000 - 10 * S}
    names = ["pcap_file", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "ts_us", "ip_len"]
    want = spark.createDataFrame([r for r in data if r[0] in behind], DDL).select(*names)
    assert kept.count() == len(behind) > 20 and kept.select(*names).exceptAll(want).count() == 0
    same(st.closed_flows(out).unionByName(still),
         fl.build_flows(spark.createDataFrame([r for r in data if r[0] not in behind], DDL)))
    assert progress.counters()["late_rows"] == 0  # none is dropped by the engine


def test_idle_keys_leave_no_state(spark, tmp_path):
    data = rows(60)
    end = [(10 ** 6, data[-1][1] + 10_000 * S, "end", "x", 1, "y", 2, 17, 1)]
    schema = write(spark, str(tmp_path / "in"), [data, end])
    out, _, _ = run(spark, tmp_path, schema, "1 second")
    state = str(tmp_path / "out/state")
    assert st._state(spark, state, "open_flow").load(state).where("key.pcap_file <> 'end'").count() == 0
    same(st.closed_flows(out), fl.build_flows(spark.createDataFrame(data, DDL)))


@pytest.mark.parametrize("seed", range(6))
def test_chunk_maps_compose_to_the_fold(seed):
    """Chunks folded apart and joined by their edges give the flows of one fold over all packets."""
    r = np.random.default_rng(seed)
    ts = np.cumsum(r.choice([0, 1, 20, 59, 60, 61, 130], 400, p=[.2, .2, .3, .1, .1, .05, .05]))
    packets = np.stack([ts, r.integers(40, 1500, 400), r.integers(0, 2, 400)]).astype(np.int64)
    t, cum = st._running(packets)
    closed, last = st._fold(t, cum, None, 60, 120)
    whole = [*closed, last]
    for width in (50, 120, 1000):
        got, opened = [], None
        for c in np.unique(ts // width):
            done, run_, tail = st.close_chunk(packets[:, ts // width == c], 60, 120)
            through, opened = st._fold(run_[0], run_[1:], opened, 60, 120)
            got += through
            if tail is not None:
                got += [opened, *done]
                opened = tail
        assert sorted([*got, opened]) == sorted(whole)


def test_session_keeps_its_settings(spark, tmp_path):
    before = spark.conf.get(rn.PROVIDER)
    spark.conf.set(rn.PROVIDER, "other")
    try:
        with rn.settings(spark, {**rn.state_settings(spark), "spark.wirefold.none": "x"}):
            assert spark.conf.get(rn.PROVIDER) == rn.ROCKSDB and spark.conf.get("spark.wirefold.none") == "x"
        assert spark.conf.get(rn.PROVIDER) == "other" and spark.conf.get("spark.wirefold.none", None) is None
    finally:
        spark.conf.set(rn.PROVIDER, before)


# --- live alert join ------------------------------------------------------------------------------------------------

FLOW_DDL = "pcap_file string, src_ip string, src_port int, dst_ip string, dst_port int, protocol int, start_us long, end_us long"
ALERT_DDL = "alert_id long, src_ip string, src_port int, dest_ip string, dest_port int, proto string, t_us long"


def live(spark, tmp_path, alerts, flows, files=2):
    f = spark.createDataFrame(flows, FLOW_DDL).withColumn("end_ts", F.timestamp_micros("end_us"))
    a = spark.createDataFrame(alerts, ALERT_DDL).withColumn("alert_ts", F.timestamp_micros("t_us"))
    for name, df, col in (("f", f, "end_us"), ("a", a, "t_us")):
        rows = sorted(df.collect(), key=lambda r: r[col])
        for part in cut(rows, files) or [[]]:
            spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda n, df: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n))
    out, _ = rn.drain(sw.live_alert_status(read("a", a), read("f", f), 2, 120, "5 seconds"), "live")
    return out, a, f


def status(df):
    return sorted((r["alert_id"], r["n_candidates"], r["match_status"], r["flow"] and r["flow"]["start_us"])
                  for r in df.collect())


def sample(seed, n):
    r = random.Random(seed)
    flows, alerts = [], []
    for i in range(n):
        start = r.randrange(0, 4000) * S
        flows.append(("f", "a", 1, r.choice("bcd"), 2, 6, start, start + r.randrange(0, 120) * S))
    for i in range(n):
        dst, t = r.choice("bcdz"), r.randrange(0, 4200) * S
        alerts.append((i, "a", 1, dst, 2, "TCP", t) if i % 2 else (i, dst, 2, "a", 1, "tcp", t))
    return alerts + [(n, None, 1, "b", 2, "TCP", 5 * S), (n + 1, "a", 1, "b", 2, "icmp", 9 * S)], flows


def test_every_alert_has_one_status(spark, tmp_path):
    alerts, flows = sample(1, 80)
    out, a, f = live(spark, tmp_path, alerts, flows)
    want = al.match_status(a, al.candidates(a, f, 2, 120))
    settled = sw.settle_alerts(out, a, f, 2, 120)
    assert status(settled) == status(want)
    assert {x[2] for x in status(settled)} == {"matched_unique", "matched_ambiguous", "alert_unmatched"}
    early = status(out)
    assert len(early) > 30 and set(early) <= set(status(want))
    assert any(x[2] == "alert_unmatched" for x in early)


def test_alerts_without_flows(spark, tmp_path):
    alerts, flows = sample(2, 30)
    out, a, f = live(spark, tmp_path, alerts, [(*x[:3], "nowhere", *x[4:]) for x in flows])
    assert out.count() > 0 and {r["match_status"] for r in out.collect()} == {"alert_unmatched"}
    settled = sw.settle_alerts(out, a, f, 2, 120)
    assert status(settled) == sorted((x[0], 0, "alert_unmatched", None) for x in alerts)


def test_open_windows_are_put_out(spark, tmp_path):
    data = [(i, i * 1000 * S, "m", (i % 10) / 10) for i in range(30)]
    df = spark.createDataFrame(data, "event_id long, ts_us long, method string, y_score double").withColumn(
        "ts", F.timestamp_micros("ts_us"))
    df.write.parquet(str(tmp_path / "in"))
    counts = sw.alarm_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["method"], delay="10 seconds")
    out, _ = rn.drain_to(counts, str(tmp_path / "out"))
    still = sw.open_alarm_counts(spark, str(tmp_path / "out/state"), ["method"])
    got = sw.rates(out.unionByName(still), ["method"])
    want = sw.alarm_rate(df, ["method"])
    assert still.count() >= 1 and got.count() == want.count() and got.exceptAll(want).count() == 0


def test_session_window_gap_is_strict(spark):
    data = [(i, t, "f", "a", 1, "b", 2, 6, 1) for i, t in enumerate([0, 60 * S, 120 * S + 1])]
    df = spark.createDataFrame(data, DDL)
    got = sorted((r.start_us, r.packet_count_total) for r in
                 sw.session_flows(df.withColumn("ts", F.timestamp_micros("ts_us"))).collect())
    assert got == [(0, 2), (120 * S + 1, 1)]


def test_tasks_share_an_arrival_file(spark, tmp_path, monkeypatch):
    """One file per arrival, in order of time, each in row groups that tasks can share; no row is lost."""
    (spark.range(60_000).selectExpr(
        "id as event_id", "timestamp_micros(1704067200000000 + id * 21600000 + id % 7) as ts", "id % 5 as user_id",
        "'view' as event_type", "rand(1) as value", "concat('{\"k\":', id, '}') as props")
     .coalesce(1).write.parquet(str(tmp_path / "events.parquet")))
    monkeypatch.setattr(stream_queries, "ROW_GROUP_BYTES", 1 << 17, raising=False)
    folder, real = [], stream_queries.scratch_path
    monkeypatch.setattr(stream_queries, "scratch_path", lambda s, n: folder.append(real(s, n)) or folder[-1])
    stream_queries._arrivals(spark, str(tmp_path))
    files = sorted(glob.glob(folder[0].removeprefix("file:") + "/*.parquet"), key=os.path.getmtime)
    first = [spark.read.parquet(f).where("event_id % 50 <> 7").agg(F.min("event_id")).first()[0] for f in files]
    rows = [pq.ParquetFile(f).metadata for f in files]
    assert sum(m.num_rows for m in rows) == 60_000
    assert [i for i in first if i is not None] == sorted(i for i in first if i is not None)
    assert len(files) == 5 and all(m.num_row_groups > 2 for m in rows if m.num_rows > 15_000)
