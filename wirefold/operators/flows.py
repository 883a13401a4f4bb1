"""Bidirectional flows with idle and active timeouts.

A packet opens a new flow when its gap to the previous packet of the key exceeds the idle timeout, or when it lies
more than the active timeout after the start of the open flow. The second rule depends on every earlier decision, so
it is a fold over sorted packets: each key (and, for hot keys, each time chunk of the key) is one sorted run in a
partition and passes through `mapInArrow` in batches, with constant memory. Everything around the fold - keys,
sorting, totals - stays in Spark SQL, and flow totals are a partial-then-final aggregate on (key, flow start).

Hot keys. A key with more than `hot_rows` packets is cut into chunks of about `hot_rows` packets in time order. What
a chunk needs from the past is one number, the start of the flow still open at its left edge. Each chunk publishes
how it maps that number to the one at its right edge; the maps combine in a tree, down which the numbers come; then all
chunks fold in parallel. Parts of a flow that crosses chunks share its start and meet in the final aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wirefold.functions.columns import micros_to_seconds
from wirefold.operators.ordering import numbered
from wirefold.operators.packets import accept, with_key
from wirefold.schemas import I, L, S, struct
from wirefold.session import cut_lineage

# Idle and active timeouts in seconds.
IDLE_S, ACTIVE_S = 60.0, 120.0
HOT_ROWS = 4_000_000
KEY = ["pcap_file", "lo_ip", "lo_port", "hi_ip", "hi_port", "protocol"]
CHUNK, HASH = "_chunk", "_kh"
US = 1_000_000


# --- helpers that run inside tasks -------------------------------------------------------------------------------

def _starts(ts: np.ndarray, active: int, start: int) -> list[int]:
    """Positions at which the active timeout opens a flow, for one gap-free run that begins inside `start`'s flow."""
    out, i, n = [], 0, len(ts)
    while ts[-1] - start > active:
        i += int(np.searchsorted(ts[i:], start + active, side="right"))
        if i >= n:
            break
        out.append(i)
        start = int(ts[i])
    return out


def _key_change(batch: pa.RecordBatch, cols: list[str], last: tuple | None) -> np.ndarray:
    """Rows whose key differs from the row before. Rows are sorted by key hash, so a key that changes under one hash
    would be interleaved with another: that (one in about 10^19 pairs of one partition) is refused, not folded."""
    n = batch.num_rows
    change = np.zeros(n, dtype=bool)
    for c in cols:
        a = batch.column(c)
        if n > 1:
            change[1:] |= pc.not_equal(a.slice(1), a.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    first = _key_at(batch, cols, 0)
    change[0] = last is None or last != first
    if HASH in batch.schema.names and cols[0] != HASH:
        h = batch.column(HASH).to_numpy(zero_copy_only=False)
        if (change[1:] & (h[1:] == h[:-1])).any():
            raise ValueError("two keys share a hash in one partition; use exact_sort=True")
    return change


def _key_at(batch: pa.RecordBatch, cols: list[str], i: int) -> tuple:
    return tuple(batch.column(c)[i].as_py() for c in cols)


def _walk(cols: list[str], idle: int, active: int, batches: Iterator[pa.RecordBatch]):
    """(batch, flow start, gap to the previous packet of the flow, opens a flow) per batch of sorted packets."""
    last_key, last_ts, open_start = None, 0, 0
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        ts = batch.column("ts_us").to_numpy(zero_copy_only=False)
        new_key = _key_change(batch, cols, last_key)
        prev = np.empty(n, dtype=np.int64)
        prev[1:] = ts[:-1]
        prev[0] = last_ts
        fresh = new_key | (ts - prev > idle)
        carried = {}
        if "carry_start" in batch.schema.names:
            has = pc.is_valid(batch.column("carry_start")).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(new_key & has):
                carried[int(i)] = batch.column("carry_start")[int(i)].as_py()
                prev[i] = batch.column("carry_last")[int(i)].as_py()
        edges = np.flatnonzero(fresh)
        if len(edges) == 0 or edges[0] != 0:
            edges = np.concatenate(([0], edges))
        ends = np.concatenate((edges[1:], [n]))
        first = ts[edges].copy()
        if not fresh[0]:
            first[0] = open_start
        for i, s in carried.items():
            first[np.searchsorted(edges, i)] = s
        start = np.repeat(first, ends - edges)
        opens = fresh.copy()
        for i in carried:
            opens[i] = False
        for r in np.flatnonzero(ts[ends - 1] - first > active):
            a, b = int(edges[r]), int(ends[r])
            marks = _starts(ts[a:b], active, int(first[r]))
            for j, m in enumerate(marks):
                stop = marks[j + 1] if j + 1 < len(marks) else b - a
                start[a + m:a + stop] = ts[a + m]
                opens[a + m] = True
        last_key = _key_at(batch, cols, n - 1)
        last_ts, open_start = int(ts[-1]), int(start[-1])
        yield batch, start, np.where(opens, 0, ts - prev), opens, new_key


INNER = ("carry_start", "carry_last", "_chunk", "_kh")


def _fold(cols: list[str], idle: int, active: int):
    """Sorted packets in; the same packets with `flow_start_us`, `delta_us` and `opens` out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, start, delta, opens, _ in _walk(cols, idle, active, batches):
            keep = [c for c in batch.schema.names if c not in INNER]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(start), pa.array(delta), pa.array(opens)],
                names=[*keep, "flow_start_us", "delta_us", "opens"])

    return run


def _fold_totals(cols: list[str], idle: int, active: int):
    """Sorted packets in; one row of totals per flow and batch out, so that few rows leave the Python worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, start, _, opens, new_key in _walk(cols, idle, active, batches):
            cut = np.flatnonzero(opens | new_key)
            if len(cut) == 0 or cut[0] != 0:
                cut = np.concatenate(([0], cut))
            size = batch.column("ip_len").to_numpy(zero_copy_only=False).astype(np.int64)
            fwd = batch.column("fwd").to_numpy(zero_copy_only=False).astype(np.int64)
            ts = batch.column("ts_us").to_numpy(zero_copy_only=False)
            at = pa.array(cut)
            sums = [np.diff(np.append(cut, len(ts))), *(np.add.reduceat(x, cut) for x in (size, fwd, size * fwd))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(at) for c in KEY] + [pa.array(start[cut]), pa.array(np.maximum.reduceat(ts, cut))]
                + [pa.array(x.astype(np.int64)) for x in sums],
                names=[*KEY, "flow_start_us", "ts_us", "n", "bytes", "n_fwd", "bytes_fwd"])

    return run


def _chunk_map(ts: np.ndarray, idle: int, active: int) -> tuple[int, int | None, int, list[int], list[int]]:
    """(last ts, fixed right-edge start or None, right-edge start if nothing is open, map edges, map values)."""
    gaps = np.flatnonzero(np.diff(ts) > idle)
    if len(gaps):
        tail = ts[gaps[-1] + 1:]
        marks = _starts(tail, active, int(tail[0]))
        const = int(tail[marks[-1]]) if marks else int(tail[0])
        return int(ts[-1]), const, const, [], []
    u = np.unique(ts)
    ptr = np.searchsorted(u, u + active, side="right")
    ptr = np.where(ptr < len(u), ptr, np.arange(len(u)))
    while True:
        hop = ptr[ptr]
        if np.array_equal(hop, ptr):
            break
        ptr = hop
    final = u[ptr]
    m = min(len(u), int(np.searchsorted(u, u[0] + active, side="right")) + 1)
    edge, val = _squeeze(u[:m], final[:m])
    return int(ts[-1]), None, int(final[0]), edge.tolist(), val.tolist()


def _squeeze(edge: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = np.append(val[1:] != val[:-1], True) if len(val) else np.array([], dtype=bool)
    return edge[keep], val[keep]


def _apply_map(s: np.ndarray, active: int, last: int, edge: np.ndarray, val: np.ndarray) -> np.ndarray:
    x = s + active
    at = np.minimum(np.searchsorted(edge, x, side="right"), max(len(edge) - 1, 0))
    return np.where(x >= last, s, val[at] if len(val) else s)


_LONGS = T.ArrayType(T.LongType())
MAP_SCHEMA = struct(pcap_file=S, lo_ip=S, lo_port=I, hi_ip=S, hi_port=I, protocol=I, _chunk=L, first_ts=L, last_ts=L,
                    const_out=L, fresh_out=L, edge=_LONGS, val=_LONGS)


def _map_chunks(idle: int, active: int):
    cols = [*KEY, CHUNK]

    def emit(key, parts):
        ts = np.concatenate(parts)
        last, const, fresh, edge, val = _chunk_map(ts, idle, active)
        return [*key, int(ts[0]), last, const, fresh, edge, val]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, rows = None, [], []
        schema = pa.schema([(f.name, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(),
                                      "array<bigint>": pa.list_(pa.int64())}[f.dataType.simpleString()])
                            for f in MAP_SCHEMA])

        def table(rs):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rs], type=schema.field(i).type) for i in range(len(schema))], schema=schema)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            ts = batch.column("ts_us").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(_key_change(batch, cols, key))
            for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(ts)]))):
                if a in cut:
                    if parts:
                        rows.append(emit(key, parts))
                    parts, key = [], tuple(batch.column(c)[int(a)].as_py() for c in cols)
                if b > a:
                    parts.append(ts[a:b])
            if rows:
                yield table(rows)
                rows = []
        if parts:
            yield table([emit(key, parts)])

    return run


# --- Spark side --------------------------------------------------------------------------------------------------

def _chunk_plan(pk: DataFrame, hot_rows: int, bucket_us: int) -> DataFrame | None:
    """(key, bucket, chunk) for keys above `hot_rows`; None when there is no such key.

    The first aggregate combines map-side, so a hot key costs one row per task. A key's rows in the second window
    are its time buckets, bounded by the capture's length.
    """
    hot = pk.groupBy(*KEY).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).select(*KEY)
    if hot.isEmpty():
        return None
    hot = cut_lineage(hot)
    per = (pk.join(hot, KEY, "left_semi")
           .groupBy(*KEY, _bucket(bucket_us)).agg(F.count("*").alias("_n")))
    w = Window.partitionBy(*KEY).orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(w), F.lit(0))
    return cut_lineage(per.select(*KEY, "_tb", F.floor(before / hot_rows).cast("bigint").alias(CHUNK)))


def _bucket(bucket_us: int):
    return F.floor(F.col("ts_us") / bucket_us).cast("bigint").alias("_tb")


FAN = 8  # maps combined per task call


def _rows(table: pa.Table) -> Iterator[tuple]:
    """(last_ts, fixed, out, edge, val) of neighbouring maps in time order."""
    table = table.combine_chunks()
    last, fixed, out = (table.column(c).to_pylist() for c in ("last_ts", "fixed", "out"))
    edge, val = table.column("edge"), table.column("val")
    for i in range(table.num_rows):
        yield last[i], fixed[i], out[i], edge[i].values.to_numpy(), val[i].values.to_numpy()


def _through(row: tuple, start: int, active: int) -> int:
    """The start at a map's right edge, for the start of the flow open at its left edge."""
    last, fixed, out, edge, val = row
    return out if fixed else int(_apply_map(np.array([start]), active, last, edge, val)[0])


def _combine(active: int, schema: pa.Schema):
    """Maps of neighbours to the one map of them all."""

    def run(key, table):
        table = table.sort_by("_i")
        fixed, out, first, last = False, 0, table.column("first_ts")[0].as_py(), 0
        edge = val = np.array([], np.int64)
        for row in _rows(table):
            last, _, _, ea, va = row
            if fixed or row[1]:
                fixed, out = True, _through(row, out, active)
                continue
            e = np.concatenate((edge, ea))
            v = np.concatenate((_apply_map(val, active, last, ea, va), va))
            m = int(np.searchsorted(e, first + active, side="right")) + 1
            edge, val = _squeeze(e[:m], v[:m])
        if fixed:
            edge = val = np.array([], np.int64)
        return pa.table([[x] for x in (*(k.as_py() for k in key), first, last, fixed, out, edge, val)], schema=schema)

    return run


def _spread(active: int, schema: pa.Schema):
    """Neighbours, with the start at the left edge of the first, to the start at the left edge of each."""

    def run(key, table):
        table = table.sort_by("_i")
        at = [table.column("carry_start")[0].as_py()]
        for row in _rows(table.slice(0, table.num_rows - 1)):
            at.append(_through(row, at[-1], active))
        return pa.table([*(table.column(c) for c in (*KEY, "_i")), pa.array(at, pa.int64())], schema=schema)

    return run


def _carry(hot_packets: DataFrame, idle: int, active: int) -> DataFrame:
    """Per chunk of a hot key: start of the flow open at its left edge and the time of the packet before it.

    Maps combine upwards in a tree of FAN branches, and the starts come down it. A map has at most one edge per packet time
    of one active timeout, and a level at most as many edges as there are packets, so neither a task call nor a level
    holds more however short the chunks are.
    """
    cols = [*KEY, CHUNK]
    maps = cut_lineage(hot_packets.select(*cols, "ts_us").repartition(*cols).sortWithinPartitions(*cols, "ts_us")
                       .mapInArrow(_map_chunks(idle, active), MAP_SCHEMA))
    w = Window.partitionBy(*KEY).orderBy(CHUNK)
    places = (maps.select(*cols, "first_ts", "last_ts").withColumn("_i", F.row_number().over(w).cast("bigint") - 1)
              .withColumn("_prev_last", F.lag("last_ts").over(w))
              .withColumn("_joined", F.coalesce(F.col("first_ts") - F.col("_prev_last") <= idle, F.lit(False))))
    places = cut_lineage(places.select(*cols, "_i", "_prev_last", "_joined"))
    out = F.when(F.col("_joined"), F.col("const_out")).otherwise(F.coalesce("const_out", "fresh_out"))
    level = (maps.join(places, cols).withColumn("_out", out).withColumn("fixed", F.col("_out").isNotNull())
             .select(*KEY, "_i", "first_ts", "last_ts", "fixed", F.coalesce("_out", F.lit(0)).alias("out"), "edge", "val"))
    levels = [cut_lineage(level)]
    block = F.floor(F.col("_i") / FAN).cast("bigint")
    while levels[-1].where("_i > 0").limit(1).count():
        up = levels[-1].withColumn("_up", block).groupBy(*KEY, "_up").applyInArrow(
            _combine(active, to_arrow_schema(levels[0].schema)), levels[0].schema)
        levels.append(cut_lineage(up))
    # The first chunk of a key is joined to none before it, so the start that it gets is never read.
    carry = levels.pop().select(*KEY, "_i", F.lit(0).cast("bigint").alias("carry_start"))
    at = carry.schema
    for level in reversed(levels):
        below = level.withColumn("_up", block).join(carry.withColumnRenamed("_i", "_up"), [*KEY, "_up"])
        carry = cut_lineage(below.groupBy(*KEY, "_up").applyInArrow(_spread(active, to_arrow_schema(at)), at))
    return (places.where("_joined").select(*KEY, CHUNK, "_i", F.col("_prev_last").alias("carry_last"))
            .join(carry, [*KEY, "_i"]).select(*KEY, CHUNK, "carry_start", "carry_last"))


def _sorted_runs(packets: DataFrame, idle_s: float, active_s: float, hot_rows: int | None,
                 chunk_bucket_s: float | None, tie: str, keep: list[str] | None, exact_sort: bool):
    """Keyed packets, partitioned and sorted so that every key (or chunk of a hot key) is one run; and the run key.

    Sorting goes by a 64-bit hash of the key, then time: two long comparisons instead of five text ones.
    """
    idle, active = round(idle_s * US), round(active_s * US)
    pk = with_key(accept(packets))
    if keep is not None:
        pk = pk.select(*dict.fromkeys([*KEY, "ts_us", "fwd", *keep, *([tie] if tie in pk.columns else [])]))
    cols, keys = pk.columns, list(KEY)
    # Counting rows needs no column, so a small input is settled from file footers alone.
    look = hot_rows is not None and packets.count() > hot_rows
    # Chunks are whole buckets of a tenth of the idle timeout, so one overshoots `hot_rows` by a bucket at most.
    bucket_us = round((chunk_bucket_s or idle_s / 10) * US)
    plan = _chunk_plan(pk, hot_rows, bucket_us) if look else None
    if plan is not None:
        tagged = (pk.withColumn("_tb", _bucket(bucket_us))
                  .join(plan, [*KEY, "_tb"], "left").drop("_tb"))
        carry = cut_lineage(_carry(tagged.where(F.col(CHUNK).isNotNull()), idle, active))
        pk = (tagged.withColumn(CHUNK, F.coalesce(CHUNK, F.lit(0).cast("bigint")))
              .join(carry, [*KEY, CHUNK], "left"))
        keys = [*KEY, CHUNK]
    pk = pk.select(*cols, *[c for c in pk.columns if c not in cols])
    order = [*keys] if exact_sort else [HASH]
    if not exact_sort:
        pk = pk.withColumn(HASH, F.xxhash64(*keys))
    order += ["ts_us"] + ([tie] if tie in cols else [])
    return pk.repartition(*keys).sortWithinPartitions(*order), cols, keys, idle, active


def assign_flows(packets: DataFrame, idle_s: float = IDLE_S, active_s: float = ACTIVE_S,
                 hot_rows: int | None = HOT_ROWS, chunk_bucket_s: float | None = None, tie: str = "event_id",
                 keep: list[str] | None = None, exact_sort: bool = False) -> DataFrame:
    """Accepted packets with key columns, `fwd`, `flow_start_us`, `delta_us` (gap inside the flow, first 0), `opens`.

    `keep` names the other packet columns to carry (all by default): the fold hides unused columns from the optimizer.
    `hot_rows=None` skips the look for hot keys (a row count, then one column-pruned counting pass on large inputs).
    """
    runs, cols, keys, idle, active = _sorted_runs(packets, idle_s, active_s, hot_rows, chunk_bucket_s, tie, keep,
                                                  exact_sort)
    schema = T.StructType([T.StructField(c, runs.schema[c].dataType) for c in cols]
                          + [T.StructField("flow_start_us", L), T.StructField("delta_us", L),
                             T.StructField("opens", T.BooleanType())])
    return runs.mapInArrow(_fold(keys, idle, active), schema)


def plain_totals(packets: DataFrame, idle_s: float = IDLE_S, active_s: float = ACTIVE_S,
                 hot_rows: int | None = HOT_ROWS, chunk_bucket_s: float | None = None,
                 exact_sort: bool = False) -> DataFrame:
    """Flow totals without statistics: the fold itself adds up, and Spark merges the parts of a flow."""
    runs, _, keys, idle, active = _sorted_runs(packets, idle_s, active_s, hot_rows, chunk_bucket_s, "ts_us", ["ip_len"],
                                               exact_sort)
    schema = T.StructType([T.StructField(c, runs.schema[c].dataType) for c in KEY] + [
        T.StructField(c, L) for c in ("flow_start_us", "ts_us", "n", "bytes", "n_fwd", "bytes_fwd")])
    parts = runs.mapInArrow(_fold_totals(keys, idle, active), schema)
    g = parts.groupBy(*KEY, F.col("flow_start_us").alias("start_us")).agg(
        F.max("ts_us").alias("end_us"), F.sum("n").alias("packet_count_total"), F.sum("bytes").alias("bytes_total"),
        F.sum("n_fwd").alias("packet_count_fwd"), F.sum("bytes_fwd").alias("bytes_fwd"))
    return g.select(*KEY, "start_us", "end_us", "packet_count_total", "bytes_total", "packet_count_fwd",
                    (F.col("packet_count_total") - F.col("packet_count_fwd")).alias("packet_count_bwd"), "bytes_fwd",
                    (F.col("bytes_total") - F.col("bytes_fwd")).alias("bytes_bwd"))


def flow_totals(assigned: DataFrame, stats: bool = False, flags: bool = False) -> DataFrame:
    """One row per flow in integer microseconds; partial aggregation keeps a hot flow to one row per task."""
    n_fwd = F.sum(F.col("fwd").cast("bigint"))
    aggs = [
        F.max("ts_us").alias("end_us"), F.count("*").alias("packet_count_total"),
        F.sum("ip_len").cast("bigint").alias("bytes_total"), n_fwd.alias("packet_count_fwd"),
        (F.count("*") - n_fwd).alias("packet_count_bwd"),
        F.sum(F.when(F.col("fwd"), F.col("ip_len")).otherwise(0)).cast("bigint").alias("bytes_fwd"),
        F.sum(F.when(F.col("fwd"), 0).otherwise(F.col("ip_len"))).cast("bigint").alias("bytes_bwd"),
    ]
    if stats:
        aggs += _size_and_gap_stats()
    if flags:
        aggs += flag_counts()
    return assigned.groupBy(*KEY, F.col("flow_start_us").alias("start_us")).agg(*aggs)


def _size_and_gap_stats():
    size = F.col("ip_len").cast("bigint")
    gap = F.when(~F.col("opens"), F.col("delta_us"))
    return [F.min(size).alias("size_min"), F.max(size).alias("size_max"), F.min(gap).alias("iat_min_us"), F.max(gap).alias("iat_max_us"),
            F.stddev_samp(size.cast("double")).alias("size_std"), F.avg(size.cast("double")).alias("size_mean"),
            F.avg(gap.cast("double")).alias("iat_mean_us"), F.stddev_samp(gap.cast("double")).alias("iat_std_us")]


# TCP flag bits.
TCP_FLAGS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32}


def flag_counts(col: str = "tcp_flags"):
    return [F.sum((F.coalesce(F.col(col), F.lit(0)).bitwiseAND(bit) != 0).cast("bigint")).alias(f"{name}_count")
            for name, bit in TCP_FLAGS.items()]


def build_flows(packets: DataFrame, idle_s: float = IDLE_S, active_s: float = ACTIVE_S, *,
                stats: bool = False, flags: bool = False, hot_rows: int | None = HOT_ROWS,
                number: bool = False) -> DataFrame:
    """Packets to flows: key, start and end, packet and byte totals by direction, optional statistics."""
    if stats or flags:
        keep = ["ip_len", *(["tcp_flags"] if flags else [])]
        totals = flow_totals(assign_flows(packets, idle_s, active_s, hot_rows, keep=keep), stats, flags)
    else:
        totals = plain_totals(packets, idle_s, active_s, hot_rows)
    flows = finish(totals)
    # Numbering reads its input several times (cuts, totals, rows), so the flows are stored first.
    return number_flows(cut_lineage(flows)) if number else flows


def finish(totals: DataFrame) -> DataFrame:
    """Flow totals with endpoint names and times in seconds."""
    flows = totals.withColumnsRenamed({"lo_ip": "src_ip", "lo_port": "src_port", "hi_ip": "dst_ip",
                                       "hi_port": "dst_port"})
    flows = flows.withColumn("duration_us", F.col("end_us") - F.col("start_us"))
    return flows.withColumns({"start_time": micros_to_seconds("start_us"), "end_time": micros_to_seconds("end_us"),
                              "duration_s": micros_to_seconds("duration_us")})


FLOW_ORDER = ["src_ip", "src_port", "dst_ip", "dst_port", "protocol"]


def number_flows(flows: DataFrame) -> DataFrame:
    """`flow_id` per capture file and `global_flow_id` over all files, both by (start, key)."""
    per_file = numbered(flows, ["pcap_file"], "start_us", FLOW_ORDER, "flow_id")
    return numbered(per_file, [], "start_us", ["pcap_file", *FLOW_ORDER], "global_flow_id")


def idle_sessions(packets: DataFrame, idle_s: float = IDLE_S, chunk_s: float | None = None) -> DataFrame:
    """Sessions split on idle gaps only, in SQL: pieces inside (key, time chunk), then pieces linked over chunks.

    The window over packets is bounded by the chunk (ten idle timeouts by default); the window over pieces by the
    capture's length, since a key has at most one piece per idle timeout and one more per chunk.
    """
    idle, chunk_s = round(idle_s * US), chunk_s or 10 * idle_s
    pk = with_key(accept(packets)).withColumn(CHUNK, F.floor(F.col("ts_us") / round(chunk_s * US)).cast("bigint"))
    w = Window.partitionBy(*KEY, CHUNK).orderBy("ts_us")
    opened = F.coalesce(F.col("ts_us") - F.lag("ts_us").over(w) > idle, F.lit(True))
    pk = pk.withColumn("_new", opened.cast("int"))
    piece = F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0))
    pieces = (pk.withColumn("_piece", piece).groupBy(*KEY, CHUNK, "_piece")
              .agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("b"), F.count("*").alias("n"),
                   F.sum("ip_len").cast("bigint").alias("bytes")))
    k = Window.partitionBy(*KEY).orderBy("a")
    opened = F.coalesce(F.col("a") - F.lag("b").over(k) > idle, F.lit(True)).cast("int")
    linked = pieces.withColumn("_open", opened).withColumn("_session", F.sum("_open").over(k))
    return (linked.groupBy(*KEY, "_session")
            .agg(F.min("a").alias("start_us"), F.max("b").alias("end_us"), F.sum("n").alias("packet_count_total"),
                 F.sum("bytes").alias("bytes_total")).drop("_session"))
