"""Flows from a live packet stream.

Packets are held per key and time chunk. When the watermark passes a chunk's end, the chunk is folded: flows that begin
after its first idle gap and end before its last one are final, whatever came before. What depends on the past is the
run of packets up to the first gap, and it depends on one number only, the start of the flow still open at the chunk's
left edge. So a closed chunk gives a map from that start to the flows of the run and the start at its right edge, kept as
running totals over the run's distinct times. A second operator, one per key, holds the open flow's totals alone and
sends them through the maps of its chunks in time order, a search per flow and not a step per packet. A hot key thus
spreads over its chunks; no state holds a list that grows with it. The result equals the batch result for every packet
that is on time.

A packet that lies before the watermark when it arrives is late: it is put out as a row of kind `late` in the same
batch, so on-time packets and late ones together are the input. The event time column is dropped before the stateful
operator, so the engine itself drops none.

An idle flow closes when the watermark has passed every chunk that could continue it, which keeps state to keys that are
really active. Flows still open when the input ends stay in state until a later event moves the watermark on, or until
`open_flows` reads them from there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wirefold.operators.flows import ACTIVE_S, IDLE_S, KEY, US
from wirefold.operators.packets import accept, with_key
from wirefold.schemas import I, L, S, struct

OPEN_FIELDS = ["start_us", "end_us", "packet_count_total", "bytes_total", "packet_count_fwd", "bytes_fwd"]
OPEN = struct(**{f: L for f in OPEN_FIELDS})
HELD = struct(packets=T.BinaryType())
FLOW, EDGE, TAIL, LATE, PACKETS, OPENED = "flow", "edge", "tail", "late", "packets", "open"

_IDENT = struct(pcap_file=S, lo_ip=S, lo_port=I, hi_ip=S, hi_port=I, protocol=I)
_TOTALS = [T.StructField(f, L) for f in OPEN_FIELDS]
# `edge` has the run before the first gap, and in its totals the flow that is open after the last gap, if there is one.
PIECES = T.StructType(_IDENT.fields + [T.StructField("kind", S), T.StructField("chunk", L)] + _TOTALS
                      + [T.StructField("run", T.BinaryType())])
OUT = T.StructType(_IDENT.fields + [T.StructField("kind", S)] + _TOTALS)


def _pack(*columns: np.ndarray) -> bytes:
    return np.stack([np.asarray(c, np.int64) for c in columns]).tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(n, -1)


def _fold(ts: np.ndarray, cum: np.ndarray, opened: tuple | None, idle: int, active: int):
    """Closed flows and the open one after the packets at distinct sorted times `ts`, with running totals `cum`, have
    been added to `opened`. One step per flow, not per packet."""
    closed, i, n = [], 0, len(ts)
    gaps = np.append(np.flatnonzero(np.diff(ts) > idle) + 1, n)
    while i < n:
        if opened is not None and (ts[i] - opened[1] > idle or ts[i] - opened[0] > active):
            closed.append(opened)
            opened = None
        start = opened[0] if opened else int(ts[i])
        stop = min(int(gaps[np.searchsorted(gaps, i, side="right")]), int(np.searchsorted(ts, start + active, side="right")))
        add = cum[:, stop - 1] - (cum[:, i - 1] if i else 0)
        before = opened[2:] if opened else (0, 0, 0, 0)
        opened = (start, int(ts[stop - 1]), *[int(a) + b for a, b in zip(add, before)])
        i = stop
    return closed, opened


def _running(packets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted times of (time, size, forward) columns and the running totals up to each."""
    ts, size, fwd = packets[:, np.argsort(packets[0], kind="stable")]
    last = np.flatnonzero(np.append(ts[1:] != ts[:-1], True))
    totals = np.stack([np.arange(1, len(ts) + 1), np.cumsum(size), np.cumsum(fwd), np.cumsum(size * fwd)])
    return ts[last], totals[:, last]


def close_chunk(packets: np.ndarray, idle: int, active: int) -> tuple[list[tuple], np.ndarray, tuple | None]:
    """Of one chunk: final flows, the first run with its running totals, and the flow open after the last gap."""
    ts, cum = _running(packets)
    gaps = np.flatnonzero(np.diff(ts) > idle)
    if not len(gaps):
        return [], np.vstack([ts, cum]), None
    m = int(gaps[0]) + 1
    closed, tail = _fold(ts[m:], cum[:, m:] - cum[:, m - 1:m], None, idle, active)
    return closed, np.vstack([ts[:m], cum[:, :m]]), tail


def _frame(key, rows: list[tuple], names: list[str], schema: T.StructType) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    for i, k in enumerate(KEY):
        out[k] = key[i]
    return out[schema.names]


class ChunkProcessor(StatefulProcessor):
    """Keyed by (key, chunk): holds the chunk's packets as packed columns and folds them when it is over."""

    def __init__(self, idle: int, active: int, chunk: int):
        self.idle, self.active, self.chunk = idle, active, chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        wm_us, kept = timerValues.getCurrentWatermarkInMs() * 1000, False
        for pdf in rows:
            p = pdf[["ts_us", "ip_len", "fwd"]].to_numpy(np.int64).T
            on_time = p[0] >= wm_us
            if on_time.any():
                self.held.appendValue((_pack(*p[:, on_time]),))
                kept = True
            if not on_time.all():
                yield _late_rows(key, p[:, ~on_time])
        if kept:
            self.handle.registerTimer((int(key[-1]) + 1) * self.chunk // 1000)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = (int(key[-1]) + 1) * self.chunk
        if timerValues.getCurrentWatermarkInMs() * 1000 < end:
            self.handle.registerTimer(end // 1000 + 1)
            yield pd.DataFrame()
            return
        parts = [_unpack(r[0], 3) for r in self.held.get()]
        self.held.clear()
        if parts:
            yield _pieces(key, np.concatenate(parts, axis=1), self.idle, self.active)
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def _late_rows(key, p: np.ndarray) -> pd.DataFrame:
    return _frame(key, [(LATE, int(key[-1]), t, t, 1, size, fwd, size * fwd, None) for t, size, fwd in p.T.tolist()],
                  ["kind", "chunk", *OPEN_FIELDS, "run"], PIECES)


def _pieces(key, packets: np.ndarray, idle: int, active: int) -> pd.DataFrame:
    """The rows of a closed chunk."""
    closed, run, tail = close_chunk(packets, idle, active)
    rows = [(FLOW, int(key[-1]), *c, None) for c in closed]
    rows.append((EDGE if tail is None else TAIL, int(key[-1]), *(tail or [0] * 6), _pack(*run)))
    return _frame(key, rows, ["kind", "chunk", *OPEN_FIELDS, "run"], PIECES)


def _through_edges(opened: tuple | None, edges: pd.DataFrame, idle: int, active: int):
    """Closed flows and the open one after the edges of closed chunks, in time order."""
    closed: list[tuple] = []
    for row in edges.sort_values("chunk").itertuples(index=False):
        run = _unpack(row.run, 5)
        done, opened = _fold(run[0], run[1:], opened, idle, active)
        closed += done
        if row.kind == TAIL:
            closed.append(opened)
            opened = tuple(int(getattr(row, f)) for f in OPEN_FIELDS)
    return closed, opened


def _flow_rows(key, rows: list[tuple]) -> pd.DataFrame:
    return _frame(key, [(FLOW, *r) for r in rows], ["kind", *OPEN_FIELDS], OUT)


class JoinProcessor(StatefulProcessor):
    """Keyed by key: holds the open flow's totals and sends them through the edges of closed chunks."""

    def __init__(self, idle: int, active: int, chunk: int):
        self.idle, self.active, self.chunk = idle, active, chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open_flow", OPEN)

    def _over(self, end: int) -> int:
        """End of the last chunk that could continue a flow whose last packet is at `end`."""
        return ((end + self.idle) // self.chunk + 1) * self.chunk

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        edges = []
        for pdf in rows:
            joined = pdf["kind"].isin([EDGE, TAIL])
            if joined.any():
                edges.append(pdf[joined])
            if not joined.all():
                yield pdf.loc[~joined, OUT.names]
        if edges:
            opened = tuple(self.open.get()) if self.open.exists() else None
            closed, opened = _through_edges(opened, pd.concat(edges), self.idle, self.active)
            self.open.update(opened)
            self.handle.registerTimer(-(-self._over(opened[1]) // 1000))
            yield _flow_rows(key, closed)
        else:
            yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        opened = tuple(self.open.get()) if self.open.exists() else None
        if opened is None:
            yield pd.DataFrame()
        elif timerValues.getCurrentWatermarkInMs() * 1000 >= self._over(opened[1]):
            self.open.clear()
            yield _flow_rows(key, [opened])
        else:
            self.handle.registerTimer(-(-self._over(opened[1]) // 1000))
            yield pd.DataFrame()

    def close(self) -> None:
        pass


_NAMES = {"lo_ip": "src_ip", "lo_port": "src_port", "hi_ip": "dst_ip", "hi_port": "dst_port"}


def _chunk_us(active_s: float, chunk_s: float | None) -> int:
    """Chunks end on whole milliseconds, as watermarks do."""
    return max(round((chunk_s or active_s) * 1000), 1) * 1000


def stream_pieces(packets: DataFrame, idle_s: float = IDLE_S, active_s: float = ACTIVE_S, delay: str = "10 seconds",
                  time_col: str = "ts", chunk_s: float | None = None) -> DataFrame:
    """Streaming packets (with event time `time_col` and `ts_us`) to rows of kind `flow` (closed flows) and `late`
    (packets behind the watermark), append mode. `closed_flows` and `late_packets` take the written table apart.

    `chunk_s` (the active timeout by default) is what a hot key is cut by, and how long its packets are held.
    """
    idle, active, chunk = round(idle_s * US), round(active_s * US), _chunk_us(active_s, chunk_s)
    pk = with_key(accept(packets)).withWatermark(time_col, delay)
    pk = pk.select(*KEY, F.expr(f"ts_us div {chunk} - if(ts_us % {chunk} < 0, 1, 0)").cast("bigint").alias("chunk"),
                   F.col("ts_us").cast("bigint").alias("ts_us"), F.col("fwd").cast("bigint").alias("fwd"),
                   F.coalesce("ip_len", F.lit(0)).cast("bigint").alias("ip_len"))
    pieces = pk.groupBy(*KEY, "chunk").transformWithStateInPandas(
        ChunkProcessor(idle, active, chunk), PIECES, "Append", "EventTime")
    return pieces.groupBy(*KEY).transformWithStateInPandas(JoinProcessor(idle, active, chunk), OUT, "Append", "EventTime")


def _with_bwd(flows: DataFrame) -> DataFrame:
    return flows.withColumns({
        "packet_count_bwd": F.col("packet_count_total") - F.col("packet_count_fwd"),
        "bytes_bwd": F.col("bytes_total") - F.col("bytes_fwd")}).drop("kind").withColumnsRenamed(_NAMES)


def closed_flows(table: DataFrame) -> DataFrame:
    """The flows of a table written by `stream_pieces`."""
    return _with_bwd(table.where(F.col("kind") == FLOW))


def late_packets(table: DataFrame) -> DataFrame:
    """The late packets of a table written by `stream_pieces`, with source and destination as they were sent."""
    fwd = F.col("packet_count_fwd") == 1
    way = {"src_ip": ("lo_ip", "hi_ip"), "src_port": ("lo_port", "hi_port"), "dst_ip": ("hi_ip", "lo_ip"),
           "dst_port": ("hi_port", "lo_port")}
    return table.where(F.col("kind") == LATE).select(
        "pcap_file", *[F.when(fwd, F.col(a)).otherwise(F.col(b)).alias(n) for n, (a, b) in way.items()], "protocol",
        F.col("start_us").alias("ts_us"), F.col("bytes_total").alias("ip_len"))


def _state(spark: SparkSession, checkpoint: str, variable: str):
    """A reader of the named state variable, of whichever operator holds it."""
    found = spark.read.format("state-metadata").load(checkpoint).select("operatorId", "operatorProperties").collect()
    at = next(r[0] for r in found if variable in json.dumps(r[1]))
    return spark.read.format("statestore").option("operatorId", at).option("stateVarName", variable)


def open_flows(spark: SparkSession, checkpoint: str, idle_s: float = IDLE_S, active_s: float = ACTIVE_S,
               chunk_s: float | None = None) -> DataFrame:
    """The end-of-input flush: the open flows and the held chunks that a finished query left in its state, folded into
    flows. Chunks fold each on their own; a key brings together only their edges."""
    idle, active = round(idle_s * US), round(active_s * US)
    held = _state(spark, checkpoint, "held").option("flattenCollectionTypes", True).load(checkpoint)
    held = held.select("key.*", F.col("list_element.packets").alias("run")).toDF(*KEY, "chunk", "run")
    pieces = held.groupBy(*KEY, "chunk").applyInPandas(
        lambda key, pdf: _pieces(key, np.concatenate([_unpack(b, 3) for b in pdf["run"]], axis=1), idle, active), PIECES)
    opened = _state(spark, checkpoint, "open_flow").load(checkpoint).select("key.*", "value.*").toDF(*KEY, *OPEN_FIELDS)
    opened = opened.select(*KEY, F.lit(OPENED).alias("kind"), F.lit(0).cast("bigint").alias("chunk"), *OPEN_FIELDS,
                           F.lit(None).cast("binary").alias("run"))

    def join(key, pdf):
        start = pdf.loc[pdf["kind"] == OPENED, OPEN_FIELDS].astype("int64")
        start = tuple(int(v) for v in start.iloc[0]) if len(start) else None
        closed, last = _through_edges(start, pdf[pdf["kind"].isin([EDGE, TAIL])], idle, active)
        return _flow_rows(key, closed + ([last] if last is not None else []))

    final = pieces.where(F.col("kind") == FLOW).select(*OUT.names)
    rest = pieces.where(F.col("kind") != FLOW).unionByName(opened).groupBy(*KEY).applyInPandas(join, OUT)
    return _with_bwd(final.unionByName(rest))
