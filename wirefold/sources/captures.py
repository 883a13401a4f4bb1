"""Capture files (classic pcap and pcapng) as a Spark data source.

A capture is read in byte ranges, one task each, so one very large file spreads over the cluster. A range that starts
inside a file finds its first record by looking for a run of consistent record headers; when a range ends, its task
checks that the place where it stopped is the place where the next range will start, and fails the job if not, so no
packet is lost or read twice unnoticed. `splitBytes=0` reads every file in one piece. The driver plans from the sizes
that the directory listing gives and opens no file; headers are read by tasks, and small captures share tasks.

Only the header fields of IPv4 TCP and UDP packets are kept; everything else is a row with NULL addresses or another
protocol, which the packet filter counts.
"""

from __future__ import annotations

import struct as st
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wirefold.schemas import CAPTURE_PACKET
from wirefold.sources.tables import discover_captures

# Fixed values of the two file formats.
PCAP_MAGIC = {0xA1B2C3D4: 1_000_000, 0xA1B23C4D: 1_000_000_000}  # time units per second
NG_SECTION, NG_INTERFACE, NG_PACKET, NG_SIMPLE, NG_ENHANCED = 0x0A0D0D0A, 1, 2, 3, 6
NG_BYTE_ORDER = 0x1A2B3C4D
LINK_ETHERNET, LINK_RAW, LINK_SLL = 1, 101, 113
LONGEST = 1 << 24  # bytes of a record where the file states no limit
OPTIONS = 1 << 16  # bytes that a block may hold beside the frame
RUN = 16
BATCH = 16_384
SPLIT = 128 << 20
OPEN_COST = 1 << 20  # bytes that opening a file counts as
BACK_S, AHEAD_S = 86_400, 20 * 366 * 86_400  # how far a record's time may lie before and after the one before it


@dataclass
class Range:
    """Bytes of a file; `stop` is None where its size was not known to the planner."""

    path: str
    start: int
    stop: int | None
    last: bool


@dataclass
class Ranges(InputPartition):
    parts: list[Range]


@dataclass
class Head:
    """What a reader must know from the start of the file."""

    ng: bool
    order: str
    body: int
    link: list
    per_s: list
    limit: int = 0

    def allow(self, snap: int) -> None:
        """Longest frame that the file announces; 0 stands for no limit."""
        self.limit = max(self.limit, snap if 0 < snap < LONGEST else LONGEST)

    def add_interface(self, body: bytes) -> None:
        self.link.append(st.unpack(self.order + "H", body[:2])[0])
        self.allow(st.unpack(self.order + "I", body[4:8])[0])
        self.per_s.append(_units(body[8:], self.order))


def _open(path: str):
    filesystem, local = pafs.FileSystem.from_uri(path)
    return filesystem.open_input_file(local)


def read_head(f) -> Head:
    magic = f.read_at(24, 0)
    if len(magic) < 24:
        raise ValueError("file too short for a capture header")
    for order in "<>":
        m = st.unpack(order + "I", magic[:4])[0]
        if m in PCAP_MAGIC:
            head = Head(False, order, 24, [st.unpack(order + "I", magic[20:24])[0] & 0xFFFF], [PCAP_MAGIC[m]])
            head.allow(st.unpack(order + "I", magic[16:20])[0])
            return head
    if st.unpack("<I", magic[:4])[0] != NG_SECTION:
        raise ValueError("not a capture file")
    order = "<" if st.unpack("<I", magic[8:12])[0] == NG_BYTE_ORDER else ">"
    head, at = Head(True, order, 0, [], []), 0
    while True:
        kind, size = _block(f, head, at)
        if kind == NG_INTERFACE:
            head.add_interface(f.read_at(size - 12, at + 8))
        elif kind != NG_SECTION or at > 0:
            break
        at += size
    head.body = at
    return head


def _units(options: bytes, order: str) -> int:
    """Timestamp units per second from the interface options; microseconds by default."""
    i = 0
    while i + 4 <= len(options):
        code, n = st.unpack(order + "HH", options[i:i + 4])
        if code == 0:
            break
        if code == 9 and n:
            v = options[i + 4]
            return 2 ** (v & 0x7F) if v & 0x80 else 10 ** v
        i += 4 + (n + 3) // 4 * 4
    return 1_000_000


def _block(f, head: Head, at: int) -> tuple[int, int]:
    raw = f.read_at(8, at)
    return st.unpack(head.order + "II", raw) if len(raw) == 8 else (-1, 0)


def _next(f, head: Head, at: int, size: int, prev: float | None) -> tuple[int, float | None] | None:
    """Offset after the record at `at` and its time, or None when the bytes there do not look like a record."""
    if head.ng:
        kind, n = _block(f, head, at)
        if n < 12 or n % 4 or n > head.limit + OPTIONS or at + n > size or kind > 0x80000000 or kind == 0:
            return None
        tail = f.read_at(4, at + n - 4)
        return (at + n, None) if st.unpack(head.order + "I", tail)[0] == n else None
    raw = f.read_at(16, at)
    if len(raw) < 16:
        return None
    sec, frac, incl, orig = st.unpack(head.order + "IIII", raw)
    if frac >= head.per_s[0] or incl > head.limit or incl > orig or incl == 0 or at + 16 + incl > size:
        return None
    if prev is not None and not -BACK_S <= sec - prev <= AHEAD_S:  # captures may pause for days
        return None
    return at + 16 + incl, float(sec)


def find_record(f, head: Head, at: int, size: int) -> int:
    """First offset >= `at` from which a run of consistent records starts (or reaches the end of the file)."""
    pos = max(at, head.body)
    if head.ng:
        pos = (pos + 3) // 4 * 4
    while pos < size:
        cur, t, n = pos, None, 0
        while n < RUN and cur < size:
            step = _next(f, head, cur, size, t)
            if step is None:
                break
            cur, t = step
            n += 1
        if n == RUN or (cur == size and n > 0):
            return pos
        pos += 4 if head.ng else 1
    return size


def _payload(link: int, data: bytes) -> bytes | None:
    """IPv4 packet inside a link-layer frame, or None."""
    if link == LINK_RAW:
        return data if data and data[0] >> 4 == 4 else None
    at, kind = (12, data[12:14]) if link == LINK_ETHERNET else (14, data[14:16]) if link == LINK_SLL else (0, b"")
    while kind in (b"\x81\x00", b"\x88\xa8"):
        at += 4
        kind = data[at:at + 2]
    return data[at + 2:] if kind == b"\x08\x00" else None


def _fields(link: int, data: bytes) -> tuple:
    """(src_ip, dst_ip, src_port, dst_port, protocol, ip_len, tcp_flags); NULLs where a layer is missing."""
    ip = _payload(link, data)
    if ip is None or len(ip) < 20:
        return None, None, None, None, None, None, None
    head, proto = (ip[0] & 15) * 4, ip[9]
    src, dst = ".".join(map(str, ip[12:16])), ".".join(map(str, ip[16:20]))
    size = st.unpack("!H", ip[2:4])[0]
    l4 = ip[head:]
    first = not st.unpack("!H", ip[6:8])[0] & 0x1FFF
    if proto not in (6, 17) or len(l4) < 4 or not first:
        return src, dst, None, None, proto if proto not in (6, 17) else None, size, None
    sport, dport = st.unpack("!HH", l4[:4])
    return src, dst, sport, dport, proto, size, (l4[13] if proto == 6 and len(l4) > 13 else None)


def records(f, head: Head, start: int, stop: int, size: int) -> Iterator[tuple[int, int | None, int, bytes]]:
    """(offset, time in ns, link type, frame) of records beginning in [start, stop); last value is the end offset.

    Simple packet blocks carry no time and belong to the first interface. Interfaces and sections that follow packets are
    taken up on the way; a range that begins inside the file cannot number them and refuses.
    """
    inside = start != head.body
    at = start
    while at < min(stop, size):
        if head.ng:
            kind, n = _block(f, head, at)
            if n < 12 or at + n > size:
                raise ValueError(f"damaged block at byte {at}")
            if kind in (NG_SECTION, NG_INTERFACE) and inside:
                raise ValueError("interface or section after packets: read the capture with splitBytes=0")
            if kind == NG_SECTION:
                if stop < size:
                    raise ValueError("capture with several sections: read it with splitBytes=0")
                head.order = "<" if st.unpack("<I", f.read_at(4, at + 8))[0] == NG_BYTE_ORDER else ">"
                head.link, head.per_s = [], []
                n = _block(f, head, at)[1]
            elif kind == NG_INTERFACE:
                head.add_interface(f.read_at(n - 12, at + 8))
            elif kind in (NG_ENHANCED, NG_PACKET):
                raw = f.read_at(n - 12, at + 8)
                itf, hi, lo, incl, _ = st.unpack(head.order + "IIIII", raw[:20])
                if kind == NG_PACKET:  # the obsolete block holds a drop count beside the interface
                    itf = st.unpack(head.order + "HH", raw[:4])[0]
                if itf >= len(head.link):
                    raise ValueError(f"interface {itf} is not described before byte {at}: read it with splitBytes=0")
                yield at, ((hi << 32) | lo) * 1_000_000_000 // head.per_s[itf], head.link[itf], raw[20:20 + incl]
            elif kind == NG_SIMPLE:
                raw = f.read_at(n - 12, at + 8)
                yield at, None, head.link[0], raw[4:4 + st.unpack(head.order + "I", raw[:4])[0]]
            at += n
        else:
            raw = f.read_at(16, at)
            if len(raw) < 16:
                break
            sec, frac, incl, _ = st.unpack(head.order + "IIII", raw)
            if at + 16 + incl > size:
                break
            yield at, sec * 1_000_000_000 + frac * 1_000_000_000 // head.per_s[0], head.link[0], f.read_at(incl, at + 16)
            at += 16 + incl
    yield at, -1, -1, b""


class _Buffered:
    """Positioned reads served from one window, so small header reads do not each go to storage."""

    def __init__(self, f, window: int = 4 << 20):
        self.f, self.window, self.at, self.buf = f, window, 0, b""

    def read_at(self, n: int, at: int) -> bytes:
        if at < self.at or at + n > self.at + len(self.buf):
            self.at, self.buf = at, self.f.read_at(max(n, self.window), at)
        i = at - self.at
        return self.buf[i:i + n]


class CaptureReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int | None]], split_bytes: int):
        self.files, self.split = files, split_bytes

    def partitions(self) -> list[Ranges]:
        """Large files in ranges of their own, small ones together up to the size of a range."""
        out, held, cost = [], [], 0
        for path, size in self.files:
            step = self.split or max(size or 1, 1)
            starts = list(range(0, max(size or 1, 1), step))
            for s in starts:
                part = Range(path, s, None if size is None else min(s + step, size), s == starts[-1])
                weight = OPEN_COST + (0 if size is None else part.stop - s)
                if held and (cost + weight > (self.split or SPLIT) or size is None):
                    out.append(Ranges(held))
                    held, cost = [], 0
                held.append(part)
                cost += weight
        return [*out, Ranges(held)] if held else out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for part in partition.parts:
            yield from self._read(part)

    def _read(self, part: Range) -> Iterator[pa.RecordBatch]:
        with _open(part.path) as raw:
            size = raw.size()
            stop = size if part.stop is None else part.stop
            f = _Buffered(raw)
            head = read_head(f)
            start = head.body if part.start == 0 else find_record(f, head, part.start, size)
            name = part.path.rstrip("/").rsplit("/", 1)[-1]
            rows, end = [], start
            for at, ns, link, frame in records(f, head, start, stop, size):
                end = at
                if link < 0:
                    break
                time = (None, None) if ns is None else (ns // 1000, ns / 1e9)
                rows.append((name, at, *time, *_fields(link, frame)))
                if len(rows) >= BATCH:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)
            if not part.last and find_record(f, head, stop, size) != max(end, start):
                raise ValueError(f"{part.path}: no safe split near byte {stop}; read it with splitBytes=0")


# `packet_no` is the byte offset of the record: it orders packets within a file and is stable over any split.
_SCHEMA = pa.schema([("pcap_file", pa.string()), ("packet_no", pa.int64()), ("ts_us", pa.int64()),
                     ("timestamp", pa.float64()), ("src_ip", pa.string()), ("dst_ip", pa.string()),
                     ("src_port", pa.int32()), ("dst_port", pa.int32()), ("protocol", pa.int32()),
                     ("ip_len", pa.int32()), ("tcp_flags", pa.int32())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, type=_SCHEMA.field(i).type) for i, c in enumerate(cols)],
                                      schema=_SCHEMA)


class CaptureSource(DataSource):
    """`spark.read.format("capture").option("files", <lines of size, tab, path>)`; a line may be a path alone."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self):
        return CAPTURE_PACKET

    def reader(self, schema) -> CaptureReader:
        files = [line.rpartition("\t")[::2] for line in self.options["files"].split("\n")]
        files = [(path, int(size) if size else None) for size, path in files]
        return CaptureReader(files, int(self.options.get("splitbytes", SPLIT)))


def read_captures(spark, path: str, split_bytes: int = SPLIT):
    """Packets of one capture or of all captures of a directory."""
    spark.dataSource.register(CaptureSource)
    files = "\n".join(f"{size}\t{p}" for p, size in discover_captures(spark, path, sizes=True))
    return spark.read.format("capture").option("files", files).option("splitBytes", str(split_bytes)).load()
