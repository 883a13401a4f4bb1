"""Capture reader: both formats, all layers, and byte ranges of any size."""

import struct as st

import pytest

from wirefold.operators import packets as pk
from wirefold.sources import tables as tb
from wirefold.sources.captures import CaptureReader, read_captures


def ipv4(proto, src, dst, sport, dport, size, flags=0x12):
    l4 = st.pack("!HH", sport, dport) + (st.pack("!IIBBHHH", 1, 2, 0x50, flags, 64, 0, 0) if proto == 6
                                         else st.pack("!HH", 8, 0))
    body = l4 + bytes(max(0, size - 20 - len(l4)))
    head = st.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 1, 0, 64, proto, 0, bytes(src), bytes(dst))
    return head + body


def ether(payload, kind=0x0800):
    return bytes(12) + st.pack("!H", kind) + payload


def frames(n):
    out = []
    for i in range(n):
        if i % 10 == 3:
            f = ether(bytes(28), 0x0806)
        elif i % 10 == 7:
            f = ether(ipv4(1, (10, 0, 0, 1), (10, 0, 0, 2), 0, 0, 60))
        else:
            f = ether(ipv4(17 if i % 3 == 0 else 6, (10, 0, 0, i % 5), (10, 0, 1, i % 3), 1000 + i % 7, 80, 60 + i % 200))
        out.append((1_500_000_000_000_000 + i * 1500, f))
    return out


def classic(fs, order="<", nano=False):
    out = st.pack(order + "IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for us, f in fs:
        frac = us % 1_000_000 * (1000 if nano else 1)
        out += st.pack(order + "IIII", us // 1_000_000, frac, len(f), len(f)) + f
    return out


def block(kind, body):
    body += bytes(-len(body) % 4)
    n = len(body) + 12
    return st.pack("<II", kind, n) + body + st.pack("<I", n)


def ng(fs):
    out = block(0x0A0D0D0A, st.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    out += block(1, st.pack("<HHI", 1, 0, 65535) + st.pack("<HHB3x", 9, 1, 6) + st.pack("<HH", 0, 0))
    for us, f in fs:
        out += block(6, st.pack("<IIIII", 0, us >> 32, us & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


@pytest.mark.parametrize("make", [classic, lambda f: classic(f, ">"), lambda f: classic(f, "<", True), ng])
@pytest.mark.parametrize("split", [0, 3000])
def test_formats_and_splits(spark, tmp_path, make, split):
    fs = frames(300)
    (tmp_path / "Monday.pcap").write_bytes(make(fs))
    df = read_captures(spark, str(tmp_path), split)
    if split:
        assert df.rdd.getNumPartitions() > 3
    rows = df.orderBy("packet_no").collect()
    assert [r.ts_us for r in rows] == [us for us, _ in fs]
    assert {r.outcome: r.n_packets for r in pk.reject_counts(df).collect()} == {
        "accepted": 240, "skipped_no_ip": 30, "skipped_no_transport": 30}
    tcp = next(r for r in rows if r.protocol == 6)
    assert tcp.tcp_flags == 0x12 and tcp.dst_port == 80 and tcp.ip_len >= 60


def test_two_files_and_discovery(spark, tmp_path):
    (tmp_path / "b.pcap").write_bytes(classic(frames(20)))
    (tmp_path / "a.pcapng").write_bytes(ng(frames(30)))
    names = [f.rsplit("/", 1)[-1] for f in tb.discover_captures(spark, str(tmp_path))]
    assert names == ["b.pcap", "a.pcapng"]
    got = {r.pcap_file: r["count"] for r in read_captures(spark, str(tmp_path)).groupBy("pcap_file").count().collect()}
    assert got == {"b.pcap": 20, "a.pcapng": 30}


def test_missing_and_empty(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tb.discover_captures(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        tb.discover_captures(spark, str(tmp_path))
    assert tb.discover_csvs(spark, str(tmp_path)) == []


def test_other_packet_blocks_and_late_interfaces(spark, tmp_path):
    fs = frames(6)
    out = ng(fs[:2])
    out += block(3, st.pack("<I", len(fs[2][1])) + fs[2][1])
    us, f = fs[4]
    out += block(2, st.pack("<HHIIII", 0, 0, us >> 32, us & 0xFFFFFFFF, len(f), len(f)) + f)
    out += block(1, st.pack("<HHI", 1, 0, 300_000))  # an interface after packets, with microseconds
    us, f = fs[5][0], ether(ipv4(6, (10, 0, 0, 1), (10, 0, 1, 1), 5, 6, 20000))
    f += bytes(270_000)
    out += block(6, st.pack("<IIIII", 1, us >> 32, us & 0xFFFFFFFF, len(f), len(f)) + f)
    (tmp_path / "a.pcapng").write_bytes(out)
    rows = read_captures(spark, str(tmp_path), 0).orderBy("packet_no").collect()
    assert [r.ts_us for r in rows] == [fs[0][0], fs[1][0], None, fs[4][0], fs[5][0]]
    assert rows[2].src_ip == "10.0.0.2" and rows[4].ip_len == 20000
    got = {r.outcome: r.n_packets for r in pk.reject_counts(read_captures(spark, str(tmp_path), 0)).collect()}
    assert got == {"accepted": 4, "skipped_no_time": 1}


def test_planning_opens_no_file():
    """Ten thousand small captures share tasks, a large one is cut; none of the paths exists."""
    files = [(f"/nowhere/{i:05}.pcap", 2000 + i) for i in range(10_000)] + [("/nowhere/z.pcap", 1 << 30)]
    parts = CaptureReader(files, 128 << 20).partitions()
    ranges = [r for p in parts for r in p.parts]
    assert len(parts) < 120 and sum(r.stop - r.start for r in ranges) == sum(s for _, s in files)
    assert sum(r.path.endswith("z.pcap") for r in ranges) == 8 and all(r.last == (r.stop == dict(files)[r.path]) for r in ranges)
    assert len(CaptureReader(files[:5], 0).partitions()) == 1
    assert [r.stop for p in CaptureReader([("/nowhere/a.pcap", None)] * 3, 1 << 20).partitions() for r in p.parts] == [None] * 3


def test_many_small_captures(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"{i:03}.pcap").write_bytes(classic(frames(3 + i % 4)))
    df = read_captures(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 1
    got = {r.pcap_file: r["count"] for r in df.groupBy("pcap_file").count().collect()}
    assert got == {f"{i:03}.pcap": 3 + i % 4 for i in range(60)}


@pytest.mark.parametrize("order", ["<", ">"])
def test_pauses_of_days_at_every_split(spark, tmp_path, order):
    """Packets that lie two days, or a year, apart: every split still finds its first record."""
    fs = [(us + (i // 5) * 2 * 86_400_000_000 + (i // 90) * 366 * 86_400_000_000, f) for i, (us, f) in enumerate(frames(200))]
    (tmp_path / "a.pcap").write_bytes(classic(fs, order))
    df = read_captures(spark, str(tmp_path), 1500)
    assert [r.ts_us for r in df.orderBy("packet_no").collect()] == [us for us, _ in fs]
