"""CSV records with quoted breaks, encodings and headers; logs under changing headers."""

import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wirefold.operators import labeling as lb
from wirefold.sources import records as rec
from wirefold.sources import tables as tb

CELL = st.text(alphabet='a,"\n x', max_size=6)


def as_text(rows):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    return out.getvalue()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(CELL, min_size=2, max_size=4), min_size=1, max_size=8), st.lists(st.integers(0, 200), max_size=4))
def test_blocks_compose_to_the_records(rows, cuts):
    """Whatever lines a block begins at, blocks joined by `owners` give the records of one reader."""
    text = as_text(rows).encode()
    lines = text.split(b"\n")[:-1]
    bounds = sorted({0, *[c % len(lines) for c in cuts]})
    blocks = [lines[a:b] for a, b in zip(bounds, [*bounds[1:], len(lines)])]
    edges = []
    for at, block in zip(bounds, blocks):
        states, closes = [False, True], False
        for line in block:
            if b'"' in line:
                states = [rec.inside_after(line, s) for s in states]
                closes = closes or not states[1]
        edges.append(("f", at, *states, closes))
    owner = rec.owners(edges)
    done, parts = [], {}
    for at, block in zip(bounds, blocks):
        begun = owner.get(("f", at))
        r = rec.Records(begun is not None)
        begun = at if begun is None else begun
        for i, line in enumerate(block):
            for found in r.add(line):
                if begun != at:
                    parts.setdefault(begun, []).append(found)
                    begun = at
                else:
                    done.append((at, i, found))
        if r.held:
            parts.setdefault(begun, []).append(b"\n".join(r.held))
    got = [rec.fields(x.decode()) for _, _, x in sorted([*done, *[(a, 1 << 20, b"\n".join(p)) for a, p in parts.items()]])]
    assert got == [x for x in csv.reader(io.StringIO(text.decode(), newline=""))]


def test_open_quote_is_an_error():
    with pytest.raises(ValueError, match="open"):
        rec.owners([("f", 0, True, True, False), ("f", 9, False, True, False)])


def test_quoted_breaks_over_splits(spark, tmp_path):
    """Files large enough for many splits, with records that run over lines and splits."""
    r, want = random.Random(1), []
    for name in ("a.csv", "b.csv"):
        rows = [["id", " Label ", "note"]]
        for i in range(3000):
            note = r.choice(["", "plain", 'say "x", y', "two\nlines", "w " * 300 + "\n" * r.randrange(1, 40) + "end"])
            rows.append([f"{name}{i}", f"L{i % 7}", note])
        (tmp_path / name).write_text(as_text(rows), newline="")
        want += [(x[0], x[1], x[2] or None) for x in rows[1:]]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = tb.read_label_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
        assert df.columns == ["id", "Label", "note", "pcap_file"]
        got = [(x["id"], x["Label"], x["note"]) for x in df.collect()]
        first = tb.read_label_csv(spark, str(tmp_path / "a.csv"), nrows=5).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted(x["id"] for x in first) == [f"a.csv{i}" for i in range(5)]


def test_bad_records(spark, tmp_path):
    head = b"\xef\xbb\xbf\n Source IP ,Label,Label\r\n"
    (tmp_path / "a.csv").write_bytes(head + b'1,x,"y\r\nz"\r\n\r\n  \r\n2,x,y,\r\n3\r\n4,"q ""r""",\xe9\r\n')
    (tmp_path / "b.csv").write_bytes(b"label,source ip\nB,9\n")
    (tmp_path / "c.csv").write_bytes(b"")
    rows, heads = tb.label_files(spark, [str(tmp_path / f"{n}.csv") for n in "abc"])
    assert rows.columns == ["Source IP", "Label", "Label.1", "pcap_file"]
    got = sorted(tuple(r) for r in rows.collect())
    assert got == [("1", "x", "y\r\nz", "a.csv"), ("3", None, None, "a.csv"), ("4", 'q "r"', "é", "a.csv"),
                   ("9", "B", None, "b.csv")]
    assert {r["pcap_file"]: (r["columns_count"], r["label_column"]) for r in heads.collect()} == {
        "a.csv": (3, "Label"), "b.csv": (2, "label")}
    s = {(r["pcap_file"], r["label"]): (r["n"], r["columns_count"]) for r in lb.label_summary(rows, heads=heads).collect()}
    assert s == {("a.csv", "x"): (1, 3), ("a.csv", 'q "r"'): (1, 3), ("a.csv", None): (1, 3), ("b.csv", "B"): (1, 2)}
    (tmp_path / "d.csv").write_bytes(b'a,b\n1,"x\n2,y\n')
    with pytest.raises(ValueError, match="open"):
        tb.read_label_csv(spark, str(tmp_path / "d.csv")).collect()


def test_one_job_however_many_files(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"{i:02}.csv").write_bytes(b"a,Label\n1,caf\xe9\n" if i % 2 else "a,x,Label\n1,2,café\n".encode())
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("read", "read")
    df = tb.read_label_csv(spark, tb.discover_csvs(spark, str(tmp_path)))
    jobs = len(tracker.getJobIdsForGroup("read"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 4  # the facts of all files, in one adaptive query
    assert df.groupBy("Label").count().collect() == [("café", 30)]


def test_conn_logs_with_different_headers(spark, tmp_path):
    a = "#separator \\x09\n#fields\tts\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tlabel\n1.5\ta\t1\tb\t2\ttcp\tX\n"
    b = "#fields\tuid\tts\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tlabel   det_label\nC5\t2.5\tc\t3\td\t4\tudp\tY   Z\n"
    (tmp_path / "a.log").write_text(a)
    (tmp_path / "b.log").write_text(b)
    (tmp_path / "c.log").write_text(a + b + a.replace("1.5", "3.5") + "9\tshort\n")
    r = tb.read_conn_log(spark, [str(tmp_path / f"{n}.log") for n in "abc"])
    got = sorted((x.ts, x.source_ip, x.source_port, x.destination_port, x.protocol, x.label, x.detailed_label) for x in r.collect())
    one, two = ("a", 1, 2, 6, "X", None), ("c", 3, 4, 17, "Y", "Z")
    assert got == sorted([(1.5, *one), (1.5, *one), (2.5, *two), (2.5, *two), (3.5, *one),
                          (9.0, "short", None, None, None, None, None)], key=lambda x: x[0]) or sorted(
        got, key=str) == sorted([(1.5, *one), (1.5, *one), (2.5, *two), (2.5, *two), (3.5, *one),
                                 (9.0, "short", None, None, None, None, None)], key=str)
    (tmp_path / "d.log").write_text("1\t2\n")
    with pytest.raises(ValueError, match="d.log"):
        tb.read_conn_log(spark, [str(tmp_path / "a.log"), str(tmp_path / "d.log")])


def test_mapping_takes_the_last_entry_of_the_file(spark, tmp_path):
    head = "dataset_name,original_label,binary_label,coarse_family,keep_or_exclude,exclude_reason,notes\n"
    (tmp_path / "m.csv").write_text(head + "d,A,attack,x,keep,,\nd,B,benign,,keep,,\nd,A,benign,,keep,,\n")
    m = tb.read_mapping(spark, str(tmp_path / "m.csv"))
    flows = spark.createDataFrame([("f", "h0", 1, "h1", 2, 6, 5)], "pcap_file string, src_ip string, src_port int, dst_ip "
                                  "string, dst_port int, protocol int, start_us long")
    ref = spark.createDataFrame([("h0", 1, "h1", 2, 6, "A")], "source_ip string, source_port int, destination_ip string, "
                                "destination_port int, protocol int, label string")
    for order in (F.asc("row_order"), F.desc("row_order")):
        got = lb.align_labels(flows, ref, m.orderBy(order), "d").first()
        assert got["binary_label"] == "benign" and got["coarse_family"] is None
