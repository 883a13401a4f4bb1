"""Readers, writers, guards and manifests."""

import pytest
from pyspark.sql import functions as F

from wirefold.schemas import META_COLS
from wirefold.operators import features as ft
from wirefold.sources import sinks as sk
from wirefold.sources import tables as tb


def test_label_csv_encodings_and_bad_lines(spark, tmp_path):
    head = " Source IP, Source Port, Destination IP, Destination Port, Protocol, Label\n"
    (tmp_path / "b.csv").write_bytes((head + "1.1.1.1,1,2.2.2.2,2,6,Web – XSS\n").encode())
    (tmp_path / "a.csv").write_bytes(head.encode() + b"1.1.1.1,1,2.2.2.2,2,6,Web \x96 XSS\n1.1.1.1,x,2.2.2.2,2,6,B\n"
                                     b"too,many,fields,in,this,line,here\n")
    files = tb.discover_csvs(spark, str(tmp_path))
    assert [f[-5:] for f in files] == ["a.csv", "b.csv"]
    raw = tb.read_label_csv(spark, files)
    assert tb.detect_label_column(raw.columns) == "Label" and tb.detect_label_column(["x"]) is None
    rows = sorted((r.pcap_file, r.source_port, r.label) for r in tb.five_tuple_labels(raw).collect() if r.source_port)
    assert rows == [("a.csv", 1, "Web \x96 XSS"), ("b.csv", 1, "Web – XSS")]
    assert raw.count() == 3 and tb.read_label_csv(spark, files, nrows=1).count() == 2
    with pytest.raises(FileNotFoundError):
        tb.discover_csvs(spark, str(tmp_path / "none"))


def test_conn_log(spark, tmp_path):
    p = tmp_path / "conn.log.labeled"
    p.write_text("#separator \\x09\n#fields\tts\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tlabel   det_label\n"
                 "#types\ttime\n1.5\ta\t1\tb\t2\ttcp\tMalicious   Okiru\n2.5\ta\t-\tb\t2\tudp\tBenign   -\n#close\n")
    r = tb.read_conn_log(spark, str(p)).orderBy("ts").collect()
    assert [(x.source_port, x.protocol, x.label, x.detailed_label) for x in r] == [
        (1, 6, "Malicious", "Okiru"), (None, 17, "Benign", None)]


def test_write_once_and_formats(spark, tmp_path):
    df = spark.range(10)
    p = sk.config_path(str(tmp_path), {"b": 1, "a": 2})
    assert p == sk.config_path(str(tmp_path), {"a": 2, "b": 1}) != sk.config_path(str(tmp_path), {"a": 3})
    assert sk.write_once(df, p) and not sk.write_once(df, p, if_exists="skip")
    with pytest.raises(FileExistsError):
        sk.write_once(df, p)
    with pytest.raises(ValueError):
        sk.write_flows(df, str(tmp_path / "x"), "orc")
    sk.write_flows(df.coalesce(1), str(tmp_path / "many"), max_rows=3)
    assert len(list((tmp_path / "many").glob("part-*.parquet"))) == 4


def test_manifest_and_fingerprint(spark, tmp_path):
    d = tmp_path / "d"
    d.mkdir()
    (d / "a.bin").write_bytes(b"abc")
    (d / "b.bin").write_bytes(b"x" * 1000)
    old = sk.file_manifest(spark, str(d)).collect()
    assert {r.length for r in old} == {3, 1000}
    assert "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad" in {r.sha256 for r in old}
    old = spark.createDataFrame(old)
    (d / "a.bin").write_bytes(b"abd")
    (d / "c.bin").write_bytes(b"new")
    got = {r.path[-5:]: r.status for r in sk.manifest_drift(old, sk.file_manifest(spark, str(d))).collect()}
    assert got == {"a.bin": "changed", "c.bin": "added"}
    x = spark.range(100).withColumn("v", F.col("id") * 2)
    assert sk.fingerprint(x).first() == sk.fingerprint(x.repartition(7)).first()
    assert sk.fingerprint(x).first() != sk.fingerprint(x.withColumn("v", F.col("v") + (F.col("id") == 5).cast("int"))).first()


def test_plans_reports_and_mapping(spark, tmp_path):
    with pytest.raises(ValueError):
        tb.scenario_plan(spark, [("s", "train", "f", "l"), ("s", "test", "f", "l")])
    assert tb.scenario_plan(spark, [("s", "train", "f", "l")]).count() == 1
    (tmp_path / "r.csv").write_text("a,b\n1,x\n")
    assert tb.read_report(spark, str(tmp_path / "r.csv")).columns == ["a", "b"]
    (tmp_path / "m.csv").write_text("dataset_name,original_label,binary_label,coarse_family,keep_or_exclude,"
                                    "exclude_reason,notes\nd,BENIGN,benign,,keep,,\n")
    assert tb.read_mapping(spark, str(tmp_path / "m.csv")).first().original_label == "BENIGN"


def test_packet_scan_and_feature_schema(spark, tmp_path):
    p = str(tmp_path / "p")
    spark.createDataFrame([(1.25, "a", "b", 1, 2, 6, 40)], "timestamp double, src_ip string, dst_ip string, src_port int, "
                          "dst_port int, protocol int, ip_len int").write.json(p)
    r = tb.read_packets(spark, p, "json").first()
    assert r.ts_us == 1_250_000 and r.pcap_file.startswith("part-")
    one = spark.range(1).withColumn("x", F.lit(1))
    assert ft.schemas_agree([one, one]) and not ft.schemas_agree([one, one.withColumn("y", F.lit(1))])
    assert ft.missing_meta(one) == META_COLS


def test_label_lines_short_and_long(spark, tmp_path):
    for name, n in (("a.csv", 3), ("b.csv", 4)):
        lines = ["Src IP, Label ,x"] + [f"10.0.0.{i},L{i},1" for i in range(n)] + ["10.9.9.9,short", "1,2,3,4,5"]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    files = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    got = tb.read_label_csv(spark, files).collect()
    assert len(got) == 9 and sum(r["Label"] == "short" and r["x"] is None for r in got) == 2
    few = tb.read_label_csv(spark, files, nrows=2).collect()
    assert sorted((r["pcap_file"], r["Label"]) for r in few) == [(f, x) for f in ("a.csv", "b.csv") for x in ("L0", "L1")]
