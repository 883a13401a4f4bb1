"""Registered queries: sources and sinks, written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirefold.functions import columns as cl
from wirefold.operators import alerts as al
from wirefold.operators import features as ft
from wirefold.operators import labeling as lb
from wirefold.operators import packets as pk
from wirefold.operators import splits as sp
from wirefold.plans.fixtures import ACTIVE_S, table
from wirefold.registry import oracle as o
from wirefold.registry.feature_queries import NUMBERED, _split_cte
from wirefold.registry.flow_queries import IDENT, TOTALS, flows_of
from wirefold.registry.join_queries import ALERTS, FD, OFFSET_S, STATUS, TOL_S, _cand
from wirefold.registry.label_queries import labelled, with_labels
from wirefold.session import scratch_path
from wirefold.sources import sinks as sk
from wirefold.sources import tables as tb

_TUPLE = ["source_ip", "source_port", "destination_ip", "destination_port", "protocol", "label"]


def label_csv_scan(spark, sf):
    """Label rows written as CSV with padded header names, then read by the label reader."""
    path = scratch_path(spark, "labels-csv")
    names = {v: f" {k}" for k, v in tb.FIVE_TUPLE.items()}
    ref = table(spark, sf, "label_ref").select(*_TUPLE).withColumnsRenamed(names)
    ref.write.option("header", "true").csv(path)
    raw = tb.read_label_csv(spark, tb.discover_csvs(spark, path))
    return tb.five_tuple_labels(raw).groupBy(*_TUPLE).agg(F.count("*").alias("n"))


def _quoted_label_files(spark, sf):
    """Label rows in two folders of files: UTF-8, with a note that holds quotes, a comma and a line end, and ISO-8859-1,
    with the columns in another order, another label column and no note."""
    root = scratch_path(spark, "labels-quoted")
    ref = table(spark, sf, "label_ref")
    names = {v: k for k, v in tb.FIVE_TUPLE.items()}
    note = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('say ""no"", twice\nrow '), "event_id")).otherwise(F.lit(""))
    quoted = ref.where("event_id % 2 = 0").select(*_TUPLE, note.alias("Note")).withColumnsRenamed(names)
    cells = [F.concat(F.lit('"'), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit('"')) for c in quoted.columns]
    text = F.concat_ws(",", *cells)
    head = ",".join(quoted.columns)
    out = quoted.groupBy(F.spark_partition_id().alias("p")).agg(F.concat(F.lit(head + "\n"), F.concat_ws(
        "\n", F.collect_list(text))).alias("value")).select("value")
    out.write.text(f"{root}/utf8")
    back = [c for c in reversed(_TUPLE) if c != "label"]
    latin = ref.where("event_id % 2 = 1").select(F.regexp_replace("label", "–", "\u0096").alias("attack_cat"), *back)
    latin.withColumnsRenamed({k: f" {v} " for k, v in names.items()}).write.option("header", "true").option(
        "encoding", "ISO-8859-1").option("ignoreTrailingWhiteSpace", "false").csv(f"{root}/latin")
    files = [f for d, p in (("utf8", "*.txt"), ("latin", "*.csv")) for f, _ in tb.list_files(spark, f"{root}/{d}", [p])]
    return tb.label_files(spark, files)


def label_csv_records(spark, sf):
    """Files of two encodings and two headers, one with quoted line ends, read in one scan."""
    rows, _ = _quoted_label_files(spark, sf)
    label = F.coalesce("Label", "attack_cat")
    have = [F.expr(f"try_cast(`{k}` as int)").alias(v) if v in ("source_port", "destination_port", "protocol") else
            F.col(f"`{k}`").alias(v) for k, v in tb.FIVE_TUPLE.items() if k not in ("Label", "Timestamp")]
    return rows.select(*have, label.alias("label"), F.md5(F.col("Note").cast("binary")).alias("note")).groupBy(
        *_TUPLE, "note").agg(F.count("*").alias("n"))


def label_file_columns(spark, sf):
    """Per kind of file: its number of columns and the label column that the reader found, with its label counts."""
    rows, heads = _quoted_label_files(spark, sf)
    s = lb.label_summary(rows, heads=heads)
    return s.groupBy("columns_count", "label_column", "label").agg(F.sum("n").alias("n"))


def wide_label_scan(spark, sf):
    path = scratch_path(spark, "labels-wide")
    ref = table(spark, sf, "label_ref")
    cols = [F.col("source_ip"), F.col("source_port"), F.col("destination_ip"), F.col("destination_port"),
            F.when(F.col("protocol") == 6, "tcp").otherwise("udp")]
    cols += [F.lit("0").alias(f"x{i}") for i in range(5, tb.WIDE_COLUMNS)]
    cols[tb.WIDE_STIME] = F.floor(F.col("ts_us") / 1_000_000)
    cols[tb.WIDE_CAT] = F.when(F.trim("label") != "BENIGN", F.trim("label")).otherwise("")
    cols[tb.WIDE_LABEL] = (F.trim("label") != "BENIGN").cast("int")
    ref.select(*[c.alias(f"k{i}") for i, c in enumerate(cols)]).write.csv(path)
    w = tb.read_wide_labels(spark, path)
    return (w.groupBy("source_ip", "source_port", "destination_ip", "destination_port", "protocol", "label", "label_bit")
            .agg(F.count("*").alias("n"), F.sum(F.col("stime").cast("bigint")).alias("stime_sum")))


def conn_log_scan(spark, sf):
    path = scratch_path(spark, "conn-log")
    ref = table(spark, sf, "label_ref")
    line = F.concat_ws("\t", (F.col("ts_us") / 1_000_000).cast("decimal(20,6)").cast("string"), "source_ip",
                       F.col("source_port").cast("string"), "destination_ip", F.col("destination_port").cast("string"),
                       F.when(F.col("protocol") == 6, "tcp").otherwise("udp"),
                       F.when(F.col("label") == "BENIGN", "Benign").otherwise("Malicious"),
                       F.when(F.col("label") == "BENIGN", "-").otherwise(F.trim("label")))
    head = F.lit("#fields\tts\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tlabel\tdetailed-label")
    rows = ref.select((F.col("event_id") % 4).alias("part"), F.lit(1).alias("k"), line.alias("value"))
    heads = spark.range(4).select(F.col("id").alias("part"), F.lit(0).alias("k"), head.alias("value"))
    rows.unionByName(heads).repartition(4, "part").sortWithinPartitions("part", "k").select("value").write.text(path)
    c = tb.read_conn_log(spark, path)
    return (c.groupBy("source_ip", "source_port", "destination_ip", "destination_port", "protocol", "label",
                      "detailed_label").agg(F.count("*").alias("n"), F.round(F.sum("ts"), 2).alias("ts_sum")))


def conn_log_headers(spark, sf):
    """Three logs read together: two with different fields, and one whose fields change on the way."""
    root = scratch_path(spark, "conn-logs")
    ref = table(spark, sf, "label_ref").withColumn("kind", F.col("event_id") % 3)
    proto = F.when(F.col("protocol") == 6, "tcp").otherwise("udp")
    ends = ["source_ip", F.col("source_port").cast("string"), "destination_ip", F.col("destination_port").cast("string")]
    label, detail = (F.when(F.col("label") == "BENIGN", x).otherwise(y) for x, y in (
        ("Benign", "Malicious"), ("-", F.trim("label"))))
    plain = F.concat_ws("\t", *ends, proto, label, detail)
    with_id = F.concat_ws("\t", F.concat(F.lit("C"), "event_id"), proto, *ends, label)
    heads = ["#fields\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tlabel\tdetailed-label",
             "#fields\tuid\tproto\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tlabel"]
    for name, parts in (("plain", [(0, 0, plain)]), ("id", [(1, 1, with_id)]), ("both", [(2, 0, plain), (2, 1, with_id)])):
        rows = None
        for i, (kind, h, line) in enumerate(parts):
            part = ref.where(F.col("kind") == kind).select(F.lit(i).alias("part"), F.lit(1).alias("k"), line.alias("value"))
            head = spark.createDataFrame([(i, 0, heads[h])], "part int, k int, value string")
            rows = head.unionByName(part) if rows is None else rows.unionByName(head).unionByName(part)
        rows.coalesce(1).sortWithinPartitions("part", "k").select("value").write.text(f"{root}/{name}")
    files = [f for n in ("plain", "id", "both") for f, _ in tb.list_files(spark, f"{root}/{n}", ["*.txt"])]
    c = tb.read_conn_log(spark, files)
    return c.groupBy("source_ip", "source_port", "destination_ip", "destination_port", "protocol", "label",
                     "detailed_label").agg(F.count("*").alias("n"))


def alert_log_match(spark, sf):
    """Alerts as JSON lines with text times, read, given ids and times, and joined to the flows."""
    path = scratch_path(spark, "eve")
    a = table(spark, sf, "alerts")
    time = F.date_format(F.timestamp_micros("alert_ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS+0000")
    ev = F.struct(time.alias("timestamp"), "event_type", "src_ip", "src_port", "dest_ip", "dest_port", "proto",
                  F.struct(F.col("alert_id").cast("string").alias("signature"), "signature_id",
                           F.lit("scan").alias("category"), F.lit(2).alias("severity")).alias("alert"))
    a.select(F.to_json(ev).alias("value")).write.text(path)
    read = al.correct_time(al.from_log(tb.read_alert_log(spark, path)), OFFSET_S)
    m = al.match_status(read, al.candidates(read, flows_of(spark, sf), TOL_S, ACTIVE_S))
    return m.select("signature", "signature_id", "t_us", "n_candidates", "match_status",
                    F.col("flow.start_us").alias("flow_start_us"))


def _packet_files(spark, sf):
    """One packet file per capture, in arrival order, read by the packet reader."""
    path = scratch_path(spark, "packet-files")
    p = table(spark, sf, "packets").withColumns({"capture": F.col("pcap_file"), "timestamp": F.col("ts_us") / 1e6})
    p = p.repartition("capture").sortWithinPartitions("capture", "ts_us", "event_id")
    p.select("timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", F.col("ip_len").cast("int").alias("ip_len"),
             "capture").write.partitionBy("capture").parquet(path)
    return tb.read_packets(spark, path)


def packet_file_scan(spark, sf):
    return _packet_files(spark, sf).groupBy("capture", "src_ip", "dst_port", "protocol").agg(
        F.count("*").alias("n"), F.sum(F.col("ip_len").cast("bigint")).alias("bytes"), F.min("ts_us").alias("first_us"))


def packet_file_cap(spark, sf):
    """The first ten packets of every file left out, the next hundred kept, by their place in the file."""
    k = pk.skip_and_cap(_packet_files(spark, sf), 10, 100, "capture", "packet_no")
    return k.groupBy("capture").agg(F.count("*").alias("n"), F.sum(F.col("ip_len").cast("bigint")).alias("bytes"),
                                    F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


def alerts_flat(spark, sf):
    """Alerts as nested JSON lines among other event types, read and flattened."""
    path = scratch_path(spark, "alert-log")
    a = table(spark, sf, "alerts")
    ev = F.struct(F.timestamp_micros("alert_ts_us").cast("string").alias("timestamp"),
                  F.when(F.col("alert_id") % 4 == 0, "flow").otherwise("alert").alias("event_type"), "src_ip", "src_port",
                  "dest_ip", "dest_port", "proto",
                  F.struct(F.concat(F.lit("sig "), "signature_id").alias("signature"), "signature_id",
                           F.lit("scan").alias("category"), F.lit(2).alias("severity")).alias("alert"))
    a.select(F.to_json(ev).alias("value")).write.text(path)
    return tb.read_alert_log(spark, path).drop("timestamp")


def feature_file_scan(spark, sf):
    """Features written per capture file and read in one scan with the source stem."""
    root = scratch_path(spark, "features")
    f = ft.extract_features(flows_of(spark, sf)).withColumn("part", F.regexp_replace("pcap_file", r"\.pcap$", ""))
    f.repartition(1).write.partitionBy("part").parquet(root)
    r = tb.read_features(spark, [root])
    return r.groupBy("_source_file").agg(F.count("*").alias("n"), F.sum("bytes_total").alias("bytes"))


def flow_sink_roundtrip(spark, sf):
    """Flow table written as CSV in bounded files and read back."""
    path = scratch_path(spark, "flows-csv")
    f = flows_of(spark, sf).select(*IDENT, "end_us", *TOTALS)
    sk.write_flows(f, path, "csv", max_rows=500)
    return spark.read.schema(f.schema).option("header", "true").csv(path)


def split_sink_roundtrip(spark, sf):
    path = scratch_path(spark, "split")
    sk.write_split(sp.with_day_split(flows_of(spark, sf, number=True)), path)
    return spark.read.parquet(path).groupBy("day", "split").agg(F.count("*").alias("n"),
                                                                F.sum("global_flow_id").alias("id_sum"))


def exclusion_sink_roundtrip(spark, sf):
    path = scratch_path(spark, "exclusions")
    sk.write_exclusions(lb.exclusion_log(labelled(spark, sf)), path)
    return spark.read.parquet(path).groupBy("exclusion_reason").agg(F.count("*").alias("n"))


def file_manifest(spark, sf):
    """Every table file of the test data by size; a frozen copy of the manifest shows no drift."""
    m = sk.file_manifest(spark, sf, "*.parquet")
    return m.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "length", "sha256")


TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def table_fingerprint(spark, sf):
    out = None
    for name in TABLES:
        p = sk.fingerprint(table(spark, sf, name)).withColumn("table_name", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return out.select("table_name", "n_rows", F.col("hash_sum").cast("string").alias("hash_sum"))


def text_functions(spark, sf):
    """Label normalisation, blank handling, context names and protocol names over label rows."""
    r = table(spark, sf, "label_ref")
    ctx = cl.context_name(F.concat(F.upper(F.col("source_ip")), F.lit(" → "), F.col("destination_ip")))
    return r.groupBy(
        cl.normalise_label("label").alias("norm"), cl.blank_to_null(F.when(F.col("event_id") % 2 == 0, F.lit("  "))
                                                                    .otherwise(F.col("label"))).alias("label_or_null"),
        cl.proto_number(F.when(F.col("protocol") == 6, "TCP").when(F.col("event_id") % 5 == 0, "icmp").otherwise("udp"))
        .alias("proto"), ctx.alias("context")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    label_csv_scan, label_csv_records, label_file_columns, wide_label_scan, conn_log_scan, conn_log_headers, alerts_flat,
    alert_log_match, packet_file_scan, packet_file_cap, feature_file_scan, flow_sink_roundtrip,
    split_sink_roundtrip, exclusion_sink_roundtrip, file_manifest, table_fingerprint, text_functions)}

_T = "source_ip, source_port, destination_ip, destination_port, protocol"
_LR = ["label_ref"]
ORACLE = {
    "label_csv_scan": o.sql(_LR, f"select {_T}, trim(label) as label, count(*) as n from label_ref group by all"),
    "label_csv_records": o.sql(_LR, f"""select {_T}, case when event_id % 2 = 1 then regexp_replace(label, '–', '') else label end as label,
        case when event_id % 2 = 0 and event_id % 5 = 0 then md5('say "no", twice' || chr(10) || 'row ' || event_id) end as note,
        count(*) as n from label_ref group by all"""),
    "label_file_columns": o.sql(_LR, """select case when event_id % 2 = 0 then 7 else 6 end as columns_count,
        case when event_id % 2 = 0 then 'Label' else 'attack_cat' end as label_column,
        case when event_id % 2 = 1 then regexp_replace(label, '–', '') else label end as label, count(*) as n
        from label_ref group by all"""),
    "wide_label_scan": o.sql(_LR, f"""select {_T}, case trim(label) when 'BENIGN' then 'Normal' else trim(label) end as label,
        cast(trim(label) <> 'BENIGN' as int) as label_bit, count(*) as n, cast(sum(ts_us // 1000000) as bigint) as stime_sum
        from label_ref group by all"""),
    "conn_log_scan": o.sql(_LR, f"""select {_T}, case label when 'BENIGN' then 'Benign' else 'Malicious' end as label,
        case label when 'BENIGN' then null else trim(label) end as detailed_label, count(*) as n,
        round(sum(ts_us / 1e6), 2) as ts_sum from label_ref group by all"""),
    "conn_log_headers": o.sql(_LR, f"""select {_T}, case label when 'BENIGN' then 'Benign' else 'Malicious' end as label,
        case when label <> 'BENIGN' and d then trim(label) end as detailed_label, count(*) as n from (
          select *, true as d from label_ref where event_id % 3 <> 1
          union all select *, false from label_ref where event_id % 3 <> 0) group by all"""),
    "alert_log_match": o.flows("""select alert_id::varchar as signature, signature_id, t_us, n_candidates, match_status,
        flow_start_us from st join al using (alert_id)""", ALERTS, FD, _cand(), STATUS, extra=["alerts"]),
    "packet_file_scan": o.sql(["packets"], """select pcap_file as capture, src_ip, dst_port, protocol, count(*) as n,
        cast(sum(ip_len) as bigint) as bytes, min(ts_us) as first_us from packets group by all"""),
    "packet_file_cap": o.sql(["packets"], """select pcap_file as capture, count(*) as n, cast(sum(ip_len) as bigint) as bytes,
        min(ts_us) as first_us, max(ts_us) as last_us from (select *, row_number() over (partition by pcap_file
        order by ts_us, event_id) as i from packets) where i > 10 and i <= 110 group by 1"""),
    "alerts_flat": o.sql(["alerts"], """select src_ip, src_port, dest_ip, dest_port, proto, 'sig ' || signature_id as signature,
        signature_id, 'scan' as category, 2 as severity from alerts where alert_id % 4 <> 0"""),
    "feature_file_scan": o.flows("""select 'part=' || replace(pcap_file, '.pcap', '') as _source_file, count(*) as n,
        cast(sum(bytes_total) as bigint) as bytes from flows group by 1"""),
    "flow_sink_roundtrip": o.flows(f"select {', '.join(IDENT)}, end_us, {', '.join(TOTALS)} from flows"),
    "split_sink_roundtrip": o.flows("""select day, split, count(*) as n, cast(sum(global_flow_id) as bigint) as id_sum
        from s group by 1, 2""", NUMBERED, _split_cte("nf")),
    "exclusion_sink_roundtrip": with_labels("""select exclusion_reason, count(*) as n from labelled
        where exclusion_reason is not null group by 1"""),
    "text_functions": o.sql(_LR, """select regexp_replace(trim(label), '[\u0096–—−]', '-', 'g') as norm,
        case when event_id % 2 = 0 then null else nullif(trim(label), '') end as label_or_null,
        case when protocol = 6 then 6 when event_id % 5 = 0 then null else 17 end as proto,
        lower(upper(source_ip) || '_to_' || destination_ip) as context, count(*) as n from label_ref group by all"""),
}
