"""Readers for packet, feature, report, label, alert and plan tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirefold.functions.columns import proto_number
from wirefold.sources import records as rec
from wirefold.schemas import ALERT_EVENT, MAPPING, PACKET, SCENARIO_PLAN

# Label column names, matched without regard to case.
LABEL_COLUMNS = ["label", "attack_cat"]
# Column names of the label files with addresses, as the tools that write them spell them.
FIVE_TUPLE = {"Source IP": "source_ip", "Source Port": "source_port", "Destination IP": "destination_ip",
              "Destination Port": "destination_port", "Protocol": "protocol", "Label": "label",
              "Timestamp": "timestamp"}


def list_files(spark: SparkSession, path: str, patterns: list[str]) -> list[tuple[str, int]]:
    """Matching files with their sizes, each pattern's sorted in turn; a file stands for itself. Raises when nothing is
    there. Nothing is opened: the listing holds the sizes."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(f"no such path: {path}")
    status = fs.getFileStatus(p)
    if status.isFile():
        return [(path, status.getLen())]
    out: list[tuple[str, int]] = []
    for pat in patterns:
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(p, pat)) or []
        out += sorted((s.getPath().toString(), s.getLen()) for s in found if s.isFile())
    return out


def discover_captures(spark: SparkSession, path: str, sizes: bool = False) -> list:
    """Paths of the captures, or (path, size) pairs."""
    files = list_files(spark, path, ["*.pcap", "*.pcapng"])
    if not files:
        raise FileNotFoundError(f"no capture files in {path}")
    return files if sizes else [f for f, _ in files]


def discover_csvs(spark: SparkSession, path: str) -> list[str]:
    """Sorted CSV files; an empty directory gives an empty list."""
    return [f for f, _ in list_files(spark, path, ["*.csv"])]


def read_packets(spark: SparkSession, path: str | list[str], fmt: str = "parquet", **options: str) -> DataFrame:
    """Packet table with the seven-field schema, plus microseconds, the file name and `packet_no`, the place of the row in
    its file (the row number in Parquet; elsewhere a number that grows with it)."""
    df = spark.read.schema(PACKET).options(**options).format(fmt).load(path)
    place = F.col("_metadata.row_index") if fmt == "parquet" else (
        F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    return df.withColumns({"ts_us": F.round(F.col("timestamp") * 1_000_000).cast("bigint"),
                           "pcap_file": _file_name(F.col("_metadata.file_path")), "packet_no": place})


def read_features(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Feature files in one scan, tagged with the stem of the file or folder they come from."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(*paths)
    return df.withColumn("_source_file", F.regexp_extract(
        F.col("_metadata.file_path"), r"([^/]+?)(?:\.parquet)?(?:/part-[^/]*)?$", 1))


def detect_label_column(columns: list[str]) -> str | None:
    for c in columns:
        if c.strip().lower() in LABEL_COLUMNS:
            return c
    return None


def read_label_csv(spark: SparkSession, paths: str | list[str], nrows: int | None = None) -> DataFrame:
    """The rows of `label_files`."""
    return label_files(spark, paths, nrows)[0]


def label_files(spark: SparkSession, paths: str | list[str], nrows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of label files with header, and one row per file: its columns, their number and its label column.

    Per file its encoding (UTF-8 where every line decodes, else ISO-8859-1) and its header; names are trimmed, files
    united by name. Quoted fields may run over line ends. A record with too few fields keeps those it has, one with too
    many is skipped, as are blank lines; empty fields are NULL. `nrows` limits each file to its first rows. A quote
    that is open at the end of a file is an error.
    """
    files = [paths] if isinstance(paths, str) else list(paths)
    if not files:
        raise FileNotFoundError("no label files given")
    facts = rec.csv_facts(spark, files)
    spelled: dict[str, str] = {}
    for file in sorted(facts):
        for c in facts[file].columns:
            spelled.setdefault(c.lower(), c)
    place = {k: i for i, k in enumerate(spelled)}
    known = {f: (x.encoding, [place[c.lower()] for c in x.columns]) for f, x in facts.items()}
    shared = spark.sparkContext.broadcast(known)  # one entry per file, as in the scan's own listing
    broken = {f: x.head_block for f, x in facts.items() if x.breaks}
    records = rec.plain_records(rec.lines(spark, files), {f: x.head_block for f, x in facts.items() if not x.breaks})
    if broken:
        records = records.unionByName(rec.broken_records(spark, files, broken))
    out = _parsed(records, shared, len(spelled))
    if nrows is not None:
        w = Window.partitionBy("file").orderBy("block", "place")
        out = out.withColumn("n", F.row_number().over(w)).where(F.col("n") <= nrows).drop("n")
    rows = out.drop("block", "place").withColumn("file", _file_name("file")).toDF("pcap_file", *spelled.values())
    heads = [(f, len(x.columns), x.columns, detect_label_column(x.columns)) for f, x in facts.items()]
    heads = spark.createDataFrame(heads, "pcap_file string, columns_count int, columns array<string>, label_column string")
    return rows.select(*[F.col(f"`{c}`") for c in spelled.values()], "pcap_file"), heads.withColumn("pcap_file", _file_name("pcap_file"))


def _file_name(path) -> Column:
    return F.regexp_extract(path, "([^/]+)$", 1)


def _parsed(records: DataFrame, shared, width: int) -> DataFrame:
    """file, block, place and a text column c0, c1, ... per name, from records without headers. Records with more
    fields than the header and blank ones go."""
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * width]
    names = ["file", "block", "place", *[f"c{i}" for i in range(width)]]

    def run(batches):
        for batch in batches:
            rows = []
            for file, block, place, record in zip(*[batch[c].to_pylist() for c in ("file", "block", "place", "record")]):
                encoding, at = shared.value[file]
                found = rec.fields(record.decode(encoding)) if record.strip() else []
                if found and len(found) <= len(at):
                    row = [file, block, place] + [None] * width
                    for i, v in zip(at, found):
                        row[3 + i] = v or None
                    rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(
                zip(*rows) if rows else [[]] * len(kinds), kinds)], names)

    return records.mapInArrow(run, "file string, block long, place long" + "".join(f", c{i} string" for i in range(width)))


def five_tuple_labels(raw: DataFrame) -> DataFrame:
    """Label rows with canonical column names and integer ports; an unreadable number becomes NULL (no key). The label
    is the column that `detect_label_column` finds."""
    named = {**FIVE_TUPLE}
    found = detect_label_column(raw.columns)
    if found is not None and "Label" not in raw.columns:
        named[found] = "label"
    have = {k: v for k, v in named.items() if k in raw.columns}
    ints = {"source_port", "destination_port", "protocol"}
    cols = [(F.expr(f"try_cast(`{k}` as int)") if v in ints else F.col(f"`{k}`")).alias(v) for k, v in have.items()]
    extra = [F.col("pcap_file")] if "pcap_file" in raw.columns else []
    return raw.select(*cols, *extra)


# The leading columns of the headerless 49-column label files, and the two label columns at the end.
WIDE_HEAD = ["srcip", "sport", "dstip", "dsport", "proto"]
WIDE_COLUMNS = 49
WIDE_STIME, WIDE_CAT, WIDE_LABEL = 28, 47, 48


def read_wide_labels(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Headerless 49-column label files; protocol names become numbers, other protocols NULL."""
    names = [*WIDE_HEAD, *[f"c{i}" for i in range(len(WIDE_HEAD), WIDE_COLUMNS)]]
    df = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)
    port = {c: F.expr(f"try_cast({c} as int)") for c in ("sport", "dsport")}
    cat = F.trim(f"c{WIDE_CAT}")
    return df.select(
        F.trim("srcip").alias("source_ip"), port["sport"].alias("source_port"), F.trim("dstip").alias("destination_ip"),
        port["dsport"].alias("destination_port"), proto_number("proto").alias("protocol"),
        F.expr(f"try_cast(c{WIDE_STIME} as double)").alias("stime"),
        F.when((cat == "") | cat.isNull(), "Normal").otherwise(cat).alias("label"),
        F.expr(f"try_cast(c{WIDE_LABEL} as int)").alias("label_bit"))


# Field names of the connection log used here.
CONN_FIELDS = {"ts": "ts", "id.orig_h": "source_ip", "id.orig_p": "source_port", "id.resp_h": "destination_ip",
               "id.resp_p": "destination_port", "proto": "proto", "label": "label",
               "detailed-label": "detailed_label", "det_label": "det_label"}


def read_conn_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tab-separated connection logs with labels; names come from each file's `#fields` line, `-` means missing.

    Every line is read by the header that stands before it in its file, so files may have different fields, and a file
    may change them on the way. Some writers separate the last two label fields by blanks instead of tabs; both are
    split. A field that a header lacks is NULL.
    """
    text, names, fields = rec.headed_lines(spark, path, "#fields")
    parts = F.split("line", r"\t|\s{2,}")
    rows = text.where(~F.col("line").startswith("#") & (F.trim("line") != "")).select("head", parts.alias("_p"))
    rows = rows.join(names, "head")

    def field(name):
        x = F.get("_p", F.array_position("names", name).cast("int") - 1)
        return F.when(~x.isin("-", "(empty)"), x)

    df = rows.select(*[(field(k) if k in fields else F.lit(None).cast("string")).alias(v) for k, v in CONN_FIELDS.items()])
    return df.withColumns({
        "source_port": F.expr("try_cast(source_port as int)"), "destination_port": F.expr("try_cast(destination_port as int)"),
        "protocol": proto_number("proto"), "ts": F.expr("try_cast(ts as double)"),
        "detailed_label": F.coalesce("detailed_label", "det_label")}).drop("det_label")


def read_alert_log(spark: SparkSession, path: str) -> DataFrame:
    """Alert events of a JSON-lines log, flattened to ten columns."""
    e = spark.read.schema(ALERT_EVENT).json(path)
    return flatten_alerts(e)


def flatten_alerts(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") == "alert").select(
        "timestamp", "src_ip", "src_port", "dest_ip", "dest_port", "proto", F.col("alert.signature").alias("signature"),
        F.col("alert.signature_id").alias("signature_id"), F.col("alert.category").alias("category"),
        F.col("alert.severity").alias("severity"))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Label mapping rows in file order (`row_order`), all columns as text."""
    df = spark.read.schema(MAPPING).option("header", "true").option("encoding", "UTF-8").csv(path)
    return df.withColumn("row_order", F.monotonically_increasing_id())


def read_report(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read.option("header", "true")
    return (r.schema(schema) if schema is not None else r).csv(path)


def scenario_plan(spark: SparkSession, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    """Plan rows (scenario, split, family, label type); one scenario may have one split only."""
    seen: dict[str, str] = {}
    for scenario, split, *_ in rows:
        if seen.setdefault(scenario, split) != split:
            raise ValueError(f"scenario {scenario} planned for two splits")
    return spark.createDataFrame(rows, SCENARIO_PLAN)
