"""Writers, guarded targets, manifests and table fingerprints."""

from __future__ import annotations

import hashlib
import json
import os

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "csv")
CHUNK_ROWS = 500_000


def write_flows(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                max_rows: int = CHUNK_ROWS, partition_by: list[str] = ()) -> str:
    """Flow table as parquet or csv in files of at most `max_rows` rows; an existing target is never overwritten."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported output format: {fmt!r}")
    w = df.write.format(fmt).mode(mode).option("maxRecordsPerFile", max_rows)
    if fmt == "csv":
        w = w.option("header", "true")
    (w.partitionBy(*partition_by) if partition_by else w).save(path)
    return path


def config_path(root: str, config: dict) -> str:
    """Target folder that follows from the configuration alone."""
    text = json.dumps(config, sort_keys=True, separators=(",", ":"), default=str)
    return os.path.join(root, hashlib.sha256(text.encode()).hexdigest()[:16])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_once(df: DataFrame, path: str, if_exists: str = "fail", fmt: str = "parquet", **options) -> bool:
    """Writes unless the target exists, which fails or is skipped; returns whether rows were written."""
    if exists(df.sparkSession, path):
        if if_exists == "skip":
            return False
        raise FileExistsError(path)
    write_flows(df, path, fmt, **options)
    return True


def write_exclusions(log: DataFrame, path: str) -> str:
    return write_flows(log, path, partition_by=["exclusion_reason"])


def write_predictions(sidecar: DataFrame, path: str) -> str:
    return write_flows(sidecar, path, partition_by=["split"])


def write_split(sidecar: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Split table next to the master table, which is only ever read."""
    return write_flows(sidecar.select("global_flow_id", "day", "split"), path, fmt)


def write_json_lines(df: DataFrame, col: str, path: str) -> str:
    df.select(F.col(col).alias("value")).write.mode("errorifexists").text(path)
    return path


def file_manifest(spark: SparkSession, path: str, pattern: str = "*", chunk: int = 64 << 20) -> DataFrame:
    """SHA-256 and size of every file below `path`.

    Listing comes from a metadata-only scan; each file is hashed by one task as a stream, so no file is held in memory
    and none meets the size limit of a binary column.
    """
    listing = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
               .load(path).select("path", "length"))

    def digest(batches):
        for pdf in batches:
            out = []
            for p in pdf["path"]:
                filesystem, local = pafs.FileSystem.from_uri(p)
                h = hashlib.sha256()
                with filesystem.open_input_stream(local) as f:
                    while block := f.read(chunk):
                        h.update(block)
                out.append(h.hexdigest())
            yield pdf.assign(sha256=out)

    n = spark.sparkContext.defaultParallelism
    return listing.repartition(n, "path").mapInPandas(digest, "path string, length bigint, sha256 string")


def manifest_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files added, removed or changed against a frozen manifest."""
    o = old.select("path", F.col("sha256").alias("old_sha"))
    n = new.select("path", F.col("sha256").alias("new_sha"))
    j = o.join(n, "path", "full_outer")
    status = (F.when(F.col("old_sha").isNull(), "added").when(F.col("new_sha").isNull(), "removed")
              .when(F.col("old_sha") != F.col("new_sha"), "changed").otherwise("same"))
    return j.select("path", status.alias("status")).where("status <> 'same'")


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free hash of all rows."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.sum(h).alias("hash_sum"))
