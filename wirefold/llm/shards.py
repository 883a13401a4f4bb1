"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source. Rank r of n rows gets the place (r + u) / n, with one
seeded offset u in [0, 1) per source, so every interval of places holds each source in its proportion. Rows are ranked
by place and the ranks cut into equal runs: shard sizes differ by one row at most, and a source's share of each shard by
less than two rows. Both rankings count per bucket first and sort one bucket at a time, so a hot source, or a million
sources of one row, is spread evenly.

Defined results: a null source is a source of its own; null and empty texts have size 1 (no bytes plus 1); repeated rows
all take part, and equal rows may swap places; an empty table gives no rows; shards beyond the row count stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirefold.llm.common import bucket_ranks, pick, utf8_bytes
from wirefold.session import cut_lineage

BITS = 12  # at least 2^BITS buckets per ranking
BUCKET_ROWS = 1 << 18  # rows that are ranked together, about


def _unit(h: Column) -> Column:
    """A hash as a number in [0, 1)."""
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def assign_shards(docs: DataFrame, shards: int = 16, seed: int = 7, bits: int | None = None) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of every row. Rankings go in 2^bits buckets; by default there
    are as many as the row count needs."""
    base = pick(docs, doc_id="doc_id", text="text", source="source").select(
        "doc_id", F.col("source").cast("string").alias("source"), (utf8_bytes(F.col("text")) + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    base = base.withColumn("stratum", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))).withColumn(
        "shuffled", F.xxhash64(F.lit(seed), "doc_id", "size", "text_crc32"))
    base = cut_lineage(base)
    bits = max(BITS, (base.count() // BUCKET_ROWS).bit_length()) if bits is None else bits
    base = base.withColumn("bucket", F.shiftright("shuffled", 64 - bits))
    placed = bucket_ranks(base, ["stratum"], "bucket", ["shuffled", "doc_id", "size", "text_crc32"], "rank", "n")
    placed = placed.withColumn("place", (F.col("rank") + _unit(F.xxhash64(F.lit(seed + 1), "stratum"))) / F.col("n"))
    placed = cut_lineage(placed.drop("bucket", "rank", "n").withColumn(
        "bucket", F.floor(F.col("place") * F.lit(1 << bits)).cast("long")))
    # One row per bucket: at most 2^bits rows, however many documents.
    whole, before = Window.partitionBy(), Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"))
    inside = Window.partitionBy("bucket").orderBy("place", "stratum", "shuffled", "doc_id", "size", "text_crc32")
    ranked = placed.join(offsets, "bucket").withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
    ranked = ranked.withColumn("shard", F.expr(f"(rank * {shards}) div total").cast("int"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return ranked.select("doc_id", "source", "size", "text_crc32", "shard", (F.col("rank") - first).alias("slot"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, parts: int | None = None) -> None:
    """Writes whole rows as one folder per shard, in slot order; doc_id must be unique. Ranges of (shard, slot) are
    written by `parts` tasks (default: the session's shuffle partitions), so a shard is several files, in slot order by
    name."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = assigned.select(F.col("doc_id").alias("__id"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    rows = docs.join(at, docs["doc_id"].cast("long") == at["__id"]).drop("__id")
    rows.repartitionByRange(parts, "__shard", "__slot").sortWithinPartitions("__shard", "__slot").write.partitionBy(
        "__shard").mode("overwrite").parquet(path)
