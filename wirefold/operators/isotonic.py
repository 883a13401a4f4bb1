"""Isotonic regression of binary labels by merging pooled blocks, without bringing scores to one place.

A block is a range of scores with its rows and positives; pooling adjacent blocks whose means fall gives the same blocks
whatever ranges were pooled before. So every depth bucket of the scores pools its own cells in one sorted pass, and
buckets merge in a tree, FAN at a time. Means of pooled blocks rise strictly and are fractions of row counts, so a range
of n rows has at most some 3 n^(2/3) of them: that is what a merge holds, however many distinct scores there are.

Scores are looked up by a running "last block at or before" and "first block at or after" over depth buckets.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirefold.operators.ordering import BUCKET, depth_cuts, with_bucket
from wirefold.session import cut_lineage

FAN = 8
BLOCK = "part long, lo double, hi double, n long, pos long"


def push(held: list[tuple], lo: float, hi: float, n: int, pos: int) -> None:
    """Adds the next block in score order to pooled ones; blocks whose means fall become one. Means are compared in
    whole numbers."""
    while held and held[-1][3] * n >= pos * held[-1][2]:
        lo, _, m, p = held.pop()
        n, pos = n + m, pos + p
    held.append((lo, hi, n, pos))


def _rows(part: int, blocks: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*blocks)) or [[]] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array([part] * len(blocks), pa.int64()), *[pa.array(list(c), t) for c, t in zip(
            cols, (pa.float64(), pa.float64(), pa.int64(), pa.int64()))]], ["part", "lo", "hi", "n", "pos"])


def _pool_runs(batches):
    """Sorted cells (part, score, n, pos) to the pooled blocks of every part."""
    part, held = None, []
    for batch in batches:
        for p, s, n, pos in zip(*[batch[c].to_pylist() for c in ("part", "score", "n", "pos")]):
            if p != part:
                if held:
                    yield _rows(part, held)
                part, held = p, []
            push(held, s, s, n, pos)
    if held:
        yield _rows(part, held)


def isotonic_blocks(cells: DataFrame, score: str = "score", buckets: int | None = None) -> DataFrame:
    """lo, hi, n, pos and value of the pooled blocks of score cells (`score`, `pos`, `neg`). Cells without a score or with
    NaN are left out."""
    c = cells.where(F.col(score).isNotNull() & ~F.isnan(score))
    c = c.select(F.col(score).cast("double").alias("score"), (F.col("pos") + F.col("neg")).alias("n"), "pos").where("n > 0")
    cuts = depth_cuts(c, "score", buckets)
    b = with_bucket(c, "score", cuts).withColumn("part", F.col(BUCKET).cast("bigint"))
    blocks = b.select("part", "score", "n", "pos").repartition("part").sortWithinPartitions("part", "score").mapInArrow(
        _pool_runs, BLOCK)
    parts = len(cuts) + 1

    def merge(key, table):
        t, found = table.sort_by("lo"), []
        for block in zip(*[t[c].to_pylist() for c in ("lo", "hi", "n", "pos")]):
            push(found, *block)
        return pa.Table.from_batches([_rows(key[0].as_py(), found)])

    while parts > 1:
        blocks = blocks.withColumn("part", F.expr(f"part div {FAN}")).groupBy("part").applyInArrow(merge, BLOCK)
        parts = -(-parts // FAN)
    return blocks.select("lo", "hi", "n", "pos", (F.col("pos") / F.col("n")).alias("value"))


def interpolate(scores: DataFrame, blocks: DataFrame, score: str, out: str) -> DataFrame:
    """Adds the fitted value at every score: the block's own inside it, on a line between the ends of two blocks, the
    first or last block's beyond all. NULL for rows without a score and where there are no blocks."""
    blocks = cut_lineage(blocks)
    ends = blocks.select(F.explode(F.array(F.struct(F.col("lo").alias("x"), "value"), F.struct(F.col("hi").alias("x"), "value")))
                         .alias("p")).select("p.*").distinct()
    asked = scores.where(F.col(score).isNotNull() & ~F.isnan(score)).select(F.col(score).cast("double").alias("x")).distinct()
    both = ends.select("x", F.struct("x", "value").alias("point")).unionByName(
        asked.select("x", F.lit(None).cast(ends.select(F.struct("x", "value")).schema[0].dataType).alias("point")))
    per = cut_lineage(with_bucket(both.groupBy("x").agg(F.max("point").alias("point")), "x", depth_cuts(both, "x")))
    here = Window.partitionBy(BUCKET).orderBy("x")
    down, up = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(BUCKET)  # one row per bucket
    edge = per.groupBy(BUCKET).agg(F.max("point").alias("top"), F.min("point").alias("bottom"))
    edge = edge.select(BUCKET, F.last("top", ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, -1)).alias(
        "below"), F.first("bottom", ignorenulls=True).over(whole.rowsBetween(1, Window.unboundedFollowing)).alias("above"))
    near = per.select(BUCKET, "x", F.last("point", ignorenulls=True).over(down).alias("a"),
                      F.first("point", ignorenulls=True).over(up).alias("b")).join(edge, BUCKET)
    a, b = F.coalesce("a", "below"), F.coalesce("b", "above")
    near = near.select("x", a.alias("a"), b.alias("b"))
    between = F.col("a.value") + (F.col("b.value") - F.col("a.value")) * (F.col("x") - F.col("a.x")) / (
        F.col("b.x") - F.col("a.x"))
    value = F.when(F.col("a").isNull(), F.col("b.value")).when(F.col("b").isNull() | (F.col("a.x") == F.col("b.x")),
                                                               F.col("a.value")).otherwise(between)
    found = near.select(F.col("x").alias("_x"), value.alias(out))
    return scores.join(found, F.col(score).cast("double") == F.col("_x"), "left").drop("_x")
