"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.session import cut_lineage


def _star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and the node itself move to the smallest neighbour; edges are (high, low).
    Only minima per node are aggregated, so a node with many neighbours is no large group."""
    least = edges.groupBy("high").agg(F.min("low").alias("least"))
    moved = edges.join(least, "high")
    return moved.filter("low != least").select(F.col("low").alias("high"), F.col("least").alias("low")).union(
        least.select("high", F.col("least").alias("low"))).distinct()


def _spread(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest node among the node and its neighbours."""
    least = edges.groupBy(F.col("high").alias("of")).agg(F.min("low").alias("least"))
    return edges.join(least, F.col("low") == F.col("of"), "left").select(
        "high", F.coalesce("least", "low").alias("low")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); the component is its smallest node.

    A round contracts stars and jumps pointers, so the number of rounds grows with the logarithm of the longest chain;
    the only value that reaches the driver is a count and a checksum per round.
    """
    e = edges.filter("a is not null and b is not null and a != b").select(
        F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()
    e, before = cut_lineage(e), None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum((F.xxhash64("high", "low") % 1_000_003).cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
        e = cut_lineage(_star(_spread(e)))
    return e.select(F.col("high").alias("node"), F.col("low").alias("component"))
