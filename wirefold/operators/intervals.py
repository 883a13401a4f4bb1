"""Point-in-interval joins on an equality key.

Intervals are copied to the time buckets they touch and points carry their own bucket, so the join is a plain equality
join on (key, bucket): a hot key spreads over time instead of meeting in one task. With buckets as wide as the longest
interval, an interval is copied at most twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


BUCKET = "_b"


def _sides(points: DataFrame, intervals: DataFrame, t: str, lo: str, hi: str, width_us: int):
    p = points.withColumn(BUCKET, F.floor(F.col(t) / width_us))
    buckets = F.sequence(F.floor(F.col(lo) / width_us), F.floor(F.col(hi) / width_us))
    return p, intervals.withColumn(BUCKET, F.explode(buckets))


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], t: str, lo: str, hi: str,
                        width_us: int) -> DataFrame:
    """Inner join: every (point, interval) pair with lo <= t <= hi and equal keys. Key names must match."""
    p, i = _sides(points, intervals, t, lo, hi, width_us)
    return p.join(i, [*keys, BUCKET]).where((F.col(t) >= F.col(lo)) & (F.col(t) <= F.col(hi))).drop(BUCKET)


def best_interval(points: DataFrame, intervals: DataFrame, keys: list[str], point_id: str, t: str, lo: str, hi: str,
                  width_us: int, rank: list, take: str, out: str) -> DataFrame:
    """Every point with `take` of its covering interval that is smallest by `rank`, NULL when none covers it.

    A point has one bucket, so choosing within (key, bucket, point) is choosing within the point and reuses the
    partitioning of the join: the points shuffle once. `intervals` must not share other column names with `points`.
    """
    p, i = _sides(points, intervals, t, lo, hi, width_us)
    i = i.withColumnsRenamed({k: f"_i_{k}" for k in [*keys, BUCKET]})
    on = (F.col(t) >= F.col(lo)) & (F.col(t) <= F.col(hi))
    for k in [*keys, BUCKET]:
        on = on & (F.col(k) == F.col(f"_i_{k}"))
    rest = [c for c in points.columns if c not in keys and c != point_id]
    return (p.join(i, on, "left").groupBy(*keys, BUCKET, point_id)
            .agg(*[F.first(c).alias(c) for c in rest], F.min_by(take, F.struct(*rank)).alias(out)).drop(BUCKET))
