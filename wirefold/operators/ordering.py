"""Exact ranks, running totals and percentiles without an unpartitioned window.

Rows are cut into buckets of near-equal depth on the ordering value (cuts come from `percentile_approx`, a
map-side-combined aggregate that returns a fixed number of doubles and is read once, so every branch of the plan
uses the same literal cuts). Windows then run inside one bucket, and bucket totals - at most `buckets` rows per
group - carry the running amount across buckets. A value repeated many times collapses to one row before any window.
"""

from __future__ import annotations

from collections import Counter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"
ROWS_PER_BUCKET = 5_000_000


def bucket_count(df: DataFrame) -> int:
    return max(64, 4 * df.sparkSession.sparkContext.defaultParallelism)


def depth_cuts(df: DataFrame, value: str, buckets: int | None = None) -> list[float]:
    """Distinct inner cut points that split all rows of `df` into buckets of near-equal row count."""
    return sorted(set(depth_points(df, value, buckets)))


def depth_points(df: DataFrame, value: str, buckets: int | None = None) -> list[float]:
    """The inner cut points, in order; a value that holds the rows of several buckets comes several times.

    Without `buckets`, the aggregate that makes the cuts also counts the rows, and is repeated with more buckets where
    these would hold more than ROWS_PER_BUCKET rows.
    """
    df = df.where(~F.isnan(F.col(value).cast("double")) | F.col(value).isNull())

    def cut(n: int):
        probs = [i / n for i in range(1, n)]
        return df.agg(F.percentile_approx(F.col(value).cast("double"), probs, 20 * n).alias("c"),
                      F.count(F.lit(1)).alias("n")).first()

    n = buckets or bucket_count(df)
    row = cut(n)
    if buckets is None and row["n"] > n * ROWS_PER_BUCKET:
        row = cut(-(-row["n"] // ROWS_PER_BUCKET))
    return list(row["c"] or [])


def with_bucket(df: DataFrame, value: str, cuts: list[float]) -> DataFrame:
    """Adds the integer bucket of `value`; a value equal to a cut belongs to the bucket that starts there."""
    if not cuts:
        return df.withColumn(BUCKET, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    tmp = df.withColumn("_bv", F.col(value).cast("double"))
    out = Bucketizer(splits=splits, inputCol="_bv", outputCol="_bf", handleInvalid="keep").transform(tmp)
    return out.withColumn(BUCKET, F.col("_bf").cast("int")).drop("_bv", "_bf")


def _offsets(df: DataFrame, groups: list[str], sums: list[str], descending: bool,
             value: str | None = None) -> DataFrame:
    """Per (groups, bucket): sums over the buckets before it, sums over the group and, for `value`, the next non-empty
    bucket's first."""
    order = F.desc(BUCKET) if descending else F.asc(BUCKET)
    firsts = [F.min(value).alias("_first")] if value else []
    totals = df.groupBy(*groups, BUCKET).agg(*[F.sum(s).alias(s) for s in sums], *firsts)
    w = Window.partitionBy(*groups).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*groups, BUCKET, *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_off_{s}") for s in sums],
                         *[F.sum(s).over(Window.partitionBy(*groups)).alias(f"_all_{s}") for s in sums],
                         *([F.lead("_first").over(w).alias("_after")] if value else []))


def running_totals(cells: DataFrame, groups: list[str], value: str, sums: list[str], *,
                   cuts: list[float] | None = None, descending: bool = False,
                   next_out: str | None = None, totals: bool = False) -> DataFrame:
    """Inclusive running sums `cum_<s>` over `value` within `groups`; `cells` has one row per (groups, value).

    `next_out` adds the next larger value (ascending order only; NULL for the largest). `totals` adds the group's sums
    `all_<s>`, which come with the bucket totals: a join by group would bring all cells of a group to one task.
    """
    cuts = depth_cuts(cells, value) if cuts is None else cuts
    b = with_bucket(cells, value, cuts)
    w = Window.partitionBy(*groups, BUCKET).orderBy(F.desc(value) if descending else F.asc(value))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    lead = [F.lead(value).over(w).alias("_next")] if next_out else []
    local = b.select("*", *[F.sum(s).over(upto).alias(f"_loc_{s}") for s in sums], *lead)
    out = local.join(_offsets(b, groups, sums, descending, value if next_out else None), [*groups, BUCKET])
    nxt = [F.coalesce("_next", "_after").alias(next_out)] if next_out else []
    both = [F.col(f"_all_{s}").alias(f"all_{s}") for s in sums] if totals else []
    return out.select(*cells.columns, *[(F.col(f"_loc_{s}") + F.col(f"_off_{s}")).alias(f"cum_{s}") for s in sums],
                      *nxt, *both)


def numbered(df: DataFrame, groups: list[str], first: str, ties: list[str], out: str,
             buckets: int | None = None) -> DataFrame:
    """1-based position within `groups` by (`first`, *ties); exact and bounded per task.

    A value of `first` that fills several buckets is cut further by the tie columns, so that rows of one time spread
    over tasks too.
    """
    points = depth_points(df, first, buckets)
    b = with_bucket(df, first, sorted(set(points)))
    heavy = {v: n for v, n in Counter(points).items() if n > 1} if ties else {}
    if heavy:
        parts = max(heavy.values()) + 1
        inside = _tie_bucket(df, first, ties, heavy)
        b = b.withColumn(BUCKET, F.col(BUCKET) * parts + F.coalesce(inside, F.lit(parts - 1)))
    b = b.withColumn("_one", F.lit(1).cast("bigint"))
    w = Window.partitionBy(*groups, BUCKET).orderBy(first, *ties)
    local = b.withColumn("_rn", F.row_number().over(w))
    return (local.join(_offsets(b, groups, ["_one"], False), [*groups, BUCKET])
            .withColumn(out, F.col("_rn") + F.col("_off__one")).drop("_rn", "_one", "_off__one", "_all__one", BUCKET))


TIE_SAMPLE = 20  # rows sampled per cut


def _tie_bucket(df: DataFrame, first: str, ties: list[str], heavy: dict[float, int]):
    """For rows whose `first` is a heavy value: how many of its cuts in the tie columns are at or before the row; NULL for
    others. Cuts come from a hashed sample of at most TIE_SAMPLE rows per cut, so they steer the spread and not the
    numbers."""
    rows = df.where(F.col(first).cast("double").isin(list(heavy))).select(first, *ties)
    some = rows.orderBy(F.xxhash64(*ties)).limit(TIE_SAMPLE * sum(heavy.values())).orderBy(first, *ties).collect()
    kinds = {t: df.schema[t].dataType for t in ties}
    out = F.lit(None).cast("int")
    for value, n in heavy.items():
        found = [r for r in some if float(r[first]) == value]
        picked = [found[len(found) * i // (n + 1)] for i in range(1, n + 1)] if found else []
        if picked:
            cuts = F.array(*[F.struct(*[F.lit(r[t]).cast(kinds[t]).alias(t) for t in ties]) for r in picked])
            at = F.size(F.filter(cuts, lambda c: c <= F.struct(*[F.col(t).alias(t) for t in ties])))
            out = F.when(F.col(first).cast("double") == value, at).otherwise(out)
    return out


def percentiles(df: DataFrame, groups: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated percentiles per group, one column per name in `probs`.

    Repeated values collapse to counts, running counts locate the two neighbours of each rank, and only those
    are kept: no buffer ever holds a whole group.
    """
    if not groups:
        return percentiles(df.withColumn("_all", F.lit(1)), ["_all"], value, probs).drop("_all")
    src = df.where(F.col(value).isNotNull())
    cells = src.groupBy(*groups, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    cuts = depth_cuts(src.select(F.col(value).cast("double").alias("_v")), "_v")
    r = running_totals(cells, groups, "_v", ["_n"], cuts=cuts, totals=True).withColumnRenamed("all__n", "_size")
    aggs, cols = [], []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("_size") - 1)
        lo_at, hi_at = F.floor(pos) + 1, F.ceil(pos) + 1
        aggs += [F.min(F.when(F.col("cum__n") >= lo_at, F.col("_v"))).alias(f"_lo_{name}"),
                 F.min(F.when(F.col("cum__n") >= hi_at, F.col("_v"))).alias(f"_hi_{name}")]
        frac = F.lit(p) * (F.col("_size") - 1) - F.floor(F.lit(p) * (F.col("_size") - 1))
        cols.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * frac).alias(name))
    return r.groupBy(*groups, "_size").agg(*aggs).select(*groups, *cols)
