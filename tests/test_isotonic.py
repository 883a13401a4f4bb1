"""Isotonic regression by merged blocks against MLlib and against the max-min formula; ranks under heavy ties."""

import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirefold.operators import isotonic as iso
from wirefold.operators import models as md
from wirefold.operators import ordering as od


def sample(seed, n, distinct):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.random() if distinct else r.randrange(40) / 40
        out.append((i, s, int(r.random() < 0.2 + 0.6 * s)))
    return out


@pytest.mark.parametrize("distinct", [True, False])
@pytest.mark.parametrize("buckets", [1, 40])
def test_equals_mllib(spark, distinct, buckets):
    df = spark.createDataFrame(sample(3, 600, distinct), "id long, y_score double, y_true int")
    cells = df.groupBy(F.col("y_score").alias("score")).agg(F.sum("y_true").alias("pos"), F.sum(1 - F.col("y_true")).alias("neg"))
    asked = spark.createDataFrame([(i / 997 * 1.2 - 0.1,) for i in range(997)], "y_score double").unionByName(df.select("y_score"))
    got = iso.interpolate(asked, iso.isotonic_blocks(cells, buckets=buckets), "y_score", "c").select("y_score", "c")
    asm = VectorAssembler(inputCols=["y_score"], outputCol="x")
    src = asm.transform(df.withColumn("label", F.col("y_true").cast("double")))
    want = IsotonicRegression(featuresCol="x", labelCol="label", predictionCol="p").fit(src).transform(asm.transform(asked))
    a = dict((r["y_score"], r["c"]) for r in got.collect())
    b = dict((r["y_score"], r["p"]) for r in want.collect())
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-9
    assert got.count() == asked.count()


def test_blocks_are_few_and_rise(spark):
    """All scores distinct: the blocks stay far below the bound, whatever the buckets."""
    n = 20_000
    cells = spark.range(n).select((F.col("id") / n).alias("score"), (F.xxhash64("id") % 100 < F.col("id") * 100 / n).cast(
        "long").alias("pos")).withColumn("neg", 1 - F.col("pos"))
    blocks = sorted(iso.isotonic_blocks(cells).collect(), key=lambda r: r["lo"])
    assert len(blocks) < 3 * n ** (2 / 3)
    assert all(a["hi"] < b["lo"] and a["value"] < b["value"] for a, b in zip(blocks, blocks[1:]))
    assert sum(r["n"] for r in blocks) == n
    perfect = cells.withColumns({"pos": (F.col("score") > 0.5).cast("long"), "neg": (F.col("score") <= 0.5).cast("long")})
    assert [(r["n"], r["value"]) for r in iso.isotonic_blocks(perfect).orderBy("lo").collect()] == [
        (n // 2 + 1, 0.0), (n // 2 - 1, 1.0)]


def test_missing_scores_and_empty_tables(spark):
    df = spark.createDataFrame([(0.2, 0), (0.8, 1), (None, 1), (float("nan"), 0)], "y_score double, y_true int")
    got = md.calibrate(df, df, "isotonic").collect()
    assert sorted((r["calibrated"] for r in got), key=str) == [0.0, 1.0, None, None]
    assert md.calibrate(df.limit(0), df, "isotonic").where("calibrated is not null").count() == 0


def test_numbers_under_one_hot_time(spark):
    """Half of all rows have one time, their order hangs on two tie columns; no window holds more than its share."""
    r = random.Random(5)
    rows = [("f" if i % 3 else "g", 50 if i % 2 else r.randrange(100), f"h{r.randrange(400):03}", i) for i in range(6000)]
    df = spark.createDataFrame(rows, "file string, t long, host string, n long")
    got = od.numbered(df, ["file"], "t", ["host", "n"], "pos").collect()
    for file in "fg":
        mine = sorted((x for x in rows if x[0] == file), key=lambda x: (x[1], x[2], x[3]))
        assert {(x["t"], x["host"], x["n"]): x["pos"] for x in got if x["file"] == file} == {
            x[1:]: i + 1 for i, x in enumerate(mine)}
    points = od.depth_points(df, "t")
    heavy = {v: c for v, c in __import__("collections").Counter(points).items() if c > 1}
    at = od._tie_bucket(df, "t", ["host", "n"], heavy)
    sizes = [x["count"] for x in df.where("t = 50").groupBy(at.alias("b")).count().collect()]
    assert max(sizes) < 0.15 * sum(sizes)


def test_numbers_with_missing_ties(spark):
    schema = T.StructType([T.StructField("t", T.LongType()), T.StructField("a", T.StringType()), T.StructField("b", T.IntegerType())])
    rows = [(7, None if i % 3 == 0 else f"k{i % 50:02}", None if i % 5 == 0 else i) for i in range(2000)]
    got = od.numbered(spark.createDataFrame(rows, schema), [], "t", ["a", "b"], "pos").orderBy("pos").collect()
    key = lambda x: (x[1] is not None, x[1] or "", x[2] is not None, x[2] or 0)
    assert [r["pos"] for r in got] == list(range(1, 2001))
    assert [key(tuple(r)) for r in got] == sorted(key(x) for x in rows)
