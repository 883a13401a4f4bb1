"""Bootstrap intervals, paired deltas, seed stability and Holm correction.

Replicates of counts and areas never touch rows. F1, recall and FPR depend on four confusion counts, so a multinomial redraw of the
counts is exactly the row bootstrap; a paired delta needs eight joint counts. ROC and precision-recall areas work on
score cells: each depth bucket is one sorted stream whose cells get Poisson weights for all replicates at once, and
only per-bucket sums leave it. Those weights come from `redraw`: any SQL engine can repeat them. So can it the hashed
redraw, the one that does touch every row in every replicate.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirefold.functions import rules
from wirefold.functions.columns import safe_divide
from wirefold.operators import redraw
from wirefold.operators.ordering import BUCKET, depth_cuts, percentiles, with_bucket
from wirefold.operators.thresholds import confusion, predicted, rates, roc_points, score_cells
from wirefold.session import cut_lineage

REPLICATES = 1000
SEED = 42
# Cells drawn per numpy call inside a task.
STEP = 256


def confusion_cells(pred: Column, y: str = "y_true") -> dict[str, Column]:
    p, t = pred.cast("boolean"), F.col(y) == 1
    return {"tp": p & t, "fp": p & ~t, "fn": ~p & t, "tn": ~p & ~t}


def hashed_counts(df: DataFrame, by: list[str], row_id: str, cells: dict[str, Column],
                  replicates: int = REPLICATES) -> DataFrame:
    """Weighted counts of each cell per group and replicate: every row has a weight of its own in every replicate, by the
    md5 of 'replicate:row_id' (a whole number). Rows without an id get the largest weight, as SQL gives them.

    A row's weights are drawn once for all cells and leave the task as sums. Drawing is what costs, so rows are dealt evenly.
    """
    spark, names = df.sparkSession, list(cells)
    x = df.select(*by, F.col(row_id).cast("bigint").alias("_id"),
                  *[F.coalesce(c, F.lit(False)).alias(f"_c{i}") for i, c in enumerate(cells.values())])
    schema = T.StructType([x.schema[k] for k in by] + [T.StructField("replicate", T.LongType())]
                          + [T.StructField(n, T.LongType()) for n in names])

    def rows(sums: dict) -> pd.DataFrame:
        parts = []
        for key, total in sums.items():
            part = pd.DataFrame(total, columns=names).assign(replicate=np.arange(replicates))
            for k, v in zip(by, key):
                part[k] = v
            parts.append(part[[*by, "replicate", *names]])
        return pd.concat(parts)

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            ident = list(zip(*[pdf[k].astype(object).where(pdf[k].notna(), None) for k in by])) if by else [()] * len(pdf)
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(ident):
                groups.setdefault(key, []).append(i)
            flags = pdf[[f"_c{i}" for i in range(len(names))]].to_numpy(np.float32)
            known = pdf["_id"].notna().to_numpy()
            ids = pdf["_id"].fillna(0).to_numpy(np.int64)
            for a in range(0, replicates, STEP):
                reps = np.arange(a, min(a + STEP, replicates))
                w = redraw.row_weights(ids, reps)
                w[:, ~known] = len(redraw.POISSON_CDF)
                for key, at in groups.items():
                    total = sums.setdefault(key, np.zeros((replicates, len(names)), np.int64))
                    total[reps] += (w[:, at] @ flags[at]).astype(np.int64)
            if len(sums) > STEP:
                yield rows(sums)
                sums = {}
        if sums:
            yield rows(sums)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    drawn = x.repartition(tasks).mapInPandas(run, schema)
    return drawn.groupBy(*by, "replicate").agg(*[F.sum(n).alias(n) for n in names])


def interval(reps: DataFrame, by: list[str], metric: str, level: float = 0.95) -> DataFrame:
    a = (1 - level) / 2
    return percentiles(reps, by, metric, {f"{metric}_lo": a, f"{metric}_hi": 1 - a})


def _redraw(names: list[str], keys: list[str], block: int, seed: int):
    def run(batches):
        for pdf in batches:
            parts = []
            for r in pdf.to_dict("records"):
                tag = zlib.crc32("|".join(str(r[k]) for k in keys).encode())
                rng = np.random.default_rng([seed, tag, int(r["_block"])])
                counts = np.array([r[n] for n in names], dtype=np.int64)
                total = int(counts.sum())
                draws = rng.multinomial(total, counts / total, size=block) if total else np.zeros((block, len(names)))
                part = pd.DataFrame(draws.astype(np.int64), columns=names)
                for k in keys:
                    part[k] = r[k]
                part["replicate"] = np.arange(block) + int(r["_block"]) * block
                parts.append(part)
            if parts:
                yield pd.concat(parts)[[*keys, "replicate", *names]]

    return run


def redraw_counts(counts: DataFrame, keys: list[str], names: list[str], replicates: int = REPLICATES,
                  seed: int = SEED, block: int = 250) -> DataFrame:
    """Multinomial redraws of the count columns of every row; blocks of replicates spread over tasks."""
    n_blocks = -(-replicates // block)
    x = counts.select(*keys, *names, F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("_block"))
    x = x.repartition(*keys, "_block")
    schema = T.StructType([counts.schema[k] for k in keys] + [T.StructField("replicate", T.LongType())]
                          + [T.StructField(n, T.LongType()) for n in names])
    return x.mapInPandas(_redraw(names, keys, block, seed), schema).where(F.col("replicate") < replicates)


def bootstrap_f1(df: DataFrame, by: list[str], threshold: float = 0.5, replicates: int = REPLICATES, seed: int = SEED,
                 score: str = "y_score", y: str = "y_true") -> DataFrame:
    """Point F1 with its percentile interval."""
    c = confusion(df, by, predicted(score, F.lit(threshold)), y)
    reps = rates(redraw_counts(c, by, ["tp", "fp", "fn", "tn"], replicates, seed))
    point = rates(c).select(*by, F.col("f1").alias("f1_pe"), (F.col("tp") + F.col("fn")).alias("n_attacks"),
                            (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n_test"))
    return point.join(interval(reps, by, "f1"), by).withColumn("n_bootstrap", F.lit(replicates))


# --- areas under curves ------------------------------------------------------------------------------------------

def _streams(keys: list[str], reps: int, kind: str):
    """Sorted cells (top score first) to one row per bucket.

    kind 'roc': positive and negative weight and concordance inside the bucket. kind 'pr': each bucket's stream opens
    with a row holding the weights above it, and yields its share of average precision.
    """

    replicates = np.arange(reps)

    def run(batches):
        key, st = None, None

        def close():
            out = dict(zip(keys, key))
            out.update({"p": st["p"].tolist(), "n": st["n"].tolist(), "u": st["u"].tolist()})
            return out

        for pdf in batches:
            rows = []
            ident = list(zip(*[pdf[k] for k in keys]))
            cuts = [0] + [i for i in range(1, len(ident)) if ident[i] != ident[i - 1]] + [len(ident)]
            pos, neg, cell, group = (pdf[c].to_numpy() for c in ("pos", "neg", "cell", "group_no"))
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if ident[a] != key:
                    if key is not None:
                        rows.append(close())
                    key = ident[a]
                    st = {c: np.zeros(reps) for c in ("p", "n", "u", "p0", "n0")}
                    if kind == "pr" and pos[a] < 0:
                        st["p0"], st["n0"] = np.array(pdf["p0"].iloc[a]), np.array(pdf["n0"].iloc[a])
                        a += 1
                for i in range(a, b, STEP):
                    j = min(i + STEP, b)
                    wp, wn = (redraw.weights(int(group[a]), 2 * cell[i:j] + c, n[i:j], replicates)
                              for c, n in ((0, pos), (1, neg)))
                    cp, cn = st["p"] + np.cumsum(wp, axis=0), st["n"] + np.cumsum(wn, axis=0)
                    if kind == "roc":
                        # Negatives of this bucket ranked above these positives, and half of the tied ones.
                        st["u"] += (wp * (cn - wn / 2)).sum(axis=0)
                    else:
                        tp, fp = st["p0"] + cp, st["n0"] + cn
                        st["u"] += (wp * np.divide(tp, tp + fp, out=np.zeros_like(tp), where=(tp + fp) > 0)).sum(axis=0)
                    st["p"], st["n"] = cp[-1], cn[-1]
            if rows:
                yield pd.DataFrame(rows)[[*keys, "p", "n", "u"]]
        if key is not None:
            yield pd.DataFrame([close()])[[*keys, "p", "n", "u"]]

    return run


def bootstrap_areas(df: DataFrame, by: list[str], replicates: int = REPLICATES,
                    score: str = "y_score", y: str = "y_true") -> DataFrame:
    """roc_auc and pr_auc of every replicate: (by, replicate, roc_auc, pr_auc). All rows count, none is subsampled.

    Prevalence stays that of the data. A cell is known by the number of rows at or above its score, and its weights
    follow from that, so they do not depend on buckets and the second pass redraws the same ones.
    """
    cuts = depth_cuts(df, score)
    points = roc_points(score_cells(df, by, score, y), by, cuts).select(
        *by, "score", "pos", "neg", (F.col("tp") + F.col("fp")).alias("cell"), redraw.group_number(by).alias("group_no"))
    cells = cut_lineage(with_bucket(points, "score", cuts))
    keys = [*by, BUCKET]
    arr = T.ArrayType(T.DoubleType())
    out = T.StructType([cells.schema[k] for k in keys] + [T.StructField(c, arr) for c in ("p", "n", "u")])
    drawn = ["pos", "neg", "cell", "group_no"]
    srt = cells.select(*keys, "score", *drawn).repartition(*keys).sortWithinPartitions(*keys, F.desc("score"))
    roc = cut_lineage(srt.mapInPandas(_streams(keys, replicates, "roc"), out))  # draws are dear
    long = roc.select(*keys, F.posexplode(F.arrays_zip("p", "n", "u")).alias("replicate", "_z")).select(
        *keys, "replicate", "_z.p", "_z.n", "_z.u")
    w = Window.partitionBy(*by, "replicate").orderBy(F.desc(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    off = long.withColumns({"p0": F.coalesce(F.sum("p").over(w), F.lit(0.0)),
                            "n0": F.coalesce(F.sum("n").over(w), F.lit(0.0))})
    auc = off.groupBy(*by, "replicate").agg(
        F.sum("p").alias("P"), F.sum("n").alias("N"), F.sum(F.col("u") + F.col("p") * F.col("n0")).alias("lost"))
    auc = auc.select(*by, "replicate", (1 - F.try_divide(F.col("lost"), F.col("P") * F.col("N"))).alias("roc_auc"), "P")
    heads = off.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("replicate", "p0", "n0"))).alias("_o")).select(
        *keys, F.lit(float("inf")).alias("score"), F.lit(-1).cast("bigint").alias("pos"),
        F.lit(-1).cast("bigint").alias("neg"), F.lit(0).cast("bigint").alias("cell"), F.lit(0).cast("bigint").alias("group_no"),
        F.col("_o.p0").alias("p0"), F.col("_o.n0").alias("n0"))
    body = cells.select(*keys, "score", *drawn).withColumns({"p0": F.lit(None).cast(arr),
                                                                    "n0": F.lit(None).cast(arr)})
    second = (body.unionByName(heads).repartition(*keys).sortWithinPartitions(*keys, F.desc("score"))
              .mapInPandas(_streams(keys, replicates, "pr"), out))
    ap = (second.select(*keys, F.posexplode("u").alias("replicate", "u")).groupBy(*by, "replicate")
          .agg(F.sum("u").alias("ap")))
    return cut_lineage(auc.join(ap, [*by, "replicate"]).select(*by, "replicate", "roc_auc",
                                                               F.try_divide("ap", "P").alias("pr_auc")))


# --- paired comparison -------------------------------------------------------------------------------------------

JOINT = [f"c{y}{a}{b}" for y in (0, 1) for a in (0, 1) for b in (0, 1)]


def joint_cells(pred_a: Column, pred_b: Column, y: str = "y_true") -> dict[str, Column]:
    t, a, b = F.col(y), pred_a.cast("int"), pred_b.cast("int")
    return {f"c{i}{j}{k}": (t == i) & (a == j) & (b == k) for i in (0, 1) for j in (0, 1) for k in (0, 1)}


def joint_counts(df: DataFrame, by: list[str], pred_a: Column, pred_b: Column, y: str = "y_true") -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in joint_cells(pred_a, pred_b, y).items()])


def f1_delta(counts: DataFrame) -> DataFrame:
    """Adds `delta` = F1(a) - F1(b) from joint counts."""
    c = F.col
    tp_a, tp_b = c("c110") + c("c111"), c("c101") + c("c111")
    pred_a, pred_b = tp_a + c("c010") + c("c011"), tp_b + c("c001") + c("c011")
    pos = c("c100") + c("c101") + c("c110") + c("c111")
    return counts.withColumn("delta", safe_divide(tp_a * 2, pred_a + pos) - safe_divide(tp_b * 2, pred_b + pos))


def summarise_delta(point: DataFrame, reps: DataFrame, by: list[str]) -> DataFrame:
    """Point delta, 95 % interval and two-sided p from one distribution; significance follows from the interval."""
    ci = interval(reps, by, "delta")
    below, above = F.avg((F.col("delta") <= 0).cast("double")), F.avg((F.col("delta") >= 0).cast("double"))
    p = reps.groupBy(*by).agg(F.least(2 * F.least(below, above), F.lit(1.0)).alias("p_value_raw"))
    j = point.select(*by, F.col("delta").alias("point_delta")).join(ci, by).join(p, by)
    return j.withColumns({
        "significant": (F.col("delta_lo") > 0) | (F.col("delta_hi") < 0),
        "delta_in_interval": (F.col("point_delta") >= F.col("delta_lo")) & (F.col("point_delta") <= F.col("delta_hi"))})


def paired_bootstrap(df: DataFrame, by: list[str], pred_a: Column, pred_b: Column, replicates: int = REPLICATES,
                     seed: int = SEED, y: str = "y_true") -> DataFrame:
    counts = joint_counts(df, by, pred_a, pred_b, y)
    reps = f1_delta(redraw_counts(counts, by, JOINT, replicates, seed))
    return summarise_delta(f1_delta(counts), reps, by)


def holm(tests: DataFrame, family: str, p: str = "p_value_raw", order: list[str] = ()) -> DataFrame:
    """Step-down adjusted p values within a comparison family (a report table: one row per test)."""
    w = Window.partitionBy(family).orderBy(p, *order)
    m = F.count("*").over(Window.partitionBy(family))
    step = F.col(p) * (m - F.row_number().over(w) + 1)
    run = F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return tests.withColumn("_step", step).withColumn("p_value_adj", F.least(run, F.lit(1.0))).drop("_step")


def seed_stability(per_seed: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    aggs = [F.count("*").alias("n_seeds")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"mean_{m}"), F.stddev_samp(m).alias(f"std_{m}"), F.min(m).alias(f"min_{m}"),
                 F.max(m).alias(f"max_{m}")]
    g = per_seed.groupBy(*by).agg(*aggs)
    return g.withColumn("stability", rules.seed_stability_class("std_f1")) if "f1" in metrics else g
