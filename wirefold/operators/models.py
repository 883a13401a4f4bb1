"""Baseline classifiers on flow features with MLlib, transfer scoring and calibration.

Everything fitted - scaler, weights, model, calibration - comes from train (or source validation) rows only; guards
refuse anything else. Scores are ordinary columns, so thresholds and metrics apply to them as to any score table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import ElementwiseProduct, MinMaxScaler, RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.operators.features import guard_features
from wirefold.operators.isotonic import interpolate, isotonic_blocks
from wirefold.operators.thresholds import best_f1, fixed_fpr, label_tiers, score_cells, sweep
from wirefold.schemas import FEATURES, PREDICTION_COLS
from wirefold.session import cut_lineage


@dataclass
class Config:
    """Baseline settings of the three models."""

    lr: dict = field(default_factory=lambda: {"C": 1.0, "max_iter": 1000})
    rf: dict = field(default_factory=lambda: {"trees": 200, "depth": 15, "min_leaf": 2})
    gbt: dict = field(default_factory=lambda: {"rounds": 300, "depth": 6, "step": 0.1, "rows": 0.8, "cols": "0.8"})
    seed: int = 42


def scaler_table(train: DataFrame, cols: list[str] = FEATURES) -> DataFrame:
    """(feature, mean, std) with population deviation, from train rows only; one aggregate."""
    aggs = [F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"),
                     F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")) for c in cols]
    return train.agg(F.array(*aggs).alias("_a")).select(F.explode("_a").alias("_e")).select("_e.*")


def scaling_stages(kind: str, n_rows: int, width: int) -> list:
    if kind == "standard":
        # MLlib divides by the sample deviation; the factor turns that into the population deviation.
        f = (n_rows / max(n_rows - 1, 1)) ** 0.5
        return [StandardScaler(inputCol="raw", outputCol="_z", withMean=True, withStd=True),
                ElementwiseProduct(scalingVec=Vectors.dense([f] * width), inputCol="_z", outputCol="features")]
    if kind == "minmax":
        return [MinMaxScaler(inputCol="raw", outputCol="features")]
    if kind == "robust":
        return [RobustScaler(inputCol="raw", outputCol="features", withCentering=True)]
    if kind == "none":
        return [ElementwiseProduct(scalingVec=Vectors.dense([1.0] * width), inputCol="raw", outputCol="features")]
    raise ValueError(f"unknown scaler: {kind}")


def require_only(df: DataFrame, col: str, allowed: list[str], what: str) -> DataFrame:
    """Refuses to fit `what` on rows outside the allowed values of a provenance column."""
    bad = df.where(~F.coalesce(F.col(col).isin(*allowed), F.lit(False))).select(col).limit(1).collect()
    if bad:
        raise ValueError(f"{what} must be fitted on {col} in {allowed}, found {bad[0][0]!r}")
    return df


def with_class_weight(train: DataFrame, y: str = "y", positive_only: bool = False) -> DataFrame:
    """Balanced weights n/(2 n_c), or n_benign/n_attack for attacks and 1 for benign rows; the two counts are read once
    and enter as literals."""
    c = {r[y]: r["n"] for r in train.groupBy(y).agg(F.count("*").alias("n")).collect()}
    if set(c) != {0, 1}:
        raise ValueError(f"training rows need both classes, found {sorted(c)}")
    n = c[0] + c[1]
    if positive_only:
        return train.withColumn("w", F.when(F.col(y) == 1, c[0] / c[1]).otherwise(1.0))
    return train.withColumn("w", F.when(F.col(y) == 1, n / (2 * c[1])).otherwise(n / (2 * c[0])))


def fit(train: DataFrame, kind: str, cfg: Config | None = None, cols: list[str] | None = None, y: str = "y",
        scaler: str = "standard", split_col: str = "split") -> PipelineModel:
    """Fits `logistic_regression`, `random_forest` or `boosted_trees` on train rows."""
    cfg, cols = cfg or Config(), list(cols or FEATURES)
    guard_features(cols)
    if split_col in train.columns:
        require_only(train, split_col, ["train"], kind)
    t = with_class_weight(train, y, positive_only=kind == "boosted_trees")
    asm = VectorAssembler(inputCols=cols, outputCol="raw" if kind == "logistic_regression" else "features")
    if kind == "logistic_regression":
        n = train.count()
        # Balanced weights sum to the row count, so this penalty equals inverse strength C on the summed loss.
        m = LogisticRegression(labelCol=y, weightCol="w", maxIter=cfg.lr["max_iter"], regParam=1.0 / (cfg.lr["C"] * n),
                               elasticNetParam=0.0, standardization=False)
        stages = [asm, *scaling_stages(scaler, n, len(cols)), m]
    elif kind == "random_forest":
        m = RandomForestClassifier(labelCol=y, weightCol="w", numTrees=cfg.rf["trees"], maxDepth=cfg.rf["depth"],
                                   minInstancesPerNode=cfg.rf["min_leaf"], seed=cfg.seed)
        stages = [asm, m]
    elif kind == "boosted_trees":
        g = cfg.gbt
        m = GBTClassifier(labelCol=y, weightCol="w", maxIter=g["rounds"], maxDepth=g["depth"], stepSize=g["step"],
                          subsamplingRate=g["rows"], featureSubsetStrategy=g["cols"], seed=cfg.seed)
        stages = [asm, m]
    else:
        raise ValueError(f"unknown model: {kind}")
    return Pipeline(stages=stages).fit(t)


def score(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """`model_name` and `y_score` = P(attack); a row-wise transform with no shuffle."""
    out = model.transform(df).withColumn("y_score", vector_to_array("probability")[1])
    drop = [c for c in ("raw", "_z", "features", "rawPrediction", "probability", "prediction", "w") if c in out.columns]
    return out.drop(*drop).withColumn("model_name", F.lit(name))


MODELS = ["logistic_regression", "random_forest", "boosted_trees"]


def run_baselines(labelled: DataFrame, cfg: Config | None = None, models: list[str] = MODELS) -> DataFrame:
    """Fits every model on train rows and scores all splits; long predictions, one block per model.

    The feature table is stored once: every fit passes over it many times.
    """
    labelled = cut_lineage(labelled)
    train = labelled.where(F.col("split") == "train")
    out = None
    for m in models:
        part = score(fit(train, m, cfg), labelled, m)
        out = part if out is None else out.unionByName(part)
    return out


def source_thresholds(val: DataFrame, budget: float = 0.01, score_col: str = "y_score", y: str = "y") -> dict:
    """Default, best-F1 and fixed-FPR thresholds from source validation rows."""
    v = val.withColumn("_all", F.lit(1))
    b = best_f1(sweep(v, ["_all"], score=score_col, y=y), ["_all"]).first()
    f = fixed_fpr(v, ["_all"], [budget], score=score_col, y=y).first()
    return {"default": 0.5, "val_tuned": b["threshold"] if b else 0.5,
            "fixed_fpr": f["threshold"] if f else 0.5}


def transfer(source: DataFrame, target: DataFrame, kind: str, dataset_col: str = "dataset",
             cfg: Config | None = None) -> DataFrame:
    """Target rows scored and labelled with model, scaler and thresholds fitted on the source alone."""
    shared = source.select(dataset_col).distinct().join(target.select(dataset_col).distinct(), dataset_col, "left_semi")
    if not shared.isEmpty():
        raise ValueError("source and target share a dataset")
    source = cut_lineage(source)
    model = fit(source.where(F.col("split") == "train"), kind, cfg)
    t = source_thresholds(score(model, source.where(F.col("split") == "val"), kind))
    return label_tiers(score(model, target, kind), t["default"], t["val_tuned"], t["fixed_fpr"], "y_score")


def combine_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of several sources' rows tagged with `source`; splits stay as they are, so validation pools too."""
    out = None
    for name, df in parts.items():
        p = df.withColumn("source", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return out


def prediction_sidecar(scored: DataFrame, thresholds: dict) -> DataFrame:
    """The 12-column prediction table."""
    s = scored.withColumnRenamed("y_score", "pred_score")
    s = label_tiers(s, thresholds["default"], thresholds["val_tuned"], thresholds["fixed_fpr"])
    s = s.withColumns({f"is_{r}": F.col("split") == r for r in ("train", "val", "test")})
    return s.select(*PREDICTION_COLS)


def calibrate(val: DataFrame, df: DataFrame, method: str = "isotonic", score_col: str = "y_score", y: str = "y_true",
              split_col: str | None = None) -> DataFrame:
    """`calibrated` score fitted on source validation rows: isotonic or Platt.

    Both fit on score cells weighted by their counts, so equal scores enter once. Rows without a score, or with NaN, are
    not fitted; isotonic regression gives them NULL.
    """
    if split_col:
        require_only(val, split_col, ["val"], "calibration")
    cells = score_cells(val.where(F.col(score_col).isNotNull() & ~F.isnan(score_col)), [], score_col, y)
    if method == "isotonic":
        return interpolate(df, isotonic_blocks(cells), score_col, "calibrated")
    if method != "platt":
        raise ValueError(f"unknown calibration: {method}")
    long = cells.select("score", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("pos").cast("double").alias("w")),
        F.struct(F.lit(0.0).alias("label"), F.col("neg").cast("double").alias("w")))).alias("_e")).select("score", "_e.*")
    asm = VectorAssembler(inputCols=["_score"], outputCol="_x")
    src = asm.transform(long.where("w > 0").withColumn("_score", F.col("score")))
    out = asm.transform(df.withColumn("_score", F.col(score_col)))
    m = LogisticRegression(featuresCol="_x", labelCol="label", weightCol="w", maxIter=200).fit(src)
    return m.transform(out).withColumn("calibrated", vector_to_array("probability")[1]).drop(
        "_x", "_score", "rawPrediction", "probability", "prediction")


def pooled_tiers(parts: dict[str, DataFrame], kind: str, cfg: Config | None = None, budget: float = 0.01) -> DataFrame:
    """Several sources trained as one: the model is fitted on the pooled train rows, the default, best-F1 and fixed-FPR
    thresholds come from the pooled validation rows, and every row gets its score and its label under each of them."""
    pooled = cut_lineage(combine_sources(parts))
    model = fit(pooled.where(F.col("split") == "train"), kind, cfg)
    scored = cut_lineage(score(model, pooled, f"multisource_{kind}"))
    t = source_thresholds(scored.where(F.col("split") == "val"), budget)
    tiers = label_tiers(scored, t["default"], t["val_tuned"], t["fixed_fpr"], "y_score")
    return tiers.withColumns({f"threshold_{k}": F.lit(float(v)) for k, v in t.items()})
