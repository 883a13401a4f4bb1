"""Scaler, weights, guards, transfer and the three end-to-end jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wirefold.operators import models as md
from wirefold.plans import pipeline as pl
from wirefold.plans.fixtures import ACTIVE_S, IDLE_S, table
from wirefold.registry import model_queries as mq
from wirefold.schemas import FEATURES, PREDICTION_COLS
from wirefold.operators import thresholds as th
from wirefold.operators.features import with_label_bit, extract_features
from wirefold.sources import tables as tb

SMALL = md.Config(lr={"C": 1.0, "max_iter": 50}, rf={"trees": 5, "depth": 4, "min_leaf": 1},
                  gbt={"rounds": 3, "depth": 3, "step": 0.1, "rows": 0.8, "cols": "0.8"})


@pytest.fixture(scope="module")
def rows(spark):
    base = spark.range(600).select(
        *[(F.pmod(F.xxhash64(F.col("id"), F.lit(i)), F.lit(1000)) / 100.0).alias(c) for i, c in enumerate(FEATURES)],
        F.col("id").alias("global_flow_id"), F.lit("Monday").alias("day"), F.lit("dos").alias("coarse_family"))
    base = base.withColumn("y", ((F.col("duration_s") > 5) | (F.col("bytes_total") > 9)).cast("int"))
    return base.withColumns({
        "binary_label": F.when(F.col("y") == 1, "attack").otherwise("benign"),
        "split": F.when(F.col("global_flow_id") % 5 < 3, "train").when(F.col("global_flow_id") % 5 == 3, "val")
        .otherwise("test"),
        "dataset": F.when(F.col("global_flow_id") < 400, "a").otherwise("b")}).cache()


@pytest.mark.parametrize("kind", md.MODELS)
def test_models_learn(rows, kind):
    m = md.fit(rows.where("split = 'train'"), kind, SMALL)
    s = md.score(m, rows.where("split = 'test'"), kind)
    r = th.ranking_metrics(s, ["model_name"], y="y").first()
    assert r.roc_auc > 0.75 and s.where("y_score < 0 or y_score > 1").count() == 0


def test_baseline_metrics_score_every_row_once(spark, rows, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def scored(x):
        seen.add(1)
        return x / 10

    base = rows.where("split = 'test'").select("y", "split", F.lit("m").alias("model_name"), scored("duration_s").alias("y_score"))
    monkeypatch.setattr(mq, "training_table", lambda spark, sf: rows)
    monkeypatch.setattr(mq.md, "run_baselines", lambda t: base)
    out = mq.baseline_metrics(spark, None).collect()
    assert seen.value == rows.where("split = 'test'").count()
    want = th.ranking_metrics(base, ["model_name"], y="y").first()
    assert len(out) == 1 and out[0].roc_auc == pytest.approx(want.roc_auc, abs=1e-4)


def test_scaler_matches_population_deviation(rows):
    train = rows.where("split = 'train'")
    m = md.fit(train, "logistic_regression", SMALL)
    z = m.stages[2].transform(m.stages[1].transform(m.stages[0].transform(train))).select("features").toPandas()
    x = np.stack([v.toArray() for v in z.features])
    assert np.allclose(x.mean(axis=0), 0, atol=1e-9) and np.allclose(x.std(axis=0), 1)
    t = {r.feature: r for r in md.scaler_table(train).collect()}
    assert t["duration_s"].std == pytest.approx(train.toPandas().duration_s.std(ddof=0))


def test_balanced_weights(rows):
    w = md.with_class_weight(rows).groupBy("y").agg(F.sum("w")).collect()
    assert {round(r[1], 6) for r in w} == {300.0}


def test_guards(rows):
    with pytest.raises(ValueError, match="split"):
        md.fit(rows, "random_forest", SMALL)
    with pytest.raises(ValueError, match="leak"):
        md.fit(rows.where("split = 'train'"), "random_forest", SMALL, cols=["duration_s", "day"])
    with pytest.raises(ValueError, match="unknown model"):
        md.fit(rows.where("split = 'train'"), "svm", SMALL)
    with pytest.raises(ValueError, match="both classes"):
        md.with_class_weight(rows.where("y = 1"))
    with pytest.raises(ValueError, match="share a dataset"):
        md.transfer(rows, rows, "random_forest", cfg=SMALL)
    with pytest.raises(ValueError, match="calibration"):
        md.calibrate(rows.withColumn("y_score", F.lit(0.5)), rows, y="y", split_col="split")


def test_transfer_refuses_any_shared_dataset(rows):
    many = rows.withColumn("dataset", F.concat(F.lit("s"), F.col("global_flow_id") % 60))
    target = rows.withColumn("dataset", F.when(F.col("global_flow_id") == 7, "s59").otherwise("t"))
    with pytest.raises(ValueError, match="share a dataset"):
        md.transfer(many, target, "logistic_regression", cfg=SMALL)


def test_boosted_trees_weigh_attacks(rows):
    train = rows.where("split = 'train'")
    n = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    w = {r["y"]: r["w"] for r in md.with_class_weight(train, positive_only=True).select("y", "w").distinct().collect()}
    assert w == {0: 1.0, 1: n[0] / n[1]}


def test_transfer_and_sidecar(rows):
    t = md.transfer(rows.where("dataset = 'a'"), rows.where("dataset = 'b'"), "random_forest", cfg=SMALL)
    assert t.count() == 200 and "pred_label_fixed_fpr" in t.columns
    s = md.score(md.fit(rows.where("split = 'train'"), "random_forest", SMALL), rows, "rf")
    side = md.prediction_sidecar(s, {"default": 0.5, "val_tuned": 0.4, "fixed_fpr": 0.9})
    assert side.columns == PREDICTION_COLS and side.count() == 600


@pytest.mark.parametrize("kind", ["minmax", "robust", "none"])
def test_other_scalers(rows, kind):
    m = md.fit(rows.where("split = 'train'"), "logistic_regression", SMALL, scaler=kind)
    assert md.score(m, rows, "lr").count() == 600


@pytest.mark.parametrize("method", ["isotonic", "platt"])
def test_calibration_is_monotone(rows, method):
    s = rows.withColumn("y_score", (F.col("duration_s") / 10)).where("split <> 'train'")
    c = md.calibrate(s.where("split = 'val'"), s, method, y="y", split_col="split").toPandas().sort_values("y_score")
    assert (c.calibrated.diff().dropna() >= -1e-9).all() and c.calibrated.between(0, 1).all()


def test_end_to_end(spark, sf, tmp_path):
    p = table(spark, sf, "packets")
    settings = pl.FlowSettings(IDLE_S, ACTIVE_S)
    flows = pl.packets_to_flows(spark, p, str(tmp_path / "f"), settings)
    assert flows.agg(F.max("global_flow_id")).first()[0] == flows.count()
    with pytest.raises(FileExistsError):
        pl.packets_to_flows(spark, p, str(tmp_path / "f"), settings)
    feats = pl.flows_to_features(flows, table(spark, sf, "label_ref"), table(spark, sf, "label_mapping"), "demo",
                                 str(tmp_path / "l"))
    assert feats.count() == flows.count() and set(FEATURES) <= set(feats.columns)
    summary = spark.read.text(str(tmp_path / "l/summary"))
    assert summary.count() == 5
    rep = pl.features_to_report(feats, spark.read.parquet(str(tmp_path / "l/split")), str(tmp_path / "r"), SMALL,
                                ["random_forest"])
    kinds = {r.threshold_type for r in rep.collect()}
    assert {"default", "best_f1", "fixed_fpr_0.01"} <= kinds
    preds = spark.read.parquet(str(tmp_path / "r/predictions"))
    assert preds.where("binary_label is null or binary_label not in ('attack', 'benign')").count() == 0
    cut = {r.threshold_type: r.threshold for r in th.analyze(preds.where("split = 'val'"), ["model_name"]).collect()}
    for r in rep.collect():
        assert r.threshold == cut[r.threshold_type]
        test = preds.where("split = 'test'")
        assert r.tp == test.where((F.col("y_score") >= r.threshold) & (F.col("y_true") == 1)).count()
    assert set(spark.read.parquet(str(tmp_path / "r/sidecar/random_forest")).columns) == set(PREDICTION_COLS)
    assert with_label_bit(feats).count() == extract_features(flows).count()


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_flows_from_packet_files_with_a_cap(spark, tmp_path, fmt):
    """The pipeline on the packet reader: packets are skipped and capped by their place in each file."""
    for name in ("a", "b"):
        rows = [(10.0 + i if name == "a" else 900.0 - i, "10.0.0.1", "10.0.0.2", 5 + i % 3, 80, 6, 100 + i) for i in range(60)]
        df = spark.createDataFrame(rows, "timestamp double, src_ip string, dst_ip string, src_port int, dst_port int, "
                                         "protocol int, ip_len int")
        df.coalesce(1).write.format(fmt).save(str(tmp_path / name))
    packets = tb.read_packets(spark, [str(tmp_path / "a"), str(tmp_path / "b")], fmt)
    flows = pl.packets_to_flows(spark, packets, str(tmp_path / "f"), pl.FlowSettings(max_packets=20, skip_packets=5))
    got = flows.agg(F.sum("packet_count_total"), F.sum("bytes_total"), F.countDistinct("pcap_file")).first()
    assert tuple(got) == (40, 2 * sum(range(105, 125)), 2)


def test_pooled_tiers(rows):
    """Thresholds come from the validation rows of both sources, and every test row has a label under each."""
    parts = {"x": rows.where("global_flow_id % 2 = 0"), "y": rows.where("global_flow_id % 2 = 1")}
    got = md.pooled_tiers(parts, "logistic_regression", SMALL).cache()
    assert got.count() == rows.count() and {r[0] for r in got.select("source").distinct().collect()} == {"x", "y"}
    want = md.source_thresholds(got.where("split = 'val'"))
    one = got.select("threshold_default", "threshold_val_tuned", "threshold_fixed_fpr").distinct().collect()
    assert len(one) == 1 and tuple(one[0]) == (want["default"], want["val_tuned"], want["fixed_fpr"])
    for tier, t in (("val_tuned", want["val_tuned"]), ("fixed_fpr", want["fixed_fpr"])):
        assert got.where(F.col(f"pred_label_{tier}") != (F.col("y_score") >= t).cast("int")).count() == 0
