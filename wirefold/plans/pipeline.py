"""The three end-to-end jobs: packets to flows, flows to labelled features, features to scored evaluation tables.

Each stage writes a table that the next one reads, so a lost executor costs at most one stage, and an existing target
is never overwritten.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.operators import features as ft
from wirefold.operators import flows as fl
from wirefold.operators import labeling as lb
from wirefold.operators import models as md
from wirefold.operators import packets as pk
from wirefold.operators import splits as sp
from wirefold.operators import thresholds as th
from wirefold.schemas import FEATURES
from wirefold.sources import captures, sinks, tables


@dataclass
class FlowSettings:
    idle_s: float = fl.IDLE_S
    active_s: float = fl.ACTIVE_S
    fmt: str = "parquet"
    max_packets: int | None = None
    skip_packets: int = 0


def packets_to_flows(spark: SparkSession, source: str | DataFrame, target: str,
                     settings: FlowSettings | None = None) -> DataFrame:
    """Capture files (or a packet table) to a numbered flow table at `target`; returns the stored table."""
    s = settings or FlowSettings()
    packets = captures.read_captures(spark, source) if isinstance(source, str) else source
    tie = next((c for c in ("packet_no", "event_id") if c in packets.columns), "ts_us")
    if s.skip_packets or s.max_packets is not None:
        packets = pk.skip_and_cap(packets, s.skip_packets, s.max_packets, order=tie)
    flows = fl.build_flows(packets, s.idle_s, s.active_s)
    sinks.write_once(flows, f"{target}/flows_raw", fmt="parquet")
    numbered = fl.number_flows(spark.read.parquet(f"{target}/flows_raw"))
    sinks.write_once(numbered, f"{target}/flows", fmt=s.fmt)
    return spark.read.schema(numbered.schema).option("header", "true").format(s.fmt).load(f"{target}/flows")


def flows_to_features(flows: DataFrame, label_ref: DataFrame, mapping: DataFrame, dataset: str, target: str,
                      plan: dict[str, str] | None = None) -> DataFrame:
    """Labels, split, features, exclusion log and run summary; checks the accounting identity on the way."""
    spark = flows.sparkSession
    labelled = lb.align_labels(flows, label_ref, mapping, dataset)
    sinks.write_once(labelled, f"{target}/labelled")
    labelled = spark.read.parquet(f"{target}/labelled")
    sinks.write_once(lb.accounting(labelled), f"{target}/accounting")
    sinks.write_exclusions(lb.exclusion_log(labelled), f"{target}/exclusions")
    sinks.write_json_lines(lb.run_summary(labelled), "summary_json", f"{target}/summary")
    feats = ft.extract_features(labelled, ["global_flow_id"])
    sinks.write_once(ft.all_missing_rows(feats, FEATURES).select("global_flow_id"), f"{target}/all_missing")
    feats = ft.repair(feats)
    sinks.write_once(feats, f"{target}/features")
    feats = spark.read.parquet(f"{target}/features")
    split = sp.with_day_split(feats, plan)
    sp.require_no_leak(split, "pcap_file")
    sinks.write_split(split, f"{target}/split")
    return feats


def features_to_report(features: DataFrame, split: DataFrame, target: str, cfg: md.Config | None = None,
                       models: list[str] = md.MODELS) -> DataFrame:
    """Fits the baselines on train days, stores predictions and, per model, the 12-column sidecar, and returns the test
    metrics at operating points that the validation days set."""
    spark = features.sparkSession
    clean = ft.with_label_bit(ft.clean_labelled(sp.join_sidecar(features, split)))
    preds = md.run_baselines(clean, cfg, models).select(
        "model_name", "global_flow_id", "pcap_file", "day", "split", "binary_label", "coarse_family",
        F.col("y").alias("y_true"), "y_score")
    sinks.write_flows(preds, f"{target}/predictions", partition_by=["model_name", "split"])
    preds = spark.read.parquet(f"{target}/predictions")
    val, test = preds.where("split = 'val'"), preds.where("split = 'test'")
    for m in models:
        cuts = md.source_thresholds(val.where(F.col("model_name") == m), y="y_true")
        sinks.write_predictions(md.prediction_sidecar(preds.where(F.col("model_name") == m), cuts),
                                f"{target}/sidecar/{m}")
    report = th.at_points(test, th.analyze(val, ["model_name"]), ["model_name"]).join(
        th.ranking_metrics(test, ["model_name"]).select("model_name", "roc_auc", "pr_auc"), "model_name")
    sinks.write_once(report, f"{target}/report")
    return spark.read.parquet(f"{target}/report")


def label_source(spark: SparkSession, directory: str) -> DataFrame:
    """All label CSVs of a directory as one table with canonical columns."""
    return tables.five_tuple_labels(tables.read_label_csv(spark, tables.discover_csvs(spark, directory)))
