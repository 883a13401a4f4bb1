"""False alarms on traffic known to be benign."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirefold.functions import rules
from wirefold.functions.columns import BYTE_BANDS, byte_band, safe_divide, service_name


def alarm_metrics(df: DataFrame, by: list[str], threshold: float = 0.5, score: str = "y_score", start: str = "start_us",
                  end: str = "end_us") -> DataFrame:
    """Alerts, false-positive rate, alerts per hour and per 1000 flows; every row is benign."""
    t = F.lit(float(threshold))
    g = df.groupBy(*by).agg(F.count("*").alias("total_flows"), F.count_if(F.col(score) >= t).alias("alerted_flows"),
                            ((F.max(end) - F.min(start)) / F.lit(3.6e9)).alias("capture_duration_hours"))
    return g.withColumns({"fpr": safe_divide("alerted_flows", "total_flows"),
                          "alerts_per_hour": safe_divide("alerted_flows", "capture_duration_hours"),
                          "alerts_per_1000_flows": safe_divide(F.col("alerted_flows") * 1000, "total_flows"),
                          "eligible": rules.eligible(t), "notes": rules.false_alarm_note(t)})


def alarm_patterns(df: DataFrame, by: list[str], threshold: float = 0.5, score: str = "y_score", top_ports: int = 10,
                   port: str = "dst_port", volume: str = "bytes_total") -> DataFrame:
    """Alerts by protocol, by up to `top_ports` services, and by byte band (empty bands kept), each block ranked by
    count and numbered through. One aggregate over (pattern, value) pairs; ranks run on its small result."""
    proto = F.when(F.col("protocol") == 6, "TCP").when(F.col("protocol") == 17, "UDP")
    band_pos = {b: i for i, b in enumerate(BYTE_BANDS)}
    pairs = F.explode(F.array(F.struct(F.lit(1).alias("block"), proto.alias("v")),
                              F.struct(F.lit(2).alias("block"), service_name(port).alias("v")),
                              F.struct(F.lit(3).alias("block"), byte_band(volume).alias("v"))))
    hit = df.where(F.col(score) >= threshold)
    c = (hit.select(*by, pairs.alias("_p")).select(*by, "_p.*").where(F.col("v").isNotNull())
         .groupBy(*by, "block", "v").agg(F.count("*").alias("count")))
    bands = (c.where("block = 3").select(*by).distinct()
             .select(*by, F.lit(3).alias("block"), F.explode(F.array(*[F.lit(b) for b in BYTE_BANDS])).alias("v")))
    filled = (bands.join(c.where("block = 3"), [*by, "block", "v"], "left")
              .withColumn("count", F.coalesce("count", F.lit(0).cast("bigint"))))
    allc = c.where("block < 3").unionByName(filled)
    pos = F.lit(0)
    for b, i in band_pos.items():
        pos = F.when(F.col("v") == b, F.lit(i)).otherwise(pos)
    w = Window.partitionBy(*by, "block").orderBy(F.desc("count"), pos, F.asc("v"))
    kept = allc.withColumn("_r", F.row_number().over(w)).where((F.col("block") != 2) | (F.col("_r") <= top_ports))
    total = Window.partitionBy(*by)
    kept = kept.withColumn("_alerts", F.sum(F.when(F.col("block") == 3, F.col("count"))).over(total))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("block", "_r"))
    kind = F.when(F.col("block") == 1, "protocol").when(F.col("block") == 2, "dst_port").otherwise("bytes_band")
    return kept.select(*by, rank.alias("pattern_rank"), kind.alias("pattern_type"),
                       F.when(F.col("block") == 1, F.col("v")).otherwise("any").alias("protocol"),
                       F.when(F.col("block") == 1, "any").otherwise(F.col("v")).alias("dst_port_or_service"),
                       "count", safe_divide("count", "_alerts").alias("share_of_alerts"))


def source_stability(metrics: DataFrame, source: str = "domain", method: str = "method") -> DataFrame:
    """Mean eligible false-positive rate per source with its best and worst method."""
    e = metrics.where("eligible")
    return e.groupBy(source).agg(
        F.avg("fpr").alias("mean_fpr"), F.min_by(method, F.struct("fpr", method)).alias("best_method"),
        F.max_by(method, F.struct("fpr", method)).alias("worst_method"), F.count("*").alias("n_methods"))
