"""Split assignment by day, file order or scenario, its reports and leakage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirefold.functions.columns import capture_day, contains_any, percent

# Default split by capture day.
DAY_SPLIT = {"Monday": "train", "Tuesday": "train", "Wednesday": "train", "Thursday": "val", "Friday": "test"}
ROLES = ["train", "val", "test", "unassigned"]


def role_of(day, plan: dict[str, str] | None = None):
    """Split role of a day; days outside the plan are unassigned. The plan is a literal map, so no join is needed."""
    plan = DAY_SPLIT if plan is None else plan
    out = None
    for d, role in plan.items():
        out = (F.when if out is None else out.when)(day == d, F.lit(role))
    return F.lit("unassigned") if out is None else out.otherwise(F.lit("unassigned"))


def with_day_split(df: DataFrame, plan: dict[str, str] | None = None) -> DataFrame:
    return df.withColumn("day", capture_day()).withColumn("split", role_of(F.col("day"), plan))


def file_order_split(df: DataFrame, n_train: int, n_val: int, time: str = "start_us") -> DataFrame:
    """Files in capture order: the first `n_train` to train, the next `n_val` to val, the rest to test.

    Only one row per file is ordered; the result is a file table joined back by adaptive choice.
    """
    first = df.groupBy("pcap_file").agg(F.min(time).alias("_t"))
    idx = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_t", "pcap_file"))
    files = first.withColumn("file_index", idx).select(
        "pcap_file", "file_index", F.when(F.col("file_index") <= n_train, "train")
        .when(F.col("file_index") <= n_train + n_val, "val").otherwise("test").alias("split"))
    return df.join(files, "pcap_file")


def scenario_split(df: DataFrame, plan: DataFrame, key: str = "scenario") -> DataFrame:
    """All rows of a scenario take the scenario's split; rows without a planned scenario are unassigned."""
    return df.join(plan, key, "left").withColumn("split", F.coalesce("split", F.lit("unassigned")))


def split_leaks(df: DataFrame, unit: str) -> DataFrame:
    """Units (day, file, scenario) that occur in more than one split; empty when the split is sound."""
    return (df.groupBy(unit).agg(F.min("split").alias("a"), F.max("split").alias("b"))
            .where("a <> b").select(unit))


def require_no_leak(df: DataFrame, unit: str) -> DataFrame:
    bad = [r[0] for r in split_leaks(df, unit).limit(5).collect()]
    if bad:
        raise ValueError(f"{unit} in more than one split, e.g. {bad}")
    return df


def day_stats(clean: DataFrame) -> DataFrame:
    g = clean.groupBy("day", "split").agg(
        F.count("*").alias("total"), F.count_if(F.col("binary_label") == "benign").alias("benign"),
        F.count_if(F.col("binary_label") == "attack").alias("attack"))
    return g.withColumn("attack_pct", F.round(percent("attack", "total"), 4)).orderBy("day")


def split_rollup(clean: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("split"))
    g = clean.groupBy("split").agg(
        F.array_join(F.sort_array(F.collect_set("day")), ",").alias("days"), F.count("*").alias("total"),
        F.count_if(F.col("binary_label") == "benign").alias("benign"),
        F.count_if(F.col("binary_label") == "attack").alias("attack"))
    return g.withColumn("split_order", order).orderBy("split_order")


def split_day_totals(clean: DataFrame) -> DataFrame:
    """Totals at both levels in one pass: (split, day), split, all."""
    return clean.rollup("split", "day").agg(F.count("*").alias("total"),
                                            F.count_if(F.col("binary_label") == "attack").alias("attack"))


def attack_types(clean: DataFrame) -> DataFrame:
    return (clean.where(F.col("binary_label") == "attack").groupBy("day", "original_label")
            .agg(F.count("*").alias("n")))


def split_health(df: DataFrame, label_ref: DataFrame) -> DataFrame:
    """Per file and split: join rate, cover of the label window by flow times, and both classes present."""
    win = label_ref.groupBy("pcap_file").agg(F.min("ts_us").alias("l0"), F.max("ts_us").alias("l1"))
    g = df.groupBy("split", "pcap_file").agg(
        F.count("*").alias("n_flows"), F.count_if("matched_flag").alias("n_matched"),
        F.count_if(F.col("binary_label") == "benign").alias("n_benign"),
        F.count_if(F.col("binary_label") == "attack").alias("n_attack"),
        F.min("start_us").alias("f0"), F.max("end_us").alias("f1"))
    j = g.join(win, "pcap_file", "left")
    both = F.greatest(F.least("f1", "l1") - F.greatest("f0", "l0"), F.lit(0))
    return j.select("split", "pcap_file", "n_flows", "n_matched",
                    F.round(percent("n_matched", "n_flows"), 4).alias("join_rate"),
                    F.round(percent(both, F.col("l1") - F.col("l0")), 4).alias("time_cover"),
                    ((F.col("n_benign") > 0) & (F.col("n_attack") > 0)).alias("both_classes"))


def family_disjoint(df: DataFrame, family: str = "coarse_family") -> DataFrame:
    """Every attack family with its presence in train and test."""
    return (df.where(F.col(family).isNotNull()).groupBy(F.col(family).alias("family"))
            .agg(F.max(F.col("split") == "train").alias("in_train"), F.max(F.col("split") == "test").alias("in_test"))
            .withColumn("shared", F.col("in_train") & F.col("in_test")))


def unseen_families(df: DataFrame, family: str = "coarse_family") -> DataFrame:
    known = df.where((F.col("split") == "train") & F.col(family).isNotNull()).select(family).distinct()
    return (df.where((F.col("split") == "test") & F.col(family).isNotNull()).select(family).distinct()
            .join(known, family, "left_anti"))


def sidecar(df: DataFrame) -> DataFrame:
    return df.select("global_flow_id", "day", "split")


def join_sidecar(master: DataFrame, side: DataFrame, check: bool = True) -> DataFrame:
    """Master rows with their split; fails when a side has rows or duplicates the other lacks."""
    if check:
        c = sidecar_mismatch(master, side).first()
        if c["missing"] or c["orphan"] or c["repeated"]:
            raise ValueError(f"split sidecar does not match the master table: {c.asDict()}")
    return master.join(side, "global_flow_id")


def sidecar_mismatch(master: DataFrame, side: DataFrame) -> DataFrame:
    """Counts of ids missing from the sidecar, unknown to the master, or repeated; one union and one aggregate."""
    both = (master.select("global_flow_id", F.lit(1).alias("m"), F.lit(0).alias("s"))
            .unionByName(side.select("global_flow_id", F.lit(0).alias("m"), F.lit(1).alias("s"))))
    g = both.groupBy("global_flow_id").agg(F.sum("m").alias("m"), F.sum("s").alias("s"))
    return g.agg(F.count_if(F.col("s") == 0).alias("missing"), F.count_if(F.col("m") == 0).alias("orphan"),
                 F.count_if((F.col("s") > 1) | (F.col("m") > 1)).alias("repeated"))


def recover_endpoints(features: DataFrame, flows: DataFrame) -> DataFrame:
    """Endpoint columns back onto feature rows by (pcap_file, flow_id)."""
    ends = flows.select("pcap_file", "flow_id", "src_ip", "src_port", "dst_ip", "dst_port")
    return features.join(ends, ["pcap_file", "flow_id"])
