"""Feature projection, repair, audit and encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirefold.functions.columns import finite_or_zero, label_bit, safe_divide
from wirefold.operators.ordering import percentiles
from wirefold.schemas import BANNED_FEATURES, FEATURES, META_COLS


def extract_features(flows: DataFrame, carry: list[str] = ()) -> DataFrame:
    """Metadata columns present in `flows`, those in `carry`, then the 19 features; one narrow projection, no shuffle."""
    per = {
        "is_tcp": (F.col("protocol") == 6).cast("int"),
        "is_udp": (F.col("protocol") == 17).cast("int"),
        "bytes_per_packet": safe_divide("bytes_total", "packet_count_total"),
        "bytes_per_packet_fwd": safe_divide("bytes_fwd", "packet_count_fwd"),
        "bytes_per_packet_bwd": safe_divide("bytes_bwd", "packet_count_bwd"),
        "packets_per_second": safe_divide("packet_count_total", "duration_s"),
        "bytes_per_second": safe_divide("bytes_total", "duration_s"),
        "fwd_packet_ratio": safe_divide("packet_count_fwd", "packet_count_total"),
        "bwd_packet_ratio": safe_divide("packet_count_bwd", "packet_count_total"),
        "fwd_byte_ratio": safe_divide("bytes_fwd", "bytes_total"),
        "bwd_byte_ratio": safe_divide("bytes_bwd", "bytes_total"),
    }
    meta = [*[c for c in META_COLS if c in flows.columns], *carry]
    return flows.select(*meta, *[per[c].alias(c) if c in per else F.col(c) for c in FEATURES])


def feature_columns(df: DataFrame, strict: bool = True) -> list[str]:
    """The fixed feature list; with `strict=False`, every non-metadata column, refused if a banned one is among them."""
    cols = list(FEATURES) if strict else [c for c in df.columns if c not in META_COLS]
    guard_features(cols)
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    return cols


def guard_features(cols: list[str]) -> None:
    bad = [c for c in cols if c in BANNED_FEATURES]
    if bad:
        raise ValueError(f"columns that leak identity or labels used as features: {bad}")


def _is_nan(df: DataFrame, c: str):
    col = F.col(c)
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def _is_inf(df: DataFrame, c: str):
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return F.coalesce(F.abs(c) == float("inf"), F.lit(False))
    return F.lit(False)


def repair_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or [c for c in FEATURES if c in df.columns]
    n_nan = sum((F.count_if(_is_nan(df, c)) for c in cols[1:]), F.count_if(_is_nan(df, cols[0])))
    n_inf = sum((F.count_if(_is_inf(df, c)) for c in cols[1:]), F.count_if(_is_inf(df, cols[0])))
    return df.agg(F.count("*").alias("n_rows"), n_nan.alias("nan_filled"), n_inf.alias("inf_replaced"))


def repair(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """NaN, NULL and infinity in feature columns become 0."""
    cols = cols or [c for c in FEATURES if c in df.columns]
    fix = {}
    for c in cols:
        t = df.schema[c].dataType
        fix[c] = finite_or_zero(c) if isinstance(t, (T.DoubleType, T.FloatType)) else F.coalesce(
            F.col(c), F.lit(0).cast(t))
    return df.withColumns(fix)


def fill_missing(df: DataFrame, cols: list[str], strategy: str = "zero") -> DataFrame:
    """zero, median (exact, over present values) or drop (rows with any missing value)."""
    if strategy == "zero":
        return df.withColumns({c: F.when(_is_nan(df, c), F.lit(0.0)).otherwise(F.col(c)) for c in cols})
    if strategy == "drop":
        keep = F.lit(True)
        for c in cols:
            keep = keep & ~_is_nan(df, c)
        return df.where(keep)
    if strategy == "median":
        med = medians(df, cols).first()
        return df.withColumns({c: F.when(_is_nan(df, c), F.lit(med[c])).otherwise(F.col(c)) for c in cols})
    raise ValueError(f"unknown missing-value strategy: {strategy}")


def medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row of exact medians: columns unpivoted, ranked together per column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols]))
    long = df.select(pairs.alias("_p")).select("_p.*").where(F.col("v").isNotNull() & ~F.isnan("v"))
    return percentiles(long, ["feature"], "v", {"m": 0.5}).groupBy().pivot("feature", cols).agg(F.first("m"))


def all_missing_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    cond = F.lit(True)
    for c in cols:
        cond = cond & _is_nan(df, c)
    return df.where(cond)


def clean_labelled(df: DataFrame) -> DataFrame:
    return df.where(is_clean())


def is_clean():
    return F.coalesce(F.col("matched_flag") & ~F.col("ambiguous_flag")
                      & F.col("binary_label").isin("benign", "attack"), F.lit(False))


def clean_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total_raw_rows"), F.count_if(is_clean()).alias("total_clean_rows"),
                  F.count_if(~is_clean()).alias("dropped"))


def with_label_bit(df: DataFrame) -> DataFrame:
    return df.withColumn("y", label_bit())


def class_balance(df: DataFrame, by: list[str], y: str = "y") -> DataFrame:
    """n_neg, n_pos, n_neg/n_pos and balanced class weights n/(2 n_c)."""
    pos = F.sum(F.col(y).cast("bigint"))
    g = df.groupBy(*by).agg(F.count("*").alias("n"), pos.alias("n_pos"), (F.count("*") - pos).alias("n_neg"))
    return g.select(*by, "n_pos", "n_neg", safe_divide("n_neg", "n_pos").alias("pos_weight"),
                    safe_divide("n", F.col("n_pos") * 2).alias("weight_pos"),
                    safe_divide("n", F.col("n_neg") * 2).alias("weight_neg"))


def audit(df: DataFrame, by: str = "pcap_file") -> DataFrame:
    """Rows, NaN, infinity, label and flag counts per file, in one aggregate."""
    cols = [c for c in FEATURES if c in df.columns]
    n_nan = sum((F.count_if(_is_nan(df, c)) for c in cols[1:]), F.count_if(_is_nan(df, cols[0])))
    n_inf = sum((F.count_if(_is_inf(df, c)) for c in cols[1:]), F.count_if(_is_inf(df, cols[0])))
    meta = [c for c in META_COLS if c in df.columns]
    return df.groupBy(by).agg(
        F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("total_columns"),
        F.lit(len(cols)).alias("feature_columns"), n_nan.alias("nan_count"), n_inf.alias("inf_count"),
        F.count_if(F.col("binary_label") == "benign").alias("benign"),
        F.count_if(F.col("binary_label") == "attack").alias("attack"),
        F.count_if(F.col("binary_label").isNull()).alias("no_label"),
        F.count_if("matched_flag").alias("matched"), F.count_if("ambiguous_flag").alias("ambiguous"),
        F.lit(len(META_COLS) - len(meta)).alias("missing_meta"))


def missing_meta(df: DataFrame) -> list[str]:
    return [c for c in META_COLS if c not in df.columns]


def schemas_agree(frames: list[DataFrame]) -> bool:
    """Same feature columns in the same order in every table."""
    return len({tuple(c for c in f.columns if c not in META_COLS) for f in frames}) <= 1


def audit_tables(frames: dict[str, DataFrame], by: str = "pcap_file") -> DataFrame:
    """The audit of several feature tables, each also compared with the first: `schema_agrees` where it has the same
    feature columns in the same order."""
    first, out = next(iter(frames.values())), None
    for name, df in frames.items():
        part = audit(df, by).withColumns({"table_name": F.lit(name), "schema_agrees": F.lit(schemas_agree([first, df]))})
        out = part if out is None else out.unionByName(part)
    return out
