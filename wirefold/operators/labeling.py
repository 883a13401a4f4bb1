"""Label lookup, label join, mapping, accounting and join feasibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirefold.functions import rules
from wirefold.functions.columns import (
    blank_to_null, endpoint_high, endpoint_low, normalise_label, percent)
from wirefold.session import cut_lineage

LABEL_ENDPOINTS = ("source_ip", "source_port", "destination_ip", "destination_port")
FLOW_ENDPOINTS = ("src_ip", "src_port", "dst_ip", "dst_port")
NKEY = ["k_lo_ip", "k_lo_port", "k_hi_ip", "k_hi_port", "k_protocol"]
# A mapping table has one row per label name; anything larger is not a mapping.


def with_canonical(df: DataFrame, endpoints=FLOW_ENDPOINTS, protocol: str = "protocol") -> DataFrame:
    """Adds the canonical key as flat columns; all five are NULL when any part is missing."""
    df = df.withColumn("_lo", endpoint_low(*endpoints)).withColumn("_hi", endpoint_high(*endpoints))
    ok = F.col("_lo").isNotNull() & F.col(protocol).isNotNull()
    return df.withColumns({
        "k_lo_ip": F.when(ok, F.col("_lo.ip")), "k_lo_port": F.when(ok, F.col("_lo.port")),
        "k_hi_ip": F.when(ok, F.col("_hi.ip")), "k_hi_port": F.when(ok, F.col("_hi.port")),
        "k_protocol": F.when(ok, F.col(protocol).cast("int"))}).drop("_lo", "_hi")


def label_lookup(label_ref: DataFrame, compat_raw_conflict: bool = False) -> DataFrame:
    """One row per canonical key: its label when all rows agree, else ambiguous.

    Rows with the same endpoints and label reduce to one first, by a count, which is hashed; the least and greatest text
    sort what they get, and normalising is dear, so both meet distinct rows only. Either step combines map-side.
    Labels are normalised before they are compared; `compat_raw_conflict=True` compares the trimmed text instead.
    """
    raw = F.trim("label")
    cmp = raw if compat_raw_conflict else normalise_label("label")
    rows = label_ref.where(F.col("label").isNotNull()).groupBy(*LABEL_ENDPOINTS, "protocol", "label").agg(
        F.count("*").alias("_n"))
    src = (with_canonical(rows, LABEL_ENDPOINTS).where(F.col("k_protocol").isNotNull())
           .select(*NKEY, cmp.alias("_cmp"), raw.alias("_raw"), "_n"))
    g = src.groupBy(*NKEY).agg(F.min("_cmp").alias("_a"), F.max("_cmp").alias("_b"), F.min("_raw").alias("_raw"),
                               F.sum("_n").alias("n_label_rows"))
    amb = F.col("_a") != F.col("_b")
    return g.select(*NKEY, amb.alias("ambiguous"), F.when(~amb, F.col("_a" if not compat_raw_conflict else "_raw"))
                    .alias("label"), "n_label_rows")


def label_sets(label_ref: DataFrame) -> DataFrame:
    """Distinct normalised labels of each ambiguous key, for the ambiguity log; label names are a short list."""
    src = with_canonical(label_ref, LABEL_ENDPOINTS).where(F.col("k_protocol").isNotNull() & F.col("label").isNotNull())
    d = src.select(*NKEY, normalise_label("label").alias("label")).distinct()
    return (d.groupBy(*NKEY).agg(F.sort_array(F.collect_set("label")).alias("labels"))
            .where(F.size("labels") > 1))


def mapping_for(mapping: DataFrame, dataset: str, order: str | None = None) -> DataFrame:
    """Entries of one dataset keyed by normalised label; the last entry of a repeated label wins, by `order` or by the
    `row_order` that `read_mapping` gives."""
    order = order or ("row_order" if "row_order" in mapping.columns else None)
    m = mapping.where(F.col("dataset_name") == dataset).withColumn("norm", normalise_label("original_label"))
    m = m.withColumn("_row", F.col(order) if order else F.monotonically_increasing_id())
    row = F.struct("binary_label", blank_to_null("coarse_family").alias("coarse_family"),
                   F.coalesce("keep_or_exclude", F.lit("keep")).alias("keep_or_exclude"))
    last = F.max_by(row, "_row")
    return (m.groupBy("norm").agg(last.alias("_m"))
            .select("norm", F.col("_m.binary_label").alias("binary_label"),
                    F.col("_m.coarse_family").alias("coarse_family"),
                    (F.lower(F.trim("_m.keep_or_exclude")) != "exclude").alias("keep")))


def _look_up(keyed: DataFrame, lookup: DataFrame) -> DataFrame:
    """Flows with their key's lookup row, if there is one. Flows without a key match nothing; a hash of the row takes
    part in their join key, so that they spread over tasks instead of meeting on one NULL."""
    spread = F.when(F.col("k_protocol").isNull(), F.xxhash64(*[c for c in keyed.columns])).otherwise(F.lit(0).cast("bigint"))
    return keyed.withColumn("_spread", spread).join(
        lookup.withColumn("_spread", F.lit(0).cast("bigint")), [*NKEY, "_spread"], "left").drop("_spread")


def align_labels(flows: DataFrame, label_ref: DataFrame, mapping: DataFrame, dataset: str,
                 apply_keep: bool = True, compat_raw_conflict: bool = False) -> DataFrame:
    """Adds matched_flag, ambiguous_flag, label_match_method, original_label, binary_label, coarse_family,
    and exclusion_reason.

    The lookup is unique per key, so a hot flow key never multiplies rows; adaptive skew-join splits its partition. It is
    stored first: the join asks for keys that are not NULL, and over label rows that test builds both endpoints again
    for every key column.
    """
    lk = cut_lineage(label_lookup(label_ref, compat_raw_conflict))
    m = mapping_for(mapping, dataset)
    j = _look_up(with_canonical(flows), lk).withColumn("norm", normalise_label("label")).join(m, "norm", "left")
    no_key = F.col("k_protocol").isNull()
    method = (F.when(no_key, "no_key").when(F.col("ambiguous"), "ambiguous_canonical_5tuple")
              .when(F.col("ambiguous").isNull(), "unmatched").otherwise("canonical_5tuple"))
    mapped = F.coalesce(F.col("binary_label").isNotNull(), F.lit(False))
    keep = F.coalesce("keep", F.lit(True)) if apply_keep else F.lit(True)
    # A label that the mapping excludes leaves its class out of training, splits and metrics.
    blank = (method == "canonical_5tuple") & mapped & ~keep
    out = j.withColumns({
        "label_match_method": method, "matched_flag": method == "canonical_5tuple",
        "ambiguous_flag": method == "ambiguous_canonical_5tuple", "original_label": F.col("label"),
        "exclusion_reason": rules.exclusion_reason(method, mapped, keep),
        "binary_label": F.when(~blank, F.col("binary_label")), "coarse_family": F.when(~blank, F.col("coarse_family"))})
    return out.drop(*NKEY, "ambiguous", "label", "n_label_rows", "norm", "keep")


OUTCOMES = ["matched", "unmapped_label", "excluded_label", "ambiguous_5tuple", "unmatched", "parse_fail"]


def outcome():
    return F.coalesce("exclusion_reason", F.lit("matched"))


def accounting(labelled: DataFrame, by: str = "pcap_file", check: bool = True) -> DataFrame:
    """Counts of every outcome per group; fails the job when they do not add up to the total."""
    total = F.count("*")
    parts = {o: F.count_if(outcome() == o) for o in OUTCOMES}
    g = labelled.groupBy(by).agg(total.alias("total"), *[c.alias(o) for o, c in parts.items()])
    balanced = F.col("total") == sum((F.col(o) for o in OUTCOMES[1:]), F.col(OUTCOMES[0]))
    if check:
        balanced = F.when(balanced, F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("accounting identity broken for "), F.col(by).cast("string"))).cast("boolean"))
    return g.withColumn("balanced", balanced)


def alignment_report(labelled: DataFrame) -> DataFrame:
    n, hit = F.count("*"), F.count_if("matched_flag")
    return labelled.agg(
        n.alias("flow_rows"), hit.alias("matched"), F.count_if("ambiguous_flag").alias("ambiguous"),
        F.count_if(~F.col("matched_flag") & ~F.col("ambiguous_flag")).alias("unmatched"),
        F.count_if(F.col("binary_label") == "benign").alias("benign"),
        F.count_if(F.col("binary_label") == "attack").alias("attack"),
    ).withColumn("match_rate", F.round(percent("matched", "flow_rows"), 4))


LOG_COLS = ["pcap_file", "start_us", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "label_match_method",
            "original_label", "exclusion_reason"]


def exclusion_log(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col("exclusion_reason").isNotNull()).select(*LOG_COLS)


def ambiguous_log(labelled: DataFrame) -> DataFrame:
    return labelled.where("ambiguous_flag").select(*LOG_COLS)


def run_summary(labelled: DataFrame, by: str = "pcap_file") -> DataFrame:
    """One JSON document per day: outcome counts, match rate and label distribution."""
    acc = accounting(labelled, by)
    labels = (labelled.where(F.col("original_label").isNotNull()).groupBy(by, "original_label")
              .agg(F.count("*").alias("n")).groupBy(by)
              .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("original_label", "n")))).alias("labels")))
    rate = F.round(percent("matched", "total"), 4).alias("match_rate")
    return (acc.join(labels, by, "left")
            .select(by, F.to_json(F.struct("total", *OUTCOMES, rate, "labels")).alias("summary_json")))


def top_values(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    return (df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), F.asc("value")).limit(n))


def mapping_check(label_ref: DataFrame, mapping: DataFrame, dataset: str) -> DataFrame:
    """Per normalised label: rows, and whether the mapping knows it."""
    m = mapping_for(mapping, dataset)
    g = (label_ref.where(F.col("label").isNotNull()).groupBy(normalise_label("label").alias("norm"))
         .agg(F.count("*").alias("n_rows"), F.countDistinct("label").alias("n_spellings")))
    return (g.join(m, "norm", "left")
            .select("norm", "n_rows", "n_spellings", F.col("binary_label").isNotNull().alias("mapped"),
                    "binary_label", "coarse_family"))


def unmapped_labels(label_ref: DataFrame, mapping: DataFrame, dataset: str) -> DataFrame:
    d = label_ref.where(F.col("label").isNotNull()).select(normalise_label("label").alias("norm")).distinct()
    return d.exceptAll(mapping_for(mapping, dataset).select("norm"))


def mapping_report(label_ref: DataFrame, mapping: DataFrame, dataset: str) -> DataFrame:
    """One row: totals, label sets and row counts by binary label and family (label names are a short list)."""
    c = mapping_check(label_ref, mapping, dataset)
    rows = F.col("n_rows")
    return c.agg(
        F.sum(rows).alias("labelled_rows"), F.sum("n_spellings").alias("unique_raw_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("mapped"), F.col("norm")))), "|").alias("matched_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(~F.col("mapped"), F.col("norm")))), "|")
        .alias("unmatched_labels"),
        F.sum(F.when(F.col("binary_label") == "benign", rows).otherwise(0)).alias("benign_rows"),
        F.sum(F.when(F.col("binary_label") == "attack", rows).otherwise(0)).alias("attack_rows"),
        F.sum(F.when(F.col("coarse_family").isNotNull(), rows).otherwise(0)).alias("family_rows"),
        F.sum(F.when(~F.col("mapped"), rows).otherwise(0)).alias("unmatched_rows"))


def join_check(flows: DataFrame, label_ref: DataFrame) -> DataFrame:
    """Distinct directional and canonical keys on both sides and their overlap, one row per key kind.

    One union and two aggregates: (key -> which sides have it), then counts. No key set leaves its partition.
    """
    def keys(df, endpoints, side):
        c = with_canonical(df, endpoints).where(F.col("k_protocol").isNotNull())
        a = [F.col(e) for e in endpoints]
        dirs = F.struct(a[0].alias("ip1"), a[1].cast("int").alias("p1"), a[2].alias("ip2"), a[3].cast("int").alias("p2"),
                        F.col("k_protocol").alias("proto"))
        can = F.struct(F.col("k_lo_ip").alias("ip1"), F.col("k_lo_port").alias("p1"), F.col("k_hi_ip").alias("ip2"),
                       F.col("k_hi_port").alias("p2"), F.col("k_protocol").alias("proto"))
        e = F.explode(F.array(F.struct(F.lit("directional").alias("strategy"), dirs.alias("key")),
                              F.struct(F.lit("canonical").alias("strategy"), can.alias("key"))))
        return c.select(e.alias("_e")).select("_e.strategy", "_e.key", F.lit(side).alias("side"))

    both = keys(flows, FLOW_ENDPOINTS, 1).unionByName(keys(label_ref, LABEL_ENDPOINTS, 2))
    per = both.groupBy("strategy", "key").agg(F.max(F.col("side") == 1).alias("in_flow"),
                                              F.max(F.col("side") == 2).alias("in_label"))
    g = per.groupBy("strategy").agg(
        F.count_if("in_flow").alias("flow_unique_keys"), F.count_if("in_label").alias("label_unique_keys"),
        F.count_if(F.col("in_flow") & F.col("in_label")).alias("matched_keys"))
    return g.withColumns({"match_rate_of_flow_keys": F.round(percent("matched_keys", "flow_unique_keys"), 4),
                          "match_rate_of_label_keys": F.round(percent("matched_keys", "label_unique_keys"), 4)})


def shared_keys(flows: DataFrame, label_ref: DataFrame) -> DataFrame:
    a = with_canonical(flows).where(F.col("k_protocol").isNotNull()).select(*NKEY)
    b = with_canonical(label_ref, LABEL_ENDPOINTS).where(F.col("k_protocol").isNotNull()).select(*NKEY)
    return a.intersect(b)


def sample_times(label_ref: DataFrame, col: str = "ts_us", n: int = 5) -> DataFrame:
    """The n earliest label times."""
    return label_ref.where(F.col(col).isNotNull()).select(col).orderBy(col).limit(n)


def label_summary(label_ref: DataFrame, by: str = "pcap_file", n: int = 10, heads: DataFrame | None = None) -> DataFrame:
    """Rows, distinct labels and top labels per label file. With the `heads` that `label_files` gives, also the number of
    columns and the label column of each file, which is then where the label is read from."""
    if heads is not None:
        named = [r[0] for r in heads.select("label_column").where("label_column is not null").distinct().collect()]
        have = {c.lower(): c for c in label_ref.columns}
        chosen = F.coalesce(*[F.when(F.col("label_column") == c, F.col(f"`{have[c.lower()]}`")) for c in named],
                            F.lit(None).cast("string"))
        s = label_summary(label_ref.join(heads, by).select(by, chosen.alias("label")), by, n)
        return s.join(heads.select(by, "columns_count", "label_column"), by)
    c = label_ref.groupBy(by, "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), F.asc("label"))
    top = c.withColumn("label_rank", F.row_number().over(w)).where(F.col("label_rank") <= n)
    tot = c.groupBy(by).agg(F.sum("n").alias("file_rows"), F.count("*").alias("n_labels"))
    return top.join(tot, by).select(by, "label", "n", "label_rank", "file_rows", "n_labels")


def time_label_join(flows: DataFrame, label_ref: DataFrame, tolerance_us: int, start: str = "start_us",
                    label_time: str = "ts_us") -> DataFrame:
    """Labels by key and start time: a key with one label needs no time; a key with several keeps the label rows
    within the tolerance, and is matched when those agree (nearest row's time reported).

    Only conflicting keys join on time: their flows go through the candidates' aggregate with all their columns, one row
    per (file, key, start), and the table of flows is never joined to itself. Both sides carry a time bucket of twice the
    tolerance and the label side is copied to the neighbouring bucket, so a hot key spreads over its buckets and
    candidates stay close in time. Label rows equal in (key, bucket, label, time) collapse first.
    """
    lk = label_lookup(label_ref)
    f = with_canonical(flows).withColumn("_fid", F.struct("pcap_file", *FLOW_ENDPOINTS, "protocol", start))
    base = _look_up(f, lk)
    # Strict |start - t| < tolerance; a bucket as wide as the window makes at most two neighbours reachable.
    width = max(2 * tolerance_us, 1)
    lab = (with_canonical(label_ref, LABEL_ENDPOINTS).where(F.col("k_protocol").isNotNull())
           .select(*NKEY, normalise_label("label").alias("cand"), F.col(label_time).alias("t")).distinct())
    lab = lab.join(lk.where("ambiguous").select(*NKEY), NKEY, "left_semi")
    lo = F.floor((F.col("t") - tolerance_us) / width)
    hi = F.floor((F.col("t") + tolerance_us) / width)
    lab = lab.withColumn("_b", F.explode(F.array_distinct(F.array(lo, hi))))
    amb = base.where("ambiguous").withColumn("_fb", F.floor(F.col(start) / width))
    on = (F.col("_fb") == F.col("_b")) & (F.abs(F.col(start) - F.col("t")) < tolerance_us)
    for k in NKEY:
        on = on & (F.col(k) == F.col(f"_l_{k}"))
    near = F.when(F.col("t").isNotNull(), F.struct(F.abs(F.col(start) - F.col("t")).alias("d"), F.col("t").alias("t")))
    decided = amb.join(lab.withColumnsRenamed({k: f"_l_{k}" for k in NKEY}), on, "left").groupBy("_fid").agg(
        F.first(F.struct(*base.columns)).alias("_flow"), F.min("cand").alias("_c1"), F.max("cand").alias("_c2"),
        F.count("cand").alias("n_candidates"), F.min(near).alias("_near"))
    decided = decided.select("_flow.*", "_c1", "_c2", "n_candidates", "_near")
    plain = base.where(~F.coalesce("ambiguous", F.lit(False)))
    for c in ("_c1", "_c2", "n_candidates", "_near"):
        plain = plain.withColumn(c, F.lit(None).cast(decided.schema[c].dataType))
    j = plain.unionByName(decided)
    method = (F.when(F.col("k_protocol").isNull(), "no_key").when(F.col("ambiguous").isNull(), "unmatched")
              .when(~F.col("ambiguous"), "canonical_5tuple").when(F.col("_c1").isNull(), "no_label_in_window")
              .when(F.col("_c1") == F.col("_c2"), "time_disambiguated").otherwise("ambiguous_in_window"))
    lbl = F.when(method == "canonical_5tuple", F.col("label")).when(method == "time_disambiguated", F.col("_c1"))
    return (j.withColumn("label_match_method", method).withColumn("original_label", lbl)
            .withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0).cast("bigint")))
            .withColumn("nearest_us", F.col("_near.t"))
            .drop("_fid", "_c1", "_c2", "_near", *NKEY, "ambiguous", "label", "n_label_rows"))

