"""Packet-to-flow assignment and fixed-length packet sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirefold.functions.columns import is_forward_ip_only, proto_id
from wirefold.operators.flows import KEY, US
from wirefold.operators.intervals import best_interval
from wirefold.operators.packets import accept, with_key

EPSILON_S = 1.0
K_MAX = 32
CHANNELS = ["signed_len", "direction", "delta_t", "protocol_id"]
FEATURE_SETS = {"A": [1, 3], "B": [0, 1, 2, 3]}


def packets_to_flows(packets: DataFrame, flows: DataFrame, epsilon_s: float = EPSILON_S,
                     active_s: float = 120.0, packet_id: str = "event_id") -> DataFrame:
    """Each accepted packet with the start of its flow (NULL when none covers it within epsilon).

    Candidates come from the bucketed interval join; the flow with the least distance outside its window wins, then
    the later start.
    """
    eps = round(epsilon_s * US)
    pk = with_key(accept(packets))
    f = flows.select("pcap_file", F.col("src_ip").alias("lo_ip"), F.col("src_port").alias("lo_port"),
                     F.col("dst_ip").alias("hi_ip"), F.col("dst_port").alias("hi_port"), "protocol",
                     F.col("start_us").alias("_start"), F.col("end_us").alias("_end"), (F.col("start_us") - eps).alias("_lo"), (F.col("end_us") + eps).alias("_hi"))
    gap = F.greatest(F.col("_start") - F.col("ts_us"), F.col("ts_us") - F.col("_end"), F.lit(0)).alias("g")
    return best_interval(pk, f, KEY, packet_id, "ts_us", "_lo", "_hi", round(active_s * US) + 2 * eps,
                         [gap, (-F.col("_start")).alias("s")], "_start", "flow_start_us")


def packets_without_flow(assigned: DataFrame) -> DataFrame:
    return assigned.where(F.col("flow_start_us").isNull())


def flows_without_packets(flows: DataFrame, assigned: DataFrame) -> DataFrame:
    f = flows.withColumnsRenamed({"src_ip": "lo_ip", "src_port": "lo_port", "dst_ip": "hi_ip", "dst_port": "hi_port"})
    used = assigned.where(F.col("flow_start_us").isNotNull()).select(*KEY, F.col("flow_start_us").alias("start_us"))
    return f.join(used, [*KEY, "start_us"], "left_anti")


def first_packets(df: DataFrame, flow: list[str], order: list[str], k: int = K_MAX, tail: bool = False) -> DataFrame:
    """First (or last) `k` rows of every flow with their position. The rank filter runs before and after the shuffle,
    so a hot flow sends at most `k` rows per task."""
    keys = [F.desc(c) for c in order] if tail else [F.asc(c) for c in order]
    w = Window.partitionBy(*flow).orderBy(*keys)
    cut = df.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)
    if not tail:
        return cut
    # positions run forward in time for the last rows too
    last = F.max("pos").over(Window.partitionBy(*flow))
    return cut.withColumn("pos", (last - F.col("pos") + 1).cast("int"))


def packet_channels(assigned: DataFrame, ip_only: bool = True) -> DataFrame:
    """The four per-packet values: signed length, direction, seconds since the previous packet, protocol id."""
    fwd = is_forward_ip_only() if ip_only else F.col("fwd")
    return assigned.withColumns({
        "signed_len": F.when(fwd, F.col("ip_len")).otherwise(-F.col("ip_len")).cast("double"),
        "direction": fwd.cast("double"), "delta_t": F.col("delta_us") / F.lit(float(US)),
        "protocol_id": proto_id("protocol").cast("double")}).where(F.col("protocol_id").isNotNull())


def scaler_stats(steps: DataFrame, split: str = "train") -> DataFrame:
    """Mean and population deviation of signed length and log1p(delta_t) over train steps; padding never enters."""
    t = steps.where(F.col("split") == split)
    ld = F.log1p("delta_t")
    return t.agg(F.count("*").alias("n_steps"), F.avg("signed_len").alias("len_mean"),
                 F.stddev_pop("signed_len").alias("len_std"), F.avg(ld).alias("dt_mean"),
                 F.stddev_pop(ld).alias("dt_std"))


def to_sequences(steps: DataFrame, flow: list[str], k: int | None = K_MAX, scaler: dict | None = None,
                 channels: list[str] = CHANNELS) -> DataFrame:
    """One row per flow: `sequence` array<array<float>> of length k, zero-padded on the right, and `n_packets`; `k=None`
    keeps every step and pads nothing.

    With `scaler` (a row of `scaler_stats`) the first and third channel are standardised; padding stays zero.
    """
    ch = {c: F.col(c) for c in channels}
    if scaler is not None:
        def z(x, m, s):
            return (x - F.lit(scaler[m])) / F.lit(scaler[s] or 1.0)
        ch["signed_len"] = z(ch["signed_len"], "len_mean", "len_std")
        ch["delta_t"] = z(F.log1p(ch["delta_t"]), "dt_mean", "dt_std")
    step = F.array(*[ch[c].cast("float") for c in channels])
    g = steps.groupBy(*flow).agg(F.sort_array(F.collect_list(F.struct("pos", step.alias("v")))).alias("_s"))
    zero = F.array(*[F.lit(0.0).cast("float") for _ in channels])
    if k is None:
        return g.select(*flow, F.transform("_s", lambda x: x["v"]).alias("sequence"), F.size("_s").alias("n_packets"))
    body = F.slice(F.transform("_s", lambda x: x["v"]), 1, k)
    n = F.least(F.size("_s"), F.lit(k))
    return g.select(*flow, F.concat(body, F.array_repeat(zero, k - n)).alias("sequence"), n.alias("n_packets"))


def slice_features(seqs: DataFrame, feature_set: str = "A", k: int | None = None) -> DataFrame:
    idx = FEATURE_SETS[feature_set]
    s = F.col("sequence") if k is None else F.slice("sequence", 1, k)
    return seqs.withColumn("sequence", F.transform(s, lambda v: F.array(*[F.element_at(v, i + 1) for i in idx])))


def channel_means(seqs: DataFrame, flow: list[str], n_channels: int = 4) -> DataFrame:
    """Per flow and channel the mean over real steps, one row per (flow, channel)."""
    real = F.slice("sequence", 1, F.greatest("n_packets", F.lit(1)))

    def total(i: int):
        return F.aggregate(F.transform(real, lambda v: F.element_at(v, i + 1).cast("double")), F.lit(0.0),
                           lambda a, x: a + x)

    means = [total(i) / F.greatest("n_packets", F.lit(1)) for i in range(n_channels)]
    e = F.explode(F.array(*[F.struct(F.lit(i).alias("channel"), m.alias("value")) for i, m in enumerate(means)]))
    keep = [c for c in seqs.columns if c not in ("sequence", "n_packets")]
    return seqs.select(*keep, e.alias("_e")).select(*keep, "_e.channel", "_e.value")
