"""Packet-level filters and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.functions.columns import endpoint_high, endpoint_low, is_forward
from wirefold.operators.ordering import numbered

def reject_reason():
    """Why a packet cannot belong to a flow; NULL when accepted."""
    return (F.when(F.col("src_ip").isNull() | F.col("dst_ip").isNull(), "skipped_no_ip")
            .when(~F.coalesce(F.col("protocol").isin(6, 17), F.lit(False)) | F.col("src_port").isNull()
                  | F.col("dst_port").isNull(), "skipped_no_transport"))


def _reason(packets: DataFrame):
    """The reject reason, or that a capture block carried no time."""
    if "ts_us" not in packets.columns:
        return reject_reason()
    return F.coalesce(reject_reason(), F.when(F.col("ts_us").isNull(), "skipped_no_time"))


def accept(packets: DataFrame) -> DataFrame:
    return packets.where(_reason(packets).isNull())


def reject_counts(packets: DataFrame) -> DataFrame:
    return (packets.groupBy(F.coalesce(_reason(packets), F.lit("accepted")).alias("outcome"))
            .agg(F.count("*").alias("n_packets")))


def with_key(packets: DataFrame) -> DataFrame:
    """Adds the direction-free key as four flat columns (they hash, sort and cross to Arrow cheaply) and `fwd`."""
    return (packets
            .withColumn("_lo", endpoint_low()).withColumn("_hi", endpoint_high())
            .withColumns({"lo_ip": F.col("_lo.ip"), "lo_port": F.col("_lo.port"),
                          "hi_ip": F.col("_hi.ip"), "hi_port": F.col("_hi.port")})
            .drop("_lo", "_hi")
            .withColumn("fwd", is_forward()))


def skip_and_cap(packets: DataFrame, skip: int = 0, cap: int | None = None, file_col: str = "pcap_file",
                 order: str = "event_id") -> DataFrame:
    """Per file, drops the first `skip` packets and keeps the next `cap`, counted before any protocol filter."""
    n = numbered(packets, [file_col], order, [], "packet_index")
    n = n.where(F.col("packet_index") > skip)
    return n.where(F.col("packet_index") <= skip + cap) if cap is not None else n
