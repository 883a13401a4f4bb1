"""Scalar column functions: keys, labels, safe arithmetic, time and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dash-like characters read as a plain hyphen (cp1252 0x96, en dash, em dash, minus sign).
DASHES = "[\u0096\u2013\u2014\u2212]"
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday"]
PROTO_NUMBERS = {"tcp": 6, "udp": 17}
SERVICES = {21: "ftp", 22: "ssh", 53: "dns", 80: "http", 443: "https", 631: "ipp", 2049: "nfs"}
BYTE_BANDS = ["<100B", "100B-1KB", "1KB-10KB", "10KB-100KB", ">100KB"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def endpoint_low(src_ip="src_ip", src_port="src_port", dst_ip="dst_ip", dst_port="dst_port") -> Column:
    """Smaller (ip text, port) endpoint; NULL when any part is missing, so no half-known key is ever built."""
    return _ordered(F.least, src_ip, src_port, dst_ip, dst_port)


def endpoint_high(src_ip="src_ip", src_port="src_port", dst_ip="dst_ip", dst_port="dst_port") -> Column:
    return _ordered(F.greatest, src_ip, src_port, dst_ip, dst_port)


def _ordered(pick, src_ip, src_port, dst_ip, dst_port) -> Column:
    parts = [_c(x) for x in (src_ip, src_port, dst_ip, dst_port)]
    known = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull() & parts[3].isNotNull()
    a = F.struct(parts[0].alias("ip"), parts[1].cast("int").alias("port"))
    b = F.struct(parts[2].alias("ip"), parts[3].cast("int").alias("port"))
    return F.when(known, pick(a, b))


def is_forward(src_ip="src_ip", src_port="src_port", lo_ip="lo_ip", lo_port="lo_port") -> Column:
    """Source endpoint is the low endpoint; traffic of an endpoint with itself counts as forward."""
    return (_c(src_ip) == _c(lo_ip)) & (_c(src_port) == _c(lo_port))


def is_forward_ip_only(src_ip="src_ip", lo_ip="lo_ip") -> Column:
    return _c(src_ip) == _c(lo_ip)


def normalise_label(x) -> Column:
    return F.regexp_replace(F.trim(_c(x)), DASHES, "-")


def blank_to_null(x) -> Column:
    t = F.trim(_c(x))
    return F.when(t != "", t)


def safe_divide(num, den) -> Column:
    """num / den with 0.0 for a zero or missing operand, NaN or infinity."""
    q = F.try_divide(_c(num).cast("double"), _c(den).cast("double"))
    return finite_or_zero(q)


def finite_or_zero(x) -> Column:
    x = _c(x)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0)).otherwise(x)


def percent(part, whole) -> Column:
    return safe_divide(_c(part).cast("double") * 100.0, whole)


def capture_day(file_col="pcap_file") -> Column:
    """First weekday, in Monday-to-Friday order, found in the file name; else Unknown."""
    low = F.lower(_c(file_col))
    out = None
    for day in WEEKDAYS:
        out = (F.when if out is None else out.when)(low.contains(day), F.lit(day.capitalize()))
    return out.otherwise(F.lit("Unknown"))


def contains_any(file_col, parts: list[str]) -> Column:
    low = F.lower(_c(file_col))
    out = F.lit(False)
    for p in parts:
        out = out | low.contains(p.lower())
    return out


def proto_number(x) -> Column:
    low = F.lower(F.trim(_c(x)))
    out = None
    for name, num in PROTO_NUMBERS.items():
        out = (F.when if out is None else out.when)(low == name, F.lit(num))
    return out


def proto_id(x) -> Column:
    """TCP 0, UDP 1, anything else NULL."""
    return F.when(_c(x) == 6, 0).when(_c(x) == 17, 1)


def service_name(port) -> Column:
    port = _c(port)
    out = None
    for num, name in SERVICES.items():
        out = (F.when if out is None else out.when)(port == num, F.lit(name))
    return out.otherwise(F.concat(F.lit("port"), port.cast("string")))


def byte_band(x) -> Column:
    x = _c(x)
    return (F.when(x < 100, BYTE_BANDS[0]).when(x < 1000, BYTE_BANDS[1]).when(x < 10000, BYTE_BANDS[2])
            .when(x < 100000, BYTE_BANDS[3]).otherwise(BYTE_BANDS[4]))


def context_name(x) -> Column:
    return F.lower(F.regexp_replace(_c(x), "\\s*\u2192\\s*", "_to_"))


def epoch_micros(x) -> Column:
    return F.unix_micros(_c(x).cast("timestamp"))


def micros_to_seconds(x) -> Column:
    return _c(x) / F.lit(1e6)


def report_round(x, digits: int = 4) -> Column:
    return F.round(_c(x), digits)


def label_bit(x="binary_label") -> Column:
    return (_c(x) == "attack").cast("int")


def not_benign_bit(x="original_label") -> Column:
    return F.when(F.upper(F.trim(_c(x))) == "BENIGN", 0).otherwise(1)
