"""Table schemas and fixed column lists."""

from __future__ import annotations

from pyspark.sql import types as T


S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PACKET = struct(timestamp=D, src_ip=S, dst_ip=S, src_port=I, dst_port=I, protocol=I, ip_len=I)
CAPTURE_PACKET = struct(pcap_file=S, packet_no=L, ts_us=L, timestamp=D, src_ip=S, dst_ip=S, src_port=I, dst_port=I,
                        protocol=I, ip_len=I, tcp_flags=I)
FLOW = struct(flow_id=L, pcap_file=S, start_time=D, end_time=D, duration_s=D, protocol=I, src_ip=S, src_port=I,
              dst_ip=S, dst_port=I, packet_count_total=L, bytes_total=L, packet_count_fwd=L, packet_count_bwd=L,
              bytes_fwd=L, bytes_bwd=L)
MAPPING = struct(dataset_name=S, original_label=S, binary_label=S, coarse_family=S, keep_or_exclude=S,
                 exclude_reason=S, notes=S)
SCENARIO_PLAN = struct(scenario=S, split=S, family=S, label_type=S)
ALERT_EVENT = struct(timestamp=S, event_type=S, src_ip=S, src_port=I, dest_ip=S, dest_port=I, proto=S,
                     alert=struct(signature=S, signature_id=L, category=S, severity=I))
LABEL_5TUPLE = struct(source_ip=S, source_port=I, destination_ip=S, destination_port=I, protocol=I, label=S)

# Metadata columns, the 19 model features in order, and columns never allowed as features.
META_COLS = [
    "flow_id", "pcap_file", "start_time", "end_time", "matched_flag", "ambiguous_flag",
    "label_match_method", "original_label", "binary_label", "coarse_family",
]
FEATURES = [
    "duration_s", "packet_count_total", "bytes_total", "packet_count_fwd", "packet_count_bwd",
    "bytes_fwd", "bytes_bwd", "protocol", "is_tcp", "is_udp", "bytes_per_packet",
    "bytes_per_packet_fwd", "bytes_per_packet_bwd", "packets_per_second", "bytes_per_second",
    "fwd_packet_ratio", "bwd_packet_ratio", "fwd_byte_ratio", "bwd_byte_ratio",
]
BANNED_FEATURES = [
    "global_flow_id", "flow_id", "pcap_file", "start_time", "end_time", "day", "binary_label",
    "coarse_family", "matched_flag", "ambiguous_flag", "label_match_method", "original_label",
]
PREDICTION_COLS = [
    "global_flow_id", "day", "split", "binary_label", "coarse_family", "pred_score",
    "pred_label_default", "pred_label_val_tuned", "pred_label_fixed_fpr", "is_train", "is_val", "is_test",
]
