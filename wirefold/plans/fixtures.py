"""Stand-in tables derived from the driver's parquet, one SQL text per table for Spark and for the DuckDB check.

Times stay in integer microseconds so that gaps compare exactly in both engines. The timeouts are the defaults times
1000 because the events are days apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

IDLE_S, ACTIVE_S = 60_000.0, 120_000.0

TOKENS = {
    "spark": {"TS_US": "unix_micros(cast(ts as timestamp))",
              "K": "cast(get_json_object(props,'$.k') as int)", "DBL": "double"},
    "duckdb": {"TS_US": "epoch_us(ts)", "K": "cast(json_extract_string(props,'$.k') as int)", "DBL": "double"},
}

SQL = {
    "packets": """
select event_id, [TS_US] as ts_us,
       case cast(floor(([TS_US] - 1704067200000000) / 518400000000) as int)
            when 0 then 'Monday-WorkingHours.pcap' when 1 then 'Tuesday-WorkingHours.pcap'
            when 2 then 'Wednesday-workingHours.pcap' when 3 then 'Thursday-WorkingHours.pcap'
            else 'Friday-WorkingHours.pcap' end as pcap_file,
       case when event_id % 97 = 0 then null else concat('10.0.0.', cast(user_id % 4 as string)) end as src_ip,
       cast(1000 + [K] % 2 as int) as src_port,
       concat('10.0.0.', cast([K] % 3 as string)) as dst_ip,
       case event_type when 'error' then 22 when 'click' then 80 when 'view' then 443
                       when 'signup' then 53 else 2049 end as dst_port,
       case when event_id % 50 = 0 then 1 when event_id % 4 = 0 then 17 else 6 end as protocol,
       cast(40 + floor(value) as bigint) as ip_len,
       cast(event_id % 64 as int) as tcp_flags
from events""",
    "label_ref": """
select src_ip as source_ip, src_port as source_port, dst_ip as destination_ip, dst_port as destination_port,
       protocol, ts_us, event_id, pcap_file,
       case when dst_port = 22 and src_port = 1001 then 'Noise'
            when dst_port = 22 then 'SSH-Patator'
            when dst_port = 80 and event_id % 2 = 0 then 'Web Attack – XSS'
            when dst_port = 80 then 'Web Attack - XSS '
            when dst_port = 53 then 'Mystery'
            when dst_port = 2049 and event_id % 40 = 1 then 'DoS Hulk'
            else 'BENIGN' end as label
from packets
where src_ip is not null and protocol in (6, 17)
  and (event_id % 3 = 0 or event_id % 40 = 1)
  and not (dst_port = 443 and src_ip = '10.0.0.3')""",
    "label_mapping": """
select * from (values
  ('demo', 'BENIGN',           'benign', '',            'keep'),
  ('demo', 'SSH-Patator',      'attack', 'brute_force', 'keep'),
  ('demo', 'Web Attack - XSS', 'attack', 'web_attack',  'keep'),
  ('demo', 'DoS Hulk',         'attack', 'dos_ddos',    'keep'),
  ('demo', 'Noise',            'attack', '',            'exclude')
) as t(dataset_name, original_label, binary_label, coarse_family, keep_or_exclude)""",
    "alerts": """
select event_id as alert_id, ts_us + 7200000000 as alert_ts_us, src_ip,
       case when event_id % 15 = 0 then src_port + 7 else src_port end as src_port,
       dst_ip as dest_ip, dst_port as dest_port, case protocol when 6 then 'TCP' else 'UDP' end as proto,
       'alert' as event_type, 2000000 + event_id % 10 as signature_id
from packets
where dst_port = 22 and event_id % 5 = 0 and src_ip is not null and protocol in (6, 17)""",
    "scores": """
select event_id, substr('abc', cast(user_id % 3 + 1 as int), 1) as domain,
       cast(floor(([TS_US] - 1704067200000000) / 518400000000) as int) as file_no,
       case when event_type = 'error' then 1 else 0 end as y_true,
       case when event_type <> 'error' then 'benign' when user_id % 4 = 0 then 'dos_ddos'
            when user_id % 4 = 1 then 'brute_force' when user_id % 4 = 2 then 'web_attack'
            else 'reconnaissance_scan' end as family,
       case when event_id % 4 = 0 then 17 else 6 end as protocol, cast(40 + floor(value) as bigint) as bytes_total,
       cast(6 * ((event_id * 7919 + user_id * 31) % 1000) + case when event_type = 'error' then 4000 else 0 end as double) / 10000 as s_lr,
       cast(9 * ((event_id * 104729 + user_id * 17) % 1000) + case when event_type = 'error' then 1000 else 0 end as double) / 10000 as s_rf,
       cast(6 * (([K] * 37 + event_id * 13) % 1000) * (([K] * 37 + event_id * 13) % 1000)
            + case when event_type = 'error' then 4000000 else 0 end as double) / 10000000 as s_xgb
from events""",
}
SQL["long_scores"] = " union all ".join(
    f"select event_id, domain, file_no, family, protocol, bytes_total, '{m}' as method, y_true, s_{m} as y_score "
    "from scores" for m in ("lr", "rf", "xgb"))

# Wide and row-heavy twin used for timing: the score formulas over lineitem.
SQL["bench_scores"] = """
select case when l_returnflag = 'R' then 1 else 0 end as y_true, l_linestatus as domain,
       cast((l_orderkey * 7919 + l_partkey * 31) % 1000 * 6 + case when l_returnflag = 'R' then 4000 else 0 end as double) / 10000 as s_lr,
       cast((l_orderkey * 104729 + l_suppkey * 17) % 1000 * 9 + case when l_returnflag = 'R' then 1000 else 0 end as double) / 10000 as s_rf,
       cast((l_partkey * 37 + l_suppkey * 13) % 1000 * ((l_partkey * 37 + l_suppkey * 13) % 1000) * 6
            + case when l_returnflag = 'R' then 4000000 else 0 end as double) / 10000000 as s_xgb
from lineitem"""
SQL["bench_long_scores"] = " union all ".join(
    f"select domain, '{m}' as method, y_true, s_{m} as y_score from bench_scores" for m in ("lr", "rf", "xgb"))

NEEDS = {"packets": ["events"], "label_ref": ["packets"], "label_mapping": [], "alerts": ["packets"],
         "scores": ["events"], "long_scores": ["scores"], "bench_scores": ["lineitem"],
         "bench_long_scores": ["bench_scores"]}


def text(name: str, engine: str) -> str:
    out = SQL[name]
    for k, v in TOKENS[engine].items():
        out = out.replace(f"[{k}]", v)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of the test data or a stand-in derived from one."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    out = text(name, "spark")
    args = {}
    for need in NEEDS[name]:
        args[need] = table(spark, sf_dir, need)
        out = out.replace(f"from {need}", "from {" + need + "}")
    return spark.sql(out, **args)


def with_clause(names: list[str]) -> str:
    """DuckDB `with` text that defines the named stand-ins and what they need, in order."""
    seen: list[str] = []

    def add(n):
        for need in NEEDS.get(n, []):
            if need in SQL:
                add(need)
        if n in SQL and n not in seen:
            seen.append(n)

    for n in names:
        add(n)
    return "with recursive " + ",\n".join(f"{n} as ({text(n, 'duckdb')})" for n in seen)
