"""DuckDB texts shared by the checks: stand-in tables, and flows by a recursive query."""

from __future__ import annotations

from wirefold.plans.fixtures import ACTIVE_S, IDLE_S, with_clause

IDLE_US, ACTIVE_US = int(IDLE_S * 1e6), int(ACTIVE_S * 1e6)

KEYED = """keyed as (
  select *, case when (src_ip, src_port) <= (dst_ip, dst_port) then src_ip else dst_ip end as lo_ip,
    case when (src_ip, src_port) <= (dst_ip, dst_port) then src_port else dst_port end as lo_port,
    case when (src_ip, src_port) <= (dst_ip, dst_port) then dst_ip else src_ip end as hi_ip,
    case when (src_ip, src_port) <= (dst_ip, dst_port) then dst_port else src_port end as hi_port
  from packets where src_ip is not null and dst_ip is not null and protocol in (6, 17))"""

ASSIGNED = f"""numbered_packets as (
  select *, (src_ip = lo_ip and src_port = lo_port) as fwd,
    row_number() over (partition by pcap_file, lo_ip, lo_port, hi_ip, hi_port, protocol order by ts_us, event_id) as rn
  from keyed),
walk as (
  select *, ts_us as flow_start_us, cast(0 as bigint) as delta_us, true as opens from numbered_packets where rn = 1
  union all
  select p.*, case when p.ts_us - w.ts_us > {IDLE_US} or p.ts_us - w.flow_start_us > {ACTIVE_US} then p.ts_us
                   else w.flow_start_us end,
    case when p.ts_us - w.ts_us > {IDLE_US} or p.ts_us - w.flow_start_us > {ACTIVE_US} then 0 else p.ts_us - w.ts_us end,
    p.ts_us - w.ts_us > {IDLE_US} or p.ts_us - w.flow_start_us > {ACTIVE_US}
  from walk w join numbered_packets p on p.rn = w.rn + 1 and p.pcap_file = w.pcap_file and p.lo_ip = w.lo_ip
    and p.lo_port = w.lo_port and p.hi_ip = w.hi_ip and p.hi_port = w.hi_port and p.protocol = w.protocol)"""

FLOWS = """flows as (
  select pcap_file, lo_ip as src_ip, lo_port as src_port, hi_ip as dst_ip, hi_port as dst_port, protocol,
    flow_start_us as start_us, max(ts_us) as end_us, count(*) as packet_count_total,
    cast(sum(ip_len) as bigint) as bytes_total, count(*) filter (fwd) as packet_count_fwd,
    count(*) filter (not fwd) as packet_count_bwd, cast(coalesce(sum(ip_len) filter (fwd), 0) as bigint) as bytes_fwd,
    cast(coalesce(sum(ip_len) filter (not fwd), 0) as bigint) as bytes_bwd,
    max(ts_us) - flow_start_us as duration_us
  from walk group by pcap_file, lo_ip, lo_port, hi_ip, hi_port, protocol, flow_start_us)"""


def sql(tables: list[str], body: str, *ctes: str) -> str:
    head = with_clause(tables) if any(tables) else "with recursive one as (select 1 as x)"
    return head + "".join(",\n" + c for c in ctes) + "\n" + body


def keyed(body: str, *ctes: str, extra: list[str] = ()) -> str:
    return sql(["packets", *extra], body, KEYED, *ctes)


def assigned(body: str, *ctes: str, extra: list[str] = ()) -> str:
    return sql(["packets", *extra], body, KEYED, ASSIGNED, *ctes)


def flows(body: str, *ctes: str, extra: list[str] = ()) -> str:
    return sql(["packets", *extra], body, KEYED, ASSIGNED, FLOWS, *ctes)
