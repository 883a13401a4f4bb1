"""Registered queries: alerts, packet assignment and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirefold.functions.columns import capture_day
from wirefold.operators import alerts as al
from wirefold.operators import flows as fl
from wirefold.operators import sequences as sq
from wirefold.operators import splits as sp
from wirefold.plans.fixtures import ACTIVE_S, IDLE_S, table
from wirefold.registry import oracle as o
from wirefold.registry.feature_queries import _DAY, _ROLE
from wirefold.registry.flow_queries import IDENT, flows_of

TOL_S = 70_000.0
OFFSET_S = 7200.0  # the clock offset of the stand-in alerts
FLOW = [*fl.KEY, "flow_start_us"]


def alerts_of(spark, sf):
    return al.correct_time(table(spark, sf, "alerts"), OFFSET_S)


def _cands(spark, sf):
    a, f = alerts_of(spark, sf), flows_of(spark, sf)
    return a, f, al.candidates(a, f, TOL_S, ACTIVE_S)


def alert_offset(spark, sf):
    return alerts_of(spark, sf).select("alert_id", "alert_ts_us", "t_us")


def alert_flow_match(spark, sf):
    a, _, c = _cands(spark, sf)
    m = al.match_status(a, c)
    return m.select("alert_id", "n_candidates", "match_status", F.col("flow.start_us").alias("flow_start_us"))


def alert_match_rates(spark, sf):
    a, _, c = _cands(spark, sf)
    return al.status_rates(al.match_status(a, c))


def alert_flow_match_same_day(spark, sf):
    """The join also asks for the same capture day; alerts take the day of the capture they came from."""
    a = alerts_of(spark, sf).join(table(spark, sf, "packets").select(F.col("event_id").alias("alert_id"),
                                                                     capture_day().alias("day")), "alert_id")
    f = flows_of(spark, sf).withColumn("day", capture_day())
    m = al.match_status(a, al.candidates(a, f, TOL_S, ACTIVE_S, same_day=True))
    return m.select("alert_id", "day", "n_candidates", "match_status")


def alert_verdict(spark, sf):
    a, f, c = _cands(spark, sf)
    return al.flow_verdicts(f, a, c).select(*IDENT, "alert_count_unique", "alert_count_ambiguous", "alert_pred")


def packet_assign(spark, sf):
    p, f = table(spark, sf, "packets"), flows_of(spark, sf)
    return sq.packets_to_flows(p, f, 1.0, ACTIVE_S).select("event_id", "flow_start_us")


def packet_coverage(spark, sf):
    """Every tenth flow (by start) removed: its packets turn up without a flow, all kept flows have packets."""
    p, f = table(spark, sf, "packets"), flows_of(spark, sf)
    kept = f.where("start_us % 10 <> 0")
    a = sq.packets_to_flows(p, kept, 1.0, ACTIVE_S)
    n1 = sq.packets_without_flow(a).agg(F.count("*").alias("n")).withColumn("side", F.lit("packets_without_flow"))
    n2 = (sq.flows_without_packets(f, a).agg(F.count("*").alias("n"))
          .withColumn("side", F.lit("flows_without_packets")))
    return n1.unionByName(n2)


def _steps(spark, sf, k=sq.K_MAX, tail=False):
    a = fl.assign_flows(table(spark, sf, "packets"), IDLE_S, ACTIVE_S)
    s = sq.first_packets(sq.packet_channels(a), FLOW, ["ts_us", "event_id"], k, tail)
    return sp.with_day_split(s)


def first_packets(spark, sf):
    return _steps(spark, sf, 8).select("event_id", "pos", "signed_len", "direction",
                                       F.round("delta_t", 6).alias("delta_t"), "protocol_id")


def last_packets(spark, sf):
    return _steps(spark, sf, 3, tail=True).select("event_id", "pos")


def sequence_scaler(spark, sf):
    s = sq.scaler_stats(_steps(spark, sf))
    return s.select("n_steps", *[F.round(c, 6).alias(c) for c in ("len_mean", "len_std", "dt_mean", "dt_std")])


def packet_sequences(spark, sf):
    """All K_MAX steps of every flow."""
    s = sq.to_sequences(_steps(spark, sf), FLOW, sq.K_MAX)
    return s.select(*FLOW, "n_packets", _flat(F.col("sequence")).alias("steps"))


def packet_sequences_scaled(spark, sf):
    """Every scaled step of every flow, one row a step."""
    steps = _steps(spark, sf)
    scaler = sq.scaler_stats(steps).first().asDict()
    s = sq.to_sequences(steps, FLOW, sq.K_MAX, scaler)
    s = s.select(*FLOW, "n_packets", F.posexplode("sequence").alias("pos", "step")).where("pos < n_packets")
    return s.select(*FLOW, "n_packets", (F.col("pos") + 1).alias("pos"), *[
        F.round(F.element_at("step", i + 1), 2).cast("double").alias(c) for i, c in enumerate(sq.CHANNELS)])


def sequence_set_a(spark, sf):
    s = sq.slice_features(sq.to_sequences(_steps(spark, sf), FLOW, sq.K_MAX), "A", sq.K_MAX)
    return s.select(*FLOW, _flat(F.col("sequence")).alias("steps"))


def _flat(seq):
    return F.array_join(F.transform(F.flatten(seq), lambda x: F.round(x.cast("double"), 0).cast("bigint").cast("string")),
                        ",")


def conversation_sequences(spark, sf):
    """A conversation read as a flow: turn order, text length as size, user turns as forward. All turns, not padded."""
    size = F.length("text")
    c = table(spark, sf, "conversations").withColumns({
        "signed_len": F.when(F.col("role") == "user", size).otherwise(-size).cast("double"),
        "direction": (F.col("role") == "user").cast("double")})
    s = sq.to_sequences(c.withColumn("pos", F.col("turn")), ["conv_id"], None, channels=["signed_len", "direction"])
    return s.select("conv_id", "n_packets", _flat(F.col("sequence")).alias("steps"))


QUERIES = {f.__name__: f for f in (
    alert_offset, alert_flow_match, alert_match_rates, alert_flow_match_same_day, alert_verdict, packet_assign,
    packet_coverage, first_packets, last_packets, sequence_scaler, packet_sequences, packet_sequences_scaled,
    sequence_set_a, conversation_sequences)}

TOL_US = int(TOL_S * 1e6)
ALERTS = """al as (select *, alert_ts_us - 7200000000 as t_us,
  case when (src_ip, src_port) <= (dest_ip, dest_port) then src_ip else dest_ip end as lo_ip,
  case when (src_ip, src_port) <= (dest_ip, dest_port) then src_port else dest_port end as lo_port,
  case when (src_ip, src_port) <= (dest_ip, dest_port) then dest_ip else src_ip end as hi_ip,
  case when (src_ip, src_port) <= (dest_ip, dest_port) then dest_port else src_port end as hi_port,
  case proto when 'TCP' then 6 else 17 end as pr from alerts)"""


def _cand(extra: str = "") -> str:
    return f"""cand as (select a.alert_id, f.* from al a join fd f on f.src_ip = a.lo_ip and f.src_port = a.lo_port
      and f.dst_ip = a.hi_ip and f.dst_port = a.hi_port and f.protocol = a.pr {extra}
      and a.t_us between f.start_us - {TOL_US} and f.end_us + {TOL_US})"""


FD = f"fd as (select *, {_DAY} as day from flows)"
STATUS = """st as (select a.alert_id, count(c.alert_id) as n_candidates,
  case count(c.alert_id) when 0 then 'alert_unmatched' when 1 then 'matched_unique' else 'matched_ambiguous' end
  as match_status, case when count(c.alert_id) = 1 then min(c.start_us) end as flow_start_us
  from al a left join cand c on c.alert_id = a.alert_id group by 1)"""
_SDAY = f"ald as (select al.*, {_DAY} as day from al join packets on event_id = alert_id)"
_ID = ", ".join(IDENT)
_FL = ", ".join(FLOW)
STEPS = f"""steps as (select *, case src_ip = lo_ip when true then ip_len else -ip_len end::double as signed_len,
  (src_ip = lo_ip)::int::double as direction, delta_us / 1e6 as delta_t,
  case protocol when 6 then 0 else 1 end::double as protocol_id,
  row_number() over (partition by {_FL} order by ts_us, event_id) as pos,
  row_number() over (partition by {_FL} order by ts_us desc, event_id desc) as rpos,
  {_ROLE} as split from (select *, {_DAY} as day from walk))"""
_SC = """sc as (select count(*) as n_steps, avg(signed_len) as len_mean, stddev_pop(signed_len) as len_std,
  avg(ln(1 + delta_t)) as dt_mean, stddev_pop(ln(1 + delta_t)) as dt_std from steps where split = 'train' and pos <= 32)"""


def _flat_sql(cols: list[str], k: int) -> str:
    real = "string_agg(" + " || ',' || ".join(f"cast(round({c}::float::double, 0) as bigint)::varchar" for c in cols) \
        + ", ',' order by pos)"
    pad = ",0" * len(cols)
    return f"{real} || repeat('{pad}', cast({k} - count(*) as bigint))"


ORACLE = {
    "alert_offset": o.sql(["alerts"], "select alert_id, alert_ts_us, t_us from al", ALERTS),
    "alert_flow_match": o.flows("select alert_id, n_candidates, match_status, flow_start_us from st", ALERTS, FD,
                                _cand(), STATUS, extra=["alerts"]),
    "alert_match_rates": o.flows("""select count(*) as n_alerts,
        count(*) filter (match_status = 'matched_unique') as n_unique,
        count(*) filter (match_status = 'matched_ambiguous') as n_ambiguous,
        count(*) filter (match_status = 'alert_unmatched') as n_unmatched,
        round(100.0::double * count(*) filter (n_candidates > 0) / count(*), 4) as match_rate from st""",
                                 ALERTS, FD, _cand(), STATUS, extra=["alerts"]),
    "alert_flow_match_same_day": o.flows("""select a.alert_id, any_value(a.day) as day,
        count(c.alert_id) as n_candidates, case count(c.alert_id) when 0 then 'alert_unmatched'
        when 1 then 'matched_unique' else 'matched_ambiguous' end as match_status
        from ald a left join cand c on c.alert_id = a.alert_id group by 1""", ALERTS, FD, _SDAY,
                                         _cand("and a.day = f.day").replace("from al a", "from ald a"),
                                         extra=["alerts"]),
    "alert_verdict": o.flows(f"""select {_ID}, coalesce(u, 0) as alert_count_unique,
        coalesce(v, 0) as alert_count_ambiguous, case when coalesce(u, 0) > 0 then 'attack' else 'benign' end as alert_pred
        from flows left join (select {_ID}, count(*) filter (n_candidates = 1) as u,
          count(*) filter (n_candidates > 1) as v from cand join st using (alert_id) group by all) using ({_ID})""",
                             ALERTS, FD, _cand(), STATUS, extra=["alerts"]),
    "packet_assign": o.assigned("select event_id, flow_start_us from walk"),
    "packet_coverage": o.assigned(f"""select count(*) as n, 'packets_without_flow' as side from walk
        where flow_start_us % 10 = 0 union all
        select count(*), 'flows_without_packets' from (select distinct {_FL} from walk where flow_start_us % 10 = 0)"""),
    "first_packets": o.assigned("""select event_id, pos, signed_len, direction, round(delta_t, 6) as delta_t, protocol_id
        from steps where pos <= 8""", STEPS),
    "last_packets": o.assigned(f"""select event_id, max(rpos) over (partition by {_FL}) - rpos + 1 as pos
        from steps where rpos <= 3""", STEPS),
    "sequence_scaler": o.assigned("""select n_steps, round(len_mean, 6) as len_mean, round(len_std, 6) as len_std,
        round(dt_mean, 6) as dt_mean, round(dt_std, 6) as dt_std from sc""", STEPS, _SC),
}

ORACLE |= {
    "packet_sequences": o.assigned(f"""select {_FL}, count(*) as n_packets,
        {_flat_sql(['signed_len', 'direction', 'delta_t', 'protocol_id'], sq.K_MAX)} as steps
        from steps where pos <= {sq.K_MAX} group by {_FL}""", STEPS),
    "packet_sequences_scaled": o.assigned(f"""select {_FL}, n_packets, pos,
        round(((signed_len - len_mean) / len_std)::float, 2)::double as signed_len, direction,
        round(((ln(1 + delta_t) - dt_mean) / dt_std)::float, 2)::double as delta_t, protocol_id
        from (select *, least(count(*) over (partition by {_FL}), {sq.K_MAX}) as n_packets from steps), sc
        where pos <= {sq.K_MAX}""", STEPS, _SC),
    "sequence_set_a": o.assigned(f"""select {_FL}, {_flat_sql(['direction', 'protocol_id'], sq.K_MAX)} as steps
        from steps where pos <= {sq.K_MAX} group by {_FL}""", STEPS),
    "conversation_sequences": f"""select conv_id, count(*) as n_packets,
        {_flat_sql(['signed_len', 'direction'], 0)} as steps from (select *,
          (case when role = 'user' then length(text) else -length(text) end)::double as signed_len,
          (role = 'user')::int::double as direction,
          row_number() over (partition by conv_id order by turn) as pos from conversations)
        group by conv_id""",
}
