"""The registered queries once more, as plain SQL for an independent engine.

Nothing is shared with the operators: lateness, running aggregates and alert runs are written here as ordinary
window functions over whole keys, which is only possible because the check runs on small data.
"""

from __future__ import annotations

import re

BASE = 1704067200000000
AS_OF = "1790000000.0::double"

# Named relations, each with the names it builds on.
RELATIONS: dict[str, tuple[str, tuple[str, ...]]] = {}
ORACLE: dict[str, str] = {}


def relation(name: str, body: str, *needs: str) -> None:
    RELATIONS[name] = (body, needs)


def oracle(name: str, body: str, *needs: str, recursive: bool = False) -> None:
    ordered: list[str] = []

    def visit(n: str) -> None:
        for m in RELATIONS[n][1]:
            visit(m)
        if n not in ordered:
            ordered.append(n)

    for n in needs:
        visit(n)
    ctes = ",\n".join(f"{n} as ({RELATIONS[n][0]})" for n in ordered)
    ORACLE[name] = f"with {'recursive ' * recursive}{ctes}\n{body}" if ctes else body


def rounded(num: str, den: str, digits: int, scale: int = 1) -> str:
    """num * scale / den to `digits` decimals, ties away from zero, on integers."""
    n, d = f"({num})::hugeint * {scale}", f"({den})::hugeint"
    return f"((sign({num}) * ((2 * abs({n}) + {d}) // (2 * {d})))::double / {10**digits}.0::double)"


def ratio(num: str, den: str, digits: int) -> str:
    return rounded(num, den, digits, 10**digits)


# --- telemetry ---------------------------------------------------------------------------------------------------

relation(
    "tel",
    f"""
    select *, temp_cc::double / 100.0::double as temperature, target_cc::double / 100.0::double as target_temperature
    from (
      select event_id as arrival_seq,
             'cust_0' || (1 + user_id % 5) as customer_id,
             'trk_' || user_id as truck_id,
             {BASE} + (epoch_us(ts) - {BASE}) // 1000
               - case when event_id % 20 = 0 then (15 + (event_id * 37) % 106) * 1000000 else 0 end as event_us,
             (round(value * 100)::bigint % 3001) - 3000 as temp_cc,
             -1800 + (event_id % 4) * 50 as target_cc,
             case when event_type = 'error' and event_id % 3 = 0 then 'FAULT'
                  when event_type = 'signup' then 'DEFROST' when event_type = 'view' then 'OFF'
                  else 'RUNNING' end as compressor_status
      from events)""",
)
relation("v", "select *, event_us - event_us % 300000000 as w from tel where temp_cc <> 0", "tel")
relation(
    "judged",
    """
    select *, event_us < mx - 30000000 as late, mx - mx % 300000000 as head_w
    from (select *, max(event_us) over (partition by customer_id, truck_id order by arrival_seq
                                        rows between unbounded preceding and current row) as mx from v)""",
    "v",
)
relation(
    "grouped",
    """
    select customer_id, truck_id, w, count(*) as n, sum(temp_cc)::bigint as s, min(temp_cc) as mn, max(temp_cc) as mxx,
           arg_max(target_cc, arrival_seq) as tg
    from judged where not late group by 1, 2, 3""",
    "judged",
)


def aggregate_columns(prefix: str = "") -> str:
    average = rounded("s", "n", 2)
    return f"""{prefix} customer_id, truck_id, w::double / 1000000.0::double as window_start,
    (w + 300000000)::double / 1000000.0::double as window_end, n::bigint as sample_count, {average} as avg_temperature,
    mn::double / 100.0::double as min_temperature, mxx::double / 100.0::double as max_temperature,
    tg::double / 100.0::double as target_temperature,
    ({average} > -10.0::double or {average} < -25.0::double) as is_breached"""


for _name in ("window_aggregates", "window_aggregates_split"):
    oracle(_name, f"select {aggregate_columns()} from grouped", "grouped")
oracle("breached_windows", f"select * from (select {aggregate_columns()} from grouped) where is_breached", "grouped")
oracle(
    "latest_window",
    f"""select {aggregate_columns()} from grouped
    qualify row_number() over (partition by customer_id, truck_id order by w desc) = 1""",
    "grouped",
)
oracle(
    "late_events",
    """select arrival_seq, customer_id, truck_id, temperature, event_us::double / 1e6::double as timestamp
    from judged where late""",
    "judged",
)
relation(
    "counted",
    """
    select *, not late and w = head_w as is_head,
           count(case when not late then 1 end) over wp as n, sum(case when not late then temp_cc end) over wp as s,
           min(case when not late then temp_cc end) over wp as mn, max(case when not late then temp_cc end) over wp as mxx
    from judged
    window wp as (partition by customer_id, truck_id, w order by arrival_seq
                  rows between unbounded preceding and current row)""",
    "judged",
)
relation(
    "stated",
    """
    select *,
      last_value(case when is_head then temperature end ignore nulls) over
        (partition by customer_id, truck_id order by arrival_seq rows between unbounded preceding and 1 preceding) as prev,
      last_value(case when is_head then {'n': n, 's': s, 'mn': mn, 'mxx': mxx, 'tg': target_cc} end ignore nulls) over
        (partition by customer_id, truck_id order by arrival_seq rows between unbounded preceding and current row) as h
    from counted""",
    "counted",
)
relation(
    "running",
    """
    select arrival_seq, late, customer_id, truck_id, case when late then head_w else w end as w,
           case when late then h.n else n end as n, (case when late then h.s else s end)::bigint as s,
           case when late then h.mn else mn end as mn, case when late then h.mxx else mxx end as mxx,
           case when late then h.tg else target_cc end as tg
    from stated""",
    "stated",
)
for _name in (
    "running_aggregates",
    "running_aggregates_split",
    "stream_running_aggregates",
    "stream_set_running_aggregates",
):
    oracle(_name, f"select {aggregate_columns('arrival_seq, late,')} from running", "running")
for _name in ("sliding_aggregates", "stream_sliding_aggregates"):
    oracle(
        _name,
        f"""select {aggregate_columns()} from (
          select customer_id, truck_id, w, count(*) as n, sum(temp_cc)::bigint as s, min(temp_cc) as mn, max(temp_cc) as mxx,
                 arg_max(target_cc, arrival_seq) as tg
          from (select * exclude (w), unnest(range(event_us - event_us % 10000000 - 290000000,
                                                   event_us - event_us % 10000000 + 1, 10000000)) as w from v)
          group by 1, 2, 3)""",
        "v",
    )

# --- alerts ------------------------------------------------------------------------------------------------------

relation(
    "alerts_raised",
    """
    select arrival_seq, customer_id, truck_id,
           case when kind = 'COMPRESSOR_FAILURE' then 'CRITICAL' else 'WARNING' end as severity, kind as alert_type,
           temperature as trigger_temperature, target_temperature, -10.0::double as threshold_limit, compressor_status,
           event_us::double / 1000000.0::double as timestamp,
           case kind when 'COMPRESSOR_FAILURE' then 'Truck reports a compressor fault: ' || truck_id
             when 'HIGH_TEMPERATURE' then 'Too warm on truck ' || truck_id || ': ' || temperature || ' is over -10.0'
             when 'LOW_TEMPERATURE' then 'Too cold on truck ' || truck_id || ': ' || temperature || ' is under -25.0'
             else 'Warming fast on truck ' || truck_id || ': ' || printf('%.2f', temperature - prev) || ' degrees, allowed are 3.0' end as message,
           false as acknowledged
    from (select *, case when compressor_status = 'FAULT' then 'COMPRESSOR_FAILURE'
                         when temperature > -10 then 'HIGH_TEMPERATURE' when temperature < -25 then 'LOW_TEMPERATURE'
                         when temperature - prev >= 3.0::double then 'RAPID_THERMAL_RISE' end as kind from stated)
    where kind is not null""",
    "stated",
)
for _name in ("anomaly_alerts", "anomaly_alerts_split", "stream_anomaly_alerts"):
    oracle(_name, "select * from alerts_raised", "alerts_raised")
oracle("alerts_by_type", "select severity, alert_type, count(*) as alerts from alerts_raised group by 1, 2", "alerts_raised")
relation(
    "runs",
    """
    select *, greatest(0, (event_us - started_us) // 1000000) as duration_seconds
    from (select *, first_value(case when temperature > -10 then event_us end ignore nulls) over
              (partition by customer_id, truck_id, resets order by arrival_seq
               rows between unbounded preceding and current row) as started_us
          from (select *, sum(case when temperature <= -10 then 1 else 0 end) over
                    (partition by customer_id, truck_id order by arrival_seq
                     rows between unbounded preceding and current row) as resets from v))
    where temperature > -10""",
    "v",
)
for _name in ("sustained_alerts", "sustained_alerts_split", "stream_sustained_alerts"):
    oracle(
        _name,
        """select arrival_seq, customer_id, truck_id, temperature, event_us::double / 1e6::double as timestamp,
        started_us::double / 1e6::double as started_at, duration_seconds from runs where duration_seconds >= 30""",
        "runs",
    )
oracle(
    "active_temperature_alerts",
    """select customer_id, truck_id, temperature, -10.0::double as threshold, 'TRIGGERED' as status,
    started_us::double / 1000000.0::double as started_at, duration_seconds
    from (select runs.*, max(v_last.last_seq) as last_seq from runs
          join (select customer_id, truck_id, max(arrival_seq) as last_seq from v group by 1, 2) v_last
          using (customer_id, truck_id) group by all)
    where arrival_seq = last_seq""",
    "runs",
)

# Trucks in three log partitions: partitions one after another in a batch, or in each of four micro-batches.
_turn = "(select event_id, event_id * 4 // (1 + max(event_id) over ()) as batch from events)"
for _prefix, _order in (("log", "arrival_seq % 3, arrival_seq"), ("turn", "batch, arrival_seq % 3, arrival_seq")):
    relation(
        f"{_prefix}_v",
        f"""select *, event_us - event_us % 300000000 as w
        from (select * replace (row_number() over (order by {_order}) - 1 as arrival_seq)
              from tel join {_turn} t on event_id = arrival_seq) where temp_cc <> 0""",
        "tel",
    )
    for _name in ("judged", "counted", "stated", "running"):
        _body, _needs = RELATIONS[_name]
        _body = re.sub(r"\bfrom (v|judged|counted|stated)\b", rf"from {_prefix}_\1", _body)
        relation(f"{_prefix}_{_name}", _body, *(f"{_prefix}_{n}" for n in _needs))
oracle("log_running_aggregates", f"select {aggregate_columns('arrival_seq, late,')} from log_running", "log_running")
oracle("stream_log_aggregates", f"select {aggregate_columns('late,')} from turn_running", "turn_running")

relation(
    "marks",
    f"""
    select c.batch, max(event_us) // 1000 - 30000 as mark_ms
    from (select event_us, batch from v join {_turn} t on event_id = arrival_seq) r
    join (select unnest(range(0, 5)) as batch) c on r.batch < c.batch group by 1""",
    "v",
)
# The shared watermark of a micro-batch comes from those before it, and a reading is late by the one before that. A reading
# is left out if its window was closed by then; windows come out once the watermark is past their end.
oracle(
    "stream_native_windows",
    f"""select customer_id, truck_id, w as window_us, count(*) as sample_count, sum(temp_cc * 10000)::bigint as sum_fixed
    from (select v.*, batch from v join {_turn} t on event_id = arrival_seq) r
    left join marks on marks.batch = r.batch - 1
    where (mark_ms is null or (w + 300000000) // 1000 > mark_ms) and (w + 300000000) // 1000 <= (select max(mark_ms) from marks)
    group by all""",
    "v",
    "marks",
)

# The clock of a micro-batch is the latest arrival of the micro-batches before it; the fifth one has no readings. A run
# that has not fired by the last reading of a micro-batch fires in the first one from then on whose clock is past its
# time, if no reading of the truck comes in between.
relation(
    "turns",
    f"""
    select v.*, batch, 1704067200000000 + (epoch_us(ts) - 1704067200000000) // 1000 as received_us, resets, started_us,
      max(case when duration_seconds >= 30 then 1 else 0 end) over (partition by v.customer_id, v.truck_id, resets
        order by v.arrival_seq rows between unbounded preceding and current row) as fired
    from v join {_turn} t on event_id = arrival_seq join events using (event_id)
    left join (select arrival_seq, resets, started_us, duration_seconds from runs) using (arrival_seq)""",
    "runs",
)
relation(
    "clocks",
    """
    select c.batch, max(received_us) // 1000 as clock_ms from turns join (select unnest(range(1, 5)) as batch) c
    on turns.batch < c.batch group by 1""",
    "turns",
)
relation(
    "silences",
    """
    select customer_id, truck_id, resets, temperature, started_us, min(clocks.batch) as fires_in
    from (select *, lead(batch) over (partition by customer_id, truck_id order by batch) as next_batch
          from (select * from turns qualify row_number() over (partition by customer_id, truck_id, batch order by arrival_seq desc) = 1))  l
    join clocks on clocks.batch >= l.batch and (next_batch is null or clocks.batch < next_batch)
      and clock_ms > (started_us + 999) // 1000 + 30000
    where started_us is not null and fired = 0 group by all""",
    "turns",
    "clocks",
)
oracle(
    "stream_silent_heat",
    """select arrival_seq, customer_id, truck_id, temperature, event_us::double / 1e6::double as timestamp,
    started_us::double / 1e6::double as started_at, duration_seconds from runs where duration_seconds >= 30
    union all
    select null, customer_id, truck_id, temperature, (started_us + 30000000)::double / 1e6::double, started_us::double / 1e6::double, 30
    from (select * from silences qualify row_number() over (partition by customer_id, truck_id, resets order by fires_in) = 1)""",
    "runs",
    "silences",
)

# --- contract ----------------------------------------------------------------------------------------------------

relation("damaged", "select *, arrival_seq % 97 as kind from tel", "tel")
relation("kept", "select * from damaged where kind not in (0, 1, 2, 3, 5, 7, 8, 9) and temp_cc <> 0", "damaged")
oracle(
    "parse_raw",
    """select arrival_seq, case when kind not in (0, 2, 5) then customer_id end as customer_id,
    case when kind not in (0, 1, 5) then truck_id end as truck_id,
    case when kind = 8 then 1e14::double when kind not in (0, 5, 9) then temperature end as temperature,
    (case when kind in (0, 1, 2, 3, 5, 7, 8, 9) then 1 else 0 end)::integer as problems from damaged""",
    "damaged",
)
oracle(
    "valid_telemetry",
    """select arrival_seq, customer_id || ':' || truck_id as partition_key, 'evt-' || arrival_seq as event_id,
    event_us::double / 1000000.0::double as timestamp, temperature from kept""",
    "kept",
)
oracle(
    "normalize",
    """select arrival_seq, 'evt-' || arrival_seq as event_id, event_us::double / 1000000.0::double as timestamp,
    customer_id, truck_id, 'route_default' as route_id, temperature, target_temperature,
    25.0::double as ambient_temperature, case when kind = 6 then 'RUNNING' else compressor_status end as compressor_status,
    false as door_open, 80.0::double as battery_level, 37.7749::double as latitude, -122.4194::double as longitude,
    65.0::double as speed_kmh from kept""",
    "kept",
)
relation(
    "letters",
    """
    select arrival_seq, customer_id || ':' || truck_id as original_key,
      case kind when 0 then 'not-json' when 5 then 'null' else
        '{"event_id":"evt-' || arrival_seq || '","timestamp":' || (event_us // 1000000) || case when kind = 7 then '' else '.' end
        || lpad((event_us % 1000000)::varchar, 6, '0')
        || ',"customer_id":"' || case when kind = 2 then '  ' else ' ' || customer_id end || '"'
        || case when kind = 1 then '' else ',"truck_id":"' || truck_id || '"' end
        || ',"temperature":' || case kind when 4 then '"' || temperature || '"' when 8 then '100000000000000.0' when 9 then '"true"'
             else temperature::varchar end
        || ',"target_temp":' || target_temperature
        || case when kind = 6 then '' else ',"compressor_status":"' || compressor_status || '"' end
        || ',"battery_level":' || case when kind = 3 then '120.0' else '80.0' end || '}' end as payload,
      case kind when 0 then 'ValidationError: payload is not a JSON object'
        when 1 then 'ValidationError: truck_id: required field is missing'
        when 2 then 'ValidationError: customer_id: not a valid id'
        when 3 then 'ValidationError: battery_level: above 100.0'
        when 5 then 'TypeError: payload is null'
        when 7 then 'ValidationError: timestamp: above 9999999999.0'
        when 8 then 'ValidationError: temperature: above 1000000.0'
        when 9 then 'ValidationError: temperature: not a valid number'
        else 'ValueError: temperature must be non-zero' end as error,
      'raw-telemetry' as source_topic
    from damaged where kind in (0, 1, 2, 3, 5, 7, 8, 9) or temp_cc = 0""",
    "damaged",
)
for _name in ("dead_letters", "stream_dead_letters"):
    oracle(_name, "select * from letters", "letters")
relation("wire_v", "select *, event_us - event_us % 300000000 as w from kept", "kept")
for _name in ("judged", "grouped", "counted", "stated", "running"):
    _body, _needs = RELATIONS[_name]
    _body = re.sub(r"\bfrom (v|judged|counted|stated)\b", r"from wire_\1", _body)
    relation(f"wire_{_name}", _body, *(f"wire_{n}" for n in _needs))
oracle("wire_window_aggregates", f"select {aggregate_columns()} from wire_grouped", "wire_grouped")
oracle(
    "stream_fan_out",
    """select 'aggregate' as kind, arrival_seq, n::bigint as sample_count, null::varchar as error from wire_running
    union all select 'dead letter', arrival_seq, null, error from letters""",
    "wire_running",
    "letters",
)
relation(
    "wire_alerts",
    """
    select customer_id, truck_id from wire_stated
    where kind <> 6 and compressor_status = 'FAULT' or temperature > -10 or temperature < -25 or temperature - prev >= 3.0::double""",
    "wire_stated",
)
oracle(
    "stream_messages",
    """select topic, key, count(*) as messages from (
      select 'processed-averages' as topic, customer_id || ':' || truck_id as key from wire_running
      union all select 'alerts-topic', customer_id || ':' || truck_id from wire_alerts
      union all select 'telemetry-dead-letter', original_key from letters) group by all""",
    "wire_running",
    "wire_alerts",
    "letters",
)
oracle(
    "stream_progress",
    f"""select batch as batch_id, count(*) as input_rows, count(*) as records,
    count(*) filter (kind in (0, 1, 2, 3, 5, 7, 8, 9) or temp_cc = 0) as rejected
    from damaged join {_turn} t on event_id = arrival_seq group by 1""",
    "damaged",
)
relation("placed", f"select * from counted join {_turn} t on event_id = arrival_seq", "counted")
oracle(
    "stream_state_at",
    """select customer_id, truck_id, top as max_event_us, w::double / 1e6::double as window_start, count(*) as sample_count,
    arg_max(temperature, arrival_seq) as last_temperature
    from (select *, max(event_us) over (partition by customer_id, truck_id) as top from placed where batch <= 1)
    where not late and w + 330000000 >= top - 30000000 group by all""",
    "placed",
)
oracle(
    "stream_state_changes",
    """select batch as batch_id, 'update' as change_type, customer_id, truck_id, max(mx) as max_event_us from placed
    where batch in (2, 3) group by all""",
    "placed",
)
oracle(
    "quality_gate",
    """select batch_id, records, rejected, rejected::double / records::double as error_rate,
    records >= 50 and rejected::double / records::double >= 0.083::double as tripped
    from (select arrival_seq // 1000 as batch_id, count(*) as records,
                 count(*) filter (kind in (0, 1, 2, 3, 5, 7, 8, 9) or temp_cc = 0) as rejected from damaged group by 1)""",
    "damaged",
)
oracle(
    "wire_encode",
    """select customer_id || ':' || truck_id as key,
    '{"arrival_seq":' || arrival_seq || ',"customer_id":"' || customer_id || '","truck_id":"' || truck_id
    || '","compressor_status":"' || compressor_status || '"}' as value from v""",
    "v",
)
oracle(
    "bounded_read",
    """select arrival_seq, case when kind <> 0 then 'evt-' || arrival_seq end as event_id,
    case when kind = 0 then 'not-json' end as raw_message
    from damaged where kind <> 5 order by arrival_seq limit 5""",
    "damaged",
)
oracle(
    "roundtrip_reconcile",
    """select (select count(*) from tel) as produced, (select count(*) from kept) as consumed,
    (select count(*) from tel) - (select count(*) from kept) as missing, 0::bigint as duplicated,
    (select count(*) from tel) = (select count(*) from kept) as complete""",
    "tel",
    "kept",
)
for _name in ("missing_events", "missing_events_by_checksum"):
    oracle(
        _name,
        "select 'evt-' || arrival_seq as event_id from tel where arrival_seq not in (select arrival_seq from kept)",
        "tel",
        "kept",
    )

# --- metrics -----------------------------------------------------------------------------------------------------

oracle("events_by_customer", "select customer_id, count(*) as events from tel group by 1", "tel")
relation("slots", "select event_us // 300000000 as slot, count(*) as n from v group by 1", "v")
oracle(
    "dashboard_metrics",
    f"""select 'active_trucks' as metric, count(distinct (customer_id, truck_id))::double as value from v
    union all select 'events_per_second', {ratio("arg_max(n, slot)", "300", 3)} from slots
    union all select 'uptime_percent', {ratio("count(*) * 100", "max(slot) - min(slot) + 1", 1)} from slots
    union all select 'temperature_alerts', count(*)::double from (
      select arg_max(temperature, arrival_seq) as t from v group by customer_id, truck_id) where t > -10""",
    "v",
    "slots",
)

# --- lag ---------------------------------------------------------------------------------------------------------

TOPIC = "case when user_id // 6 % 2 = 0 then 'raw-telemetry' else 'audit-telemetry' end"
relation(
    "committed",
    f"""
    select 'telemetry-worker' as consumer_group, {TOPIC} as topic, (user_id % 6)::integer as partition, count(*) as committed
    from events where event_id % 10 < 9 - user_id % 6 and user_id % 6 < 5 group by all
    union all
    select 'audit-reader', {TOPIC}, (user_id % 6)::integer, count(*) from events where event_id % 2 = 0 group by all""",
)
relation(
    "lagging",
    f"""
    select consumer_group, topic, partition, coalesce(committed, 0) as current_offset, latest as latest_offset,
           greatest(latest - coalesce(committed, 0), 0) as lag,
           (case when partition <> 4 then partition % 3 + 1 end)::integer as broker,
           greatest(latest - coalesce(committed, 0), 0) > 1000 as warning
    from (select distinct consumer_group, topic from committed)
    join (select {TOPIC} as topic, (user_id % 6)::integer as partition, count(*) as latest from events group by all)
      using (topic)
    left join committed using (consumer_group, topic, partition)""",
    "committed",
)
oracle("lag_report", "select * from lagging", "lagging")
oracle(
    "group_overview",
    f"""select consumer_group, coalesce(state, 'unknown') as state, coalesce(members, 0) as members,
    coalesce(assigned, 0)::bigint as assigned_partitions, coalesce(partitions, 0) as partitions, coalesce(total, 0)::bigint as total_lag,
    coalesce(worst, 0)::bigint as max_partition_lag, coalesce(average, 0) as average_partition_lag,
    case when coalesce(worst, 0) < 1000 then 'healthy' else 'degraded' end as partition_status
    from (select unnest(['telemetry-worker', 'audit-reader', 'idle-reader']) as consumer_group,
                 unnest(['STABLE', null, 'EMPTY']) as state)
    left join (select consumer_group, count(*) as partitions, sum(lag) as total, max(lag) as worst,
                      {ratio("sum(lag)", "count(*)", 1)} as average from lagging group by 1) using (consumer_group)
    left join (select 'telemetry-worker' as consumer_group, count(*) as members, sum(member) as assigned
               from (select distinct user_id % 5 as member from events)) using (consumer_group)""",
    "lagging",
)
oracle(
    "lag_summary",
    f"""select consumer_group, count(*) as partitions, sum(lag)::bigint as total_lag, max(lag) as max_partition_lag,
    {ratio("sum(lag)", "count(*)", 1)} as average_partition_lag,
    case when max(lag) < 1000 then 'healthy' else 'degraded' end as partition_status,
    case when sum(lag) > 1000 then 'degraded' else 'healthy' end as total_status
    from lagging group by 1""",
    "lagging",
)
oracle(
    "worker_lag",
    """select consumer_group, (sum(lag) filter (partition <= 2))::bigint as worker1_lag,
    (sum(lag) filter (partition > 2))::bigint as worker2_lag from lagging group by 1""",
    "lagging",
)
oracle(
    "group_assignments",
    """select 'group-' || (s_nationkey % 4) as consumer_group, count(*) as members,
    sum(case when s_suppkey % 3 <> 0 then s_suppkey % 5 + 1 else 0 end)::bigint as assigned_partitions
    from supplier group by 1""",
)
oracle(
    "group_union",
    """select consumer_group from committed union select unnest(['telemetry-worker', 'replay-worker'])""",
    "committed",
)

# --- throughput tests --------------------------------------------------------------------------------------------

relation(
    "samples",
    f"""
    select user_id % 20 as run_id, 'node-' || (user_id % 8) as node_id, (epoch_us(ts) - {BASE}) // 86400000000 as seq,
           round(value * 1000000)::bigint as value_f, value, event_type = 'error' as failed,
           {BASE} + (epoch_us(ts) - {BASE}) // 1000 as event_us
    from events""",
)


def percentiles(by: str, percents: tuple[int, ...]) -> str:
    cols = []
    for p in percents:
        low = f"max(case when rk = ((n - 1) * {p}) // 100 then value_f end)"
        high = f"max(case when rk = ((n - 1) * {p} + 99) // 100 then value_f end)"
        cols.append(f"{rounded(f'({low}) * 100 + (({high}) - ({low})) * (((max(n) - 1) * {p}) % 100)', '100000', 3)} as p{p}")
    return f"""select {by}, max(n) as samples, {", ".join(cols)}
    from (select *, row_number() over (partition by {by} order by value_f) - 1 as rk,
                 count(*) over (partition by {by}) as n from samples)
    group by {by}"""


def summary(by: str) -> str:
    elapsed = "greatest(max(event_us) - min(event_us), 1000)"
    return f"""select {by}, processed, error_count, duration_seconds, actual_rate, average_latency_ms,
      p95 as p95_latency_ms, p99 as p99_latency_ms, failure_rate, started_us, completed_us, 'COMPLETED' as status
    from (select {by}, count(*) filter (not failed) as processed, count(*) filter (failed) as error_count,
            {ratio(elapsed, "1000000", 3)} as duration_seconds,
            {ratio("count(*) filter (not failed) * 1000000", elapsed, 2)} as actual_rate,
            {rounded("sum(value_f)", "count(*) * 1000", 3)} as average_latency_ms,
            {ratio("count(*) filter (failed)", "count(*)", 6)} as failure_rate,
            min(event_us) as started_us, max(event_us) as completed_us from samples group by {by})
    join ({percentiles(by, (95, 99))}) using ({by})"""


for _name in ("latency_percentiles", "latency_percentiles_split"):
    oracle(_name, percentiles("run_id", (50, 95, 99)), "samples")
oracle("throughput_summary", summary("run_id"), "samples")
oracle(
    "latency_histogram",
    """select le, case when le = '+Inf' then (select count(*) from samples)
      else (select count(*) from samples where value / 1000.0::double <= le::double) end as samples
    from (select unnest(['0.001', '0.005', '0.01', '0.05', '0.1', '0.5', '1.0', '5.0', '+Inf']) as le)""",
    "samples",
)
relation(
    "timed",
    """
    select * replace (case when not failed and run_id <> 19 then value_f end as value_f,
                      case when not failed and run_id <> 19 then value end as value) from samples""",
    "samples",
)
oracle(
    "timed_out_histogram",
    """select le, case when le = '+Inf' then (select count(value) from timed)
      else (select count(*) from timed where value / 1000.0::double <= le::double) end as samples
    from (select unnest(['0.001', '0.005', '0.01', '0.05', '0.1', '0.5', '1.0', '5.0', '+Inf']) as le)""",
    "timed",
)
_body = summary("run_id").replace("from samples group by", "from timed group by").replace("join (select", "left join (select")
_body = _body.replace("as n from samples)", "as n from timed where value_f is not null)")
_body = _body.replace(rounded("sum(value_f)", "count(*) * 1000", 3), f"coalesce({rounded('sum(value_f)', 'count(value_f) * 1000', 3)}, 0)")
oracle(
    "timed_out_summary",
    _body.replace("p95 as p95", "coalesce(p95, 0) as p95").replace("p99 as p99_l", "coalesce(p99, 0) as p99_l"),
    "timed",
)
oracle(
    "sketched_latencies",
    """select run_id, count(*) as samples, count(*) as timed, true as p50_is_near, true as p95_is_near, true as p99_is_near
    from samples group by 1""",
    "samples",
)
oracle(
    "delivery_stats",
    f"""select topic, slot * 5 as window_start, published, delivered, published - delivered as errors,
    {ratio("delivered * 100", "published", 2)} as delivery_percent, {ratio("sent", "5", 1)} as current_rate,
    {ratio("published", "(slot - first_slot + 1) * 5", 1)} as overall_rate
    from (select topic, slot, sent, min(slot) over (partition by topic) as first_slot,
                 (sum(sent) over (partition by topic order by slot))::bigint as published,
                 (sum(ok) over (partition by topic order by slot))::bigint as delivered
          from (select {TOPIC} as topic, event_us // 5000000 as slot, count(*) as sent, count(*) filter (event_type <> 'error') as ok
                from tel join events on event_id = arrival_seq group by all))""",
    "tel",
)
oracle(
    "throughput_overview",
    f"""select {ratio("arg_max(n, slot)", "300", 3)} as current, {ratio("sum(n)", "count(*) * 300", 3)} as average,
    {ratio("max(n)", "300", 3)} as peak
    from (select event_us // 300000000 as slot, count(*) as n from tel group by 1)""",
    "tel",
)
relation(
    "tests",
    f"""
    select *, 'test-' || node_id || '-' || seq as id,
      (processed + error_count)::double / 86.4::double * (0.9::double + (seq % 7)::double * 0.1::double) as target_rate
    from ({summary("node_id, seq")})""",
    "samples",
)
oracle(
    "recent_tests",
    """select id, node_id, seq, actual_rate, p95_latency_ms, p99_latency_ms, failure_rate, status from tests
    order by started_us desc, id limit 20""",
    "tests",
)
relation(
    "violations",
    """
    select *, (p95_latency_ms > 165)::int + (failure_rate > 0.25::double)::int + (actual_rate < target_rate * 0.7::double)::int as broken,
      case when p95_latency_ms > 165 then 'LATENCY_SPIKE' when failure_rate > 0.25::double then 'ERROR_RATE_SPIKE'
           when actual_rate < target_rate * 0.7::double then 'THROUGHPUT_DROP' end as alert_type from tests""",
    "tests",
)
relation(
    "numbered",
    """
    select *, row_number() over (partition by node_id, epoch, alert_type order by seq) as nth,
      first_value(case when alert_type is null then completed_us end ignore nulls) over
        (partition by node_id order by seq rows between 1 following and unbounded following) as resolved_us
    from (select *, count(*) filter (alert_type is null) over (partition by node_id order by seq) as epoch
          from violations)""",
    "violations",
)
oracle(
    "throughput_test_rows",
    """select id, target_rate, duration_seconds, actual_rate, actual_rate as peak_rate, average_latency_ms, p95_latency_ms,
    p99_latency_ms, error_count, failure_rate, strftime(make_timestamp(started_us), '%Y-%m-%dT%H:%M:%S.%fZ') as started_at,
    strftime(make_timestamp(completed_us), '%Y-%m-%dT%H:%M:%S.%fZ') as completed_at, status,
    case when nth = 2 and alert_type is not null then node_id end as bottleneck_node from numbered""",
    "numbered",
)
oracle(
    "test_durations",
    "select id, started_us, (completed_us - started_us) // 1000000 as seconds from tests",
    "tests",
)
_four = rounded("round(x * 1000000)::bigint", "100", 4)
for _name in ("bottleneck_alerts", "bottleneck_alerts_split"):
    oracle(
        _name,
        f"""select node_id || ':' || alert_type || ':' || seq as id, alert_type,
        case when broken > 1 then 'CRITICAL' else 'HIGH' end as severity, node_id, lower(alert_type) as metric,
        {_four.replace("(x ", "(cur ")} as current_value, {_four.replace("(x ", "(lim ")} as threshold,
        case when resolved_us is null then 'TRIGGERED' else 'RESOLVED' end as status,
        case alert_type when 'LATENCY_SPIKE' then 'Latency Spike' when 'ERROR_RATE_SPIKE' then 'Error Rate Spike'
          else 'Throughput Drop' end || ' detected during throughput test.' as description,
        completed_us as triggered_us, resolved_us
        from (select *,
                case alert_type when 'LATENCY_SPIKE' then p95_latency_ms when 'ERROR_RATE_SPIKE' then failure_rate
                  else actual_rate end as cur,
                case alert_type when 'LATENCY_SPIKE' then 165.0::double when 'ERROR_RATE_SPIKE' then 0.25::double
                  else target_rate * 0.7::double end as lim from numbered)
        where alert_type is not null and nth = 2""",
        "numbered",
    )
relation(
    "acts",
    f"""
    select *, row_number() over (partition by node_id, kind order by at_us, by_hand, seq) as i from (
      select node_id, kind, completed_us as at_us, 0 as by_hand, seq, broken, cur, lim,
        case when alert_type is null then 'CLEAN' else 'VIOLATION' end as step
      from (select *,
              case alert_type when 'LATENCY_SPIKE' then p95_latency_ms when 'ERROR_RATE_SPIKE' then failure_rate
                else actual_rate end as cur,
              case alert_type when 'LATENCY_SPIKE' then 165.0::double when 'ERROR_RATE_SPIKE' then 0.25::double
                else target_rate * 0.7::double end as lim from violations) v
      join (select unnest(['LATENCY_SPIKE', 'ERROR_RATE_SPIKE', 'THROUGHPUT_DROP']) as kind) k
        on alert_type is null or alert_type = kind
      union all
      select 'node-' || (user_id % 8), ['LATENCY_SPIKE', 'ERROR_RATE_SPIKE', 'THROUGHPUT_DROP'][event_id % 3 + 1],
        {BASE} + (epoch_us(ts) - {BASE}) // 1000, 1, event_id, null, null, null,
        case when event_id % 7 < 3 then 'RESOLVED' else 'ACKNOWLEDGED' end
      from events where event_id % 20 = 7)""",
    "violations",
)
relation(
    "walk",
    """
    select node_id, kind, 0::bigint as i, 0 as state, 0 as was, 0 as alert_no from acts group by node_id, kind
    union all
    select a.node_id, a.kind, a.i, case a.step when 'CLEAN' then 0 when 'VIOLATION' then least(state + 1, 2)
        when 'RESOLVED' then state % 2 else state end, state,
      alert_no + case when a.step = 'VIOLATION' and state = 1 then 1 else 0 end
    from walk w join acts a on a.node_id = w.node_id and a.kind = w.kind and a.i = w.i + 1""",
    "acts",
)
oracle(
    "bottleneck_lifecycle",
    f"""select node_id || ':' || kind || ':' || seq as id, kind as alert_type,
    case when broken > 1 then 'CRITICAL' else 'HIGH' end as severity, node_id, lower(kind) as metric,
    {_four.replace("(x ", "(cur ")} as current_value, {_four.replace("(x ", "(lim ")} as threshold,
    case when closed.at_us is not null then 'RESOLVED' when acknowledged_us is not null then 'ACKNOWLEDGED' else 'TRIGGERED' end as status,
    case kind when 'LATENCY_SPIKE' then 'Latency Spike' when 'ERROR_RATE_SPIKE' then 'Error Rate Spike'
      else 'Throughput Drop' end || ' detected during throughput test.' as description,
    raised.at_us as triggered_us, acknowledged_us, closed.at_us as resolved_us, closed.resolved_by
    from (select a.*, alert_no from acts a join walk using (node_id, kind, i) where was = 1 and state = 2) raised
    left join (select node_id, kind, alert_no, at_us, case step when 'CLEAN' then 'RULE' else 'OPERATOR' end as resolved_by
               from acts join walk using (node_id, kind, i) where was = 2 and state = 0) closed using (node_id, kind, alert_no)
    left join (select node_id, kind, alert_no, arg_max(at_us, i) as acknowledged_us
               from acts join walk using (node_id, kind, i) where was = 2 and step = 'ACKNOWLEDGED' group by all) seen using (node_id, kind, alert_no)""",
    "walk",
    recursive=True,
)
relation(
    "moves",
    """
    select * from (select 'alert-' || l_orderkey as id,
        l_linenumber * 1000000000000 + l_partkey * 10000 + l_suppkey as seq,
        case when l_returnflag = 'R' then 'RESOLVED' else 'ACKNOWLEDGED' end as status, epoch_us(l_shipdate) as at_us
      from lineitem) where seq % 3 <> 0""",
)
relation(
    "lifecycle",
    """
    select a.*, acknowledged_us, resolved_us,
      case when resolved_us is not null then 'RESOLVED' when acknowledged_us is not null then 'ACKNOWLEDGED'
           else 'TRIGGERED' end as status
    from (select 'alert-' || o_orderkey as id,
            ['LATENCY_SPIKE', 'ERROR_RATE_SPIKE', 'THROUGHPUT_DROP'][o_orderkey % 3 + 1] as alert_type,
            case when o_orderpriority = '1-URGENT' then 'CRITICAL' else 'HIGH' end as severity,
            'node-' || (o_custkey % 10) as node_id,
            lower(['LATENCY_SPIKE', 'ERROR_RATE_SPIKE', 'THROUGHPUT_DROP'][o_orderkey % 3 + 1]) as metric,
            o_totalprice as current_value, 100000.0::double as threshold,
            epoch_us(o_orderdate) + (o_orderkey % 86400) * 1000000 as triggered_us from orders) a
    left join (select id, arg_min(at_us, seq) as resolved_us from moves where status = 'RESOLVED' group by 1) r using (id)
    left join (select id, arg_max(at_us, seq) as acknowledged_us
               from (select *, min(case when status = 'RESOLVED' then seq end) over (partition by id) as stop from moves)
               where status = 'ACKNOWLEDGED' and (stop is null or seq < stop) group by 1) k using (id)""",
    "moves",
)
oracle("alert_state", "select * from lifecycle", "lifecycle")
oracle("alert_history", "select * from lifecycle order by triggered_us desc, id limit 50", "lifecycle")
oracle(
    "active_alerts",
    "select * from lifecycle where status <> 'RESOLVED' order by triggered_us desc, id limit 50",
    "lifecycle",
)
_day = "between 962409600000000 and 962495999999999"
oracle(
    "failure_counters",
    f"""select count(*) filter (status <> 'RESOLVED') as active, count(*) filter (triggered_us {_day}) as today,
    count(*) filter (resolved_us {_day}) as resolved_today,
    count(*) filter (status <> 'RESOLVED' and severity = 'CRITICAL') as critical from lifecycle""",
    "lifecycle",
)
oracle(
    "node_status",
    """select t.node_id, case when severity is null then 'HEALTHY' else 'BOTTLENECK' end as status,
    coalesce(severity, 'INFO') as severity, actual_rate as throughput, average_latency_ms as latency,
    p95_latency_ms as p95_latency, failure_rate as error_rate, completed_us as measured_us
    from (select * from tests qualify row_number() over (partition by node_id order by seq desc) = 1) t
    left join (select node_id, severity from lifecycle where status <> 'RESOLVED'
               qualify row_number() over (partition by node_id order by triggered_us desc, id desc) = 1) a using (node_id)""",
    "tests",
    "lifecycle",
)
oracle(
    "export_tests",
    """select '"' || id || '","' || target_rate || '","' || actual_rate || '","' || p95_latency_ms || '","' || p99_latency_ms || '","'
    || failure_rate || '","' || status || '","' || strftime(make_timestamp(completed_us), '%Y-%m-%dT%H:%M:%S.%fZ') || '"' as line
    from tests""",
    "tests",
)
oracle(
    "export_alerts",
    """select '"' || id || '","' || alert_type || '","' || severity || '","' || node_id || '","' || status || '","'
    || triggered_us || '"' as line from lifecycle""",
    "lifecycle",
)

# --- fleet and routes --------------------------------------------------------------------------------------------

relation(
    "trips_t",
    """
    select o_orderkey as trip_id, o_custkey as truck_id, c_nationkey as owner_id,
      o_orderkey % (select count(*) from supplier) as driver_id, 'Depot ' || (o_custkey % 12) as origin,
      'Dock ' || (o_orderkey % 40) as destination, (20 + o_orderkey % 600)::double as distance_km,
      case o_orderstatus when 'F' then 'completed' when 'O' then 'in_transit' else 'scheduled' end as trip_status,
      case when o_orderstatus <> 'P' then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') end as actual_start_time,
      o_totalprice as revenue, c_mktsegment
    from orders join customer on o_custkey = c_custkey""",
)
relation(
    "fact",
    """
    select trip_id, 'FL-' || truck_id as plate_number,
      upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' ' || (100 + truck_id % 9) as vehicle,
      n_name || ' Logistics' as owner, 'Driver ' || s_suppkey as driver,
      case when s_suppkey % 5 = 0 then 'Off duty' else 'On duty' end as driver_status,
      origin, destination, trip_status, distance_km, revenue, actual_start_time
    from trips_t join nation on owner_id = n_nationkey join supplier on driver_id = s_suppkey""",
    "trips_t",
)
oracle("trip_fact", "select * from fact", "fact")
for _name in ("plate_history", "plate_trips"):
    oracle(
        _name,
        """select plate_number as plate, vehicle, owner, driver, driver_status, max(actual_start_time) over () as last_seen,
        trip_id, substr(actual_start_time, 1, 10) as date, origin || ' - ' || destination as route,
        case trip_status when 'completed' then 'Completed' when 'in_transit' then 'In Transit' else 'Scheduled' end as status,
        distance_km::bigint || ' km' as distance from fact where plate_number = 'FL-71'""",
        "fact",
    )
oracle(
    "first_trip",
    "select trip_id, origin, destination, trip_status from trips_t order by trip_id limit 1",
    "trips_t",
)
oracle(
    "table_counts",
    """select 'owners' as table_name, count(*) as records from nation union all select 'trucks', count(*) from customer
    union all select 'drivers', count(*) from supplier union all select 'trips', count(*) from trips_t""",
    "trips_t",
)
relation(
    "vehicles",
    """
    select user_id as u, 'truck-' || user_id as id, case when user_id % 2 = 0 then '2024-03-05' else '2024-03-04' end as telemetry_date,
      ['Coastal Loop', 'Ridge Shuttle', 'Valley Relay'][user_id % 3 + 1] as route_name,
      ['Chilled', 'Deep Frozen', 'Fresh'][user_id % 3 + 1] as truck_type, 'Truck ' || user_id as name,
      (40 + user_id % 30)::integer as speed, case when user_id % 3 = 0 then 'delayed' else 'moving' end as status,
      40.70::double + (user_id % 70)::double / 1000.0::double as lat,
      -74.03::double + (user_id % 110)::double / 1000.0::double as lng, user_id % 4 + 3 as points
    from (select distinct user_id from events)""",
)
relation(
    "vehicle_points",
    """
    select u, id, points, i as point, 40.70::double + ((u + i * 7) % 70)::double / 1000.0::double as lat,
      -74.03::double + ((u * 3 + i * 11) % 110)::double / 1000.0::double as lng
    from (select *, unnest(range(points)) as i from vehicles)""",
    "vehicles",
)


def haversine(rel: str, key: str, order: str) -> str:
    a = """(pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lng - lng0) / 2), 2))"""
    return f"""select {key}, count(*) as points, round(coalesce(sum(6371.0::double * 2 * atan2(sqrt({a}), sqrt(1 - {a}))), 0), 2) as distance_km
    from (select *, lag(lat) over (partition by {key} order by {order}) as lat0,
                 lag(lng) over (partition by {key} order by {order}) as lng0 from {rel}) group by {key}"""


relation(
    "trips_v",
    f"""
    select 'trip-' || id as trip_id, id as vehicle_id, name as vehicle,
      case when status = 'moving' then 'IN_PROGRESS' else 'PAUSED' end as status, v.points, lat, lng, speed as speed_kmh,
      distance_km, route_name from vehicles v join ({haversine("vehicle_points", "id", "point")}) d using (id)""",
    "vehicles",
    "vehicle_points",
)
oracle("trips", "select * from trips_v", "trips_v")
oracle("trip_detail", "select * from trips_v where trip_id = 'trip-truck-7'", "trips_v")
oracle("first_trips", "select * from trips_v order by trip_id limit 4", "trips_v")
oracle(
    "route_filter",
    """select id, telemetry_date, route_name, truck_type, speed from vehicles
    where telemetry_date = '2024-03-05' and route_name = 'Coastal Loop' and truck_type = 'Chilled'""",
    "vehicles",
)
oracle(
    "fleet_search",
    """select id, name, status, speed from vehicles
    where status = 'moving' and contains(lower(name || ' ' || id), 'truck 1')""",
    "vehicles",
)
oracle(
    "route_points",
    f"""select id, point::integer as point, lat, lng, {AS_OF} - (points - point - 1) * 60.0::double as timestamp
    from vehicle_points""",
    "vehicle_points",
)
relation(
    "summaries",
    """
    select id, name, status, speed,
      least(greatest(60 + points * 8 + case when status = 'delayed' then -10 else 8 end, 52), 98)::bigint as completion,
      (180 + speed * 4 + case when status = 'delayed' then 170 else 80 end + 5) // 10 / 10.0::double as thermal_variance,
      floor(greatest(32 - speed::double / 2 + case when status = 'delayed' then 12 else 0 end, 8) + 0.5)::bigint as eta_minutes,
      (case when status = 'delayed' then 2 else 0 end)::bigint as alerts from vehicles""",
    "vehicles",
)
oracle("route_summary", "select * from summaries", "summaries")
oracle("fleet_sorted", "select id, name, eta_minutes from summaries", "summaries")
oracle(
    "fleet_positions",
    """select id, row_number() over (order by name, id) as name_position, row_number() over (order by speed desc, id) as speed_position,
    row_number() over (order by eta_minutes, id) as eta_position,
    row_number() over (order by thermal_variance desc, id) as thermal_position from summaries""",
    "summaries",
)
oracle(
    "fleet_kpis",
    """select count(*) as total_trucks, count(*) filter (status = 'moving') as moving,
    count(*) filter (status = 'delayed') as delayed, floor(sum(speed)::double / count(*) + 0.5)::bigint as average_speed,
    floor(count(*) filter (status <> 'delayed') * 100::double / count(*) + 0.5)::bigint as on_time_percent,
    max(thermal_variance) as max_thermal_variance, count(*) filter (alerts > 0) as trucks_with_alerts from summaries""",
    "summaries",
)
relation(
    "points",
    """
    select user_id as vehicle_id, event_id as seq, 40.70::double + ((event_id * 7) % 70)::double / 1000.0::double as lat,
      -74.03::double + (event_id % 110)::double / 1000.0::double as lng from events""",
)
for _name in ("route_distance", "route_distance_split"):
    oracle(_name, haversine("points", "vehicle_id", "seq"), "points")
