"""The same questions in DuckDB SQL over the driver's tables, written on their own."""

from __future__ import annotations

ALPHA = 0.2
SENSORS = ["vibration_rms", "temperature_motor", "current_phase_avg", "pressure_level", "rpm", "ambient_temp"]
SERIES = "entity_group, entity, sensor"
HISTORY = (
    "entity, entity_group, ts, operating_mode, hours_since_maintenance, failure_type, sensor, value"
)


def r(expression: str, name: str | None = None) -> str:
    """Rounding that both engines agree on, see checks.queries.SHIFT."""
    return f"round({expression} + 3.3e-8, 6) as {name or expression.split('.')[-1]}"


ROUND_LIMITS = ", ".join(r(c) for c in ("ucl", "centerline", "lcl"))

RAW_LOG = """
e as (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events),
f as (select *, (event_type = 'error' and k % 4 = 0) as maint from e),
g as (select *,
    coalesce(max(case when maint then ts end) over (partition by user_id order by ts, event_id
                 rows between unbounded preceding and current row),
             min(ts) over (partition by user_id)) as base_ts,
    min(case when maint then ts end) over (partition by user_id order by ts, event_id
                 rows between 1 following and unbounded following) as next_ts,
    lead(maint) over (partition by user_id order by ts, event_id) as next_maint
  from f),
raw_log as materialized (
select ts as timestamp, user_id as machine_id,
  case user_id % 4 when 0 then 'CNC' when 1 then 'Pump' when 2 then 'Compressor' else 'Robotic Arm' end as machine_type,
  case when k % 10 < 7 then 'normal' when k % 10 < 9 then 'peak' else 'idle' end as operating_mode,
  date_diff('microsecond', base_ts, ts) / cast(3600000000 as double) as hours_since_maintenance,
  case when date_diff('microsecond', ts, next_ts) <= 86400000000 then 1 else 0 end as failure_within_24h,
  date_diff('microsecond', ts, next_ts) / cast(3600000000 as double) as rul_hours,
  case when next_maint then concat('F', cast(k % 3 as varchar)) else 'none' end as failure_type,
  value as vibration_rms,
  cast(40 + k as double) as temperature_motor,
  case when k % 7 = 0 then null else value / (1 + k) end as current_phase_avg,
  cast(2 * k as double) - value * cast(0.1 as double) as pressure_level,
  cast(1000 + 10 * k as double) as rpm,
  cast(20 + event_id % 10 as double) as ambient_temp
from g),
wide as (
select *,
  g2 as entity_group,
  g2 || case when length(cast(machine_id as varchar)) < 2 then '0' else '' end || cast(machine_id as varchar) as entity
from (select *, case machine_type when 'Pump' then 'PMP' when 'Compressor' then 'CPR'
                when 'Robotic Arm' then 'ARM' else machine_type end as g2 from raw_log))
"""

LONG = (
    RAW_LOG
    + ",\nlong as materialized (\n"
    + "\nunion all\n".join(
        "select timestamp as ts, entity, entity_group, operating_mode, hours_since_maintenance, "
        f"failure_within_24h, rul_hours, failure_type, '{s}' as sensor, {s} as value from wide where {s} is not null"
        for s in SENSORS
    )
    + ")"
)

LIMITS = (
    LONG
    + """,
limits as materialized (
select entity_group, sensor, m as mean, s as std, m + 3 * s as ucl, m as centerline, m - 3 * s as lcl
from (select entity_group, sensor, avg(value) as m, stddev_samp(value) as s
      from long where operating_mode = 'normal' group by 1, 2))"""
)

HIST = (
    LIMITS
    + f""",
hist as materialized (
select {HISTORY}, ucl, centerline, lcl
from (select * from long where operating_mode = 'normal' and ts is not null) left join limits using (entity_group, sensor))"""
)


def events_cte(name: str = "pm", where: str = "true") -> str:
    return f""",
{name}_ticks as (select distinct entity_group, entity, ts, hours_since_maintenance as hours_pre_pm, failure_type
          from long where operating_mode = 'normal' and {where}),
{name} as (select entity_group, entity, ts, hours_pre_pm, failure_type from (
       select *, lead(hours_pre_pm) over (partition by entity_group, entity order by ts) as following from {name}_ticks)
       where hours_pre_pm > following)"""


def event_history_cte(pm: str = "pm", name: str = "pm_hist") -> str:
    return f""",
{name} as (select pm.*, d.operating_mode, d.sensor, d.value, l.ucl, l.centerline, l.lcl
  from {pm} pm join long d on d.entity_group = pm.entity_group and d.entity = pm.entity and d.ts = pm.ts
                       and d.operating_mode = 'normal'
  left join limits l on l.entity_group = d.entity_group and l.sensor = d.sensor)"""


def event_summary(history: str = "pm_hist") -> str:
    return f"""select entity, ts, min(hours_pre_pm) as hours_pre_pm, min(failure_type) as failure_type,
  coalesce(string_agg(sensor, ', ' order by sensor)
           filter (where ucl is not null and lcl is not null and (value > ucl or value < lcl)), '') as ooc_sensors
from {history} group by entity_group, entity, ts"""


def ewma_cte(source: str, alpha: float | str, name: str = "ew", by: str = SERIES, reset: bool = True) -> str:
    """Folds the readings so far of a block, for every row; `alpha` is a number or a column."""
    alpha, rest = (alpha, f"(1 - {alpha})") if isinstance(alpha, str) else (repr(alpha), repr(1.0 - alpha))
    flag = "case when hours_since_maintenance = 0 then 1 else 0 end" if reset else "0"
    return f""",
{name}_blocks as (select *, sum({flag}) over (partition by {by} order by ts, hours_since_maintenance, value
                  rows unbounded preceding) as block from {source}),
{name} as materialized (select * exclude (xs, block), list_reduce(xs, lambda y, x: {rest} * y + {alpha} * x) as ewma from (
       select *, list(value) over (partition by {by}, block order by ts, hours_since_maintenance, value
                  rows unbounded preceding) as xs from {name}_blocks))"""


def flag(measure: str = "value") -> str:
    return f"not (({measure} <= ucl or ucl is null) and ({measure} >= lcl or lcl is null))"


def ooc_table(source: str, leading: str = "") -> str:
    return f"""select {leading} entity_group, sensor, entity, count(*) as total_points,
  cast(sum(case when {flag()} then 1 else 0 end) as bigint) as ooc_points,
  {r("100 * (cast(sum(case when " + flag() + " then 1 else 0 end) as double) / count(*))", "percent_ooc")}
from {source} group by all"""


def health_cte(source: str, alpha: float = ALPHA, days: int = 2, hours: int = 24) -> str:
    rest = 1.0 - alpha
    return f""",
aged as (select *, max(ts) over (partition by {SERIES}) as last_ts,
         case when (ucl - centerline) / 3.0 > 0 then (ucl - centerline) / 3.0 end as sigma,
         coalesce(ucl is not null and lcl is not null and (value > ucl or value < lcl), false) as ooc from {source}),
sums as (select {SERIES},
   arg_max(value, (ts, value)) as latest_value, arg_max(centerline, (ts, value)) as centerline, arg_max(sigma, (ts, value)) as std,
   list_reduce(list(value order by ts, value), lambda y, x: {rest!r} * y + {alpha!r} * x) as latest_ewma,
   avg(case when ooc then 1.0::double else 0.0::double end) filter (where ts >= last_ts - interval {days} day) as ooc_rate,
   list(value order by ts, value) filter (where ts >= last_ts - interval {hours} hour) as xs,
   date_diff('microsecond', min(ts) filter (where ts >= last_ts - interval {hours} hour), max(ts)) / 86400000000.0::double as dt
   from aged group by {SERIES}),
scored as (select *, case when centerline is not null and std is not null then (latest_ewma - centerline) / std end as z,
   case when centerline is not null and std is not null and len(xs) >= 2 and dt > 0
        then (list_reduce(xs, lambda y, x: {rest!r} * y + {alpha!r} * x) - xs[1]) / std / dt end as slope from sums),
labelled as (select *, case
   when abs(z) > 3 then 'ooc'
   when slope >= 1.0 then 'drifting_up'
   when slope <= -1.0 then 'drifting_down'
   when ooc_rate >= 0.05 then 'volatile'
   when abs(slope) <= 0.8 and (z is null or abs(z) <= 1) then 'stable_baseline'
   when abs(z) > 1 then 'trending_baseline'
   else 'stable_baseline' end as baseline_trend from scored),
health as (select *, case baseline_trend when 'ooc' then 'ooc' when 'stable_baseline' then 'stable'
   else 'attention' end as health_status from labelled)"""


def health_columns(days: int, hours: int) -> str:
    return ", ".join(
        [
            SERIES,
            "latest_value",
            *[r(c) for c in ("latest_ewma", "centerline", "std")],
            r("z", "latest_z_score"),
            r("ooc_rate", f"ooc_rate_{days}d"),
            r("slope", f"ewma_slope_z_per_day_{hours}h"),
            "baseline_trend",
            "health_status",
        ]
    )


def box_cte(source: str, y: str = "value") -> str:
    return f""",
quart as (select entity_group, sensor, entity, quantile_cont({y}, 0.25) as q1, quantile_cont({y}, 0.5) as median,
   quantile_cont({y}, 0.75) as q3 from {source} group by all),
fenced as (select s.*, {y} as y, q1, median, q3, q1 - 1.5 * (q3 - q1) as low, q3 + 1.5 * (q3 - q1) as high
   from {source} s join quart using (entity_group, sensor, entity))"""


BOX = f"""select entity_group, sensor, entity, count(*) as n, {r('any_value(q1)', 'q1')}, {r('any_value(median)', 'median')},
  {r('any_value(q3)', 'q3')},
  {r('least(any_value(q1), coalesce(min(y) filter (where y >= low), any_value(q1)))', 'whisker_low')},
  {r('greatest(any_value(q3), coalesce(max(y) filter (where y <= high), any_value(q3)))', 'whisker_high')},
  cast(count(*) filter (where y < low or y > high) as bigint) as outliers
from fenced group by entity_group, sensor, entity"""

REQUESTS = """,
fleet as (select distinct entity_group, sensor from long),
each as (select distinct entity_group, entity from long),
requests as materialized (
select 'early/' || entity_group || '/' || sensor as request_id, entity_group, null::varchar as entity, sensor,
       null::timestamp as start_ts, timestamp '2024-01-12 08:00:00' as end_ts from fleet
union all
select 'middle/' || entity_group || '/' || sensor, entity_group, null, sensor,
       timestamp '2024-01-10', timestamp '2024-01-13' from fleet
union all
select 'late/' || entity_group || '/' || entity || '/vibration_rms', entity_group, entity, 'vibration_rms',
       timestamp '2024-01-18 18:30:00', null from each
union all
select 'all/' || entity_group || '/' || entity || '/rpm', entity_group, entity, 'rpm', null, null from each)"""

ASKED = """,
asked as (select request_id, h.* from hist h join requests q on h.entity_group = q.entity_group and h.sensor = q.sensor
   and (q.entity is null or q.entity = h.entity) and (q.start_ts is null or h.ts >= q.start_ts)
   and (q.end_ts is null or h.ts < q.end_ts))"""

# Health with the parameters of each request: the latest state by row number, averages as folds.
BATCH_HEALTH = f"""
wanted as (
  select 'usual/' || g as request_id, g, null::varchar[] as names, null::timestamp as since, 0.2::double as alpha, 2 as days, 24 as hours, 1.0::double as drift from groups
  union all select 'fast/' || g, g, null, null, 0.9, 5, 48, 0.5 from groups
  union all select 'pair/' || g, g, [g || '02', g || '06'], timestamp '2024-01-12', 0.4, 3, 24, 1.0 from groups
),
held as (
  select w.*, h.*, max(ts) over (partition by request_id, {SERIES}) as last_ts,
    row_number() over (partition by request_id, {SERIES} order by ts desc, value desc) as age,
    case when ucl > centerline then (ucl - centerline) / 3 end as sigma,
    coalesce(value > ucl and lcl is not null or value < lcl and ucl is not null, false) as ooc
  from wanted w join hist h on h.entity_group = w.g and (names is null or list_contains(names, h.entity)) and (since is null or ts >= since)
),
summed as (
  select request_id, {SERIES}, any_value(alpha) as alpha, any_value(drift) as drift,
    max(case when age = 1 then value end) as latest_value, max(case when age = 1 then centerline end) as centerline,
    max(case when age = 1 then sigma end) as std, list(value order by age desc) as xs,
    list(value order by age desc) filter (where ts >= last_ts - to_hours(hours)) as slope_xs,
    date_diff('microsecond', min(ts) filter (where ts >= last_ts - to_hours(hours)), max(ts)) / 86400000000.0::double as span,
    avg(ooc::int) filter (where ts >= last_ts - to_days(days)) as ooc_rate
  from held group by request_id, {SERIES}
),
folded as (
  select *, list_reduce(xs, lambda y, x: (1 - alpha) * y + alpha * x) as latest_ewma,
    list_reduce(slope_xs, lambda y, x: (1 - alpha) * y + alpha * x) as slope_end from summed
),
scores as (
  select *, case when centerline is not null then (latest_ewma - centerline) / std end as z,
    case when centerline is not null and len(slope_xs) > 1 and span > 0 then (slope_end - slope_xs[1]) / std / span end as slope from folded
),
labels as (
  select *, case when abs(z) > 3 then 'ooc' when slope >= drift then 'drifting_up' when slope <= -drift then 'drifting_down'
    when ooc_rate >= 0.05 then 'volatile' when abs(slope) <= 0.8 and coalesce(abs(z), 0) <= 1 then 'stable_baseline'
    when abs(z) > 1 then 'trending_baseline' else 'stable_baseline' end as baseline_trend
  from scores
)"""

CELL = "coalesce(cast(length({0}) as varchar) || ':' || {0}, '-')"
PRINTED_COLUMNS = "ts, entity_group, entity, sensor, operating_mode, failure_type, value"


def digest_text(digits: int) -> str:
    """Cells in the order of the column names."""
    value = f"cast(cast(round(value, {digits}) as decimal(38, {digits})) as varchar)"
    ts = "cast(epoch_us(ts) as varchar)"
    cells = ["entity", "entity_group", "failure_type", "operating_mode", "sensor", ts, value]
    return " || ".join(CELL.format(c) for c in cells)


ALTERED = """(select * replace (case when entity_group = 'CPR' and sensor = 'vibration_rms' then value + 1 else value end as value)
   from {0} where not (entity_group = 'ARM' and sensor = 'rpm'))"""
NO_AMBIENT = "(select * from {0} where not (entity_group = 'CNC' and sensor = 'ambient_temp'))"

# A chart of two tables is the same when sorting its rows gives the same list.
CONTENT = "list(row(ts, entity, operating_mode, failure_type, value) order by entity, ts, value)"


def manifest(source: str) -> str:
    return f"(select entity_group, sensor, {CONTENT} as content from {source} group by 1, 2)"


def compared(expected: str, actual: str) -> str:
    return f"""(select coalesce(x.entity_group, a.entity_group) as entity_group, coalesce(x.sensor, a.sensor) as sensor,
   case when a.sensor is null then 'missing' when x.sensor is null then 'extra'
        when x.content = a.content then 'ok' else 'mismatched' end as status
   from {manifest(expected)} x full join {manifest(actual)} a
     on x.entity_group = a.entity_group and x.sensor = a.sensor)"""


def scope(name: str, expected: str, actual: str) -> str:
    return f"""select '{name}' as scope, count(*) filter (where status = 'missing') as missing,
  count(*) filter (where status = 'extra') as extra, count(*) filter (where status = 'mismatched') as mismatched,
  bool_and(status = 'ok') as ok from {compared(expected, actual)}"""


def drawn(y: str, pixels: int, axis: str, shown: str) -> str:
    """What shows of `ew`: the ends and extremes of each column of pixels, and every violation."""
    return HIST + ewma_cte("hist", 0.2) + f""",
timed as (
  select {SERIES}, ts, {y} as y, {flag()} as violation, epoch_us(ts) as tick,
    min(epoch_us(ts)) over (partition by {axis}) as low, max(epoch_us(ts)) over (partition by {axis}) as high from ew
),
placed as (select *, (tick - low) // ((high - low) // {pixels} + 1) as pixel from timed where y is not null),
ranked as (
  select *, row_number() over (spot order by ts, y) as from_first, row_number() over (spot order by ts desc, y desc) as from_last,
    row_number() over (spot order by y, ts) as from_least, row_number() over (spot order by y desc, ts desc) as from_greatest
  from placed window spot as (partition by {SERIES}, pixel, violation)
),
points as (
  select distinct {SERIES}, pixel, ts, y, violation from ranked
  where violation or 1 in (from_first, from_last, from_least, from_greatest)
)
select {SERIES}, pixel, ts, {shown}, violation from points"""


def q(ctes: str, select: str) -> str:
    return f"with {ctes.strip()}\n{select}"


_ALL_SENSORS = "entity_group, entity, ts, sensor, value"
_SLICED = "entity_group, entity, sensor, ts, value"

ORACLE: dict[str, str] = {
    "derive_entity": q(RAW_LOG, "select * exclude (g2) from wide"),
    "unpivot_sensors": q(LONG, "select * from long"),
    "ingest": q(
        LIMITS,
        f"""select entity_group, sensor, readings, first_ts, last_ts, {r('mean')}, {r('std')}, {ROUND_LIMITS}
from (select entity_group, sensor, count(*) as readings, min(ts) as first_ts, max(ts) as last_ts from long group by 1, 2)
left join limits using (entity_group, sensor)""",
    ),
    "csv_folder": q(
        LONG,
        """select entity, ts, operating_mode, sensor, value from long
where cast(regexp_extract(entity, '([0-9]+)$', 1) as int) % 2 = 0 or sensor in ('rpm', 'ambient_temp', 'pressure_level')
union all
select null, null, null, reason, (select count(distinct machine_id) from raw_log where machine_id % 2 = 1)::double
from (values ('torn'), ('rpm')) as reasons(reason)""",
    ),
    "spc_limits": q(LIMITS, f"select entity_group, sensor, {r('mean')}, {r('std')}, {ROUND_LIMITS} from limits"),
    "catalog": q(
        LONG,
        """select distinct 'entity_group' as kind, null::varchar as entity_group, entity_group as name from long
union all select distinct 'entity', null, entity from long
union all select distinct 'sensor', null, sensor from long
union all select distinct 'group_entity', entity_group, entity from long""",
    ),
    "entities_by_group": q(LONG, "select distinct entity_group, entity from long"),
    "entity_filter_one_many": q(
        HIST,
        f"select {_ALL_SENSORS}, {ROUND_LIMITS} from hist where entity_group = 'CPR' and entity in ('CPR02', 'CPR06')",
    ),
    "time_range_extract": q(
        LONG,
        """select * from long where operating_mode = 'normal'
  and ts >= coalesce(timestamp '2024-01-08 12:00:00', timestamp '1900-01-01')
  and ts < coalesce(timestamp '2024-01-21', timestamp '9999-12-31 23:59:59')""",
    ),
    "time_slice_run": q(
        HIST, f"select {_SLICED} from hist where ts >= (select max(ts) - interval 3 day from hist)"
    ),
    "time_slice_replot": q(
        HIST,
        f"""select {_SLICED} from hist where ts <= timestamp '2024-01-20 06:00:00'
  and ts >= (select max(ts) - interval 5 day from hist where ts <= timestamp '2024-01-20 06:00:00')""",
    ),
    "entity_subset_slice": q(
        HIST + ", chosen as (select * from hist where entity in ('CPR02', 'ARM03'))",
        f"select {_SLICED} from chosen where ts >= (select max(ts) - interval 4 day from chosen)",
    ),
    "join_limits": q(
        LIMITS,
        f"select long.*, {ROUND_LIMITS} from long left join limits using (entity_group, sensor)",
    ),
    "entity_sensor_history": q(
        HIST,
        f"""select {HISTORY}, {ROUND_LIMITS} from hist where entity_group = 'CPR' and entity = 'CPR02'
  and sensor = 'temperature_motor' and ts >= timestamp '2024-01-03'""",
    ),
    "fleet_sensor_history": q(
        HIST,
        f"""select {HISTORY}, {ROUND_LIMITS} from hist where entity_group = 'CPR' and sensor = 'vibration_rms'
  and ts < timestamp '2024-01-25'""",
    ),
    "entity_all_sensor_history": q(
        HIST, f"select {_ALL_SENSORS}, {ROUND_LIMITS} from hist where entity_group = 'PMP'"
    ),
    "pm_events": q(LONG + events_cte(), "select * from pm"),
    "pm_events_in_range": q(
        LONG + events_cte(where="ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20 12:00:00'"),
        "select * from pm",
    ),
    "pm_event_join_back": q(
        LIMITS + events_cte() + event_history_cte(),
        "select entity_group, entity, ts, hours_pre_pm, failure_type, operating_mode, sensor, value from pm_hist",
    ),
    "pm_event_sensor_history": q(
        LIMITS + events_cte() + event_history_cte(),
        f"""select entity_group, entity, ts, hours_pre_pm, failure_type, operating_mode, sensor, value, {ROUND_LIMITS}
from pm_hist""",
    ),
    "batch_pm_events": q(
        LIMITS + events_cte() + event_history_cte()
        + events_cte(
            "pair",
            "entity in (entity_group || '02', entity_group || '06')"
            " and ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20 12:00:00'",
        )
        + event_history_cte("pair", "pair_hist"),
        f"""select 'all/' || entity_group as request_id, entity_group, entity, ts, hours_pre_pm, failure_type, operating_mode, sensor, value, {ROUND_LIMITS}
from pm_hist
union all
select 'pair/' || entity_group as request_id, entity_group, entity, ts, hours_pre_pm, failure_type, operating_mode, sensor, value, {ROUND_LIMITS}
from pair_hist""",
    ),
    "maintenance_block": q(
        LONG,
        f"""select {SERIES}, ts, hours_since_maintenance, value,
  cast(count(*) filter (where hours_since_maintenance = 0) over (partition by {SERIES} order by ts
       rows unbounded preceding) as bigint) as maintenance_block
from long where operating_mode = 'normal'""",
    ),
    "ewma": q(HIST + ewma_cte("hist", 0.2), f"select {SERIES}, ts, value, {r('ewma')} from ew"),
    "ewma_whole_series": q(
        HIST + ewma_cte("hist", 0.05, reset=False), f"select {SERIES}, ts, value, {r('ewma')} from ew"
    ),
    "ewma_spc": q(
        HIST + ewma_cte("hist", 0.2),
        f"select {HISTORY}, {ROUND_LIMITS}, {r('ewma')}, {flag()} as spc_violation from ew",
    ),
    "ewma_violation_variant": q(
        HIST + ewma_cte("hist", 0.6),
        f"select {HISTORY}, {ROUND_LIMITS}, {r('ewma')}, {flag('ewma')} as spc_violation from ew",
    ),
    "fleet_ooc_summary": q(HIST, ooc_table("hist")),
    "fleet_ooc_table": q(
        HIST, ooc_table("(select * from hist where ts >= (select max(ts) - interval 3 day from hist))")
    ),
    "fleet_ooc_report": q(
        HIST + ", cpr as (select * from hist where entity_group = 'CPR' and sensor = 'vibration_rms')",
        ooc_table("(select * from cpr where ts >= (select max(ts) - interval 3 day from cpr))"),
    ),
    "pm_event_ooc_summary": q(LIMITS + events_cte() + event_history_cte(), event_summary()),
    "pm_event_table": q(
        LIMITS + events_cte() + event_history_cte(),
        f"""select entity, ts as timestamp, hours_pre_pm as hours_since_last_maintenance, failure_type, ooc_sensors
from ({event_summary()})""",
    ),
    "multi_sensor_health": q(HIST + health_cte("hist"), f"select {health_columns(2, 24)} from health"),
    "multi_sensor_health_fast": q(
        HIST + health_cte("hist", 0.9, 5, 48), f"select {health_columns(5, 48)} from health"
    ),
    "health_table": q(
        HIST + health_cte("hist"),
        f"""select {SERIES}, {r('z', 'latest_z_score')}, {r('ooc_rate', 'ooc_rate_2d')},
  {r('slope', 'ewma_slope_z_per_day_24h')}, baseline_trend, health_status from health""",
    ),
    "health_attention_flag": q(
        HIST + health_cte("hist", 0.9),
        f"""select {SERIES}, baseline_trend, health_status,
  (health_status <> 'stable' or baseline_trend <> 'stable_baseline') as needs_attention from health""",
    ),
    "latest_limits": q(
        HIST,
        f"""select entity_group, sensor, {r("arg_max(ucl, ts) filter (where ucl is not null)", "ucl")},
  {r("arg_max(centerline, ts) filter (where centerline is not null)", "centerline")},
  {r("arg_max(lcl, ts) filter (where lcl is not null)", "lcl")} from hist group by 1, 2""",
    ),
    "spc_chart_series": q(
        HIST + ewma_cte("hist", 0.2),
        f"select {SERIES}, ts, value, {r('ewma')}, {flag()} as violation, {ROUND_LIMITS} from ew",
    ),
    "fleet_trend_series": q(
        HIST + ewma_cte("hist", 0.2),
        f"""select {SERIES}, ts, value, {r('ewma')}, {r('case when ' + flag() + ' then ewma end', 'violation_ewma')},
  {ROUND_LIMITS} from ew""",
    ),
    "spc_chart_drawn": q(drawn("value", 40, SERIES, "y as value"), ""),
    "fleet_trend_drawn": q(drawn("ewma", 60, "entity_group, sensor", r("y", "ewma")), ""),
    "fleet_boxplot_stats": q(HIST + box_cte("hist"), BOX),
    "fleet_boxplot_chart": q(
        HIST + box_cte("hist") + f", boxes as ({BOX})",
        f"select boxes.*, {ROUND_LIMITS} from boxes left join limits using (entity_group, sensor)",
    ),
    "fleet_boxplot_ewma": q(HIST + ewma_cte("hist", 0.2) + box_cte("ew", "ewma"), BOX),
    "fleet_boxplot_outliers": q(
        HIST + box_cte("hist"), "select entity_group, sensor, entity, ts, y from fenced where y < low or y > high"
    ),
    "batch_requests": q(
        HIST + REQUESTS + ASKED + ewma_cte("asked", 0.2, by="request_id, " + SERIES),
        f"select request_id, {SERIES}, ts, value, {r('ewma')}, {flag()} as spc_violation from ew",
    ),
    "batch_alphas": q(
        HIST
        + REQUESTS
        + ASKED
        + """,
weighed as (select *, case split_part(request_id, '/', 1) when 'late' then 0.7::double when 'middle' then 1.0::double else 0.2::double end as ewma_alpha from asked)"""
        + ewma_cte("weighed", "ewma_alpha", by="request_id, " + SERIES),
        f"select request_id, {SERIES}, ts, ewma_alpha, {r('ewma')}, {flag()} as spc_violation from ew",
    ),
    "batch_ooc_sliced": q(
        HIST
        + REQUESTS
        + ASKED
        + """,
a as (select *, split_part(request_id, '/', 1) as kind from asked),
cut as (
  select *, 'pair' as output, 2 as days from a where kind = 'early' and entity in (entity_group || '02', entity_group || '06')
  union all select *, 'whole', null from a where kind = 'early'
  union all select *, 'closed', null from a where kind = 'middle' and ts between timestamp '2024-01-11' and timestamp '2024-01-12 06:00:00'
  union all select *, 'last', 0 from a where kind = 'all'
  union all select *, null, null from a where kind = 'late'),
lasts as (select request_id, output, max(ts) as last_ts from cut group by 1, 2),
slice as (select cut.* from cut join lasts l on l.request_id = cut.request_id and l.output is not distinct from cut.output
  where days is null or ts >= last_ts - to_days(days))""",
        ooc_table("slice", "request_id, output,"),
    ),
    "batch_health": q(
        HIST + ", groups as (select distinct entity_group as g from long)," + BATCH_HEALTH,
        f"""select request_id, {SERIES}, latest_value, {r('latest_ewma')}, {r('centerline')}, {r('std')}, {r('z', 'latest_z_score')},
  {r('ooc_rate')}, {r('slope', 'ewma_slope_z_per_day')}, baseline_trend,
  case baseline_trend when 'ooc' then 'ooc' when 'stable_baseline' then 'stable' else 'attention' end as health_status
from labels""",
    ),
    "run_filter_inventory": q(
        LONG + REQUESTS,
        """select distinct 'entity_group' as kind, entity_group as name from requests where entity_group <> ''
union all select distinct 'entity', entity from requests where entity <> ''
union all select distinct 'sensor', sensor from requests where sensor <> ''""",
    ),
    "invalid_requests": q(
        LONG + ", each as (select distinct entity_group, entity from long)",
        """select 'no_sensor/' || entity as request_id, 'fleet_sensor_history' as kind, entity_group, null::varchar as entity,
       ' ' as sensor, 'missing_sensor' as reason from each
union all select 'no_entity/' || entity, 'entity_sensor_history', entity_group, '', 'rpm', 'missing_entity' from each
union all select 'no_group/' || entity, 'entity_all_sensor_history', null, entity, null, 'missing_entity_group' from each
union all select 'odd_kind/' || entity, 'entity_history', entity_group, entity, null, 'unknown_kind' from each
union all select 'odd_group/' || entity, 'fleet_sensor_history', entity_group || 'X', null, 'rpm', 'unknown_entity_group' from each
union all select 'odd_entity/' || entity, 'entity_sensor_history', entity_group, entity || 'X', 'rpm', 'unknown_entity' from each
union all select 'odd_sensor/' || entity, 'entity_sensor_history', entity_group, entity, 'torque', 'unknown_sensor' from each
union all select 'other_group/' || entity, 'entity_sensor_history',
       case when entity_group = 'CPR' then 'PMP' else 'CPR' end, entity, 'rpm', 'entity_not_in_group' from each""",
    ),
    "pm_event_windows": q(
        HIST + events_cte(),
        f"""select h.entity_group, h.entity, pm.ts as event_ts, h.ts, h.sensor, h.value, {ROUND_LIMITS}
from hist h join pm on h.entity_group = pm.entity_group and h.entity = pm.entity
  and h.ts >= pm.ts - interval 1 day and h.ts <= pm.ts + interval 1 day""",
    ),
    "shared_outputs": q(
        HIST,
        ooc_table("hist", "'all' as output,")
        + "\nunion all\n"
        + ooc_table(
            "(select * from hist where ts >= (select max(ts) - interval 3 day from hist))", "'last_3_days' as output,"
        )
        + "\nunion all\n"
        + ooc_table("(select * from hist where ts <= timestamp '2024-01-07 23:59:59')", "'first_week' as output,"),
    ),
    "replot_slices": q(
        HIST + ", early as (select * from hist where ts <= timestamp '2024-01-22')",
        ooc_table("(select * from early where ts >= (select max(ts) - interval 6 day from early))"),
    ),
    "table_fingerprint": q(
        LONG + f", digests as (select entity_group, sensor, sha256({digest_text(9)}) as d from long)",
        """select entity_group, sensor, count(*) as row_count,
  cast(sum(cast('0x' || substr(d, 1, 15) as bigint)) as varchar) as digest_high,
  cast(sum(cast('0x' || substr(d, 16, 15) as bigint)) as varchar) as digest_low
from digests group by 1, 2""",
    ),
    "manifest_compare": q(LONG, f"select * from {compared(NO_AMBIENT.format('long'), ALTERED.format('long'))}"),
    "verify_with_reuse": q(
        LONG + ", early as (select * from long where ts < timestamp '2024-01-08')",
        scope("base", "long", "long")
        + "\nunion all\n"
        + scope("replot/early", NO_AMBIENT.format("early"), ALTERED.format("early"))
        + "\nunion all\n"
        + scope("replot/no_manifest", "(select * from early where false)", "early"),
    ),
    "compare_runs": q(
        LIMITS
        + events_cte()
        + event_history_cte()
        + events_cte("late", "ts >= timestamp '2024-01-06'")
        + event_history_cte("late", "late_hist")
        + f""",
a as (select entity, list(row(ts, hours_pre_pm, failure_type, ooc_sensors) order by ts) as content
      from ({event_summary('pm_hist')}) group by entity),
b as (select entity, list(row(ts, hours_pre_pm, failure_type, ooc_sensors) order by ts) as content
      from ({event_summary('late_hist')}) group by entity)""",
        """select * from (select coalesce(a.entity, b.entity) as entity,
  case when b.entity is null then 'missing' when a.entity is null then 'extra'
       when a.content = b.content then 'ok' else 'mismatched' end as status
  from a full join b on a.entity = b.entity) where status <> 'ok'""",
    ),
    "differing_rows": q(
        LONG,
        f"""select {PRINTED_COLUMNS}, cast(sum(l) as bigint) as copies_original, cast(sum(n) as bigint) as copies_repeated from (
  select {PRINTED_COLUMNS}, 1 as l, 0 as n from {NO_AMBIENT.format('long')}
  union all select {PRINTED_COLUMNS}, 0, 1 from {ALTERED.format('long')})
group by {PRINTED_COLUMNS} having sum(l) <> sum(n)""",
    ),
}
ORACLE["located_differences"] = ORACLE["differing_rows"]
ORACLE["difference_tree"] = q(
    LONG
    + f""",
copies as (
  select {PRINTED_COLUMNS}, sum(l) as l, sum(n) as n from (
    select {PRINTED_COLUMNS}, 1 as l, 0 as n from {NO_AMBIENT.format('long')}
    union all select {PRINTED_COLUMNS}, 0, 1 from {ALTERED.format('long')})
  group by {PRINTED_COLUMNS}
),
nodes as (
  select 3 - bit_count(grouping_id(entity_group, entity, sensor)) as level, entity_group, entity, sensor,
    sum(l) as l, sum(n) as n, bool_or(l <> n) as differs
  from copies group by rollup (entity_group, entity, sensor)
)""",
    """select cast(level as int) as level, entity_group, entity, sensor, cast(l as bigint) as rows_original, cast(n as bigint) as rows_repeated,
  case when n = 0 then 'missing' when l = 0 then 'extra' else 'mismatched' end as status
from nodes where differs""",
)
ORACLE["monitored_history"] = ORACLE["ewma_spc"]
# However many logs brought the readings.
ORACLE["ingest_two_batches"] = ORACLE["ingest"]
ORACLE["incremental_averages"] = ORACLE["incremental_late"] = ORACLE["ewma_spc"]
ORACLE["incremental_events"] = ORACLE["pm_event_sensor_history"]
_CPR = HIST + ", cpr as (select * from hist where entity_group = 'CPR' and sensor = 'vibration_rms')"
_SEVERITY = "case health_status when 'ooc' then 0 when 'attention' then 1 when 'stable' then 2 else 3 end"
ORACLE |= {
    "series_extents": q(
        LONG,
        f"""select {SERIES}, cast(ts as date) as day, coalesce(operating_mode = 'normal', false) as normal, count(*) as n,
  min(ts) as first_ts, max(ts) as last_ts from long group by all""",
    ),
    "guarded_run": q(
        _CPR + ewma_cte("cpr", 0.2), f"select {HISTORY}, {r('ewma')}, {flag()} as spc_violation, {ROUND_LIMITS} from ew"
    ),
    "chart_filter": q(
        _CPR + ", one as (select * from cpr where entity = 'CPR02')" + ewma_cte("one", 0.2),
        f"select {SERIES}, ts, value, {r('ewma')}, {flag()} as violation, {ROUND_LIMITS} from ew",
    ),
    "limits_absent": q(
        LONG,
        """select entity_group, sensor, entity, count(*) as total_points, cast(0 as bigint) as ooc_points,
  cast(0 as double) as percent_ooc, cast(null as double) as ucl, cast(null as double) as centerline, cast(null as double) as lcl
from long where operating_mode = 'normal' group by all""",
    ),
    "extract_order": q(
        LONG,
        """select ts, entity, sensor, row_number() over (order by ts, entity, sensor) as place
from long where operating_mode = 'normal' and entity_group = 'CPR'""",
    ),
    "severity_order": q(
        HIST + health_cte("hist"),
        f"""select health_status, abs({r('z').removesuffix(' as z')}) as latest_z_score,
  row_number() over (order by {_SEVERITY}, abs(z) desc nulls last) as place from health""",
    ),
    "fleet_report_order": q(_CPR, "select entity, row_number() over (order by entity) as place from (select distinct entity from cpr)"),
    "event_report_order": q(
        LIMITS + events_cte() + event_history_cte(),
        """select ts as timestamp, entity, row_number() over (order by ts, entity) as place
from (select distinct ts, entity from pm_hist where entity_group = 'CPR')""",
    ),
}
for _name in ("time_slice_run", "time_slice_replot", "entity_subset_slice"):
    ORACLE[f"{_name}_kept"] = ORACLE[_name]
ORACLE["chart_limits_kept"] = ORACLE["latest_limits"]
ORACLE["extract_sink"] = ORACLE["fleet_sensor_history"]
ORACLE["table_csv_sink"] = ORACLE["pm_event_table"]
ORACLE["catalog_json_sink"] = ORACLE["catalog"]
for _name in ("ewma_spc", "multi_sensor_health", "pm_events"):
    ORACLE[f"{_name}_by_series"] = ORACLE[_name]
for _name in ("ewma_spc", "maintenance_block", "pm_events", "multi_sensor_health", "fleet_boxplot_stats"):
    ORACLE[f"{_name}_cut"] = ORACLE[_name]
