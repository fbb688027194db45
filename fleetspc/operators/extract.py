"""Histories: filtered readings with their control limits, and maintenance events.

Frames come back unordered; sort them where they are shown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspc.functions.predicates import is_normal, where_entity, where_time_range
from fleetspc.operators.series import split_series
from fleetspc.schemas import CHART_KEYS, ENTITY_KEYS, LIMIT_COLUMNS

# The columns of the histories.
SENSOR_HISTORY = [
    "entity",
    "entity_group",
    "ts",
    "operating_mode",
    "hours_since_maintenance",
    "failure_type",
    "sensor",
    "value",
    *LIMIT_COLUMNS,
]
ALL_SENSOR_HISTORY = ["entity_group", "entity", "ts", "sensor", "value", *LIMIT_COLUMNS]
PM_HISTORY = [
    "entity_group",
    "entity",
    "ts",
    "hours_pre_pm",
    "failure_type",
    "operating_mode",
    "sensor",
    "value",
    *LIMIT_COLUMNS,
]


def _given(**arguments: str | None) -> None:
    absent = [name for name, value in arguments.items() if value is None or value == ""]
    if absent:
        raise ValueError(f"these filters must be given: {absent}")


def join_limits(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Left join with the limits; readings without limits keep NULLs.

    No broadcast hint: a limits table read from parquet has an exact size, so the planner
    broadcasts it while it is small and shuffles once it is not.
    """
    return rows.join(limits.select(*CHART_KEYS, *LIMIT_COLUMNS), CHART_KEYS, "left")


def normal_readings(long: DataFrame, *, entity_group=None, entity=None, sensor=None, start_ts=None, end_ts=None) -> DataFrame:
    rows = long.where(is_normal())
    if entity_group is not None:
        rows = rows.where(F.col("entity_group") == entity_group)
    if sensor is not None:
        rows = rows.where(F.col("sensor") == sensor)
    return where_time_range(where_entity(rows, entity), start_ts, end_ts)


def sensor_history(long: DataFrame, limits: DataFrame, **filters) -> DataFrame:
    """Normal-mode readings with limits for any choice of filters, also none."""
    return join_limits(normal_readings(long, **filters), limits).select(SENSOR_HISTORY)


def entity_sensor_history(long, limits, entity_group: str, entity: str, sensor: str, start_ts=None, end_ts=None) -> DataFrame:
    """One sensor of one entity."""
    _given(entity_group=entity_group, entity=entity, sensor=sensor)
    return sensor_history(
        long, limits, entity_group=entity_group, entity=entity, sensor=sensor, start_ts=start_ts, end_ts=end_ts
    )


def fleet_sensor_history(long, limits, entity_group: str, sensor: str, start_ts=None, end_ts=None) -> DataFrame:
    """One sensor of every entity of a group."""
    _given(entity_group=entity_group, sensor=sensor)
    return sensor_history(
        long, limits, entity_group=entity_group, sensor=sensor, start_ts=start_ts, end_ts=end_ts
    )


def entity_all_sensor_history(long, limits, entity_group: str, entity=None, start_ts=None, end_ts=None) -> DataFrame:
    """All sensors of no, one or several named entities of a group; no name means all."""
    _given(entity_group=entity_group)
    rows = normal_readings(long, entity_group=entity_group, entity=entity, start_ts=start_ts, end_ts=end_ts)
    return join_limits(rows, limits).select(ALL_SENSOR_HISTORY)


def readings_at_events(rows: DataFrame, cuts=None, within: tuple[str, ...] = (), tasks: int | None = None) -> DataFrame:
    """Normal-mode readings of instants with a maintenance event, once per event, and `_last` of each event.

    `rows` are normal-mode readings. A tick is an instant with its hours and failure type, and an
    event is a tick whose next one has fewer hours. One sort per entity: the last reading of a
    tick sees the next tick, and its finding holds for all readings of the tick. `_last` is true
    for one reading of each event. `within` names columns that divide an entity's rows further,
    such as a request id. `tasks` is the number of tasks, see tasks_for.
    """
    s = split_series(rows, ENTITY_KEYS, cuts, within, tasks)
    hours = F.col("hours_since_maintenance")
    tick = ["ts", "hours_since_maintenance", "failure_type"]
    following = F.lead(F.struct(*tick)).over(s.window(*tick))
    ticks = s.rows.withColumn("_next", following)
    same = F.lit(True)
    for c in tick:
        same = same & F.col(c).eqNullSafe(F.col("_next")[c])
    ticks = ticks.withColumn("_last", F.col("_next").isNull() | ~same)
    next_hours = F.col("_next.hours_since_maintenance")
    if s.split:
        ticks = s.carry(ticks, {"_head": F.min(F.struct(*tick))}, {"_next_head": lambda up, down: F.lead("_head").over(up)})
        # The last reading of a chunk has no next one in it; ticks are never cut.
        next_hours = F.when(F.col("_next").isNull(), F.col("_next_head.hours_since_maintenance")).otherwise(next_hours)
    drops = F.col("_last") & F.coalesce(hours > next_hours, F.lit(False))
    of_tick = Window.partitionBy(*s.by, *tick)
    events = ticks.withColumn("_drops", F.max(drops).over(of_tick)).where("_drops")
    named = {"hours_since_maintenance": "hours_pre_pm"}
    kept = [c for c in ("operating_mode", "sensor", "value") if c in rows.columns]
    return events.withColumnsRenamed(named).select(*within, *ENTITY_KEYS, "ts", "hours_pre_pm", "failure_type", *kept, "_last")


def pm_events(long: DataFrame, *, entity_group=None, entity=None, start_ts=None, end_ts=None, cuts=None) -> DataFrame:
    """Last normal-mode tick of an entity before its hours since maintenance drop.

    The time range is cut out first, so an event whose next tick lies outside is not reported.
    `cuts` is over (entity_group, entity).
    """
    rows = normal_readings(long, entity_group=entity_group, entity=entity, start_ts=start_ts, end_ts=end_ts)
    rows = rows.select(*ENTITY_KEYS, "ts", "hours_since_maintenance", "failure_type", "operating_mode")
    return readings_at_events(rows, cuts).where("_last").select(*ENTITY_KEYS, "ts", "hours_pre_pm", "failure_type")


def pm_event_readings(long: DataFrame, events: DataFrame, **filters) -> DataFrame:
    """Every normal-mode reading taken at the tick of an event."""
    at_tick = normal_readings(long, **filters).select(*ENTITY_KEYS, "ts", "operating_mode", "sensor", "value")
    return events.join(at_tick, [*ENTITY_KEYS, "ts"], "inner")


def pm_event_history(long, limits, *, entity_group=None, entity=None, start_ts=None, end_ts=None, cuts=None, tasks=None) -> DataFrame:
    """Readings and limits at each maintenance event, for any choice of filters: one scan, one shuffle."""
    rows = normal_readings(long, entity_group=entity_group, entity=entity, start_ts=start_ts, end_ts=end_ts)
    return join_limits(readings_at_events(rows, cuts, tasks=tasks), limits).select(PM_HISTORY)


def pm_event_sensor_history(long, limits, entity_group: str, entity=None, start_ts=None, end_ts=None, *, cuts=None) -> DataFrame:
    """Readings and limits at each maintenance event of a group."""
    _given(entity_group=entity_group)
    return pm_event_history(
        long, limits, entity_group=entity_group, entity=entity, start_ts=start_ts, end_ts=end_ts, cuts=cuts
    )
