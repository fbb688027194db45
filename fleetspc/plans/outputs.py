"""The tables users ask for, from extract to final columns, and outputs that share one frame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from fleetspc.functions.predicates import one_sided_violation
from fleetspc.operators.ewma import ewma
from fleetspc.operators.extents import last_time
from fleetspc.operators.extract import (
    SENSOR_HISTORY,
    entity_all_sensor_history,
    fleet_sensor_history,
    join_limits,
    normal_readings,
    pm_event_sensor_history,
    sensor_history,
)
from fleetspc.operators.guards import guard
from fleetspc.operators.health import by_severity, health_table, multi_sensor_health
from fleetspc.operators.slices import entity_subset, time_slice
from fleetspc.operators.spc import ewma_spc
from fleetspc.operators.summary import fleet_ooc_summary, pm_event_ooc_summary, pm_event_table
from fleetspc.plans.setup import SensorTables
from fleetspc.sources.versions import finish_version, new_version, version_path
from fleetspc.sources.workspace import materialize


def monitored_history(
    long, limits, ewma_alpha: float = 0.2, *, violation_on: str = "value", cuts=None, tasks: int | None = None, **filters
) -> DataFrame:
    """ewma_spc of a sensor_history, with the limits joined after the average.

    The rows are the same; the limits stay out of the shuffle that brings a series together.
    """
    averaged = ewma(normal_readings(long, **filters), ewma_alpha, cuts=cuts, tasks=tasks)
    flagged = join_limits(averaged, limits).withColumn("spc_violation", one_sided_violation(violation_on))
    return flagged.select(*SENSOR_HISTORY, "ewma", "spc_violation")


def in_time_order(history: DataFrame) -> DataFrame:
    """Sort an extract for display: by ts, and by entity and sensor within a tick."""
    return history.orderBy("ts", "entity", "sensor")


def sliced(df: DataFrame, *, entities=None, start_ts=None, end_ts=None, window_days=None, mode="run") -> DataFrame:
    """Entities first, then time: a window counts back from the last row of those entities."""
    return time_slice(entity_subset(df, entities), start_ts, end_ts, window_days, mode)


def sliced_history(
    t: SensorTables, *, entities=None, start_ts=None, end_ts=None, window_days=None, mode="run", **names
) -> DataFrame:
    """`sliced` of the sensor_history with these names (entity_group, sensor), in one scan.

    The last ts that a window counts back from comes from the extents.
    """
    long = entity_subset(t.long, entities)
    last = None
    if window_days is not None:
        last = last_time(t.extents, t.long, until=end_ts or None, entity=entities, **names)
    history = sensor_history(long, t.limits, **names)
    return time_slice(history, start_ts, end_ts, window_days, mode, last)


def fleet_ooc_table(processed: DataFrame, **slice_arguments) -> DataFrame:
    """Out-of-control rates over a slice of a frame of ewma_spc."""
    return fleet_ooc_summary(sliced(processed, **slice_arguments))


def fleet_ooc_report(long, limits, entity_group, sensor, start_ts=None, end_ts=None, *, cuts=None, **slice_arguments) -> DataFrame:
    """Out-of-control rate of every entity of a group for one sensor.

    The average is not part of the answer, so its windows drop out of the plan.
    """
    history = fleet_sensor_history(long, limits, entity_group, sensor, start_ts, end_ts)
    return fleet_ooc_table(ewma_spc(history, cuts=cuts), **slice_arguments).orderBy("entity")


def pm_event_report(long, limits, entity_group, entity=None, start_ts=None, end_ts=None, *, cuts=None) -> DataFrame:
    """Maintenance events of a group with the sensors out of control at them."""
    history = pm_event_sensor_history(long, limits, entity_group, entity, start_ts, end_ts, cuts=cuts)
    return pm_event_table(pm_event_ooc_summary(history)).orderBy("timestamp", "entity")


def health_report(long, limits, entity_group, entity=None, start_ts=None, end_ts=None, **options) -> DataFrame:
    """Health of every sensor of a group's entities, worst first."""
    history = entity_all_sensor_history(long, limits, entity_group, entity, start_ts, end_ts)
    return health_table(by_severity(multi_sensor_health(history, **options)))


def shared_outputs(
    processed: DataFrame, outputs: dict[str, Callable[[DataFrame], DataFrame]]
) -> dict[str, DataFrame]:
    """Several outputs of one processed frame, computed once and stored in the shared folder."""
    stored = materialize(processed, "processed")
    return {name: output(stored) for name, output in outputs.items()}


def stored_run(
    extract: DataFrame, process: Callable[[DataFrame], DataFrame], table: str, *, what: str = "the extract", known: Sequence[str] = ("value",)
) -> DataFrame:
    """Process an extract and store it as a new version of `table`, in one job, and return it as read back.

    Raises ValueError when the extract or what was made of it had no rows, or a column in `known` no
    value in the extract. Readers of `table` then still see the version before.
    """
    spark = extract.sparkSession
    taken = guard(extract, what, known)
    made = guard(process(taken.frame), f"what was made of {what}")
    number = new_version(spark, table)
    made.frame.write.parquet(version_path(table, number))
    taken.check()
    made.check()
    finish_version(spark, table, number)
    return spark.read.schema(made.frame.schema).parquet(version_path(table, number))


def replot(stored: DataFrame, output: Callable[[DataFrame], DataFrame], **slice_arguments) -> DataFrame:
    """A new output of a frame stored by an earlier run; nothing is extracted or averaged again."""
    return output(sliced(stored, mode="replot", **slice_arguments))
