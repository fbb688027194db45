"""Out-of-control rates per entity and summaries of maintenance events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspc.functions.predicates import one_sided_violation, two_sided_violation
from fleetspc.schemas import SERIES_KEYS, require_columns, with_limit_columns


def fleet_ooc_summary(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Points, out-of-control points and their percentage per (entity_group, sensor, entity).

    Counted from the raw reading, never from a stored flag. Absent limits pass. `by` adds
    leading keys such as a request id.
    """
    require_columns(df, [*SERIES_KEYS, "value", *by], "fleet_ooc_summary")
    return (
        with_limit_columns(df)
        .groupBy(*by, "entity_group", "sensor", "entity")
        .agg(
            F.count(F.lit(1)).alias("total_points"),
            F.sum(one_sided_violation().cast("long")).alias("ooc_points"),
        )
        .withColumn("percent_ooc", 100 * (F.col("ooc_points") / F.col("total_points")))
    )


def pm_event_ooc_summary(df: DataFrame) -> DataFrame:
    """One row per maintenance event with the names of the sensors out of control at it."""
    require_columns(
        df,
        [*SERIES_KEYS, "ts", "hours_pre_pm", "failure_type", "value", "ucl", "lcl"],
        "pm_event_ooc_summary",
    )
    first = F.min(F.struct("sensor", "hours_pre_pm", "failure_type"))
    named = F.collect_set(F.when(two_sided_violation(), F.col("sensor")))
    return (
        df.groupBy("entity_group", "entity", "ts")
        .agg(first.alias("first"), F.array_join(F.array_sort(named), ", ").alias("ooc_sensors"))
        .select("entity", "ts", "first.hours_pre_pm", "first.failure_type", "ooc_sensors")
    )


def pm_event_table(summary: DataFrame) -> DataFrame:
    """The event summary under the column names of the printed table."""
    require_columns(summary, ["entity", "ts", "hours_pre_pm", "failure_type", "ooc_sensors"], "pm_event_table")
    return summary.withColumnsRenamed({"ts": "timestamp", "hours_pre_pm": "hours_since_last_maintenance"})
