"""What ingest keeps of each series and day, and what can be told from it without a scan.

A row holds the readings, the first and the last time of one series, day and kind of mode (normal
or not). That is a small part of the readings themselves, stored in the same folders as they are, so
"the last three days of these entities" or the limits beside a chart start no scan of readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspc.functions.predicates import is_normal, ts_literal, where_entity
from fleetspc.operators.extract import normal_readings
from fleetspc.schemas import CHART_KEYS, LIMIT_COLUMNS, SENSORS, SERIES_KEYS

EXTENTS = (
    "entity string, day date, normal boolean, n long, first_ts timestamp_ntz, last_ts timestamp_ntz, "
    "entity_group string, sensor string"
)


def extents(long: DataFrame) -> DataFrame:
    """One row per series, day and kind of mode; readings without a time are in a row of NULL day."""
    normal = F.coalesce(is_normal(), F.lit(False)).alias("normal")
    return long.groupBy(*SERIES_KEYS, F.to_date("ts").alias("day"), normal).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def extents_of_log(wide: DataFrame, tasks: int | None = None) -> DataFrame:
    """extents of the readings that unpivot_sensors makes of a log with entities.

    Ticks are grouped, not readings: a group holds the three figures of each sensor, so there are fewer groups by
    the number of sensors. `tasks` bounds what one task groups.
    """
    ts = F.col("timestamp").cast("timestamp_ntz")
    keys = {
        "entity_group": F.col("entity_group"), "entity": F.col("entity"), "day": F.to_date(ts),
        "normal": F.coalesce(is_normal(), F.lit(False)),
    }
    present = {s: F.col(s).cast("double").isNotNull() & ~F.isnan(F.col(s).cast("double")) for s in SENSORS}
    ticks = wide.select(*[c.alias(n) for n, c in keys.items()], ts.alias("_ts"), *[p.alias(s) for s, p in present.items()])
    if tasks:
        ticks = ticks.repartition(tasks, *keys)
    figures = []
    for s in SENSORS:
        at = F.when(F.col(s), F.col("_ts"))
        figures += [F.count_if(F.col(s)).alias(f"_n_{s}"), F.min(at).alias(f"_first_{s}"), F.max(at).alias(f"_last_{s}")]
    of_sensor = [
        F.struct(F.lit(s).alias("sensor"), F.col(f"_n_{s}").alias("n"), F.col(f"_first_{s}").alias("first_ts"), F.col(f"_last_{s}").alias("last_ts"))
        for s in SENSORS
    ]
    kept = ticks.groupBy(*keys).agg(*figures).select(*keys, F.inline(F.array(*of_sensor))).where(F.col("n") > 0)
    return kept.select(*SERIES_KEYS, "day", "normal", "n", "first_ts", "last_ts")


def write_extents(kept: DataFrame, path: str) -> None:
    """Every task writes to the folders of its rows; a folder is not brought together in one task."""
    ordered = kept.sortWithinPartitions("entity_group", "sensor", "entity", "day")
    ordered.write.mode("overwrite").partitionBy("entity_group", "sensor").parquet(path)


def read_extents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXTENTS).parquet(path)


def counts_of_extents(kept: DataFrame) -> DataFrame:
    """series_counts over SERIES_KEYS of the readings that `kept` tells of."""
    return kept.groupBy(*SERIES_KEYS).agg(
        F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
    )


def _named(kept: DataFrame, entity_group=None, entity=None, sensor=None) -> DataFrame:
    rows = kept.where("normal")
    for column, wanted in (("entity_group", entity_group), ("sensor", sensor)):
        if wanted is not None:
            rows = rows.where(F.col(column) == wanted)
    return where_entity(rows, entity)


def last_time(kept: DataFrame, long: DataFrame, *, start_ts=None, end_ts=None, until=None, **names) -> Column:
    """Last time of the normal readings of `long` with these names, start_ts <= ts < end_ts, ts <= until.

    NULL if there are none. A day that a bound cuts is the one thing extents don't know: only
    that day's readings are read, and only if a bound is given.
    """
    rows = _named(kept, **names)
    if start_ts is not None:
        rows = rows.where(F.col("last_ts") >= ts_literal(start_ts))
    bounds = [ts_literal(b) for b in (end_ts, until) if b is not None]
    if end_ts is not None:
        rows = rows.where(F.col("last_ts") < ts_literal(end_ts))
    if until is not None:
        rows = rows.where(F.col("last_ts") <= ts_literal(until))
    last = rows.agg(F.max("last_ts")).scalar()
    if not bounds:
        return last
    days = [F.date_trunc("day", b).cast("timestamp_ntz") for b in bounds]
    cut = normal_readings(long, start_ts=start_ts, end_ts=end_ts, **names)
    cut = cut.where(F.col("ts") >= (F.least(*days) if len(days) > 1 else days[0]))
    if until is not None:
        cut = cut.where(F.col("ts") <= ts_literal(until))
    return F.greatest(last, cut.agg(F.max("ts")).scalar())


def chart_limits(kept: DataFrame, limits: DataFrame, **names) -> DataFrame:
    """latest_limits of a sensor_history with these names: the limits of each chart that has readings."""
    charts = _named(kept, **names).where(F.col("day").isNotNull()).select(*CHART_KEYS).distinct()
    return charts.join(limits.select(*CHART_KEYS, *LIMIT_COLUMNS), CHART_KEYS, "left")
