"""Set-up: from a wide log to the stored tables every question reads."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspc.operators.extents import counts_of_extents, extents, extents_of_log, read_extents, write_extents
from fleetspc.operators.ingest import deal_ticks, derive_entity, spc_limits, unpivot_sensors
from fleetspc.operators.series import LongSeries, find_long_series, tasks_for
from fleetspc.schemas import ENTITY_KEYS, SENSORS, SERIES_KEYS
from fleetspc.sources.tables import read_limits, read_long, write_dealt, write_limits
from fleetspc.sources.workspace import drop, exists, materialize


@dataclass(frozen=True)
class SensorTables:
    """The stored tables, and what is known of their series, found once for all questions.

    `extents` has the readings, first and last time of each series and day, `series` of each series. `tasks` is the
    number of tasks for windows over all readings, None where the planner may choose.
    """

    long: DataFrame
    limits: DataFrame
    extents: DataFrame
    series: DataFrame
    long_series: LongSeries | None
    long_entities: LongSeries | None
    tasks: int | None = None


# Readings that a task of the set-up sorts, or groups, and writes.
READINGS_PER_FILE = 1_500_000


def files_for(raw: DataFrame) -> int | None:
    """Number of tasks that write the readings of a log, None where the session's own number will do.

    Left to itself, a session merges tasks by their compressed size, as far as it has cores to spare; a log that
    is larger than these cores' tasks may be gets tasks by its rows. Counting a log reads parquet footers only, or
    one pass over text.
    """
    wanted = math.ceil(raw.count() * len(SENSORS) / READINGS_PER_FILE)
    return wanted if wanted > raw.sparkSession.sparkContext.defaultParallelism else None


def ingest(raw: DataFrame, folder: str, files: int | None = None) -> SensorTables:
    """Write the long table and the limits under `folder` and open them.

    The log is stored while its tables are made of it, so that what it comes from is computed once.
    """
    spark = raw.sparkSession
    wide = materialize(derive_entity(raw), "wide-log")
    files = files or files_for(wide)
    write_dealt(unpivot_sensors(deal_ticks(wide, files)), f"{folder}/sensor_data")
    write_extents(extents_of_log(wide, files), f"{folder}/sensor_extents")
    drop(wide)
    long = read_long(spark, f"{folder}/sensor_data")
    write_limits(spc_limits(long), f"{folder}/sensor_spc_limits")
    return open_tables(spark, folder)


def open_tables(spark: SparkSession, folder: str) -> SensorTables:
    """Open stored tables. Long series and long entities are found by the extents, without a scan.

    Tables stored without extents have their keys scanned once.
    """
    long, stored = read_long(spark, f"{folder}/sensor_data"), f"{folder}/sensor_extents"
    kept = read_extents(spark, stored) if exists(spark, stored) else materialize(extents(long), "extents")
    counts = materialize(counts_of_extents(kept), "series-counts")
    readings = counts.agg(F.sum("n")).first()[0] or 0
    return SensorTables(
        long=long,
        limits=read_limits(spark, f"{folder}/sensor_spc_limits"),
        extents=kept,
        series=counts,
        long_series=find_long_series(long, SERIES_KEYS, counts=counts),
        long_entities=find_long_series(long, ENTITY_KEYS, counts=counts),
        tasks=tasks_for(readings, spark.sparkContext.defaultParallelism),
    )
