"""From the wide machine log to the long sensor table, the control limits and the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspc.functions.predicates import is_normal
from fleetspc.schemas import (
    CHART_KEYS,
    ENTITY_GROUPS,
    ENTITY_KEYS,
    LIMITS,
    LONG,
    SENSORS,
    TICK_COLUMNS,
    require_columns,
)


def nan_to_null(column: str) -> Column:
    return F.when(~F.isnan(column), F.col(column)).alias(column)


def derive_entity(raw: DataFrame) -> DataFrame:
    """Add `entity_group` and `entity`.

    A machine type without an entry keeps its name. The machine id is padded to two digits and
    never shortened.
    """
    require_columns(raw, ["machine_type", "machine_id"], "derive_entity")
    names = F.create_map(*[F.lit(x) for pair in ENTITY_GROUPS.items() for x in pair])
    group = F.coalesce(names[F.col("machine_type")], F.col("machine_type"))
    number = F.col("machine_id").cast("string")
    padded = F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)
    return raw.withColumn("entity_group", group).withColumn(
        "entity", F.concat(F.col("entity_group"), padded)
    )


def unpivot_sensors(wide: DataFrame) -> DataFrame:
    """One row per (tick, sensor); readings that are NULL or NaN are left out."""
    require_columns(wide, ["timestamp", *TICK_COLUMNS[1:], *SENSORS], "unpivot_sensors")
    ids = [
        F.col("timestamp").cast("timestamp_ntz").alias("ts"),
        "entity",
        "entity_group",
        "operating_mode",
        nan_to_null("hours_since_maintenance"),
        "failure_within_24h",
        nan_to_null("rul_hours"),
        "failure_type",
    ]
    readings = [F.col(s).cast("double").alias(s) for s in SENSORS]
    long = wide.select(*ids, *readings).unpivot(TICK_COLUMNS, SENSORS, "sensor", "value")
    kept = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return kept.select(LONG.fieldNames())


def deal_ticks(wide: DataFrame, tasks: int | None = None) -> DataFrame:
    """The log range-partitioned by group, day, entity and time.

    Readings made of dealt ticks need no shuffle of their own, which would move every tick once per sensor.
    """
    order = ["entity_group", F.to_date("timestamp"), "entity", "timestamp"]
    return wide.repartitionByRange(tasks, *order) if tasks else wide.repartitionByRange(*order)


def spc_limits(long: DataFrame) -> DataFrame:
    """Three-sigma limits per (entity_group, sensor) from normal-mode readings.

    The deviation is the sample one, NULL for a single reading. NULL keys have no limits.
    """
    require_columns(long, [*CHART_KEYS, "operating_mode", "value"], "spc_limits")
    known = F.col("entity_group").isNotNull() & F.col("sensor").isNotNull()
    return _limits(
        long.where(is_normal() & known)
        .groupBy(*CHART_KEYS)
        .agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    )


def _limits(moments: DataFrame) -> DataFrame:
    mean, std = F.col("mean"), F.col("std")
    return moments.select(
        *CHART_KEYS,
        mean,
        std,
        (mean + 3 * std).alias("ucl"),
        mean.alias("centerline"),
        (mean - 3 * std).alias("lcl"),
    ).select(LIMITS.fieldNames())


def limits_of_moments(moments: DataFrame) -> DataFrame:
    """spc_limits out of (CHART_KEYS, n, mean, squares), squares being the sum of squared deviations."""
    std = F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1)))
    return _limits(moments.withColumn("std", std))


def entities_by_group(long: DataFrame) -> DataFrame:
    """Distinct (entity_group, entity). One row per pair, so a group may be of any size."""
    return long.select(*ENTITY_KEYS).distinct()


def catalog(long: DataFrame) -> DataFrame:
    """Distinct names in the long table as rows (kind, entity_group, name).

    Kinds: entity_group, entity, sensor, and group_entity for the entities of each group.
    Distinct triples are formed once, in one scan; the four lists come from those.
    """
    triples = long.select("entity_group", "entity", "sensor").distinct()
    facts = F.array(
        F.struct(F.lit("entity_group").alias("kind"), F.lit(None).cast("string").alias("of"), F.col("entity_group").alias("name")),
        F.struct(F.lit("entity").alias("kind"), F.lit(None).cast("string").alias("of"), F.col("entity").alias("name")),
        F.struct(F.lit("sensor").alias("kind"), F.lit(None).cast("string").alias("of"), F.col("sensor").alias("name")),
        F.struct(F.lit("group_entity").alias("kind"), F.col("entity_group").alias("of"), F.col("entity").alias("name")),
    )
    return (
        triples.select(F.explode(facts).alias("f"))
        .select("f.kind", F.col("f.of").alias("entity_group"), "f.name")
        .distinct()
    )
