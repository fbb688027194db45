"""Reading and writing the sensor tables and the result tables."""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetspc.schemas import ENTITY_KEYS, LIMITS, LONG, RAW, SERIES_KEYS


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns by name and type; NaN becomes NULL."""

    def typed(field: T.StructField):
        cell = F.col(field.name).cast(field.dataType)
        if isinstance(field.dataType, T.DoubleType):
            cell = F.nanvl(cell, F.lit(None).cast("double"))
        return cell.alias(field.name)

    return df.select([typed(f) for f in schema.fields])


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Wide machine log from CSV. Columns are taken by name and typed; nothing is inferred."""
    return _typed(spark.read.option("header", True).csv(path), RAW)


def read_raw_parquet(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark.read.parquet(path), RAW)


def read_long_csv(spark: SparkSession, path: str) -> DataFrame:
    """Long sensor table from CSV, with the time column called `timestamp` or `ts`."""
    df = spark.read.option("header", True).csv(path)
    return _typed(df.withColumnRenamed("timestamp", "ts"), LONG)


def read_limits_csv(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark.read.option("header", True).csv(path), LIMITS)


def write_long(long: DataFrame, path: str, files: int | None = None) -> None:
    """Replace the long table.

    One folder per (entity_group, sensor), the two equality filters of every fleet question.
    Rows are range-partitioned by group, sensor, day, entity and time before the write: files
    come out even however uneven the series are, and their min/max statistics are narrow in
    time and entity, so bounds on either skip row groups.
    """
    order = ["entity_group", "sensor", F.to_date("ts"), "entity", "ts"]
    ranged = long.repartitionByRange(files, *order) if files else long.repartitionByRange(*order)
    (
        ranged.sortWithinPartitions(*order)
        .write.mode("overwrite")
        .partitionBy("entity_group", "sensor")
        .parquet(path)
    )


def write_dealt(long: DataFrame, path: str) -> None:
    """Replace the long table by readings whose ticks are range-partitioned already (see ingest.deal_ticks).

    The layout is that of write_long, but for the sensor: a task has all sensors of its ticks, a file of each.
    """
    order = ["entity_group", "sensor", F.to_date("ts"), "entity", "ts"]
    long.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("entity_group", "sensor").parquet(path)


def read_long(spark: SparkSession, *paths: str) -> DataFrame:
    """The long table, or all of several ones."""
    tables = [spark.read.schema(LONG).parquet(path).select(LONG.fieldNames()) for path in paths]
    return reduce(DataFrame.union, tables)


def write_series(long: DataFrame, path: str, buckets: int) -> None:
    """Store the long table by series: what one machine measured is in one file, in order.

    Files are buckets of (entity_group, entity), so averages, health and events, whose windows are
    over series or machines, need no shuffle on the table read_series gives. `buckets` bounds how
    many tasks such a question has, and a machine is never in two of them: take a few times
    the cores, and keep write_long for tables in which one machine is larger than a task may be.
    """
    order = [*SERIES_KEYS, "ts", "hours_since_maintenance", "value"]
    name = _series_name(path)
    long.sparkSession.sql(f"drop table if exists {name}")
    # Dealt as the buckets are, so that each is written by one task.
    dealt = long.select(LONG.fieldNames()).repartition(buckets, *ENTITY_KEYS)
    writer = dealt.write.format("parquet").bucketBy(buckets, *ENTITY_KEYS).sortBy(*order)
    writer.option("path", f"{path}/files").saveAsTable(name)
    long.sparkSession.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/layout")


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """The table of write_series, from any session: its layout is declared to this one's catalog."""
    name = _series_name(path)
    if not spark.catalog.tableExists(name):
        buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in LONG.fields)
        order = ", ".join([*SERIES_KEYS, "ts", "hours_since_maintenance", "value"])
        keys = ", ".join(ENTITY_KEYS)
        spark.sql(
            f"create table {name} ({columns}) using parquet clustered by ({keys}) sorted by ({order}) into {buckets} buckets "
            f"location '{path}/files'"
        )
    return spark.table(name)


def _series_name(path: str) -> str:
    return f"series_{sha256(path.encode()).hexdigest()[:24]}"


def write_limits(limits: DataFrame, path: str) -> None:
    """Replace the limits table: one row per (entity_group, sensor)."""
    limits.write.mode("overwrite").parquet(path)


def read_limits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LIMITS).parquet(path)


def write_frame(df: DataFrame, path: str) -> DataFrame:
    """Store an extracted or processed frame and return it as read back, types kept."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_table_csv(df: DataFrame, path: str) -> None:
    """Result table as CSV with a header, in as many files as it has partitions. Times keep their microseconds."""
    times = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
    df.write.mode("overwrite").option("header", True).option("timestampNTZFormat", times).csv(path)


def write_catalog_json(catalog: DataFrame, path: str) -> None:
    catalog.write.mode("overwrite").json(path)
