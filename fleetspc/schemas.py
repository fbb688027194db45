"""Column names, table schemas, fixed values and the required-column check."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The sensor columns of the wide log.
SENSORS = [
    "vibration_rms",
    "temperature_motor",
    "current_phase_avg",
    "pressure_level",
    "rpm",
    "ambient_temp",
]

# Machine type -> entity group. Other machine types keep their own name.
ENTITY_GROUPS = {
    "CNC": "CNC",
    "Pump": "PMP",
    "Compressor": "CPR",
    "Robotic Arm": "ARM",
}

# Fixed value: the operating mode that limits, averages and flags are computed on.
NORMAL = "normal"

ENTITY_KEYS = ["entity_group", "entity"]
SERIES_KEYS = ["entity_group", "entity", "sensor"]
CHART_KEYS = ["entity_group", "sensor"]
LIMIT_COLUMNS = ["ucl", "centerline", "lcl"]

# The columns of a tick that stay beside every sensor reading, and of the tables.
TICK_COLUMNS = [
    "ts",
    "entity",
    "entity_group",
    "operating_mode",
    "hours_since_maintenance",
    "failure_within_24h",
    "rul_hours",
    "failure_type",
]

RAW = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("machine_id", T.LongType()),
        T.StructField("machine_type", T.StringType()),
        T.StructField("operating_mode", T.StringType()),
        T.StructField("hours_since_maintenance", T.DoubleType()),
        T.StructField("failure_within_24h", T.IntegerType()),
        T.StructField("rul_hours", T.DoubleType()),
        T.StructField("failure_type", T.StringType()),
        *[T.StructField(s, T.DoubleType()) for s in SENSORS],
    ]
)

LONG = T.StructType(
    [
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("entity", T.StringType()),
        T.StructField("entity_group", T.StringType()),
        T.StructField("operating_mode", T.StringType()),
        T.StructField("hours_since_maintenance", T.DoubleType()),
        T.StructField("failure_within_24h", T.IntegerType()),
        T.StructField("rul_hours", T.DoubleType()),
        T.StructField("failure_type", T.StringType()),
        T.StructField("sensor", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

LIMITS = T.StructType(
    [
        T.StructField("entity_group", T.StringType()),
        T.StructField("sensor", T.StringType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("std", T.DoubleType()),
        T.StructField("ucl", T.DoubleType()),
        T.StructField("centerline", T.DoubleType()),
        T.StructField("lcl", T.DoubleType()),
    ]
)

REQUESTS = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("entity_group", T.StringType()),
        T.StructField("entity", T.StringType()),
        T.StructField("sensor", T.StringType()),
        T.StructField("start_ts", T.TimestampNTZType()),
        T.StructField("end_ts", T.TimestampNTZType()),
    ]
)


def require_columns(df: DataFrame, columns: Iterable[str], purpose: str) -> None:
    """Raise KeyError when `df` lacks a column. Looks at metadata only, starts no job."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise KeyError(f"{purpose} needs columns {missing}; the frame has {sorted(df.columns)}")


def with_limit_columns(df: DataFrame) -> DataFrame:
    """Add the control-limit columns that are absent, as NULL."""
    absent = [c for c in LIMIT_COLUMNS if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast("double") for c in absent}) if absent else df


def assert_not_empty(df: DataFrame, what: str) -> DataFrame:
    """Raise ValueError on an empty frame. Starts a job that stops at the first row."""
    if df.isEmpty():
        raise ValueError(f"no rows in {what}")
    return df
