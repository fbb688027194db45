"""A wide machine log out of an `events` table (event_id, ts, user_id, event_type, value, props).

Stands in for a plant's log where only web events are at hand: every user is a machine, every
event a tick, and some error events are maintenance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspc.functions.predicates import micros_between
from fleetspc.operators.series import split_series
from fleetspc.schemas import RAW

MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_DAY = 86_400_000_000


def machine_log(events: DataFrame, *, cuts=None) -> DataFrame:
    """Wide log of schema RAW. `cuts` is over (user_id)."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    ticks = events.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
    ticks = ticks.withColumn("maint", (F.col("event_type") == "error") & (F.col("k") % 4 == 0))
    s = split_series(ticks, ["user_id"], cuts)
    up = s.window("ts", "event_id")
    down = s.window(F.col("ts").desc(), F.col("event_id").desc())
    maint_ts = F.when(F.col("maint"), F.col("ts"))
    so_far = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Later rows are read as earlier rows of the reversed order: a frame that grows row by row.
    later = down.rowsBetween(Window.unboundedPreceding, -1)
    rows = s.rows.withColumns(
        {
            "last_maint": F.max(maint_ts).over(so_far),
            "first_ts": F.first("ts").over(so_far),
            "next_maint": F.lead("maint").over(up),
            "next_ts": F.min(maint_ts).over(later),
        }
    )
    if s.split:
        before, after = Window.unboundedPreceding, -1
        rows = s.carry(
            rows,
            {
                "_first": F.min("ts"),
                "_first_maint": F.min(maint_ts),
                "_last_maint": F.max(maint_ts),
                "_head": F.min(F.struct("ts", "event_id", "maint")),
            },
            {
                "_series_first": lambda up, down: F.min("_first").over(up.rowsBetween(before, after)),
                "_before_maint": lambda up, down: F.max("_last_maint").over(up.rowsBetween(before, after)),
                "_after_maint": lambda up, down: F.min("_first_maint").over(down.rowsBetween(before, after)),
                "_next_head": lambda up, down: F.lead("_head").over(up)["maint"],
            },
        )
        rows = rows.withColumns(
            {
                "last_maint": F.coalesce("last_maint", "_before_maint"),
                "first_ts": F.coalesce("_series_first", "first_ts"),
                "next_maint": F.coalesce("next_maint", "_next_head"),
                "next_ts": F.coalesce("next_ts", "_after_maint"),
            }
        )
    base_ts = F.coalesce("last_maint", "first_ts")
    k = F.col("k")
    kinds = (
        F.when(F.col("user_id") % 4 == 0, "CNC")
        .when(F.col("user_id") % 4 == 1, "Pump")
        .when(F.col("user_id") % 4 == 2, "Compressor")
        .otherwise("Robotic Arm")
    )
    modes = F.when(k % 10 < 7, "normal").when(k % 10 < 9, "peak").otherwise("idle")
    ahead = micros_between("ts", "next_ts")
    return rows.select(
        F.col("ts").alias("timestamp"),
        F.col("user_id").alias("machine_id"),
        kinds.alias("machine_type"),
        modes.alias("operating_mode"),
        (micros_between(base_ts, "ts") / F.lit(float(MICROS_PER_HOUR))).alias("hours_since_maintenance"),
        F.when(ahead <= MICROS_PER_DAY, 1).otherwise(0).alias("failure_within_24h"),
        (ahead / F.lit(float(MICROS_PER_HOUR))).alias("rul_hours"),
        F.when(F.col("next_maint"), F.concat(F.lit("F"), (k % 3).cast("string"))).otherwise("none").alias("failure_type"),
        F.col("value").alias("vibration_rms"),
        (40 + k).cast("double").alias("temperature_motor"),
        F.when(k % 7 != 0, F.col("value") / (1 + k)).alias("current_phase_avg"),
        ((2 * k).cast("double") - F.col("value") * 0.1).alias("pressure_level"),
        (1000 + 10 * k).cast("double").alias("rpm"),
        (20 + F.col("event_id") % 10).cast("double").alias("ambient_temp"),
    ).select(RAW.fieldNames())
