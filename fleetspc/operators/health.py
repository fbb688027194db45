"""Health of every sensor of every entity: latest state, recent violations and trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspc.functions.predicates import micros_between, sigma_from_limits, two_sided_violation
from fleetspc.operators.ewma import check_alpha
from fleetspc.operators.series import split_series
from fleetspc.schemas import LIMIT_COLUMNS, SERIES_KEYS, require_columns

MICROS_PER_DAY = 86_400_000_000


def _newest_first() -> list[Column]:
    return [F.col("ts").desc(), F.col("value").desc()]


def _with_age(df: DataFrame, cuts, within: tuple[str, ...], tasks: int | None) -> DataFrame:
    """Add `_age`, the number of newer readings in the series, and `_last_ts`."""
    s = split_series(df, SERIES_KEYS, cuts, within, tasks)
    w = s.window(*_newest_first())
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = s.rows.withColumns(
        {"_age": F.row_number().over(w).cast("long") - 1, "_last_ts": F.first("ts").over(so_far)}
    )
    if s.split:
        newer = lambda up, down: F.sum("_rows").over(down.rowsBetween(Window.unboundedPreceding, -1))
        last = lambda up, down: F.max("_chunk_last").over(down.rowsBetween(Window.unboundedPreceding, -1))
        rows = s.carry(
            rows,
            {"_rows": F.count(F.lit(1)), "_chunk_last": F.max("ts")},
            {"_newer": newer, "_series_last": last},
        )
        rows = rows.withColumns(
            {
                "_age": F.col("_age") + F.coalesce(F.col("_newer"), F.lit(0)),
                "_last_ts": F.coalesce(F.col("_series_last"), F.col("_last_ts")),
            }
        )
    return rows.select(*df.columns, "_age", "_last_ts")


def multi_sensor_health(
    df: DataFrame,
    *,
    window_days: int = 2,
    ewma_alpha: float = 0.2,
    stable_slope_z_per_day: float = 0.8,
    drifting_slope_z_per_day: float = 1.0,
    volatile_ooc_rate: float = 0.05,
    slope_window_hours: int = 24,
    cuts=None,
    tasks: int | None = None,
) -> DataFrame:
    """One row per (entity_group, entity, sensor) with z-score, violation rate, slope and label.

    Both averages are needed at the newest reading only, so each is a weighted sum over ages:
    the reading of age j weighs alpha * (1 - alpha)**j, the oldest one (1 - alpha)**j. The
    average over the whole series is not restarted by maintenance. The average behind the slope
    starts at the first reading of the slope window. Readings that are NULL are left out.
    """
    require_columns(df, [*SERIES_KEYS, "ts", "value", *LIMIT_COLUMNS], "multi_sensor_health")
    window_days, slope_window_hours = int(window_days), int(slope_window_hours)
    return _health(
        df,
        {
            "ewma_alpha": F.lit(check_alpha(ewma_alpha)),
            "window_days": F.lit(window_days),
            "slope_window_hours": F.lit(slope_window_hours),
            "stable_slope_z_per_day": F.lit(float(stable_slope_z_per_day)),
            "drifting_slope_z_per_day": F.lit(float(drifting_slope_z_per_day)),
            "volatile_ooc_rate": F.lit(float(volatile_ooc_rate)),
        },
        f"ooc_rate_{window_days}d",
        f"ewma_slope_z_per_day_{slope_window_hours}h",
        cuts,
        tasks=tasks,
    )


# The parameters of health and their usual values.
HEALTH_PARAMETERS = {
    "window_days": 2,
    "ewma_alpha": 0.2,
    "stable_slope_z_per_day": 0.8,
    "drifting_slope_z_per_day": 1.0,
    "volatile_ooc_rate": 0.05,
    "slope_window_hours": 24,
}


def health_within(df: DataFrame, within: tuple[str, ...], *, cuts=None, tasks: int | None = None) -> DataFrame:
    """multi_sensor_health of what `within`, such as a request id, makes of a series.

    The columns of HEALTH_PARAMETERS hold the parameters of each row; within a series they are the
    same. The rate and the slope are called `ooc_rate` and `ewma_slope_z_per_day`, as their windows
    differ from row to row.
    """
    require_columns(df, [*within, *SERIES_KEYS, "ts", "value", *LIMIT_COLUMNS, *HEALTH_PARAMETERS], "health_within")
    parameters = {c: F.col(c) for c in HEALTH_PARAMETERS}
    return _health(df, parameters, "ooc_rate", "ewma_slope_z_per_day", cuts, within, tasks)


def _health(df: DataFrame, parameters: dict[str, Column], ooc_rate: str, slope: str, cuts, within: tuple[str, ...] = (), tasks: int | None = None) -> DataFrame:
    """Parameters are literals, or columns that come along as keys of the aggregate."""
    carried = list(parameters) if within else []
    alpha = check_alpha(parameters["ewma_alpha"]) if within else parameters["ewma_alpha"]
    age, value, decay = F.col("_age"), F.col("value"), F.lit(1.0) - alpha

    rows = (
        df.select(*within, *carried, *SERIES_KEYS, "ts", "value", *LIMIT_COLUMNS)
        .where(value.isNotNull())
        .transform(_with_age, cuts, within, tasks)
        .withColumns({"_sigma": sigma_from_limits(), "_ooc": two_sided_violation().cast("double")})
    )
    in_slope = F.col("ts") >= F.col("_last_ts") - F.make_dt_interval(F.lit(0), parameters["slope_window_hours"])
    recent = F.col("ts") >= F.col("_last_ts") - F.make_dt_interval(parameters["window_days"])
    weighted = alpha * F.pow(decay, age.cast("double")) * value

    def at_newest(column: str) -> Column:
        return F.max(F.when(age == 0, F.col(column)))

    # The keys come first: what brought a series together serves this aggregate too.
    sums = rows.groupBy(*within, *SERIES_KEYS, *carried).agg(
        at_newest("value").alias("latest_value"),
        at_newest("centerline").alias("centerline"),
        at_newest("_sigma").alias("std"),
        F.sum(weighted).alias("sum_all"),
        F.max(age).alias("oldest"),
        F.max_by("value", age).alias("oldest_value"),
        F.avg(F.when(recent, F.col("_ooc"))).alias(ooc_rate),
        F.sum(F.when(in_slope, weighted)).alias("slope_sum"),
        F.max(F.when(in_slope, age)).alias("slope_oldest"),
        F.max_by("value", F.when(in_slope, age)).alias("slope_first"),
        F.min(F.when(in_slope, F.col("ts"))).alias("slope_start"),
        F.max("ts").alias("last_ts"),
    )

    def average(total: str, oldest: str, oldest_value: str) -> Column:
        rest = decay * F.pow(decay, F.col(oldest).cast("double")) * F.col(oldest_value)
        return F.col(total) + rest

    std = F.col("std")
    days = micros_between("slope_start", "last_ts") / MICROS_PER_DAY
    change = average("slope_sum", "slope_oldest", "slope_first") - F.col("slope_first")
    known = F.col("centerline").isNotNull() & std.isNotNull()
    sums = sums.withColumns(
        {
            "latest_ewma": average("sum_all", "oldest", "oldest_value"),
            slope: F.when(known & (F.col("slope_oldest") >= 1) & (days > 0), change / std / days),
        }
    ).withColumn("latest_z_score", F.when(known, (F.col("latest_ewma") - F.col("centerline")) / std))

    z, per_day = F.abs("latest_z_score"), F.col(slope)
    # The trend labels; the first rule that holds decides.
    trend = (
        F.when(z > 3.0, "ooc")
        .when(per_day >= parameters["drifting_slope_z_per_day"], "drifting_up")
        .when(per_day <= -parameters["drifting_slope_z_per_day"], "drifting_down")
        .when(F.col(ooc_rate) >= parameters["volatile_ooc_rate"], "volatile")
        .when((F.abs(per_day) <= parameters["stable_slope_z_per_day"]) & (z.isNull() | (z <= 1.0)), "stable_baseline")
        .when(z > 1.0, "trending_baseline")
        .otherwise("stable_baseline")
    )
    status = (
        F.when(F.col("baseline_trend") == "ooc", "ooc")
        .when(F.col("baseline_trend") == "stable_baseline", "stable")
        .otherwise("attention")
    )
    return (
        sums.withColumn("baseline_trend", trend)
        .withColumn("health_status", status)
        .select(
            *within,
            *SERIES_KEYS,
            "latest_value",
            "latest_ewma",
            "centerline",
            "std",
            "latest_z_score",
            ooc_rate,
            slope,
            "baseline_trend",
            "health_status",
        )
    )


def by_severity(health: DataFrame) -> DataFrame:
    """Sort for display: ooc, attention, stable; then the largest z-score; then sensor, entity."""
    rank = (
        F.when(F.col("health_status") == "ooc", 0)
        .when(F.col("health_status") == "attention", 1)
        .when(F.col("health_status") == "stable", 2)
        .otherwise(3)
    )
    return health.orderBy(rank, F.desc_nulls_last(F.abs("latest_z_score")), "sensor", "entity")


def health_table(health: DataFrame) -> DataFrame:
    """The health summary without its working columns."""
    inner = ["latest_value", "latest_ewma", "centerline", "std"]
    require_columns(
        health,
        ["entity", "sensor", *inner, "latest_z_score", "baseline_trend", "health_status"],
        "health_table",
    )
    return health.drop(*inner)


def health_attention_flag(table: DataFrame) -> DataFrame:
    """Add `needs_attention`: the status is not stable or the trend is not the stable baseline.

    A frame with one of the two columns is judged by that one; with neither it is unchanged.
    """
    calm = {"health_status": "stable", "baseline_trend": "stable_baseline"}
    tests = [~F.col(c).eqNullSafe(v) for c, v in calm.items() if c in table.columns]
    if not tests:
        return table
    return table.withColumn("needs_attention", tests[0] if len(tests) == 1 else tests[0] | tests[1])
