"""The data behind the charts: series with limits and box statistics."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspc.functions.predicates import micros_of
from fleetspc.operators.series import ROWS_PER_CHUNK
from fleetspc.schemas import CHART_KEYS, LIMIT_COLUMNS, SERIES_KEYS, require_columns, with_limit_columns
from fleetspc.sources.workspace import materialize

QUARTILES = (0.25, 0.5, 0.75)
QUARTILE_NAMES = ("q1", "median", "q3")
BOX_KEYS = ["entity_group", "sensor", "entity"]

# Columns of a chart: eight inches at a hundred dots.
PIXELS = 800


def chart_rows(df: DataFrame, entity_group=None, sensor=None, entity=None) -> DataFrame:
    """Rows of one chart; an argument that is not given does not filter."""
    named = {"entity_group": entity_group, "sensor": sensor, "entity": entity}
    for column, wanted in named.items():
        if wanted is not None:
            df = df.where(F.col(column) == wanted)
    return df


def latest_limits(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Last limit by ts that is not NULL, each limit on its own, per chart."""
    df = with_limit_columns(df)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c) for c in LIMIT_COLUMNS]
    return df.groupBy(*(by or CHART_KEYS)).agg(*last)


def _with_chart_limits(df: DataFrame, by: list[str]) -> DataFrame:
    """Replace the limits of each row by those of its chart.

    The limits are one row per chart, written and read back, so the join is a broadcast while
    that table is small and moves the rows only when it is not.
    """
    limits = materialize(latest_limits(df, by), "chart-limits")
    return df.drop(*LIMIT_COLUMNS).join(limits, by, "left")


def _violation() -> Column:
    return F.coalesce(F.col("spc_violation"), F.lit(False)).alias("violation")


def spc_chart_series(df: DataFrame, entity_group=None, entity=None, sensor=None) -> DataFrame:
    """Raw and averaged points of an entity's sensor, flagged, with the chart's limits."""
    require_columns(df, [*SERIES_KEYS, "ts", "value", "ewma"], "spc_chart_series")
    rows = _flagged(chart_rows(df, entity_group, sensor, entity))
    return _with_chart_limits(rows, SERIES_KEYS).select(
        *SERIES_KEYS, "ts", "value", "ewma", _violation(), *LIMIT_COLUMNS
    )


def fleet_trend_series(df: DataFrame, entity_group=None, sensor=None) -> DataFrame:
    """Averaged trace of every entity; a flagged raw reading marks the average at its tick."""
    require_columns(df, [*SERIES_KEYS, "ts", "value", "ewma"], "fleet_trend_series")
    rows = _flagged(chart_rows(df, entity_group, sensor))
    marked = F.when(F.col("spc_violation"), F.col("ewma")).alias("violation_ewma")
    return _with_chart_limits(rows, CHART_KEYS).select(
        *SERIES_KEYS, "ts", "value", "ewma", marked, *LIMIT_COLUMNS
    )


def drawn_points(
    series: DataFrame, y: str, *, pixels: int = PIXELS, axis: list[str] | None = None, ts_range: tuple | None = None
) -> DataFrame:
    """The points of a chart that show: (series, pixel, ts, y, violation), each point once.

    `series` are rows of spc_chart_series or fleet_trend_series. The time axis is cut into at most
    `pixels` columns of equal width. Of the points in a column that are no violations, the first,
    the last, the least and the greatest stay, which draw the same line as all of them; of equal
    ones the earliest is the least and the latest the greatest. Every violation stays. So what is
    drawn is bounded by the width of the chart and the violations, however long a series is.

    The axis runs from the first to the last reading of a chart, `axis` being its keys (one series
    unless given, CHART_KEYS for a fleet), or over `ts_range`, whose bounds belong to it; readings
    outside it are not drawn. Points without `y` or time are not drawn; they end no axis if their
    time is known. NULL keys are keys.

    One aggregate that is combined before its shuffle: rows leave a task as points of columns.
    """
    require_columns(series, [*SERIES_KEYS, "ts", y], "drawn_points")
    if pixels < 1:
        raise ValueError("pixels must be at least 1")
    marked = F.col("violation_ewma").isNotNull() if "violation_ewma" in series.columns else F.coalesce("violation", F.lit(False))
    time = micros_of(F.col("ts"))
    rows = series.select(*SERIES_KEYS, "ts", F.col(y).alias("_y"), marked.alias("violation"))
    if ts_range is not None:
        low, high = (micros_of(F.lit(bound).cast("timestamp_ntz")) for bound in ts_range)
        rows = rows.where(F.col("ts").between(*[F.lit(bound).cast("timestamp_ntz") for bound in ts_range]))
    else:
        axis = list(axis or SERIES_KEYS)
        ends = series.groupBy(*axis).agg(F.min(time).alias("_low"), F.max(time).alias("_high"))
        # Stored, so that its size is known to the planner.
        ends = materialize(ends.select(*[F.col(c).alias(f"_{c}") for c in axis], "_low", "_high"), "chart-axes")
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in axis]
        rows = rows.join(ends, reduce(and_, same))
        low, high = F.col("_low"), F.col("_high")
    # Rounded up, so that the last reading falls into the last column and products cannot overflow.
    width = F.floor((high - low) / pixels) + 1
    point = F.struct(F.col("ts").alias("ts"), F.col("_y").alias("y"))
    height = F.struct(F.col("_y").alias("y"), F.col("ts").alias("ts"))
    placed = rows.where(F.col("_y").isNotNull() & F.col("ts").isNotNull()).select(
        *SERIES_KEYS, F.floor((time - low) / width).cast("long").alias("pixel"), "ts", "_y",
        # A violation is a group of its own.
        F.when(F.col("violation"), point).alias("_violation"),
    )
    columns = placed.groupBy(*SERIES_KEYS, "pixel", "_violation").agg(
        F.min(point).alias("_first"), F.max(point).alias("_last"), F.min(height).alias("_least"), F.max(height).alias("_greatest")
    )
    heights = [F.struct(F.col(c)["ts"].alias("ts"), F.col(c)["y"].alias("y")) for c in ("_least", "_greatest")]
    shown = F.explode(F.array_distinct(F.array("_first", "_last", *heights))).alias("_point")
    drawn = columns.select(*SERIES_KEYS, "pixel", F.col("_violation").isNotNull().alias("violation"), shown)
    return drawn.select(*SERIES_KEYS, "pixel", F.col("_point")["ts"].alias("ts"), F.col("_point")["y"].alias(y), "violation")


def _flagged(df: DataFrame) -> DataFrame:
    return df if "spc_violation" in df.columns else df.withColumn("spc_violation", F.lit(False))


def _box_rows(df: DataFrame, show_ewma: bool) -> DataFrame:
    measure = "ewma" if show_ewma and "ewma" in df.columns else "value"
    require_columns(df, [*BOX_KEYS, measure], "box statistics")
    return df.where(F.col(measure).isNotNull()).select(
        *BOX_KEYS, *[c for c in ("ts",) if c in df.columns], F.col(measure).alias("y")
    )


def _between(low: Column, high: Column, at: Column) -> Column:
    """Linear interpolation at the fractional rank `at` between its two neighbours."""
    return low + (high - low) * (at - F.floor(at))


def _with_quartiles_by_sorting(rows: DataFrame) -> DataFrame:
    """Rows with q1, median, q3 of their group, from one sort of the group that may spill.

    All of it, and the statistics on top, share one shuffle by group.
    """
    group = Window.partitionBy(*BOX_KEYS)
    ranked = rows.withColumn("_rank", F.row_number().over(group.orderBy("y")) - 1)
    ranked = ranked.withColumn("_n", F.count(F.lit(1)).over(group))

    def quartile(p: float) -> Column:
        at = (F.col("_n") - 1) * p
        low, high = (
            F.max(F.when(F.col("_rank") == f(at), F.col("y"))).over(group) for f in (F.floor, F.ceil)
        )
        return _between(low, high, at)

    named = {n: quartile(p) for p, n in zip(QUARTILES, QUARTILE_NAMES)}
    return ranked.withColumns(named).drop("_rank", "_n")


def _quartiles_by_counting(rows: DataFrame, accuracy: int = 100_000) -> DataFrame:
    """One row per group with q1, median, q3, for groups too large to be sorted in one task.

    A bounded sketch proposes splitters close around each quartile. Exact counts between the
    splitters tell in which interval a wanted rank lies, and only the readings of those
    intervals are ranked. The sketch decides how much is ranked, never the result.
    """
    near = 2.0 / accuracy
    around = sorted({min(1.0, max(0.0, p + d)) for p in QUARTILES for d in (-near, near)})
    proposed = F.percentile_approx("y", F.array(*[F.lit(p) for p in around]), F.lit(accuracy))
    splitters = materialize(
        rows.groupBy(*BOX_KEYS).agg(proposed.alias("splitters"), F.count(F.lit(1)).alias("n")),
        "box-splitters",
    )
    same = [rows[k].eqNullSafe(splitters[k]) for k in BOX_KEYS]
    interval = sum((F.col("y") >= F.col("splitters")[i]).cast("int") for i in range(len(around)))
    placed = rows.join(splitters, same, "inner").select(
        *[rows[k] for k in BOX_KEYS], "y", "n", interval.alias("interval")
    )

    # One row per group and interval; at most len(around) + 1 of them in a group.
    in_group = Window.partitionBy(*BOX_KEYS).orderBy("interval")
    counts = placed.groupBy(*BOX_KEYS, "interval").agg(
        F.count(F.lit(1)).alias("held"), F.max("n").alias("n")
    )
    counts = counts.withColumn("below", F.sum("held").over(in_group) - F.col("held"))
    ranks = F.array(*[f((F.col("n") - 1) * p) for p in QUARTILES for f in (F.floor, F.ceil)])
    wanted = counts.withColumn(
        "ranks", F.filter(ranks, lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("held")))
    ).where(F.size("ranks") > 0)
    wanted = materialize(wanted.select(*BOX_KEYS, "interval", "n", "below", "ranks"), "box-intervals")

    here = [placed[k].eqNullSafe(wanted[k]) for k in BOX_KEYS]
    distinct = (
        placed.join(wanted, [*here, placed["interval"] == wanted["interval"]], "inner")
        .groupBy(*[placed[k] for k in BOX_KEYS], wanted["interval"], "below", "ranks", wanted["n"], "y")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    upwards = Window.partitionBy(*BOX_KEYS, "interval").orderBy("y")
    distinct = distinct.withColumn("upto", F.col("below") + F.sum("copies").over(upwards))
    hit = distinct.withColumn(
        "hits",
        F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("copies"))),
    ).where(F.size("hits") > 0)

    def quartile(p: float) -> Column:
        def ranked(rank: Column) -> Column:
            return F.max(F.when(F.array_contains("hits", rank), F.col("y")))

        at = (F.col("n") - 1) * p
        return _between(ranked(F.floor(at)), ranked(F.ceil(at)), (F.max("n") - 1) * p)

    return hit.groupBy(*BOX_KEYS).agg(*[quartile(p).alias(n) for p, n in zip(QUARTILES, QUARTILE_NAMES)])


def _with_fences(rows: DataFrame, long: DataFrame | None) -> DataFrame:
    """Rows with the quartiles and 1.5-IQR fences of their entity."""
    if long is None:
        boxed = _with_quartiles_by_sorting(rows)
    else:
        is_long = [rows[k].eqNullSafe(long[k]) for k in BOX_KEYS]
        few, many = rows.join(long, is_long, "left_anti"), rows.join(long, is_long, "left_semi")
        box = materialize(_quartiles_by_counting(many), "box-quartiles")
        same = [many[k].eqNullSafe(box[k]) for k in BOX_KEYS]
        counted = many.join(box, same, "inner").select(*[many[c] for c in rows.columns], *QUARTILE_NAMES)
        boxed = _with_quartiles_by_sorting(few).unionByName(counted)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return boxed.withColumns({"fence_low": F.col("q1") - reach, "fence_high": F.col("q3") + reach})


def _long_groups(rows: DataFrame, cuts) -> DataFrame | None:
    """Keys of the groups too large to be sorted in one task, as a written table; None if none."""
    if not isinstance(cuts, str):
        return cuts[0] if cuts else None
    counted = rows.groupBy(*BOX_KEYS).count().where(F.col("count") > ROWS_PER_CHUNK)
    table = materialize(counted.select(*BOX_KEYS), "long-groups")
    return None if table.isEmpty() else table


def _boxed(df: DataFrame, entity_group, sensor, show_ewma: bool, cuts) -> DataFrame:
    chart = chart_rows(df, entity_group, sensor)
    return _with_fences(_box_rows(chart, show_ewma), _long_groups(chart, cuts))


def fleet_boxplot_stats(df: DataFrame, entity_group=None, sensor=None, *, show_ewma: bool = False, cuts=None) -> DataFrame:
    """Per entity: count, quartiles, whiskers and number of outliers.

    Whiskers end at the furthest reading within 1.5 IQR of the box, and at the box when no
    reading lies beyond it. `cuts` is over (entity_group, entity, sensor) and says which
    groups are too large to be sorted in one task; FIND counts them.
    """
    fenced = _boxed(df, entity_group, sensor, show_ewma, cuts)
    y, low, high = F.col("y"), F.col("fence_low"), F.col("fence_high")
    reached_low, reached_high = F.min(F.when(y >= low, y)), F.max(F.when(y <= high, y))
    return (
        fenced.groupBy(*BOX_KEYS)
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.max(c).alias(c) for c in QUARTILE_NAMES],
            reached_low.alias("whisker_low"),
            reached_high.alias("whisker_high"),
            F.sum(((y < low) | (y > high)).cast("long")).alias("outliers"),
        )
        .withColumn("whisker_low", F.least("q1", F.coalesce("whisker_low", "q1")))
        .withColumn("whisker_high", F.greatest("q3", F.coalesce("whisker_high", "q3")))
    )


def fleet_boxplot_chart(df: DataFrame, entity_group=None, sensor=None, *, show_ewma: bool = False, cuts=None) -> DataFrame:
    """fleet_boxplot_stats with the limit lines of the chart: the last limits of its group and sensor."""
    boxes = fleet_boxplot_stats(df, entity_group, sensor, show_ewma=show_ewma, cuts=cuts)
    limits = materialize(latest_limits(chart_rows(df, entity_group, sensor)), "chart-limits")
    same = [boxes[k].eqNullSafe(limits[k]) for k in CHART_KEYS]
    return boxes.join(limits, same, "left").select(*[boxes[c] for c in boxes.columns], *LIMIT_COLUMNS)


def fleet_boxplot_outliers(df: DataFrame, entity_group=None, sensor=None, *, show_ewma: bool = False, cuts=None) -> DataFrame:
    """The readings beyond the whiskers, one row each."""
    fenced = _boxed(df, entity_group, sensor, show_ewma, cuts)
    beyond = (F.col("y") < F.col("fence_low")) | (F.col("y") > F.col("fence_high"))
    return fenced.where(beyond).drop(*QUARTILE_NAMES, "fence_low", "fence_high")
