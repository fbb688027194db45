"""Readings met with many time ranges at once, each reading entering the join once.

The ranges of a key may overlap in any way. Their bounds cut the key's time into disjoint segments
(gaps that no range covers are left out), and a segment lists the ranges that cover it. A reading
lies in one segment of its key or in none, and meets that segment's ranges.

Segments are found by equality on the key and a time bin. Each key has bins of its own width, such
that it has as many bins as segments and gaps, n of them: they take 2 * n + 1 rows at most, be
its ranges long or short, and readings are never copied to several bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspc.functions.predicates import micros_between, micros_of
from fleetspc.sources.workspace import materialize

MICROS_PER_HOUR = 3_600_000_000
# Ranges, or pairs of a segment and a range that covers it, that one task lists.
RANGES_PER_TASK = 50_000
# Rows of segments up to which the planner may choose to broadcast them.
BROADCAST_ROWS = 200_000
_MICROSECOND = "interval '0.000001' second"


def _dealt(rows: DataFrame, number: int, by: Sequence[str]) -> DataFrame:
    """Rows dealt to as many tasks as `number` rows take; left to the planner where one is enough."""
    tasks = -(-number // RANGES_PER_TASK)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(tasks, cores), *by) if tasks > 1 else rows


def range_segments(ranges: DataFrame, keys: Sequence[str], least_hours: float = 1.0) -> DataFrame:
    """Disjoint segments (keys, from_ts, to_ts, ranges) of half-open ranges (keys, start_ts, end_ts, ...).

    `_origin` and `_width` say where the bins of the key begin and how wide they are.

    `ranges` of a segment is an array of the other columns of the ranges that cover it. Both bounds
    are given; empty ranges cover nothing. Key columns are not NULL. A range is counted through
    the segments it covers, so the work is the number of (segment, range) pairs. Lists are made by tasks whose
    number follows from that of the ranges and pairs.
    """
    carried = [c for c in ranges.columns if c not in (*keys, "start_ts", "end_ts")]
    proper = materialize(
        ranges.where(F.col("start_ts") < F.col("end_ts")).select(*keys, "start_ts", "end_ts", F.struct(*carried).alias("_range")),
        "ranges",
    )
    # One row per key with its bounds in order, and the bins that suit their number.
    bounds = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("start_ts", "end_ts")))))
    number = proper.count()
    of_key = _dealt(proper, number, keys).groupBy(*keys).agg(bounds.alias("_bounds"))
    first, last, n = F.element_at("_bounds", 1), F.element_at("_bounds", -1), F.size("_bounds") - 1
    width = F.greatest(F.ceil(micros_between(first, last) / n), F.lit(least_hours * MICROS_PER_HOUR)).cast("long")
    between = F.transform("_bounds", lambda t, i: F.struct(t.alias("from_ts"), F.get("_bounds", i + 1).alias("to_ts")))
    places = of_key.select(*keys, micros_of(first).alias("_origin"), width.alias("_width"), F.posexplode(between).alias("_place", "_b"))
    places = places.select(*keys, "_origin", "_width", "_place", "_b.from_ts", "_b.to_ts")

    # A broadcast is chosen by compressed size, which says little about the rows that a task then holds.
    if number > RANGES_PER_TASK:
        places = places.hint("merge")

    def place_of(bound: str) -> DataFrame:
        return places.select(*keys, F.col("from_ts").alias(bound), F.col("_place").alias(f"_{bound}"))

    placed = proper.join(place_of("start_ts"), [*keys, "start_ts"]).join(place_of("end_ts"), [*keys, "end_ts"])
    if number > RANGES_PER_TASK:
        placed = materialize(placed.select(*keys, "_start_ts", "_end_ts", "_range"), "placed-ranges")
        number = placed.agg(F.sum(F.col("_end_ts") - F.col("_start_ts"))).first()[0]
    covering = placed.select(
        *keys, F.explode(F.sequence(F.col("_start_ts"), F.col("_end_ts") - 1)).alias("_place"), "_range"
    )
    covering = _dealt(covering, number, [*keys, "_place"])
    listed = covering.groupBy(*keys, "_place").agg(F.collect_list("_range").alias("ranges"))
    return listed.join(places, [*keys, "_place"]).drop("_place")


def _bin(ts: str) -> Column:
    return F.floor((micros_of(ts) - F.col("_origin")) / F.col("_width"))


def binned_segments(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Segments with one row per bin they touch, as a written table."""
    spread = segments.withColumn("_last", F.expr(f"to_ts - {_MICROSECOND}"))
    spread = spread.withColumn("_bin", F.explode(F.sequence(_bin("from_ts"), _bin("_last"))))
    # Names that no reading has.
    named = spread.select(
        *keys, "_origin", "_width", "_bin", F.col("from_ts").alias("_from"), F.col("to_ts").alias("_to"), F.col("ranges").alias("_ranges")
    )
    return materialize(named, "segments")


def match_segments(rows: DataFrame, ranges: DataFrame, keys: Sequence[str], *, least_hours: float = 1.0, tasks: int | None = None) -> DataFrame:
    """`rows` (keys, ts, ...) once per range of their key that holds them, with the range's other columns.

    Both joins are equalities, the first of them on the keys alone: where those are folders of a
    stored table, only the folders of keys that have ranges are opened. `tasks`, see series.tasks_for, is how many
    tasks the readings are dealt to where there are too many segments for each task to have them all.
    """
    spread = binned_segments(range_segments(ranges, keys, least_hours), keys)
    # A bin's width is positive; that is stated so that the planner prunes folders by it.
    grid = spread.where(F.col("_width") > 0).select(*keys, "_origin", "_width").distinct()
    met = rows.join(grid, list(keys)).withColumn("_bin", _bin("ts"))
    if tasks and spread.count() > BROADCAST_ROWS:
        met, spread = met.repartition(tasks, *keys, "_bin"), spread.hint("merge")
    met = met.join(spread.drop("_origin", "_width"), [*keys, "_bin"]).where((F.col("ts") >= F.col("_from")) & (F.col("ts") < F.col("_to")))
    return met.select(*rows.columns, F.inline("_ranges"))


def closed_end(column: str) -> Column:
    """End of a half-open range that holds all up to and including the bound."""
    return F.expr(f"{column} + {_MICROSECOND}")
