"""Ordered computations over series of any length.

A window function sorts one whole partition in one task, so a series that holds a large share
of all rows would end up in a single task. Here such a series is cut into time chunks: windows
run inside a chunk, each chunk is summed up in one row, and what a chunk needs to know about
its neighbours is carried over from those few rows. Series below the row limit are left whole
and cost nothing extra.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fleetspc.functions.predicates import micros_between, micros_of
from fleetspc.sources.workspace import materialize

CHUNK = "_chunk"
ROWS_PER_CHUNK = 4_000_000

# Readings that a task of a window sorts on average, where their number is known.
ROWS_PER_TASK = 500_000

# A chunk may hold this many times its share before it is cut again.
UNEVEN = 4

# Chunk of series that are not cut, and of rows without a time; sorts before all others.
WHOLE = -(2**62)

# Tables of chunk bounds: per series, then per chunk that had to be cut again.
LongSeries = list[DataFrame]

# Argument value: count the input of the operator to find the series that need cutting.
FIND = "find"

# Positions in a span at most, and spans after which every double has faded to zero.
LONGEST_SPAN = 2**40
FADED = 15

# Stands in for a NULL key column, so that chunk rows join on plain equality.
_NULL_KEY = "\u0000"


def series_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, first and last time per series."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def find_long_series(
    rows: DataFrame,
    keys: Sequence[str],
    rows_per_chunk: int = ROWS_PER_CHUNK,
    counts: DataFrame | None = None,
) -> LongSeries | None:
    """How to cut the series of `rows` that have more than `rows_per_chunk` rows; None if none.

    One partially aggregated count over the key and time columns finds them: at most
    (all rows / rows_per_chunk) can qualify. Each is cut into chunks of equal duration, the
    chunks are counted, and one that still holds more than its share, because of a burst or a
    stray timestamp, is cut again. The levels are written tables, so their exact size is known
    to the planner. They also fit any subset of `rows`. Rows of one series at one instant stay
    together. `counts`, series_counts over these or more keys, saves the first count.
    """
    levels: list[DataFrame] = []
    times = rows.select(*keys, "ts")
    while True:
        by = [*keys, CHUNK] if levels else [*keys]
        most = rows_per_chunk * (UNEVEN if levels else 1)
        placed = _place(times, keys, levels).where(F.col(CHUNK) != WHOLE) if levels else times
        if counts is not None and not levels:
            counted = counts.groupBy(*by).agg(
                F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
            )
        else:
            counted = series_counts(placed, by)
        counted = counted.where((F.col("n") > most) & (F.col("first_ts") < F.col("last_ts")))
        chunks = F.ceil(F.col("n") / F.lit(rows_per_chunk))
        span = micros_between("first_ts", "last_ts") + 1
        width = F.ceil(span / chunks).cast("long").alias("width_us")
        table = materialize(counted.select(*by, micros_of("first_ts").alias("first_us"), width), "long-series")
        if table.isEmpty():
            return levels or None
        levels.append(table)


def tasks_for(rows: int, cores: int) -> int | None:
    """Tasks for windows over `rows` rows, None where one task would do and the planner may choose.

    The planner merges tasks by their compressed size until there is one per core, so their memory grows with the
    table; these don't.
    """
    wanted = math.ceil(rows / ROWS_PER_TASK)
    return max(wanted, cores) if wanted > 1 else None


def _plain(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add key columns free of NULL, so that they join on plain equality."""
    text = {f"_by_{c}": F.coalesce(F.col(c).cast("string"), F.lit(_NULL_KEY)) for c in columns}
    return df.withColumns(text)


def _place(rows: DataFrame, keys: Sequence[str], levels: LongSeries) -> DataFrame:
    """Add the chunk of each row: the start of the chunk in microseconds, at the finest level."""
    keyed = [f"_by_{c}" for c in keys]
    rows = _plain(rows, keys)
    for depth, level in enumerate(levels):
        on = [*keyed, CHUNK] if depth else keyed
        bounds = _plain(level, keys).select(*on, "first_us", "width_us")
        steps = F.greatest(F.floor((micros_of("ts") - F.col("first_us")) / F.col("width_us")), F.lit(0))
        finer = F.col("first_us") + steps * F.col("width_us")
        coarser = F.col(CHUNK) if depth else F.lit(WHOLE)
        rows = (
            rows.join(bounds, on, "left")
            .withColumn(CHUNK, F.coalesce(finer, coarser))
            .drop("first_us", "width_us")
        )
    return rows


@dataclass(frozen=True)
class SeriesRows:
    """Rows with the columns `by` that identify one window partition."""

    rows: DataFrame
    by: list[str]
    keys: list[str]
    split: bool

    def window(self, *order: Column | str) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*order)

    def carry(
        self,
        rows: DataFrame,
        summary: dict[str, Column],
        carried: Callable[[DataFrame, WindowSpec, WindowSpec], DataFrame] | dict[str, Callable],
    ) -> DataFrame:
        """Add columns that come from the other chunks of the same series.

        `summary` aggregates a chunk to one row. `carried` turns those rows into new columns,
        by expressions of (window over chunks upwards, window over chunks downwards). Only rows
        of cut series are summed up; the condition is on a window key, so it moves below the
        windows that made `rows`. Chunks that learn nothing send no row to the join.
        """
        cut = rows.where(F.col(CHUNK) != WHOLE)
        chunks = cut.groupBy(*self.by).agg(*[c.alias(n) for n, c in summary.items()])
        series = Window.partitionBy(*self.keys)
        up, down = series.orderBy(F.col(CHUNK)), series.orderBy(F.col(CHUNK).desc())
        if callable(carried):
            chunks = carried(chunks, up, down)
            names = [c for c in chunks.columns if c not in (*self.by, *summary)]
        else:
            names = list(carried)
            chunks = chunks.select("*", *[f(up, down).alias(n) for n, f in carried.items()])
        informed = reduce(or_, [F.col(n).isNotNull() for n in names])
        return rows.join(chunks.select(*self.by, *names).where(informed), self.by, "left")


def split_series(
    rows: DataFrame,
    keys: Sequence[str],
    cuts: LongSeries | str | None,
    within: Sequence[str] = (),
    tasks: int | None = None,
) -> SeriesRows:
    """Prepare `rows` for windows over `keys` (and `within`, columns that divide a series further).

    `cuts` is a result of find_long_series over `keys`, or FIND. `tasks`, see tasks_for, is the number of tasks
    that the windows are dealt to; without it the planner chooses.
    """
    if isinstance(cuts, str):
        cuts = find_long_series(rows, keys)
    if cuts is None:
        whole = [*within, *keys]
        dealt = rows.repartition(tasks, *whole) if tasks else rows
        return SeriesRows(dealt, whole, whole, split=False)
    placed = _place(_plain(rows, within), keys, cuts)
    series = [f"_by_{c}" for c in (*within, *keys)]
    dealt = placed.repartition(tasks, *series, CHUNK) if tasks else placed
    return SeriesRows(dealt, [*series, CHUNK], series, split=True)


def decayed_sum(
    rows: DataFrame,
    by: Sequence[str],
    order: Sequence[Column | str],
    position: str,
    term: str,
    decay: float | Column,
    out: str,
) -> DataFrame:
    """Add out_i = sum over j <= i of decay ** (position_i - position_j) * term_j.

    `position` never falls along `order`, and no two rows of a partition are equal in `order`. The
    textbook form decay**p * cumsum(term * decay**-p) overflows on long partitions, so positions
    are cut into spans over which decay**-p stays below e**100, and the totals of earlier spans are
    added, faded by their distance. From the greatest double to the least is a factor of e**1454:
    what lies FADED spans back or more is zero whatever its size, so no term is cut off. Terms are
    scaled by a power of two, so that readings up to the greatest double stay in range. A decay that
    is a column is the same in all rows of a partition.
    """
    if isinstance(decay, Column):
        rate = -F.ln(decay)
        fitting = F.greatest(F.floor(F.lit(100.0) / rate), F.lit(1)).cast("long")
        # A decay of 0 has no logarithm; nothing is carried from one position to the next.
        span = F.when(decay == 0.0, F.lit(1)).when(rate > 100.0 / LONGEST_SPAN, fitting).otherwise(F.lit(LONGEST_SPAN))
        base = decay
    elif decay == 0.0:
        return rows.withColumn(out, F.col(term))
    else:
        rate = -math.log(decay)
        span = F.lit(max(1, math.floor(100.0 / rate)) if rate > 100.0 / LONGEST_SPAN else LONGEST_SPAN)
        base = F.lit(decay)
    in_span = Window.partitionBy(*by, "_span").orderBy(*order)
    so_far = in_span.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*by).orderBy("_span").rangeBetween(-FADED, -1)
    scale = F.lit(2.0**-150)
    at_end = F.lead("_span").over(in_span).isNull()
    end = F.struct(F.col(position).alias("position"), F.col("_local").alias("total"))

    def faded(total: Column, end: Column) -> Column:
        return total + end["total"] * F.pow(base, (F.col(position) - end["position"]).cast("double"))

    return (
        rows.withColumn("_span", F.floor(F.col(position) / span))
        .withColumn("_offset", (F.col(position) - F.col("_span") * span).cast("double"))
        .withColumn("_scaled", F.sum(F.col(term) * scale * F.pow(base, -F.col("_offset"))).over(so_far))
        .withColumn("_local", F.pow(base, F.col("_offset")) * F.col("_scaled"))
        .withColumn("_end", F.when(at_end, end))
        .withColumn("_ends", F.collect_list("_end").over(earlier))
        .withColumn("_carried", F.when(F.size("_ends") > 0, F.aggregate(F.array_sort("_ends"), F.lit(0.0), faded)).otherwise(F.lit(0.0)))
        .withColumn(out, (F.col("_local") + F.col("_carried")) / scale)
        .drop("_span", "_offset", "_scaled", "_local", "_end", "_ends", "_carried")
    )
