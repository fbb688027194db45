"""Maintenance blocks and the exponentially weighted moving average of a series.

y_0 = x_0 and y_t = (1 - alpha) * y_{t-1} + alpha * x_t, started afresh at every row with zero
hours since maintenance. NULL keys form a series like any other. Rows with equal ts are taken
in the order of the other columns.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspc.operators.series import CHUNK, decayed_sum, split_series
from fleetspc.schemas import SERIES_KEYS, require_columns

ROW_ORDER = ["ts", "hours_since_maintenance", "value"]


def check_alpha(alpha: float | Column) -> float | Column:
    """The factor; that of a column is checked row by row when it is used."""
    if isinstance(alpha, Column):
        wrong = F.raise_error(F.format_string("ewma_alpha must be in (0, 1], got %s", alpha.cast("string")))
        return F.when((alpha > 0) & (alpha <= 1.0), alpha).otherwise(wrong.cast("double"))
    alpha = float(alpha)
    if not 0 < alpha <= 1.0:
        raise ValueError(f"ewma_alpha must be in (0, 1], got {alpha}")
    return alpha


def _reset() -> Column:
    return F.when(F.col("hours_since_maintenance") == 0, 1).otherwise(0)


def maintenance_block(df: DataFrame, *, cuts=None) -> DataFrame:
    """Add `maintenance_block`: zero-hour rows up to and including this one, per series."""
    require_columns(df, [*SERIES_KEYS, *ROW_ORDER], "maintenance_block")
    s = split_series(df, SERIES_KEYS, cuts)
    so_far = s.window(*ROW_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = s.rows.withColumn("_block", F.sum(_reset()).over(so_far))
    block = F.col("_block")
    if s.split:
        earlier = lambda up, down: F.sum("_resets").over(up.rowsBetween(Window.unboundedPreceding, -1))
        rows = s.carry(rows, {"_resets": F.sum(_reset())}, {"_earlier": earlier})
        block = block + F.coalesce(F.col("_earlier"), F.lit(0))
    return rows.select(*df.columns, block.cast("long").alias("maintenance_block"))


def ewma(
    df: DataFrame,
    alpha: float | Column = 0.2,
    *,
    reset_on_maintenance: bool = True,
    within: tuple[str, ...] = (),
    cuts=None,
    tasks: int | None = None,
) -> DataFrame:
    """Add `ewma` per (entity_group, entity, sensor).

    Readings that are NULL are left out, as they are at ingest. `within` names columns that
    divide a series further, such as a request id. `alpha` may be a column that is the same in all
    rows of a series, or of what `within` makes of it. `tasks` is the number of tasks, see tasks_for.
    """
    alpha = check_alpha(alpha)
    require_columns(df, [*SERIES_KEYS, *ROW_ORDER, *within], "ewma")
    s = split_series(df.where(F.col("value").isNotNull()), SERIES_KEYS, cuts, within, tasks)
    if isinstance(alpha, Column):
        s = replace(s, rows=s.rows.withColumn("_alpha", alpha))
        alpha = F.col("_alpha")
    # A literal stays one, so that its powers are folded.
    decay = 1.0 - alpha
    weight = decay if isinstance(decay, Column) else F.lit(decay)
    w = s.window(*ROW_ORDER)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    rows = s.rows.withColumn("_reset", _reset() if reset_on_maintenance else F.lit(0))
    rows = rows.withColumns(
        {
            "_row": F.row_number().over(w),
            "_block": F.sum("_reset").over(so_far),
            "_first": F.first("value").over(so_far),
        }
    )
    block_start = F.coalesce(F.max(F.when(F.col("_reset") == 1, F.col("_row"))).over(so_far), F.lit(1))
    rows = rows.withColumn("_position", F.col("_row") - block_start)
    # A cut series opens its chunks like any other row; what went before is added below.
    opens = (F.col("_position") == 0) & (F.lit(not s.split) | (F.col("_block") > 0))
    rows = rows.withColumn("_term", F.when(opens, F.col("value")).otherwise(alpha * F.col("value")))
    rows = decayed_sum(rows, [*s.by, "_block"], ["_row"], "_position", "_term", decay, "_total")
    if not s.split:
        return rows.select(*df.columns, F.col("_total").alias("ewma"))

    def previous_average(chunks: DataFrame, up, down) -> DataFrame:
        """ewma at the end of the chunk before: the same recursion, one row per chunk."""
        first = F.row_number().over(up) == 1
        start = F.pow(weight, F.col("_rows")) * F.col("_opening")
        chunks = chunks.withColumn("_chunk_block", F.sum("_has_reset").over(up)).withColumn(
            "_chunk_term",
            F.col("_end") + F.when(first & (F.col("_has_reset") == 0), start).otherwise(F.lit(0.0)),
        )
        in_block = Window.partitionBy(*s.keys, "_chunk_block").orderBy(CHUNK)
        chunks = chunks.withColumn("_at", F.sum("_rows").over(in_block))
        chunks = decayed_sum(
            chunks, [*s.keys, "_chunk_block"], [CHUNK], "_at", "_chunk_term", decay, "_chunk_end"
        )
        return chunks.withColumn("_previous", F.lag("_chunk_end").over(up)).drop(
            "_chunk_block", "_chunk_term", "_at", "_chunk_end"
        )

    rows = s.carry(
        rows,
        {
            "_rows": F.count(F.lit(1)),
            "_has_reset": F.max("_reset"),
            "_end": F.max_by("_total", "_row"),
            "_opening": F.min_by("value", "_row"),
            **({"_alpha": F.max("_alpha")} if "_alpha" in rows.columns else {}),
        },
        previous_average,
    )
    faded = F.pow(weight, F.col("_position") + 1) * F.coalesce(F.col("_previous"), F.col("_first"))
    average = F.col("_total") + F.when(F.col("_block") == 0, faded).otherwise(F.lit(0.0))
    return rows.select(*df.columns, average.alias("ewma"))
