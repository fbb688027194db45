"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A side of a join is sent to every executor only after its rows were counted and are no more
# than this; rows here are a few keys and numbers, so the bound is some tens of MB.
BROADCAST_ROWS = 500_000


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def rebalanced(df: DataFrame, *columns: str) -> DataFrame:
    """Even partitions, so that a heavy one is cut however its rows are keyed."""
    return df.hint("rebalance", *columns) if columns else df.hint("rebalance")


def small(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored table for broadcast if its counted rows are within the bound.

    Beyond the bound the join is left to the planner, which shuffles both sides and splits
    uneven partitions.
    """
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side


def same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Equality of columns in which NULL equals NULL; still an equi-join key."""
    condition = F.lit(True)
    for c in columns:
        condition = condition & left[c].eqNullSafe(right[c])
    return condition
