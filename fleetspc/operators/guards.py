"""Checks on the rows of a frame that ride on the action that reads them.

`assert_not_empty` computes a frame until its first row comes and throws the work away. A guard
counts the rows as they pass instead (DataFrame.observe), and raises once the action has ended.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from fleetspc.schemas import require_columns


@dataclass(frozen=True)
class Guard:
    """Use `frame` in place of the frame that was given, run one action, then `check`."""

    frame: DataFrame
    what: str
    known: tuple[str, ...]
    seen: Observation

    def check(self) -> None:
        """Raise ValueError if no row passed, or a column in `known` was NULL in every row.

        Waits for the action. Where the planner proves a frame empty, nothing is counted at all.
        """
        found = self.seen.get
        if not found.get("rows"):
            raise ValueError(f"no rows in {self.what}")
        blank = [c for c in self.known if not found.get(f"known {c}")]
        if blank:
            raise ValueError(f"{self.what} has no value in columns {blank}")


def guard(df: DataFrame, what: str, known: Sequence[str] = ()) -> Guard:
    """Count the rows of `df`, and the values of the columns `known`, while it is read.

    Starts no job. Later filters aren't pushed below a guard, so filters of an extract come first.
    """
    require_columns(df, known, what)
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"known {c}") for c in known]]
    return Guard(df.observe(seen, *counts), what, tuple(known), seen)
