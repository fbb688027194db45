"""Moving average and out-of-control flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspc.functions.predicates import is_normal, one_sided_violation
from fleetspc.operators.ewma import check_alpha, ewma
from fleetspc.schemas import SERIES_KEYS, require_columns, with_limit_columns


def ewma_spc(
    df: DataFrame,
    ewma_alpha: float | Column = 0.2,
    *,
    violation_on: str = "value",
    within: tuple[str, ...] = (),
    cuts=None,
    tasks: int | None = None,
) -> DataFrame:
    """Normal-mode rows with `ewma`, restarted after maintenance, and `spc_violation`.

    The flag compares the raw reading with the limits; the average is for the eye only. With
    violation_on="ewma" the average is compared instead.
    """
    ewma_alpha = check_alpha(ewma_alpha)
    if violation_on not in ("value", "ewma"):
        raise ValueError(f"violation_on must be 'value' or 'ewma', got {violation_on!r}")
    require_columns(
        df, [*SERIES_KEYS, "ts", "operating_mode", "hours_since_maintenance", "value"], "ewma_spc"
    )
    rows = with_limit_columns(df).where(is_normal())
    averaged = ewma(rows, ewma_alpha, within=within, cuts=cuts, tasks=tasks)
    return averaged.withColumn("spc_violation", one_sided_violation(violation_on))
