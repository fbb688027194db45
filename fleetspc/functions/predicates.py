"""Row predicates as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspc.schemas import NORMAL


def is_normal() -> Column:
    return F.col("operating_mode") == NORMAL


def one_sided_violation(measure: str = "value") -> Column:
    """True unless the reading passes every limit it has; an absent side always passes.

    A NULL reading fails a limit that exists.
    """
    x = F.col(measure)
    above = F.col("ucl").isNotNull() & ~F.coalesce(x <= F.col("ucl"), F.lit(False))
    below = F.col("lcl").isNotNull() & ~F.coalesce(x >= F.col("lcl"), F.lit(False))
    return above | below


def two_sided_violation() -> Column:
    """True when both limits exist and the reading lies outside them."""
    x = F.col("value")
    outside = (x > F.col("ucl")) | (x < F.col("lcl"))
    return F.col("ucl").isNotNull() & F.col("lcl").isNotNull() & F.coalesce(outside, F.lit(False))


def sigma_from_limits() -> Column:
    """One sigma out of the limits; NULL when it is not positive."""
    sigma = (F.col("ucl") - F.col("centerline")) / 3.0
    return F.when(sigma > 0, sigma)


def entity_list(entity: Any) -> list[str]:
    """Entity argument (nothing, one, many) as a list without blanks."""
    if entity is None:
        return []
    many = [entity] if isinstance(entity, str) or not isinstance(entity, Iterable) else entity
    names = [str(e).strip() for e in many if e is not None]
    return [n for n in names if n]


def where_entity(df: DataFrame, entity: Any) -> DataFrame:
    names = entity_list(entity)
    if not names:
        return df
    return df.where(F.col("entity") == names[0] if len(names) == 1 else F.col("entity").isin(names))


def ts_literal(moment: str | datetime) -> Column:
    text = moment.isoformat(sep=" ") if isinstance(moment, datetime) else str(moment)
    return F.lit(text).cast("timestamp_ntz")


def where_time_range(df: DataFrame, start_ts=None, end_ts=None) -> DataFrame:
    """Half-open [start, end). Only the given bounds enter the plan, so they reach the scan.

    A NULL ts never passes, also without bounds.
    """
    df = df.where(F.col("ts").isNotNull())
    if start_ts is not None:
        df = df.where(F.col("ts") >= ts_literal(start_ts))
    if end_ts is not None:
        df = df.where(F.col("ts") < ts_literal(end_ts))
    return df


def days_and_hours(days: int = 0, hours: int = 0) -> Column:
    return F.make_dt_interval(F.lit(int(days)), F.lit(int(hours)))


def micros_between(earlier: Column | str, later: Column | str) -> Column:
    """Microseconds from one wall-clock time to another; no session time zone enters."""
    earlier, later = (F.col(x) if isinstance(x, str) else x for x in (earlier, later))
    seconds = (later - earlier).cast("interval second").cast("decimal(20,6)")
    return (seconds * 1_000_000).cast("long")


def micros_of(ts: Column | str) -> Column:
    """Microseconds since 1970 of a wall-clock time."""
    return micros_between(ts_literal("1970-01-01 00:00:00"), ts)
