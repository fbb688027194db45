"""Slices of a processed frame taken for one output. Bounds are closed, unlike in extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspc.functions.predicates import days_and_hours, entity_list, ts_literal
from fleetspc.schemas import require_columns
from fleetspc.sources.workspace import materialize

# What a slice of a request's output may give besides the request: absent columns are as if NULL.
SLICE_COLUMNS = {
    "slice_entities": "array<string>",
    "slice_start_ts": "timestamp_ntz",
    "slice_end_ts": "timestamp_ntz",
    "slice_window_days": "int",
}


def entity_subset(df: DataFrame, entities=None) -> DataFrame:
    """Keep the named entities; no names, or a frame without entities, is left as it is.

    Comes before time_slice, so that `window_days` counts back from the subset's last row.
    """
    names = entity_list(entities)
    if not names or "entity" not in df.columns:
        return df
    return df.where(F.col("entity").isin(names))


def time_slice(
    df: DataFrame, start_ts=None, end_ts=None, window_days=None, mode: str = "run", last: Column | None = None
) -> DataFrame:
    """Keep start <= ts <= end, or the last `window_days` days before the frame's own last ts.

    mode "run", for outputs of a fresh frame: the window counts only when neither bound is
    given, and a window of 0 days keeps the rows of the last ts.
    mode "replot", for outputs of a stored frame: NULL ts is dropped, the window counts when
    `start_ts` is absent, back from the last ts up to `end_ts`, and a window of 0 is ignored.
    The last ts is one scalar subquery, a partially aggregated maximum, unless `last` gives what is
    known of it, see extents.last_time.
    """
    if mode not in ("run", "replot"):
        raise ValueError(f"mode must be 'run' or 'replot', got {mode!r}")
    if "ts" not in df.columns:
        return df
    if mode == "run":
        starts, ends = start_ts is not None, end_ts is not None
        windowed = window_days is not None and not starts and not ends
    else:
        starts, ends = bool(start_ts), bool(end_ts)
        windowed = bool(window_days) and not starts
        df = df.where(F.col("ts").isNotNull())
    if starts:
        df = df.where(F.col("ts") >= ts_literal(start_ts))
    if ends:
        df = df.where(F.col("ts") <= ts_literal(end_ts))
    if windowed:
        last = df.agg(F.max("ts")).scalar() if last is None else last
        df = df.where(F.col("ts") >= last - days_and_hours(days=int(window_days)))
    return df


def sliced_within(rows: DataFrame, slices: DataFrame, mode: str = "run") -> DataFrame:
    """Rows of requests (request_id, entity, ts, ...), each cut to the slices of its request.

    One row of `slices` is one output: `request_id`, perhaps `output`, its name, and SLICE_COLUMNS,
    which mean what entity_subset and time_slice make of them. So a request with several slices has
    its rows once per output, and one without any keeps them all, with no output's name. A window
    counts back from the last ts of the request's own named entities: one partially aggregated
    maximum per output, joined back. `rows` are read twice, so a stored frame is best.
    """
    if mode not in ("run", "replot"):
        raise ValueError(f"mode must be 'run' or 'replot', got {mode!r}")
    require_columns(rows, ["request_id", "entity", "ts"], "sliced_within")
    absent = {c: F.lit(None).cast(kind) for c, kind in SLICE_COLUMNS.items() if c not in slices.columns}
    named = slices.withColumns(absent)
    keys = ["request_id", *[c for c in ("output",) if c in slices.columns]]
    names = F.filter(F.transform("slice_entities", lambda e: F.trim(e)), lambda e: e != "")
    window, start, end = F.col("slice_window_days"), F.col("slice_start_ts"), F.col("slice_end_ts")
    windowed = window.isNotNull() & start.isNull()
    windowed = windowed & end.isNull() if mode == "run" else windowed & (window != 0)
    asked = materialize(
        named.select(
            *keys, F.when(F.size(names) > 0, names).alias("_names"), start.alias("_start"), end.alias("_end"),
            F.when(windowed, window).alias("_days"),
        ),
        "slices",
    )
    ts = F.col("ts")
    kept = rows.join(asked, "request_id", "left").where(
        (F.col("_names").isNull() | F.array_contains("_names", F.col("entity")))
        & (F.col("_start").isNull() | (ts >= F.col("_start")))
        & (F.col("_end").isNull() | (ts <= F.col("_end")))
    )
    if mode == "replot":
        kept = kept.where(ts.isNotNull())
    last = kept.where(F.col("_days").isNotNull()).groupBy(*keys, "_days").agg(F.max("ts").alias("_last"))
    since = F.col("_last") - F.make_dt_interval(F.col("_days"))
    last = materialize(last.select(*keys, since.alias("_since")), "slice-starts")
    same = [kept[k].eqNullSafe(last[k]) for k in keys]
    out = kept.join(last, same, "left").where(F.col("_days").isNull() | (ts >= F.col("_since")))
    return out.select(*[kept[k] for k in keys], *[c for c in rows.columns if c not in keys])
