"""Many requests answered in one job, and readings around events."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspc.functions.predicates import days_and_hours, micros_of
from fleetspc.operators.extract import PM_HISTORY, SENSOR_HISTORY, join_limits, normal_readings, readings_at_events
from fleetspc.operators.health import HEALTH_PARAMETERS, health_within
from fleetspc.operators.ingest import entities_by_group
from fleetspc.operators.ranges import closed_end, match_segments
from fleetspc.operators.series import series_counts, tasks_for
from fleetspc.operators.slices import sliced_within
from fleetspc.operators.spc import ewma_spc
from fleetspc.operators.summary import fleet_ooc_summary
from fleetspc.schemas import ENTITY_KEYS, LIMIT_COLUMNS, REQUESTS, SERIES_KEYS, require_columns
from fleetspc.sources.workspace import materialize

# The filters each kind of history needs.
REQUIRED_FILTERS = {
    "entity_all_sensor_history": ["entity_group"],
    "pm_event_sensor_history": ["entity_group"],
    "entity_sensor_history": ["entity_group", "entity", "sensor"],
    "fleet_sensor_history": ["entity_group", "sensor"],
}
PM_KIND = "pm_event_sensor_history"

MICROS_PER_HOUR = 3_600_000_000

# Bins of a level are this many times as wide as those of the level before, and a closed range
# goes to the first level on which it touches no more than one bin above that number.
FINER = 32
# The level of ranges with an open end, and of those that are too long for the others: one bin.
OPEN = 3
# Rows of ranges up to which the planner may choose to broadcast them.
BROADCAST_ROWS = 200_000


def _bin(ts: Column | str, bin_hours: int, level: int) -> Column:
    if level == OPEN:
        return F.lit(0).cast("long")
    return F.floor(micros_of(ts) / (bin_hours * MICROS_PER_HOUR * FINER**level))


def spread_ranges(ranges: DataFrame, *, bin_hours: int = 24) -> DataFrame:
    """Ranges (start_ts, end_ts), one row per time bin they touch, as a written table.

    A NULL bound is open. A range takes at most FINER + 1 rows however long it is, and an open
    one takes one row, so the table grows with the number of ranges alone.
    """
    level, bins = F.lit(OPEN), F.array(_bin("start_ts", bin_hours, OPEN))
    for k in reversed(range(OPEN)):
        first, last = _bin("start_ts", bin_hours, k), _bin("end_ts", bin_hours, k)
        fits = last - first <= FINER
        level = F.when(fits, k).otherwise(level)
        bins = F.when(fits, F.sequence(first, last)).otherwise(bins)
    in_order = F.coalesce(F.col("start_ts") <= F.col("end_ts"), F.lit(True))
    spread = ranges.where(in_order).withColumn("_level", level.cast("int"))
    return materialize(spread.withColumn("_bin", F.explode(bins)), "ranges")


def match_ranges(
    rows: DataFrame, spread: DataFrame, keys: Sequence[str], *, closed: bool = False, bin_hours: int = 24
) -> DataFrame:
    """Join rows to spread ranges of the same keys: start_ts <= ts < end_ts, or <= end_ts if closed.

    An equality on keys, level and bin. A row stands once for each level that the ranges use, so
    it meets the ranges of its own bins only. More ranges than BROADCAST_ROWS are shuffled, since the
    size of their file says little about their number; adaptive execution splits what is uneven.
    """
    ts, start, end = F.col("ts"), F.col("start_ts"), F.col("end_ts")
    inside = (start.isNull() | (ts >= start)) & (end.isNull() | ((ts <= end) if closed else (ts < end)))
    # At most four levels.
    levels = sorted(r["_level"] for r in spread.select("_level").distinct().collect()) or [OPEN]
    places = [F.struct(F.lit(k).alias("_level"), _bin("ts", bin_hours, k).alias("_bin")) for k in levels]
    binned = rows.select("*", F.inline(F.array(*places)))
    if spread.count() > BROADCAST_ROWS:
        spread = spread.hint("merge")
    return binned.join(spread, [*keys, "_level", "_bin"], "inner").where(inside).drop("_level", "_bin")


def _name(column: Column) -> Column:
    """A name without blanks around it; NULL if nothing is left."""
    return F.nullif(F.trim(column), F.lit(""))


def normal_requests(requests: DataFrame) -> DataFrame:
    """Requests with trimmed names, NULL where blank, one row per entity that they name.

    Entities are named by `entity`, by the array `entities` if there is one, or by both; other
    columns pass through.
    """
    named = F.array(F.col("entity"))
    if "entities" in requests.columns:
        named = F.concat(named, F.coalesce("entities", F.array().cast("array<string>")))
    named = F.array_distinct(F.filter(F.transform(named, _name), lambda e: e.isNotNull()))
    trimmed = {c: _name(F.col(c)) for c in ("entity_group", "sensor") if c in requests.columns}
    return requests.withColumns(trimmed).withColumn("entity", F.explode_outer(named)).drop("entities")


def request_ranges(requests: DataFrame, series: DataFrame, many: bool = False) -> DataFrame:
    """What each request asks of each series: (SERIES_KEYS, request_id, start_ts, end_ts), half-open.

    `n`, the readings of the series, is as many as the range can hold. `many` series are not broadcast, however
    well their names compress.

    `series` are series_counts over SERIES_KEYS; they turn names that are not given into all names
    there are, and open bounds into a series' first and last time. The names of requests meet
    those of series by equality, in each of the four ways of giving an entity and a sensor or not.
    """
    names = ["entity", "sensor"]
    wanted = normal_requests(requests).where(F.col("entity_group").isNotNull()).select(
        "request_id", "entity_group", "start_ts", "end_ts",
        *[F.coalesce(c, F.lit("")).alias(f"_{c}") for c in names],
        *[F.col(c).isNotNull().alias(f"_by_{c}") for c in names],
    )
    asked_as = [
        F.struct(
            *[(F.col(c) if given else F.lit("")).alias(f"_{c}") for c, given in zip(names, way)],
            *[F.lit(given).alias(f"_by_{c}") for c, given in zip(names, way)],
        )
        for way in product((True, False), repeat=2)
    ]
    named = series.where(F.col("sensor").isNotNull()).select(*SERIES_KEYS, "first_ts", "last_ts", "n", F.inline(F.array(*asked_as)))
    met = (named.hint("merge") if many else named).join(wanted, ["entity_group", "_entity", "_sensor", "_by_entity", "_by_sensor"])
    return met.select(
        *SERIES_KEYS, "request_id", F.coalesce("start_ts", "first_ts").alias("start_ts"),
        F.coalesce(F.col("end_ts"), closed_end("last_ts")).alias("end_ts"), "n",
    )


def request_rows(
    long: DataFrame, limits: DataFrame, requests: DataFrame, *, bin_hours: float = 1, series: DataFrame | None = None
) -> DataFrame:
    """Normal-mode readings of every request, with limits and the request's id.

    A request names a group, a sensor or none for all of them, one or several entities or none
    for the whole fleet (see normal_requests), and a half-open time range whose bounds may be NULL.
    Readings are scanned once, and only folders of groups and sensors that are asked for; a
    reading enters the join once, whatever asks for it (see match_segments). Readings without a
    sensor's name are in no request. `series`, series_counts over SERIES_KEYS of the stored table,
    saves a scan of its names and times.
    """
    return _rows_and_tasks(long, limits, requests, bin_hours, series)[0]


def _rows_and_tasks(long, limits, requests, bin_hours, series) -> tuple[DataFrame, int | None]:
    matched, tasks = _matched(long, requests, bin_hours, series)
    return join_limits(matched, limits).select("request_id", *SENSOR_HISTORY), tasks


# Stands in for the entity of readings without one, so that they join on plain equality.
_NO_ENTITY = "\u0000"


def _matched(long: DataFrame, requests: DataFrame, bin_hours: float, series: DataFrame | None) -> tuple[DataFrame, int | None]:
    """Readings of the requests, and the tasks for windows over as many of them as there can be."""
    require_columns(requests, REQUESTS.fieldNames(), "requests")
    many = series is not None and series.count() > BROADCAST_ROWS
    ranges = request_ranges(requests, series_counts(long, SERIES_KEYS) if series is None else series, many)
    key = F.coalesce("entity", F.lit(_NO_ENTITY)).alias("_key")
    ranges = materialize(ranges.select("entity_group", "sensor", key, "request_id", "start_ts", "end_ts", "n"), "request-ranges")
    cores = long.sparkSession.sparkContext.defaultParallelism
    tasks = tasks_for(ranges.agg(F.sum("n")).first()[0] or 0, cores)
    columns = [c for c in SENSOR_HISTORY if c in long.columns]
    readings = normal_readings(long).select(*columns, key)
    keys = ["entity_group", "sensor", "_key"]
    matched = match_segments(readings, ranges.drop("n"), keys, least_hours=bin_hours, tasks=tasks)
    return matched.select("request_id", *columns), tasks


def _of_kind(requests: DataFrame, pm: bool) -> DataFrame:
    if "kind" not in requests.columns:
        return requests
    return requests.where(F.coalesce(F.col("kind") == PM_KIND, F.lit(False)) == F.lit(pm))


def batch_requests(
    long: DataFrame,
    limits: DataFrame,
    requests: DataFrame,
    ewma_alpha: float = 0.2,
    *,
    bin_hours: float = 1,
    cuts=None,
    series: DataFrame | None = None,
) -> DataFrame:
    """request_rows with `ewma` and `spc_violation`, averaged within each request.

    With a column `kind`, requests for maintenance events are left to batch_pm_events. With a column
    `ewma_alpha`, each request is averaged with its own, or with the argument where that is NULL.
    """
    asked = _of_kind(requests, False)
    rows, tasks = _rows_and_tasks(long, limits, asked, bin_hours, series)
    if "ewma_alpha" not in requests.columns:
        return ewma_spc(rows, ewma_alpha, within=("request_id",), cuts=cuts, tasks=tasks)
    rows = _with_parameters(rows, asked, {"ewma_alpha": float(ewma_alpha)})
    averaged = ewma_spc(rows, F.col("ewma_alpha"), within=("request_id",), cuts=cuts, tasks=tasks)
    return averaged.select("request_id", *SENSOR_HISTORY, "ewma_alpha", "ewma", "spc_violation")


def _with_parameters(rows: DataFrame, requests: DataFrame, usual: dict[str, float | int]) -> DataFrame:
    """Add each request's own parameters, or the usual one where it is NULL or not a column.

    One row per request_id, written, so the planner knows its size; of several rows under one
    request_id the greatest parameter counts.
    """
    given = [c for c in usual if c in requests.columns]
    if not given:
        return rows.withColumns({c: F.lit(v) for c, v in usual.items()})
    kinds = {c: "int" if isinstance(v, int) else "double" for c, v in usual.items()}
    own = requests.groupBy("request_id").agg(*[F.max(F.col(c).cast(kinds[c])).alias(f"_{c}") for c in given])
    joined = rows.join(materialize(own, "request-parameters"), "request_id", "left")
    chosen = {c: F.coalesce(f"_{c}", F.lit(v)) if c in given else F.lit(v) for c, v in usual.items()}
    return joined.withColumns(chosen).drop(*[f"_{c}" for c in given])


def batch_pm_events(
    long: DataFrame, limits: DataFrame, requests: DataFrame, *, bin_hours: float = 1, cuts=None, series: DataFrame | None = None
) -> DataFrame:
    """Readings and limits at each maintenance event of every request, with the request's id.

    Events are found within the time range of the request. With a column `kind`, only requests for
    maintenance events are answered. `cuts` is over (entity_group, entity).
    """
    rows, tasks = _matched(long, _of_kind(requests, True), bin_hours, series)
    return join_limits(readings_at_events(rows, cuts, within=("request_id",), tasks=tasks), limits).select("request_id", *PM_HISTORY)


def batch_ooc(
    long: DataFrame, limits: DataFrame, requests: DataFrame, slices: DataFrame, *, mode: str = "run",
    bin_hours: float = 1, series: DataFrame | None = None,
) -> DataFrame:
    """Out-of-control rates of every request, over each of its output slices (see sliced_within).

    The readings of all requests are found in one scan and stored; the slices and the last ts that
    windows count back from are taken of those.
    """
    matched, _ = _matched(long, _of_kind(requests, False), bin_hours, series)
    matched = matched.select("request_id", *SERIES_KEYS, "ts", "value")
    sliced = sliced_within(materialize(matched, "request-readings"), slices, mode)
    by = tuple(c for c in ("request_id", "output") if c in sliced.columns)
    return fleet_ooc_summary(join_limits(sliced, limits), by)


def batch_health(
    long: DataFrame, limits: DataFrame, requests: DataFrame, *, bin_hours: float = 1, cuts=None, series: DataFrame | None = None
) -> DataFrame:
    """Health of every series of every request, each with the parameters of its own request.

    Columns of HEALTH_PARAMETERS among the requests' are its parameters; NULL, or no such column,
    means the usual value.
    """
    asked = _of_kind(requests, False)
    rows, tasks = _rows_and_tasks(long, limits, asked, bin_hours, series)
    rows = rows.select("request_id", *SERIES_KEYS, "ts", "value", *LIMIT_COLUMNS)
    return health_within(_with_parameters(rows, asked, HEALTH_PARAMETERS), ("request_id",), cuts=cuts, tasks=tasks)


def run_filter_inventory(requests: DataFrame) -> DataFrame:
    """Distinct groups, entities and sensors that a set of requests names, as rows (kind, name)."""
    named = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("name"))
            for kind in ("entity_group", "entity", "sensor")
        ]
    )
    return (
        normal_requests(requests).select(F.explode(named).alias("n"))
        .select("n.kind", "n.name")
        .where(F.col("name").isNotNull())
        .distinct()
    )


def invalid_requests(requests: DataFrame, long: DataFrame) -> DataFrame:
    """Requests (with a `kind`) that cannot run, each with the first reason that applies.

    Names are compared without blanks around them, as in request_rows, and returned as given. The
    names known to the data are written tables of distinct values, joined by equality. A name
    that is not given becomes a key of its own request, which is in no table.
    """
    require_columns(requests, ["request_id", "kind", *SERIES_KEYS], "invalid_requests")
    names = materialize(long.select(*SERIES_KEYS).distinct(), "names")
    nothing = F.concat(F.lit("\u0000"), F.coalesce(F.col("request_id").cast("string"), F.lit("")))

    def known(column: str) -> DataFrame:
        found = names.select(F.col(column).alias(f"_key_{column}")).where(F.col(column).isNotNull())
        return found.distinct().withColumn(f"_{column}", F.lit(True))

    pairs = entities_by_group(names).select(*[F.col(c).alias(f"_key_{c}") for c in ENTITY_KEYS], F.lit(True).alias("_pair"))
    checked = requests.withColumns({f"_key_{c}": F.coalesce(_name(F.col(c)), nothing) for c in SERIES_KEYS})
    for column in SERIES_KEYS:
        checked = checked.join(known(column), f"_key_{column}", "left")
    checked = checked.join(pairs, [f"_key_{c}" for c in ENTITY_KEYS], "left")

    def blank(column: str) -> Column:
        return _name(F.col(column)).isNull()

    reason = F.when(~F.coalesce(F.col("kind").isin(list(REQUIRED_FILTERS)), F.lit(False)), "unknown_kind")
    for column in SERIES_KEYS:
        needing = [kind for kind, needs in REQUIRED_FILTERS.items() if column in needs]
        reason = reason.when(F.col("kind").isin(needing) & blank(column), f"missing_{column}")
    for column in SERIES_KEYS:
        reason = reason.when(~blank(column) & F.col(f"_{column}").isNull(), f"unknown_{column}")
    reason = reason.when(~blank("entity") & F.col("_pair").isNull(), "entity_not_in_group")
    return (
        checked.withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select("request_id", "kind", *SERIES_KEYS, "reason")
    )


def pm_event_windows(long: DataFrame, limits: DataFrame, events: DataFrame, days: int = 3) -> DataFrame:
    """Normal-mode readings of an entity from `days` before to `days` after each of its events."""
    reach = days_and_hours(days=days)
    ranges = events.select(
        *ENTITY_KEYS,
        F.col("ts").alias("event_ts"),
        (F.col("ts") - reach).alias("start_ts"),
        (F.col("ts") + reach).alias("end_ts"),
    )
    readings = normal_readings(long).select(*ENTITY_KEYS, "ts", "sensor", "value")
    ranges = ranges.withColumn("end_ts", closed_end("end_ts"))
    near = match_segments(readings, ranges, ENTITY_KEYS)
    return join_limits(near, limits).select(
        *ENTITY_KEYS, "event_ts", "ts", "sensor", "value", "ucl", "centerline", "lcl"
    )
