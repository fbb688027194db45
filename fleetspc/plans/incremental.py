"""A plant's tables that grow log by log, without history being read again.

Every log is a version of the plant (see sources.versions): a folder with its readings, their
averages, the maintenance events it completes, and the state that the next log goes on from.

- Limits: count, mean and sum of squared deviations per group and sensor, merged pairwise.
- Averages: last average, blocks and rows per series. What went before a log fades by a power of
  the row's place in it, until the first maintenance.
- Events: the readings at an entity's last tick, which is an event if the next log starts with
  fewer hours.

A log that reaches back to or before the last tick of an entity changes that entity's past. Its
readings, and those of no other entity, are then read again, and its averages and events are written
whole with the new log; `since` says from which log on the files of an entity count.

Only normal-mode readings with a time have averages and events. The averaging factor is the plant's.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetspc.functions.predicates import is_normal, one_sided_violation
from fleetspc.operators.ewma import ROW_ORDER, check_alpha, ewma, maintenance_block
from fleetspc.operators.extract import PM_HISTORY, SENSOR_HISTORY, join_limits, normal_readings, readings_at_events
from fleetspc.operators.ingest import deal_ticks, derive_entity, limits_of_moments, unpivot_sensors
from fleetspc.schemas import CHART_KEYS, ENTITY_KEYS, LIMIT_COLUMNS, SERIES_KEYS
from fleetspc.sources.tables import read_long, write_dealt
from fleetspc.sources.versions import finish_version, finished_versions, new_version, version_path
from fleetspc.sources.workspace import materialize

_HISTORY = [c for c in SENSOR_HISTORY if c not in LIMIT_COLUMNS]
_EVENTS = [c for c in PM_HISTORY if c not in LIMIT_COLUMNS]


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """NULL keys are a key like any other."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def _with(rows: DataFrame, state: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Left join with some columns of a state table."""
    return rows.join(state, _same(rows, state, keys), "left").select(*[rows[c] for c in rows.columns], *[state[c] for c in columns])


@dataclass(frozen=True)
class Plant:
    """A plant as of its newest finished log."""

    spark: SparkSession
    folder: str
    logs: list[int]

    def _path(self, log: int, table: str) -> str:
        return f"{version_path(self.folder, log)}/{table}"

    def state(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self._path(self.logs[-1], table))

    def long(self) -> DataFrame:
        return read_long(self.spark, *[self._path(log, "sensor_data") for log in self.logs])

    def limits(self) -> DataFrame:
        return limits_of_moments(self.state("moments"))

    def _of_entities(self, table: str) -> DataFrame:
        """Rows of all logs, an entity's from that log on from which they count."""
        parts = [self.spark.read.parquet(self._path(log, table)).withColumn("_log", F.lit(log)) for log in self.logs]
        rows, since = reduce(DataFrame.unionByName, parts), self.state("entities")
        counted = rows.join(since, [*[rows[k].eqNullSafe(since[k]) for k in ENTITY_KEYS], rows["_log"] >= since["since"]], "left_semi")
        return counted.drop("_log")

    def averages(self) -> DataFrame:
        """Normal-mode readings with `ewma` and `maintenance_block`."""
        return self._of_entities("averages")

    def processed(self, violation_on: str = "value") -> DataFrame:
        """What monitored_history gives of the whole plant."""
        flagged = join_limits(self.averages(), self.limits()).withColumn("spc_violation", one_sided_violation(violation_on))
        return flagged.select(*SENSOR_HISTORY, "ewma", "spc_violation")

    def pm_event_history(self) -> DataFrame:
        """Readings and limits at each maintenance event that a later tick has shown."""
        return join_limits(self._of_entities("events"), self.limits()).select(PM_HISTORY)


def open_plant(spark: SparkSession, folder: str) -> Plant | None:
    logs = finished_versions(spark, folder)
    return Plant(spark, folder, logs) if logs else None


def _moments(new: DataFrame, before: DataFrame | None) -> DataFrame:
    """Count, mean and sum of squared deviations per chart, of what was known and what is new."""
    known = F.col("entity_group").isNotNull() & F.col("sensor").isNotNull()
    n = F.count("value")
    fresh = new.where(is_normal() & known).groupBy(*CHART_KEYS).agg(
        n.alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * n).alias("squares")
    )
    if before is None:
        return fresh
    both = before.select(*CHART_KEYS, F.struct("n", "mean", "squares").alias("a"), F.lit(None).alias("b")).unionByName(
        fresh.select(*CHART_KEYS, F.lit(None).alias("a"), F.struct("n", "mean", "squares").alias("b"))
    )
    a, b = F.col("a"), F.col("b")
    total, apart = a["n"] + b["n"], b["mean"] - a["mean"]
    merged = F.struct(
        total.alias("n"),
        (a["mean"] + apart * b["n"] / total).alias("mean"),
        (a["squares"] + b["squares"] + apart * apart * a["n"] * b["n"] / total).alias("squares"),
    )
    one = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(merged)
    return both.groupBy(*CHART_KEYS).agg(F.max("a").alias("a"), F.max("b").alias("b")).select(*CHART_KEYS, one.alias("m")).select(*CHART_KEYS, "m.*")


def _averages(rows: DataFrame, alpha: float, before: DataFrame | None, cuts) -> DataFrame:
    """Averages of a log's readings that go on from the state of their series."""
    local = maintenance_block(ewma(rows.select(*_HISTORY), alpha, cuts=cuts), cuts=cuts)
    if before is None:
        return local
    in_series = Window.partitionBy(*SERIES_KEYS).orderBy(*ROW_ORDER)
    so_far = in_series.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = local.withColumns({"_row": F.row_number().over(in_series), "_first": F.first("value").over(so_far)})
    joined = _with(local, before, SERIES_KEYS, ["last_ewma", "blocks"])
    # The average that starts afresh differs from the one that goes on by what was before its first row.
    carried = F.pow(F.lit(1.0 - alpha), F.col("_row").cast("double")) * (F.col("last_ewma") - F.col("_first"))
    goes_on = F.col("last_ewma").isNotNull() & (F.col("maintenance_block") == 0)
    return joined.select(
        *_HISTORY, (F.col("ewma") + F.when(goes_on, carried).otherwise(0.0)).alias("ewma"),
        (F.col("maintenance_block") + F.coalesce("blocks", F.lit(0))).alias("maintenance_block"),
    )


def _series_state(averages: DataFrame, before: DataFrame | None, late: DataFrame | None) -> DataFrame:
    """(SERIES_KEYS, rows, blocks, last_ewma, first_ts, last_ts) after a log."""
    order = F.struct(*ROW_ORDER)
    new = averages.groupBy(*SERIES_KEYS).agg(
        F.count(F.lit(1)).alias("rows"), F.max("maintenance_block").alias("blocks"), F.max_by("ewma", order).alias("last_ewma"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    if before is None:
        return new
    if late is not None:
        before = before.join(late, _same(before, late, ENTITY_KEYS), "left_anti")
    both = before.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    newest = F.max_by(F.struct("blocks", "last_ewma"), "_new")
    return (
        both.groupBy(*SERIES_KEYS)
        .agg(F.sum("rows").alias("rows"), newest.alias("_s"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
        .select(*SERIES_KEYS, "rows", "_s.blocks", "_s.last_ewma", "first_ts", "last_ts")
    )


def append_log(raw: DataFrame, folder: str, ewma_alpha: float = 0.2, *, files: int | None = None, cuts=None) -> Plant:
    """Add a log to the plant in `folder`, which the first log founds, and open the plant.

    Reads the log, the state, and the files of entities whose past it changes. `cuts` are those of
    the log's series.
    """
    spark, alpha = raw.sparkSession, check_alpha(ewma_alpha)
    before = open_plant(spark, folder)
    if before is not None and (known := before.state("alpha").first()["ewma_alpha"]) != alpha:
        raise ValueError(f"the plant's averages have ewma_alpha {known}, not {alpha}")
    number = new_version(spark, folder)
    here = version_path(folder, number)
    write_dealt(unpivot_sensors(deal_ticks(derive_entity(raw), files)), f"{here}/sensor_data")
    new = read_long(spark, f"{here}/sensor_data")
    rows = normal_readings(new)

    bounds = rows.groupBy(*ENTITY_KEYS).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    bounds = materialize(bounds, "log-bounds")
    late = None
    if before is not None:
        known = before.state("entities").withColumnRenamed("last_ts", "known_ts")
        reaching = _with(bounds, known, ENTITY_KEYS, ["known_ts"]).where(F.col("first_ts") <= F.col("known_ts"))
        reaching = materialize(reaching.select(*ENTITY_KEYS), "late-entities")
        late = None if reaching.isEmpty() else reaching

    # Readings that go on from the state, and all readings of entities whose past has changed.
    pending = before.state("pending") if before else None
    again = None
    if late is not None:
        again = normal_readings(read_long(spark, *[before._path(log, "sensor_data") for log in before.logs], f"{here}/sensor_data"))
        again = again.join(late, _same(again, late, ENTITY_KEYS), "left_semi")
        rows = rows.join(late, _same(rows, late, ENTITY_KEYS), "left_anti")
        pending = pending.join(late, _same(pending, late, ENTITY_KEYS), "left_anti")

    averages = _averages(rows, alpha, before.state("series") if before else None, cuts)
    candidates = rows if pending is None else rows.unionByName(pending)
    events = readings_at_events(candidates)
    if again is not None:
        averages = averages.unionByName(_averages(again, alpha, None, None))
        events = events.unionByName(readings_at_events(again))
        candidates = candidates.unionByName(again)
    averages.write.parquet(f"{here}/averages")
    events.select(_EVENTS).write.parquet(f"{here}/events")

    _moments(new, before.state("moments") if before else None).write.parquet(f"{here}/moments")
    written = spark.read.parquet(f"{here}/averages")
    _series_state(written, before.state("series") if before else None, late).write.parquet(f"{here}/series")

    # An entity that is new, or late, counts from this log on.
    entities = bounds.select(*ENTITY_KEYS, "last_ts", F.lit(None).cast("int").alias("since"))
    if before is not None:
        entities = entities.unionByName(before.state("entities"))
    if late is not None:
        entities = entities.unionByName(late.select(*ENTITY_KEYS, F.lit(None).cast("timestamp_ntz").alias("last_ts"), F.lit(number).alias("since")))
    entities = entities.groupBy(*ENTITY_KEYS).agg(F.max("last_ts").alias("last_ts"), F.coalesce(F.max("since"), F.lit(number)).alias("since"))
    entities.write.parquet(f"{here}/entities")
    last = spark.read.parquet(f"{here}/entities").select(*ENTITY_KEYS, "last_ts")
    at_last = [*[candidates[k].eqNullSafe(last[k]) for k in ENTITY_KEYS], candidates["ts"] == last["last_ts"]]
    candidates.join(last, at_last, "left_semi").write.parquet(f"{here}/pending")
    spark.createDataFrame([(alpha,)], "ewma_alpha double").coalesce(1).write.parquet(f"{here}/alpha")
    finish_version(spark, folder, number)
    return open_plant(spark, folder)
