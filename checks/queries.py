"""Every operator as a query over the driver's `events` table.

The plant's set-up step comes first: the events become a wide machine log, and that is ingested
into the stored sensor table and limits. This happens once per Spark application and data
folder; the questions then read the stored tables, as they do in use.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetspc.operators import charts, ewma, extents, extract, health, requests, spc, summary, verify
from fleetspc.operators import ingest as ingesting
from fleetspc.operators.series import find_long_series
from fleetspc.operators.slices import time_slice
from fleetspc.plans import incremental, outputs
from fleetspc.plans.setup import SensorTables, ingest
from fleetspc.schemas import CHART_KEYS, ENTITY_KEYS, SERIES_KEYS
from fleetspc.sources.events_log import machine_log
from fleetspc.sources.logs import read_csv_logs
from fleetspc.sources.tables import read_series, write_catalog_json, write_frame, write_series, write_table_csv
from fleetspc.sources.workspace import materialize, new_path, shared_folder

_tables: dict[tuple[str, str], SensorTables] = {}


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return machine_log(spark.read.parquet(f"{sf_dir}/events.parquet"))


def folder_of(spark: SparkSession, sf_dir: str, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{sha256(sf_dir.encode()).hexdigest()[:12]}"


def sensor_tables(spark: SparkSession, sf_dir: str) -> SensorTables:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _tables:
        _tables[key] = ingest(raw_log(spark, sf_dir), folder_of(spark, sf_dir, "tables"))
    return _tables[key]


# Doubles are shifted off the decimal grid that the inputs lie on before they are rounded for
# comparison, so that no value sits on a rounding boundary. The SQL side does the same.
SHIFT = 3.3e-8


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + F.lit(SHIFT), 6) for c in columns})


LIMITS = ("ucl", "centerline", "lcl")


def history(t: SensorTables) -> DataFrame:
    return extract.sensor_history(t.long, t.limits)


def processed(t: SensorTables) -> DataFrame:
    return outputs.monitored_history(t.long, t.limits, cuts=t.long_series, tasks=t.tasks)


def pm_history(t: SensorTables) -> DataFrame:
    return extract.pm_event_history(t.long, t.limits, cuts=t.long_entities, tasks=t.tasks)


def moment(text: str | None) -> Column:
    return F.lit(text).cast("timestamp_ntz")


# --- ingest -------------------------------------------------------------------------------


def derive_entity(spark, sf_dir):
    return ingesting.derive_entity(raw_log(spark, sf_dir))


def unpivot_sensors(spark, sf_dir):
    return ingesting.unpivot_sensors(derive_entity(spark, sf_dir))


def ingested(spark, sf_dir):
    t = ingest(raw_log(spark, sf_dir), f"{folder_of(spark, sf_dir, 'ingest')}")
    stored = t.long.groupBy(*CHART_KEYS).agg(
        F.count(F.lit(1)).alias("readings"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    return rounded(stored.join(t.limits, CHART_KEYS, "left"), "mean", "std", *LIMITS)


# Fixed values of the checks: machine types that a log may name, and what its files call its columns.
_SHUFFLED = ["machine_type", "rpm", "timestamp", "operating_mode", "machine_id", "ambient_temp", "pressure_level", "plant"]


def csv_folder(spark, sf_dir):
    """Readings of a log whose files have their columns in different orders, and torn rows per reason."""
    raw = materialize(raw_log(spark, sf_dir), "raw-log")
    folder = new_path(spark, "csv-log")
    text = raw.select([F.col(c).cast("string").alias(c) for c in raw.columns])
    odd = F.col("machine_id") % 2 == 1
    text.where(~odd).write.option("header", True).csv(f"{folder}/even")
    # Another order, columns that are missing, and one that no log knows.
    text.where(odd).withColumn("plant", F.lit("x,y")).select(_SHUFFLED).write.option("header", True).csv(f"{folder}/odd")
    # One row too short and one with a word for a number, for each of these machines.
    ids = raw.where(odd).select(F.col("machine_id").cast("string").alias("id")).distinct()
    lines = F.array(F.concat("id", F.lit(",2024-01-01")), F.concat("id", F.lit(",2024-01-01 00:00:00,fast")))
    plain = ids.select(F.explode(lines).alias("machine_id,timestamp,rpm")).write.option("header", True).option("quote", "")
    plain.option("sep", "|").csv(f"{folder}/torn")
    log, rejected = read_csv_logs(spark, f"{folder}/*")
    long = ingesting.unpivot_sensors(ingesting.derive_entity(log)).select("entity", "ts", "operating_mode", "sensor", "value")
    counted = rejected.groupBy(F.col("reason").alias("sensor")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    nothing = F.lit(None).cast("string")
    counted = counted.select(nothing.alias("entity"), moment(None).alias("ts"), nothing.alias("operating_mode"), "sensor", "value")
    return long.unionByName(counted)


def plant_of_logs(spark, sf_dir, name: str, *when: Column) -> incremental.Plant:
    """The log of a plant, arriving in the parts that the conditions make of it, each in time or late."""
    raw = materialize(raw_log(spark, sf_dir), "raw-log")
    folder = new_path(spark, name)
    for condition in when:
        plant = incremental.append_log(raw.where(condition), folder)
    return plant


def ingest_two_batches(spark, sf_dir):
    """Counts, times and limits after two logs."""
    early = F.col("timestamp") < moment("2024-01-15 07:30:00")
    plant = plant_of_logs(spark, sf_dir, "two-logs", early, ~early)
    stored = plant.long().groupBy(*CHART_KEYS).agg(
        F.count(F.lit(1)).alias("readings"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    return rounded(stored.join(plant.limits(), CHART_KEYS, "left"), "mean", "std", *LIMITS)


def incremental_averages(spark, sf_dir):
    """Averages and flags after three logs that follow each other."""
    first, second = F.col("timestamp") < moment("2024-01-09"), F.col("timestamp") < moment("2024-01-20 12:00:00")
    plant = plant_of_logs(spark, sf_dir, "three-logs", first, ~first & second, ~second)
    return rounded(plant.processed(), "ewma", *LIMITS)


def incremental_late(spark, sf_dir):
    """Averages after a log that brings what two earlier logs lacked of some machines."""
    early = F.col("timestamp") < moment("2024-01-15")
    late = F.col("timestamp").between(moment("2024-01-11"), moment("2024-01-16")) & (F.col("machine_id") % 7 == 2)
    plant = plant_of_logs(spark, sf_dir, "late-log", early & ~late, ~early & ~late, late)
    return rounded(plant.processed(), "ewma", *LIMITS)


def incremental_events(spark, sf_dir):
    """Readings at maintenance events after two logs and a late one."""
    early = F.col("timestamp") < moment("2024-01-15")
    late = F.col("timestamp").between(moment("2024-01-04"), moment("2024-01-20")) & (F.col("machine_id") % 5 == 1)
    plant = plant_of_logs(spark, sf_dir, "event-logs", early & ~late, ~early & ~late, late)
    return rounded(plant.pm_event_history(), *LIMITS)


def spc_limits(spark, sf_dir):
    return rounded(ingesting.spc_limits(sensor_tables(spark, sf_dir).long), "mean", "std", *LIMITS)


def catalog(spark, sf_dir):
    return ingesting.catalog(sensor_tables(spark, sf_dir).long)


def entities_by_group(spark, sf_dir):
    return ingesting.entities_by_group(sensor_tables(spark, sf_dir).long)


# --- filters, slices, joins -----------------------------------------------------------------


def entity_filter_one_many(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    named = ["CPR02", " CPR06 ", None, ""]
    return rounded(extract.entity_all_sensor_history(t.long, t.limits, "CPR", named), *LIMITS)


def time_range_extract(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    return extract.normal_readings(t.long, start_ts="2024-01-08 12:00:00", end_ts="2024-01-21")


_SLICED = ["entity_group", "entity", "sensor", "ts", "value"]


def time_slice_run(spark, sf_dir):
    return time_slice(history(sensor_tables(spark, sf_dir)), window_days=3).select(_SLICED)


def time_slice_replot(spark, sf_dir):
    df = history(sensor_tables(spark, sf_dir))
    return time_slice(df, end_ts="2024-01-20 06:00:00", window_days=5, mode="replot").select(_SLICED)


def time_slice_run_kept(spark, sf_dir):
    """The last three days, known from what ingest kept of each series."""
    return outputs.sliced_history(sensor_tables(spark, sf_dir), window_days=3).select(_SLICED)


def time_slice_replot_kept(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    return outputs.sliced_history(t, end_ts="2024-01-20 06:00:00", window_days=5, mode="replot").select(_SLICED)


def entity_subset_slice_kept(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    return outputs.sliced_history(t, entities=["CPR02", "ARM03"], window_days=4).select(_SLICED)


def series_extents(spark, sf_dir):
    return sensor_tables(spark, sf_dir).extents


def chart_limits_kept(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    return rounded(extents.chart_limits(t.extents, t.limits), *LIMITS)


def guarded_run(spark, sf_dir):
    """Averages of a fleet's sensor, stored in one job that also tells whether the extract had rows."""
    t = sensor_tables(spark, sf_dir)
    extract_of = extract.fleet_sensor_history(t.long, t.limits, "CPR", "vibration_rms")
    return rounded(outputs.stored_run(extract_of, spc.ewma_spc, new_path(spark, "guarded")), "ewma", *LIMITS)


def entity_subset_slice(spark, sf_dir):
    df = history(sensor_tables(spark, sf_dir))
    return outputs.sliced(df, entities=["CPR02", "ARM03"], window_days=4).select(_SLICED)


def join_limits(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    return rounded(extract.join_limits(t.long, t.limits), *LIMITS)


# --- histories and events -------------------------------------------------------------------


def entity_sensor_history(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    df = extract.entity_sensor_history(t.long, t.limits, "CPR", "CPR02", "temperature_motor", "2024-01-03")
    return rounded(df, *LIMITS)


def fleet_sensor_history(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    df = extract.fleet_sensor_history(t.long, t.limits, "CPR", "vibration_rms", None, "2024-01-25")
    return rounded(df, *LIMITS)


def entity_all_sensor_history(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    return rounded(extract.entity_all_sensor_history(t.long, t.limits, "PMP"), *LIMITS)


def pm_events(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    return extract.pm_events(t.long, cuts=t.long_entities)


def pm_events_in_range(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    return extract.pm_events(
        t.long, start_ts="2024-01-10", end_ts="2024-01-20 12:00:00", cuts=t.long_entities
    )


def pm_event_join_back(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    return extract.pm_event_readings(t.long, extract.pm_events(t.long, cuts=t.long_entities))


def pm_event_sensor_history(spark, sf_dir):
    return rounded(pm_history(sensor_tables(spark, sf_dir)), *LIMITS)


# --- averages and flags ---------------------------------------------------------------------


def maintenance_block(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    df = ewma.maintenance_block(extract.normal_readings(t.long), cuts=t.long_series)
    return df.select(*SERIES_KEYS, "ts", "hours_since_maintenance", "value", "maintenance_block")


def ewma_reset(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    df = ewma.ewma(extract.normal_readings(t.long), 0.2, cuts=t.long_series, tasks=t.tasks)
    return rounded(df.select(*SERIES_KEYS, "ts", "value", "ewma"), "ewma")


def ewma_whole_series(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    df = ewma.ewma(extract.normal_readings(t.long), 0.05, reset_on_maintenance=False, cuts=t.long_series, tasks=t.tasks)
    return rounded(df.select(*SERIES_KEYS, "ts", "value", "ewma"), "ewma")


def ewma_spc(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    return rounded(spc.ewma_spc(history(t), cuts=t.long_series, tasks=t.tasks), "ewma", *LIMITS)


def ewma_violation_variant(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    df = spc.ewma_spc(history(t), 0.6, violation_on="ewma", cuts=t.long_series, tasks=t.tasks)
    return rounded(df, "ewma", *LIMITS)


def monitored_history(spark, sf_dir):
    return rounded(processed(sensor_tables(spark, sf_dir)), "ewma", *LIMITS)


# --- the same on the table stored by series, whose plans shuffle nothing -----------------------

BUCKETS = 16
_by_series: dict[tuple[str, str], str] = {}


def stored_by_series(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    t, key = sensor_tables(spark, sf_dir), (spark.sparkContext.applicationId, sf_dir)
    if key not in _by_series:
        _by_series[key] = new_path(spark, "by-series")
        write_series(t.long, _by_series[key], BUCKETS)
    return read_series(spark, _by_series[key]), t.limits


def ewma_spc_by_series(spark, sf_dir):
    long, limits = stored_by_series(spark, sf_dir)
    return rounded(outputs.monitored_history(long, limits), "ewma", *LIMITS)


def multi_sensor_health_by_series(spark, sf_dir):
    df = health.multi_sensor_health(extract.sensor_history(*stored_by_series(spark, sf_dir)))
    return rounded(df, *_HEALTH_DOUBLES, "ooc_rate_2d", "ewma_slope_z_per_day_24h")


def pm_events_by_series(spark, sf_dir):
    return extract.pm_events(stored_by_series(spark, sf_dir)[0])


# --- summaries ------------------------------------------------------------------------------


def fleet_ooc_summary(spark, sf_dir):
    return rounded(summary.fleet_ooc_summary(history(sensor_tables(spark, sf_dir))), "percent_ooc")


def fleet_ooc_table(spark, sf_dir):
    table = outputs.fleet_ooc_table(processed(sensor_tables(spark, sf_dir)), window_days=3)
    return rounded(table, "percent_ooc")


def fleet_ooc_report(spark, sf_dir):
    """How often was each entity of a fleet out of control over the last three days?"""
    t = sensor_tables(spark, sf_dir)
    df = outputs.fleet_ooc_report(
        t.long, t.limits, "CPR", "vibration_rms", window_days=3, cuts=t.long_series
    )
    return rounded(df, "percent_ooc")


def pm_event_ooc_summary(spark, sf_dir):
    return summary.pm_event_ooc_summary(pm_history(sensor_tables(spark, sf_dir)))


def pm_event_table(spark, sf_dir):
    return summary.pm_event_table(pm_event_ooc_summary(spark, sf_dir))


_HEALTH_DOUBLES = ("latest_ewma", "centerline", "std", "latest_z_score")


def multi_sensor_health(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    df = health.multi_sensor_health(history(t), cuts=t.long_series, tasks=t.tasks)
    return rounded(df, *_HEALTH_DOUBLES, "ooc_rate_2d", "ewma_slope_z_per_day_24h")


def multi_sensor_health_fast(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    df = health.multi_sensor_health(
        history(t), ewma_alpha=0.9, window_days=5, slope_window_hours=48, cuts=t.long_series
    )
    return rounded(df, *_HEALTH_DOUBLES, "ooc_rate_5d", "ewma_slope_z_per_day_48h")


def health_table(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    df = health.health_table(health.multi_sensor_health(history(t), cuts=t.long_series, tasks=t.tasks))
    return rounded(df, "latest_z_score", "ooc_rate_2d", "ewma_slope_z_per_day_24h")


def health_attention_flag(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    df = health.multi_sensor_health(history(t), ewma_alpha=0.9, cuts=t.long_series)
    flagged = health.health_attention_flag(health.health_table(df))
    return flagged.select(*SERIES_KEYS, "baseline_trend", "health_status", "needs_attention")


# --- charts ---------------------------------------------------------------------------------


def latest_limits(spark, sf_dir):
    return rounded(charts.latest_limits(history(sensor_tables(spark, sf_dir))), *LIMITS)


def spc_chart_series(spark, sf_dir):
    return rounded(charts.spc_chart_series(processed(sensor_tables(spark, sf_dir))), "ewma", *LIMITS)


def fleet_trend_series(spark, sf_dir):
    df = charts.fleet_trend_series(processed(sensor_tables(spark, sf_dir)))
    return rounded(df, "ewma", "violation_ewma", *LIMITS)


def spc_chart_drawn(spark, sf_dir):
    """Raw points of every series as they show on a chart of 40 columns."""
    chart = charts.spc_chart_series(processed(sensor_tables(spark, sf_dir)))
    return charts.drawn_points(chart, "value", pixels=40)


def fleet_trend_drawn(spark, sf_dir):
    """Averaged traces on the time axis of their fleet, 60 columns."""
    trend = charts.fleet_trend_series(processed(sensor_tables(spark, sf_dir)))
    return rounded(charts.drawn_points(trend, "ewma", pixels=60, axis=CHART_KEYS), "ewma")


def chart_filter(spark, sf_dir):
    """One entity's chart out of a frame of all."""
    df = processed(sensor_tables(spark, sf_dir))
    return rounded(charts.spc_chart_series(df, "CPR", "CPR02", "vibration_rms"), "ewma", *LIMITS)


def limits_absent(spark, sf_dir):
    """Rates and chart limits of readings that came without limit columns."""
    df = extract.normal_readings(sensor_tables(spark, sf_dir).long)
    return summary.fleet_ooc_summary(df).join(charts.latest_limits(df), CHART_KEYS)


# --- sinks and display orders -----------------------------------------------------------------


def extract_sink(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    df = extract.fleet_sensor_history(t.long, t.limits, "CPR", "vibration_rms", None, "2024-01-25")
    return rounded(write_frame(df, new_path(spark, "extract")), *LIMITS)


def table_csv_sink(spark, sf_dir):
    """The table of maintenance events as another program reads it from its CSV files."""
    path = new_path(spark, "events-csv")
    write_table_csv(pm_event_table(spark, sf_dir), path)
    columns = "entity string, timestamp timestamp_ntz, hours_since_last_maintenance double, failure_type string, ooc_sensors string"
    # Readers of CSV take an empty cell for NULL; an event without sensors has an empty one.
    return spark.read.option("header", True).schema(columns).csv(path).na.fill("", ["ooc_sensors"])


def catalog_json_sink(spark, sf_dir):
    path = new_path(spark, "catalog-json")
    write_catalog_json(catalog(spark, sf_dir), path)
    return spark.read.schema("kind string, entity_group string, name string").json(path)


def placed(df: DataFrame, *columns: str) -> DataFrame:
    """Columns of a sorted frame and each row's place, from its partition and place therein."""
    numbered = df.select(*columns, F.monotonically_increasing_id().alias("_id"))
    stored = materialize(numbered, "placed").withColumns(
        {"_part": F.shiftrightunsigned("_id", 33), "_in_part": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}
    )
    # One row per partition of the sort.
    parts = materialize(stored.groupBy("_part").agg(F.count(F.lit(1)).alias("n")), "placed-parts")
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_part", before.alias("_before"))
    return stored.join(parts, "_part").select(*columns, (F.col("_before") + F.col("_in_part") + 1).alias("place"))


def extract_order(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    return placed(outputs.in_time_order(extract.entity_all_sensor_history(t.long, t.limits, "CPR")), "ts", "entity", "sensor")


def severity_order(spark, sf_dir):
    """Status and score by place; scores that are equal but for the last bits may swap their sensors."""
    df = health.multi_sensor_health(history(sensor_tables(spark, sf_dir)))
    return rounded(placed(health.by_severity(df), "health_status", "latest_z_score"), "latest_z_score").withColumn(
        "latest_z_score", F.abs("latest_z_score")
    )


def fleet_report_order(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    return placed(outputs.fleet_ooc_report(t.long, t.limits, "CPR", "vibration_rms"), "entity")


def event_report_order(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    return placed(outputs.pm_event_report(t.long, t.limits, "CPR"), "timestamp", "entity")


def fleet_boxplot_stats(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    df = charts.fleet_boxplot_stats(history(t), cuts=t.long_series)
    return rounded(df, "q1", "median", "q3", "whisker_low", "whisker_high")


def fleet_boxplot_chart(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    df = charts.fleet_boxplot_chart(history(t), cuts=t.long_series)
    return rounded(df, "q1", "median", "q3", "whisker_low", "whisker_high", *LIMITS)


def fleet_boxplot_ewma(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    df = charts.fleet_boxplot_stats(processed(t), show_ewma=True, cuts=t.long_series)
    return rounded(df, "q1", "median", "q3", "whisker_low", "whisker_high")


def fleet_boxplot_outliers(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    return charts.fleet_boxplot_outliers(history(t), cuts=t.long_series)


# --- the same with series cut into chunks ----------------------------------------------------

# Readings per chunk, low enough that every series of the test data is cut.
SHORT_CHUNK = 20


def cut_series(t: SensorTables):
    return find_long_series(t.long, SERIES_KEYS, SHORT_CHUNK)


def ewma_spc_cut(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    return rounded(spc.ewma_spc(history(t), cuts=cut_series(t), tasks=t.tasks), "ewma", *LIMITS)


def maintenance_block_cut(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    df = ewma.maintenance_block(extract.normal_readings(t.long), cuts=cut_series(t))
    return df.select(*SERIES_KEYS, "ts", "hours_since_maintenance", "value", "maintenance_block")


def pm_events_cut(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    return extract.pm_events(t.long, cuts=find_long_series(t.long, ENTITY_KEYS, SHORT_CHUNK))


def multi_sensor_health_cut(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    df = health.multi_sensor_health(history(t), cuts=cut_series(t))
    return rounded(df, *_HEALTH_DOUBLES, "ooc_rate_2d", "ewma_slope_z_per_day_24h")


def fleet_boxplot_stats_cut(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    df = charts.fleet_boxplot_stats(history(t), cuts=cut_series(t))
    return rounded(df, "q1", "median", "q3", "whisker_low", "whisker_high")


# --- batches and reuse ----------------------------------------------------------------------


def data_requests(t: SensorTables) -> DataFrame:
    """Requests that follow from the data: two per chart and two per entity."""
    fleet, each = t.long.select(*CHART_KEYS).distinct(), t.long.select(*ENTITY_KEYS).distinct()
    no_entity, vibration = F.lit(None).cast("string"), F.lit("vibration_rms")

    def ask(df, kind, entity, sensor, start, end):
        parts = [F.lit(kind), F.col("entity_group"), entity, sensor]
        return df.select(
            F.concat_ws("/", *parts).alias("request_id"),
            "entity_group",
            entity.alias("entity"),
            sensor.alias("sensor"),
            moment(start).alias("start_ts"),
            moment(end).alias("end_ts"),
        )

    return (
        ask(fleet, "early", no_entity, F.col("sensor"), None, "2024-01-12 08:00:00")
        .unionByName(ask(fleet, "middle", no_entity, F.col("sensor"), "2024-01-10", "2024-01-13"))
        .unionByName(ask(each, "late", F.col("entity"), vibration, "2024-01-18 18:30:00", None))
        .unionByName(ask(each, "all", F.col("entity"), F.lit("rpm"), None, None))
    )


def batch_requests(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    df = requests.batch_requests(t.long, t.limits, data_requests(t), cuts=t.long_series, series=t.series)
    return rounded(df.select("request_id", *SERIES_KEYS, "ts", "value", "ewma", "spc_violation"), "ewma")


def batch_alphas(spark, sf_dir):
    """Averages of many requests, each with its own factor: 0.7, 1, or the usual one."""
    t = sensor_tables(spark, sf_dir)
    kind = F.split("request_id", "/")[0]
    asked = data_requests(t).withColumn("ewma_alpha", F.when(kind == "late", 0.7).when(kind == "middle", 1.0))
    df = requests.batch_requests(t.long, t.limits, asked, cuts=t.long_series, series=t.series)
    return rounded(df.select("request_id", *SERIES_KEYS, "ts", "ewma_alpha", "ewma", "spc_violation"), "ewma")


def batch_ooc_sliced(spark, sf_dir):
    """Rates of many requests, over the last days of two entities, between two times, at the last tick, and whole."""
    t = sensor_tables(spark, sf_dir)
    nothing, no_time, no_days = F.lit(None).cast("array<string>"), moment(None), F.lit(None).cast("int")
    pair = F.array(F.concat("entity_group", F.lit("02")), F.concat(F.lit(" "), "entity_group", F.lit("06 ")), F.lit(""))
    asked = data_requests(t)

    def outputs_of(kind, output, entities, start, end, days):
        return asked.where(F.split("request_id", "/")[0] == kind).select(
            "request_id", F.lit(output).alias("output"), entities.alias("slice_entities"),
            start.alias("slice_start_ts"), end.alias("slice_end_ts"), days.alias("slice_window_days"),
        )

    slices = (
        outputs_of("early", "pair", pair, no_time, no_time, F.lit(2))
        .unionByName(outputs_of("early", "whole", nothing, no_time, no_time, no_days))
        .unionByName(outputs_of("middle", "closed", nothing, moment("2024-01-11"), moment("2024-01-12 06:00:00"), F.lit(1)))
        .unionByName(outputs_of("all", "last", nothing, no_time, no_time, F.lit(0)))
    )
    return rounded(requests.batch_ooc(t.long, t.limits, asked, slices, series=t.series), "percent_ooc")


def batch_health(spark, sf_dir):
    """Health of every group with two factors and two windows, and of two entities within a range."""
    t = sensor_tables(spark, sf_dir)
    groups = t.long.select("entity_group").distinct()
    nothing, usual = F.lit(None).cast("string"), F.lit(None).cast("double")

    def ask(name, entities, start, alpha, days, hours, steady):
        return groups.select(
            F.concat_ws("/", F.lit(name), "entity_group").alias("request_id"), "entity_group", nothing.alias("entity"),
            entities.cast("array<string>").alias("entities"), nothing.alias("sensor"), moment(start).alias("start_ts"),
            moment(None).alias("end_ts"), alpha.alias("ewma_alpha"), F.lit(days).cast("int").alias("window_days"),
            F.lit(hours).cast("int").alias("slope_window_hours"), steady.alias("drifting_slope_z_per_day"),
        )

    pair = F.array(F.concat("entity_group", F.lit("02")), F.concat("entity_group", F.lit("06")))
    asked = (
        ask("usual", F.lit(None), None, usual, None, None, usual)
        .unionByName(ask("fast", F.lit(None), None, F.lit(0.9), 5, 48, F.lit(0.5)))
        .unionByName(ask("pair", pair, "2024-01-12", F.lit(0.4), 3, None, usual))
    )
    df = requests.batch_health(t.long, t.limits, asked, cuts=t.long_series, series=t.series)
    return rounded(df, *_HEALTH_DOUBLES, "ooc_rate", "ewma_slope_z_per_day")


def batch_pm_events(spark, sf_dir):
    """Maintenance events of each group, of two named entities within a range, and of an average's request."""
    t = sensor_tables(spark, sf_dir)
    nothing, events = F.lit(None).cast("string"), F.lit("pm_event_sensor_history")
    columns = ["request_id", "kind", "entity_group", "entity", "entities", "sensor", "start_ts", "end_ts"]

    def ask(name, kind, entities, start, end):
        groups = t.long.select("entity_group").distinct()
        return groups.select(
            F.concat_ws("/", F.lit(name), "entity_group"), kind, "entity_group", nothing, entities, nothing, moment(start), moment(end)
        ).toDF(*columns)

    pair = F.array(F.concat("entity_group", F.lit("02")), F.concat(F.lit(" "), "entity_group", F.lit("06 ")), nothing)
    asked = (
        ask("all", events, F.lit(None).cast("array<string>"), None, None)
        .unionByName(ask("pair", events, pair, "2024-01-10", "2024-01-20 12:00:00"))
        .unionByName(ask("average", F.lit("entity_all_sensor_history"), pair, None, None))
    )
    return rounded(requests.batch_pm_events(t.long, t.limits, asked, cuts=t.long_entities, series=t.series), *LIMITS)


def run_filter_inventory(spark, sf_dir):
    return requests.run_filter_inventory(data_requests(sensor_tables(spark, sf_dir)))


def invalid_requests(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    one, fleet, every = "entity_sensor_history", "fleet_sensor_history", "entity_all_sensor_history"
    each = t.long.select(*ENTITY_KEYS).distinct()
    group, entity, nothing = F.col("entity_group"), F.col("entity"), F.lit(None).cast("string")
    cases = [
        ("good", one, group, entity, F.lit("rpm")),
        ("good_all", every, group, nothing, nothing),
        ("no_sensor", fleet, group, nothing, F.lit(" ")),
        ("no_entity", one, group, F.lit(""), F.lit("rpm")),
        ("no_group", every, nothing, entity, nothing),
        ("odd_kind", "entity_history", group, entity, nothing),
        ("odd_group", fleet, F.concat(group, F.lit("X")), nothing, F.lit("rpm")),
        ("odd_entity", one, group, F.concat(entity, F.lit("X")), F.lit("rpm")),
        ("odd_sensor", one, group, entity, F.lit("torque")),
        ("other_group", one, F.when(group == "CPR", "PMP").otherwise("CPR"), entity, F.lit("rpm")),
    ]
    variants = F.array(
        *[
            F.struct(
                F.concat_ws("/", F.lit(name), entity).alias("request_id"),
                F.lit(kind).alias("kind"),
                g.alias("entity_group"),
                e.alias("entity"),
                s.alias("sensor"),
            )
            for name, kind, g, e, s in cases
        ]
    )
    return requests.invalid_requests(each.select(F.inline(variants)), t.long)


def pm_event_windows(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    events = extract.pm_events(t.long, cuts=t.long_entities)
    return rounded(requests.pm_event_windows(t.long, t.limits, events, days=1), *LIMITS)


def shared_outputs(spark, sf_dir):
    named = outputs.shared_outputs(
        processed(sensor_tables(spark, sf_dir)),
        {
            "all": outputs.fleet_ooc_table,
            "last_3_days": lambda df: outputs.fleet_ooc_table(df, window_days=3),
            "first_week": lambda df: outputs.fleet_ooc_table(df, end_ts="2024-01-07 23:59:59"),
        },
    )
    frames = [df.withColumn("output", F.lit(name)) for name, df in named.items()]
    return rounded(frames[0].unionByName(frames[1]).unionByName(frames[2]), "percent_ooc")


def replot_slices(spark, sf_dir):
    stored = write_frame(processed(sensor_tables(spark, sf_dir)), folder_of(spark, sf_dir, "processed"))
    table = outputs.replot(
        stored, summary.fleet_ooc_summary, end_ts="2024-01-22 00:00:00", window_days=6
    )
    return rounded(table, "percent_ooc")


# --- verification ---------------------------------------------------------------------------

_PRINTED = ["ts", *SERIES_KEYS, "operating_mode", "failure_type", "value"]


def printed(t: SensorTables) -> DataFrame:
    return t.long.select(_PRINTED)


def altered(df: DataFrame) -> DataFrame:
    """The same table with one chart missing and the readings of another moved."""
    kept = df.where(~((F.col("entity_group") == "ARM") & (F.col("sensor") == "rpm")))
    moved = (F.col("entity_group") == "CPR") & (F.col("sensor") == "vibration_rms")
    return kept.withColumn("value", F.when(moved, F.col("value") + 1).otherwise(F.col("value")))


def without_cnc_ambient(df: DataFrame) -> DataFrame:
    return df.where(~((F.col("entity_group") == "CNC") & (F.col("sensor") == "ambient_temp")))


def table_fingerprint(spark, sf_dir):
    return verify.table_fingerprint(printed(sensor_tables(spark, sf_dir)), CHART_KEYS, digits=9)


def manifest_compare(spark, sf_dir):
    df = printed(sensor_tables(spark, sf_dir))
    expected = verify.table_fingerprint(without_cnc_ambient(df), CHART_KEYS, digits=9)
    return verify.manifest_compare(expected, verify.table_fingerprint(altered(df), CHART_KEYS, digits=9), CHART_KEYS)


def verify_with_reuse(spark, sf_dir):
    df = printed(sensor_tables(spark, sf_dir))
    early = df.where(F.col("ts") < moment("2024-01-08"))

    def manifest(frame, scope):
        return verify.table_fingerprint(frame, CHART_KEYS, digits=9).withColumn("scope", F.lit(scope))

    base = materialize(manifest(df, "base"), "manifest")
    expected = base.unionByName(manifest(without_cnc_ambient(early), "replot/early"))
    actual = base.unionByName(manifest(altered(early), "replot/early")).unionByName(
        manifest(early, "replot/no_manifest")
    )
    return verify.verify_scopes(expected, actual, CHART_KEYS)


def compare_runs(spark, sf_dir):
    t = sensor_tables(spark, sf_dir)
    original = summary.pm_event_ooc_summary(pm_history(t))
    later = extract.pm_event_history(t.long, t.limits, start_ts="2024-01-06", cuts=t.long_entities, tasks=t.tasks)
    return verify.compare_runs(original, summary.pm_event_ooc_summary(later), ["entity"])


def difference_tree(spark, sf_dir):
    df = printed(sensor_tables(spark, sf_dir))
    both = (verify.table_fingerprint(side, SERIES_KEYS) for side in (without_cnc_ambient(df), altered(df)))
    return verify.difference_tree(*both, SERIES_KEYS)


def located_differences(spark, sf_dir):
    df = printed(sensor_tables(spark, sf_dir))
    return verify.located_differences(without_cnc_ambient(df), altered(df), CHART_KEYS)


def differing_rows(spark, sf_dir):
    df = printed(sensor_tables(spark, sf_dir))
    return verify.differing_rows(without_cnc_ambient(df), altered(df))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "derive_entity": derive_entity,
    "unpivot_sensors": unpivot_sensors,
    "ingest": ingested,
    "csv_folder": csv_folder,
    "ingest_two_batches": ingest_two_batches,
    "incremental_averages": incremental_averages,
    "incremental_late": incremental_late,
    "incremental_events": incremental_events,
    "spc_limits": spc_limits,
    "catalog": catalog,
    "entities_by_group": entities_by_group,
    "entity_filter_one_many": entity_filter_one_many,
    "time_range_extract": time_range_extract,
    "time_slice_run": time_slice_run,
    "time_slice_replot": time_slice_replot,
    "entity_subset_slice": entity_subset_slice,
    "join_limits": join_limits,
    "entity_sensor_history": entity_sensor_history,
    "fleet_sensor_history": fleet_sensor_history,
    "entity_all_sensor_history": entity_all_sensor_history,
    "pm_events": pm_events,
    "pm_events_in_range": pm_events_in_range,
    "pm_event_join_back": pm_event_join_back,
    "pm_event_sensor_history": pm_event_sensor_history,
    "maintenance_block": maintenance_block,
    "ewma": ewma_reset,
    "ewma_whole_series": ewma_whole_series,
    "ewma_spc": ewma_spc,
    "ewma_violation_variant": ewma_violation_variant,
    "monitored_history": monitored_history,
    "ewma_spc_by_series": ewma_spc_by_series,
    "multi_sensor_health_by_series": multi_sensor_health_by_series,
    "pm_events_by_series": pm_events_by_series,
    "fleet_ooc_summary": fleet_ooc_summary,
    "fleet_ooc_table": fleet_ooc_table,
    "fleet_ooc_report": fleet_ooc_report,
    "pm_event_ooc_summary": pm_event_ooc_summary,
    "pm_event_table": pm_event_table,
    "multi_sensor_health": multi_sensor_health,
    "multi_sensor_health_fast": multi_sensor_health_fast,
    "health_table": health_table,
    "health_attention_flag": health_attention_flag,
    "latest_limits": latest_limits,
    "spc_chart_series": spc_chart_series,
    "fleet_trend_series": fleet_trend_series,
    "spc_chart_drawn": spc_chart_drawn,
    "fleet_trend_drawn": fleet_trend_drawn,
    "fleet_boxplot_stats": fleet_boxplot_stats,
    "fleet_boxplot_chart": fleet_boxplot_chart,
    "fleet_boxplot_ewma": fleet_boxplot_ewma,
    "fleet_boxplot_outliers": fleet_boxplot_outliers,
    "ewma_spc_cut": ewma_spc_cut,
    "maintenance_block_cut": maintenance_block_cut,
    "pm_events_cut": pm_events_cut,
    "multi_sensor_health_cut": multi_sensor_health_cut,
    "fleet_boxplot_stats_cut": fleet_boxplot_stats_cut,
    "batch_requests": batch_requests,
    "batch_pm_events": batch_pm_events,
    "batch_alphas": batch_alphas,
    "batch_ooc_sliced": batch_ooc_sliced,
    "batch_health": batch_health,
    "run_filter_inventory": run_filter_inventory,
    "invalid_requests": invalid_requests,
    "pm_event_windows": pm_event_windows,
    "shared_outputs": shared_outputs,
    "replot_slices": replot_slices,
    "table_fingerprint": table_fingerprint,
    "manifest_compare": manifest_compare,
    "verify_with_reuse": verify_with_reuse,
    "compare_runs": compare_runs,
    "differing_rows": differing_rows,
    "difference_tree": difference_tree,
    "located_differences": located_differences,
    "time_slice_run_kept": time_slice_run_kept,
    "time_slice_replot_kept": time_slice_replot_kept,
    "entity_subset_slice_kept": entity_subset_slice_kept,
    "series_extents": series_extents,
    "chart_limits_kept": chart_limits_kept,
    "guarded_run": guarded_run,
    "chart_filter": chart_filter,
    "limits_absent": limits_absent,
    "extract_sink": extract_sink,
    "table_csv_sink": table_csv_sink,
    "catalog_json_sink": catalog_json_sink,
    "extract_order": extract_order,
    "severity_order": severity_order,
    "fleet_report_order": fleet_report_order,
    "event_report_order": event_report_order,
}
