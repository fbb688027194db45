"""What the plans look like: shuffles, joins, scans; and hot keys end to end."""

import re

import pytest
from pyspark.sql import functions as F

from checks.compare import connect, difference, ordered
from checks.oracle import ORACLE
from checks.queries import QUERIES, sensor_tables
from conftest import DATA
from fleetspc.operators import charts, extract, health, series, spc
from fleetspc.plans import outputs
from fleetspc.plans.setup import ingest
from fleetspc.schemas import ENTITY_KEYS, SERIES_KEYS
from fleetspc.sources.events_log import machine_log


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"\bExchange ", plan(df)))


@pytest.fixture(scope="module")
def tables(spark):
    return sensor_tables(spark, DATA)


@pytest.fixture(scope="module")
def readings(tables):
    return extract.sensor_history(tables.long, tables.limits)


def test_one_shuffle_per_series_computation(readings, tables):
    assert shuffles(spc.ewma_spc(readings, cuts=None)) == 1
    assert shuffles(outputs.monitored_history(tables.long, tables.limits, cuts=None)) == 1
    assert shuffles(health.multi_sensor_health(readings, cuts=None)) == 1
    assert shuffles(extract.pm_events(tables.long, cuts=None)) == 1
    history = extract.pm_event_history(tables.long, tables.limits, cuts=None)
    # One scan of the readings, one of the limits.
    assert shuffles(history) == 1 and plan(history).count("FileScan") == 2
    assert shuffles(charts.fleet_boxplot_stats(readings, cuts=None)) == 1


def test_rates_do_not_compute_averages(tables):
    df = outputs.fleet_ooc_report(tables.long, tables.limits, "CPR", "rpm", cuts=None)
    assert "Window" not in plan(df) and "hours_since_maintenance" not in plan(df)


def test_time_window_reaches_the_scan(tables):
    df = outputs.fleet_ooc_report(tables.long, tables.limits, "CPR", "rpm", window_days=3, cuts=None)
    assert re.search(r"FileScan parquet[^\n]*\n[^\n]*\+- Subquery", plan(df))


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "Pandas" not in text
    assert difference(df, duck, name) is None


def test_a_machine_with_a_third_of_all_rows(spark, tmp_path):
    """Cut into chunks it gives what it gives whole."""
    events = spark.read.parquet(f"{DATA}/events.parquet")
    hot = events.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(2)).otherwise(F.col("user_id")))
    t = ingest(machine_log(hot), str(tmp_path / "hot"))
    history = extract.sensor_history(t.long, t.limits)
    cuts = series.find_long_series(t.long, SERIES_KEYS, 100)
    entities = series.find_long_series(t.long, ENTITY_KEYS, 600)
    assert len({r.entity for r in cuts[0].collect()}) == 1 == entities[0].count()

    def same(a, b, *doubles):
        a, b = (df.withColumns({c: F.round(F.col(c) + 3.3e-8, 6) for c in doubles}).toPandas() for df in (a, b))
        assert ordered(a).equals(ordered(b))

    limits = ("ucl", "centerline", "lcl")
    same(spc.ewma_spc(history, cuts=None), spc.ewma_spc(history, cuts=cuts), "ewma", *limits)
    scores = ("latest_ewma", "centerline", "std", "latest_z_score", "ooc_rate_2d", "ewma_slope_z_per_day_24h")
    same(health.multi_sensor_health(history, cuts=None), health.multi_sensor_health(history, cuts=cuts), *scores)
    same(extract.pm_events(t.long, cuts=None), extract.pm_events(t.long, cuts=entities))
    boxes = ("q1", "median", "q3", "whisker_low", "whisker_high")
    same(charts.fleet_boxplot_stats(history, cuts=None), charts.fleet_boxplot_stats(history, cuts=cuts), *boxes)


def test_small_sides_may_outgrow_broadcasting(spark, tables):
    """With broadcasts off, joins shuffle and give the same rows."""
    from checks import queries

    names = ["join_limits", "batch_requests", "pm_event_windows", "fleet_boxplot_outliers", "spc_chart_series"]
    cuts = series.find_long_series(tables.long, SERIES_KEYS, 20)

    def results():
        history = extract.sensor_history(tables.long, tables.limits)
        frames = [queries.QUERIES[n](spark, DATA) for n in names]
        frames.append(queries.rounded(spc.ewma_spc(history, cuts=cuts), "ewma"))
        frames.append(charts.fleet_boxplot_stats(history, cuts=cuts))
        return [plan(df) for df in frames], [ordered(df.toPandas()) for df in frames]

    _, want = results()
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for s in settings:
        spark.conf.set(s, "-1")
    try:
        plans, got = results()
    finally:
        for s in settings:
            spark.conf.unset(s)
    # Filters of partitions at run time are in the plan too, and are empty where nothing is broadcast.
    joins = [re.sub(r"SubqueryAdaptiveBroadcast", "", p) for p in plans[:5]]
    assert all("SortMergeJoin" in p and "Broadcast" not in p for p in joins)
    assert all("NestedLoop" not in p and "Cartesian" not in p for p in plans)
    assert all(a.equals(b) for a, b in zip(want, got))


def test_windows_are_dealt_by_the_number_of_readings(spark, tables, monkeypatch):
    """With their number known, windows have tasks by it, in the one shuffle they had before, and the same rows."""
    monkeypatch.setattr(series, "ROWS_PER_TASK", 100)
    n = tables.long.count()
    tasks = series.tasks_for(n, 3)
    assert tasks == -(-n // 100) and series.tasks_for(100, 3) is None and series.tasks_for(150, 3) == 3
    history = extract.sensor_history(tables.long, tables.limits)
    cuts = series.find_long_series(tables.long, SERIES_KEYS, 20)
    for make in (
        lambda **k: spc.ewma_spc(history, **k), lambda **k: health.multi_sensor_health(history, **k),
        lambda **k: extract.pm_event_history(tables.long, tables.limits, **k),
    ):
        dealt = make(tasks=tasks)
        assert shuffles(dealt) == 1 and f"{tasks}), REPARTITION_BY_NUM" in plan(dealt)
        assert ordered(dealt.toPandas()).equals(ordered(make().toPandas()))
    a, b = (spc.ewma_spc(history, cuts=cuts, tasks=k).withColumn("ewma", F.round("ewma", 6)) for k in (7, None))
    assert ordered(a.toPandas()).equals(ordered(b.toPandas()))
