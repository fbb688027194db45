"""Tables stored by series, and operators that start no job of their own."""

import pytest

from conftest import as_set
from fleetspc.operators import charts, ewma, extract, health, spc
from fleetspc.plans import outputs
from fleetspc.sources.tables import read_series, write_series
from fleetspc.sources.workspace import new_path
from test_plans import shuffles, tables  # noqa: F401


@pytest.fixture(scope="module")
def by_series(spark, tables):  # noqa: F811
    path = new_path(spark, "by-series")
    write_series(tables.long, path, 5)
    return path


def test_stored_series_need_no_shuffle(spark, tables, by_series):  # noqa: F811
    long, limits = read_series(spark, by_series), tables.limits
    assert as_set(long) == as_set(tables.long)
    for one, other in (
        (outputs.monitored_history(long, limits), outputs.monitored_history(tables.long, limits)),
        (health.multi_sensor_health(extract.sensor_history(long, limits)), health.multi_sensor_health(extract.sensor_history(tables.long, limits))),
        (extract.pm_events(long), extract.pm_events(tables.long)),
        (extract.pm_event_history(long, limits), extract.pm_event_history(tables.long, limits)),
    ):
        assert shuffles(one) == 0 and shuffles(other) == 1
        assert as_set(one) == as_set(other)


def test_a_session_that_does_not_know_the_table(spark, tables, by_series):  # noqa: F811
    """Its layout is read from the folder; one file a bucket, which holds whole machines."""
    name = read_series(spark, by_series).inputFiles()
    for table in spark.catalog.listTables():
        if table.name.startswith("series_"):
            spark.sql(f"drop table {table.name}")
    again = read_series(spark, by_series)
    assert sorted(again.inputFiles()) == sorted(name) and len(name) <= 5
    assert shuffles(extract.pm_events(again)) == 0 and as_set(again) == as_set(tables.long)


def test_operators_start_no_job(spark, tables):  # noqa: F811
    """Series are counted where that is asked for, and not by default."""
    tracker, group = spark.sparkContext.statusTracker(), "building"
    history = extract.sensor_history(tables.long, tables.limits)
    spark.sparkContext.setJobGroup(group, group)
    try:
        for operator in (
            ewma.ewma, ewma.maintenance_block, spc.ewma_spc, health.multi_sensor_health, extract.pm_events, charts.fleet_boxplot_stats,
            charts.fleet_boxplot_outliers,
        ):
            operator(history)
        extract.pm_event_history(tables.long, tables.limits)
        outputs.health_report(tables.long, tables.limits, "CPR")
        outputs.pm_event_report(tables.long, tables.limits, "CPR")
        outputs.fleet_ooc_report(tables.long, tables.limits, "CPR", "rpm")
        assert list(tracker.getJobIdsForGroup(group)) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
