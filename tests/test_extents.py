"""What ingest keeps of each series, and guards that ride on an action."""

import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from checks.queries import sensor_tables
from conftest import DATA, DAY0, as_set, reading
from fleetspc.functions.predicates import where_time_range
from fleetspc.operators import charts, extents, extract, spc
from fleetspc.operators.guards import guard
from fleetspc.operators.ingest import deal_ticks, unpivot_sensors
from fleetspc.operators.slices import time_slice
from fleetspc.plans import outputs
from fleetspc.plans.setup import open_tables
from fleetspc.schemas import SENSORS
from fleetspc.sources.versions import finished_versions


def at(hours):
    return DAY0 + timedelta(hours=hours)


@pytest.fixture
def long(history):
    return history(
        reading("a", at=1), reading("a", at=20), reading("a", at=30, mode="peak"), reading("a", at=31),
        reading("b", at=3), reading("b", at=100), reading("b", sensor="temp", at=50), reading("b", at=None),
        reading("c", group="PMP", at=200, mode="idle"), reading("d", group=None, at=12), reading(None, at=13),
    )


BOUNDS = [None, at(0), at(1), at(2), at(20), at(24), at(30), at(31), at(48), at(99), at(100), at(500)]


def test_last_time_is_that_of_a_scan(spark, long):
    kept = extents.extents(long).cache()
    cases = [dict(start_ts=a, end_ts=b, until=None) for a in BOUNDS[::3] for b in BOUNDS]
    cases += [dict(start_ts=None, end_ts=at(40), until=c) for c in BOUNDS] + [dict(until=c) for c in BOUNDS]
    columns, expected = [], []
    for i, case in enumerate(cases):
        names = ({}, {"entity_group": "CPR"}, {"entity": ["a", " b "]}, {"sensor": "rpm", "entity": "b"})[i % 4]
        columns.append(extents.last_time(kept, long, **case, **names).alias(f"c{i}"))
        rows = where_time_range(extract.normal_readings(long, **names), case.get("start_ts"), case.get("end_ts"))
        if case.get("until") is not None:
            rows = rows.where(F.col("ts") <= F.lit(case["until"]).cast("timestamp_ntz"))
        expected.append(rows.agg(F.max("ts").alias(f"e{i}")))
    for lo in range(0, len(columns), 16):
        found = tuple(spark.range(1).select(columns[lo : lo + 16]).first())
        told = tuple(e.first()[0] for e in expected[lo : lo + 16])
        assert found == told


def test_nothing_is_known_of_an_empty_table(spark, long):
    none = long.where("false")
    assert spark.range(1).select(extents.last_time(extents.extents(none), none, until=at(3)).alias("x")).first().x is None


def test_rows_of_odd_readings(long):
    kept = extents.extents(long)
    assert kept.agg(F.sum("n")).first()[0] == long.count()
    assert as_set(kept.where("day is null"), "entity", "n", "first_ts", "last_ts") == [("b", 1, None, None)]
    assert kept.where("entity is null or entity_group is null").count() == 2
    assert kept.where("not normal").agg(F.sum("n")).first()[0] == 2


def test_limits_of_charts_without_readings(long):
    limits = long.sparkSession.createDataFrame([("CPR", "rpm", 3.0, 2.0, 1.0)], "entity_group string, sensor string, ucl double, centerline double, lcl double")
    kept = extents.extents(long)
    frame = extract.join_limits(where_time_range(extract.normal_readings(long.drop("ucl", "centerline", "lcl"))), limits)
    assert as_set(extents.chart_limits(kept, limits)) == as_set(charts.latest_limits(frame))
    assert extents.chart_limits(kept, limits, entity="c").count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_window_starts_no_scan_of_readings(spark):
    t = sensor_tables(spark, DATA)
    df = outputs.sliced_history(t, window_days=3, entity_group="CPR")
    assert len(re.findall(r"FileScan parquet \[[^\]]*operating_mode", plan(df))) == 1
    assert "normal#" in plan(df)
    old = time_slice(extract.sensor_history(t.long, t.limits, entity_group="CPR"), window_days=3)
    assert as_set(df, "entity", "sensor", "ts", "value") == as_set(old, "entity", "sensor", "ts", "value")


def test_opening_tables_reads_no_readings(spark, tmp_path):
    from fleetspc.plans.setup import ingest
    from checks.queries import raw_log

    t = ingest(raw_log(spark, DATA), str(tmp_path / "plant"))
    rows = as_set(t.series)
    # Without the readings' files the counts are still there.
    for file in (tmp_path / "plant" / "sensor_data").rglob("*.parquet"):
        file.write_bytes(b"")
    assert as_set(open_tables(spark, str(tmp_path / "plant")).series) == rows


def jobs_of(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    try:
        with pytest.raises(ValueError) as raised:
            work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)), str(raised.value)


def test_an_empty_extract_raises_after_one_job(spark, long, tmp_path):
    long.write.parquet(str(tmp_path / "long"))
    stored = spark.read.schema(long.schema).parquet(str(tmp_path / "long"))
    none = stored.where("value > 5")

    def work():
        outputs.stored_run(none, lambda df: df.select("entity", "value"), str(tmp_path / "out"), what="the run")

    assert jobs_of(spark, "guarded", work) == (1, "no rows in the run")
    assert finished_versions(spark, str(tmp_path / "out")) == []


def test_guards_tell_what_is_missing(spark, long, tmp_path):
    table = str(tmp_path / "out")
    first = outputs.stored_run(long, spc.ewma_spc, table)
    assert first.count() == spc.ewma_spc(long).count()
    with pytest.raises(ValueError, match="no rows in what was made of the extract"):
        outputs.stored_run(long, lambda df: df.where("value > 5"), table)
    with pytest.raises(ValueError, match="no value in columns \\['ucl'\\]"):
        outputs.stored_run(long, spc.ewma_spc, table, known=["value", "ucl"])
    with pytest.raises(KeyError):
        guard(long, "the extract", ["absent"])
    # The version of the run that passed is the one that readers see.
    assert finished_versions(spark, table) == [0] and outputs.stored_run(long, spc.ewma_spc, table).count() == first.count()


def test_extents_of_a_log_are_those_of_its_readings(spark, tmp_path):
    """NaN and NULL readings, ticks without time, mode, group or entity; and no shuffle of readings."""
    nan = float("nan")
    ticks = [(None if h is None else at(h), e, g, m, v, r) for h in (1, 20, 30, None) for e, g in (("a", "CPR"), ("b", None), (None, "CPR"))
             for m in ("normal", "peak", None) for v, r in ((1.0, None), (nan, 2.0))]
    wide = spark.createDataFrame(ticks, "timestamp timestamp_ntz, entity string, entity_group string, operating_mode string, vibration_rms double, rpm double")
    absent = {c: F.lit(None).cast("double") for c in (*SENSORS, "hours_since_maintenance", "rul_hours") if c not in wide.columns}
    wide = wide.withColumns({**absent, "failure_within_24h": F.lit(0), "failure_type": F.lit("none")})
    readings = unpivot_sensors(wide)
    wanted = as_set(extents.extents(readings), *extents.extents(readings).columns)
    for tasks in (None, 4):
        assert as_set(extents.extents_of_log(wide, tasks), *extents.extents(readings).columns) == wanted
        assert as_set(unpivot_sensors(deal_ticks(wide, tasks))) == as_set(readings)


def test_a_folder_of_extents_is_written_by_several_tasks(spark, tmp_path):
    """The rows of one group and sensor do not meet in one task."""
    kept = sensor_tables(spark, DATA).extents.where("entity_group = 'CPR' and sensor = 'rpm'").repartition(4)
    extents.write_extents(kept, str(tmp_path / "kept"))
    stored = extents.read_extents(spark, str(tmp_path / "kept"))
    assert len(stored.inputFiles()) == 4 and as_set(stored) == as_set(kept.select(stored.columns))
