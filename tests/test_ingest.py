import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import DATA, as_set, reading
from fleetspc.operators.ingest import catalog, derive_entity, entities_by_group, spc_limits, unpivot_sensors
from fleetspc.operators.series import find_long_series
from fleetspc.plans.setup import ingest, open_tables
from fleetspc.schemas import LONG, RAW, SENSORS, assert_not_empty
from fleetspc.sources import tables
from fleetspc.sources.events_log import machine_log

T0 = datetime(2024, 1, 1)


def raw(spark, *rows):
    return spark.createDataFrame(rows, RAW)


def tick(machine_id=7, machine_type="Pump", mode="normal", hours=1.0, values=(1.0,) * 6, ts=T0):
    return (ts, machine_id, machine_type, mode, hours, 0, 10.0, "none", *values)


def test_entity_names(spark):
    df = raw(spark, tick(7, "Pump"), tick(12, "Robotic Arm"), tick(123, "Compressor"), tick(1, "Lathe"), tick(0, "CNC"))
    assert as_set(derive_entity(df), "entity_group", "entity") == [
        ("ARM", "ARM12"), ("CNC", "CNC00"), ("CPR", "CPR123"), ("Lathe", "Lathe01"), ("PMP", "PMP07"),
    ]


def test_unpivot_drops_null_and_nan_readings(spark):
    df = raw(spark, tick(values=(1.0, None, math.nan, 4.0, 5.0, 6.0), hours=math.nan))
    long = unpivot_sensors(derive_entity(df))
    assert long.schema.fieldNames() == LONG.fieldNames()
    assert as_set(long, "sensor", "value") == [
        ("ambient_temp", 6.0), ("pressure_level", 4.0), ("rpm", 5.0), ("vibration_rms", 1.0),
    ]
    assert long.where("hours_since_maintenance is not null").count() == 0


def test_limits_use_normal_rows_and_the_sample_deviation(history):
    df = history(
        reading(value=1.0), reading(value=3.0), reading(value=99.0, mode="peak"),
        reading(sensor="single", value=5.0), reading(group=None, value=7.0),
    )
    rows = {r.sensor: r for r in spc_limits(df).collect()}
    assert set(rows) == {"rpm", "single"}
    std = math.sqrt(2)
    assert rows["rpm"].mean == rows["rpm"].centerline == 2.0
    assert rows["rpm"].ucl == pytest.approx(2 + 3 * std) and rows["rpm"].lcl == pytest.approx(2 - 3 * std)
    assert rows["single"]["std"] is None and rows["single"].ucl is None


def test_catalog_lists_every_name_once(history):
    df = history(reading("CPR01"), reading("CPR01", "vibration_rms"), reading("PMP02", group="PMP"))
    assert as_set(catalog(df)) == sorted([
        ("entity_group", None, "CPR"), ("entity_group", None, "PMP"), ("entity", None, "CPR01"),
        ("entity", None, "PMP02"), ("sensor", None, "rpm"), ("sensor", None, "vibration_rms"),
        ("group_entity", "CPR", "CPR01"), ("group_entity", "PMP", "PMP02"),
    ], key=repr)
    assert as_set(entities_by_group(df)) == [("CPR", "CPR01"), ("PMP", "PMP02")]


def test_raw_csv_is_read_by_column_name(spark, tmp_path):
    header = ["machine_id", "timestamp", "machine_type", "operating_mode", "hours_since_maintenance",
              "failure_within_24h", "rul_hours", "failure_type", *SENSORS, "extra"]
    line = "7,2024-01-13 19:32:57,Pump,normal,16.4,0,61.18,none,2.38,53.05,,1,2,3,x"
    (tmp_path / "raw.csv").write_text(",".join(header) + "\n" + line + "\n")
    df = tables.read_raw_csv(spark, str(tmp_path / "raw.csv"))
    assert df.schema == RAW
    row = df.collect()[0]
    assert row.timestamp == datetime(2024, 1, 13, 19, 32, 57) and row.current_phase_avg is None and row.machine_id == 7


def test_nan_text_is_null(spark, tmp_path):
    (tmp_path / "nan.csv").write_text("entity_group,sensor,mean,std,ucl,centerline,lcl\nCPR,rpm,1.0,NaN,NaN,1.0,\n")
    row = tables.read_limits_csv(spark, str(tmp_path / "nan.csv")).collect()[0]
    assert (row["std"], row.ucl, row.centerline) == (None, None, 1.0)


def test_large_logs_get_more_files(spark, monkeypatch):
    from fleetspc.plans import setup

    log = raw(spark, *[tick(i) for i in range(10)])
    assert setup.files_for(log) is None
    monkeypatch.setattr(setup, "READINGS_PER_FILE", 3)
    assert setup.files_for(log) == 20


def test_long_and_limits_csv(spark, tmp_path):
    (tmp_path / "long.csv").write_text(
        "timestamp,entity,entity_group,operating_mode,hours_since_maintenance,failure_within_24h,rul_hours,failure_type,sensor,value\n"
        "2024-01-13 19:40:57,CPR11,CPR,normal,16.53,0,61.04,none,vibration_rms,2.38\n"
    )
    (tmp_path / "limits.csv").write_text("entity_group,sensor,mean,std,ucl,centerline,lcl\nCPR,vibration_rms,2.5,0.5,4.0,2.5,\n")
    long = tables.read_long_csv(spark, str(tmp_path / "long.csv"))
    assert long.schema == LONG and long.collect()[0].ts == datetime(2024, 1, 13, 19, 40, 57)
    assert tables.read_limits_csv(spark, str(tmp_path / "limits.csv")).collect()[0].lcl is None


def test_ingest_stores_what_it_derives(spark, tmp_path):
    log = machine_log(spark.read.parquet(f"{DATA}/events.parquet"))
    t = ingest(log, str(tmp_path / "a"))
    assert t.long.schema == LONG and t.long_series is None
    want = unpivot_sensors(derive_entity(log))
    assert t.long.exceptAll(want).isEmpty() and want.exceptAll(t.long).isEmpty()
    assert t.limits.count() == 24
    again = open_tables(spark, str(tmp_path / "a"))
    assert again.long.count() == 5862


def test_ingest_replaces_an_earlier_table(spark, tmp_path):
    ingest(raw(spark, tick(7), tick(8)), str(tmp_path / "b"))
    assert ingest(raw(spark, tick(9)), str(tmp_path / "b")).long.count() == 6


def test_stored_filters_reach_the_scan(spark, tmp_path):
    t = ingest(machine_log(spark.read.parquet(f"{DATA}/events.parquet")), str(tmp_path / "c"))
    df = t.long.where("entity_group = 'CPR' and sensor = 'rpm' and entity = 'CPR02' and ts >= timestamp_ntz'2024-01-10'")
    plan = df.select("ts", "value")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(entity_group" in plan and "GreaterThanOrEqual(ts" in plan
    assert "EqualTo(entity,CPR02)" in plan and "rul_hours" not in plan


def test_machine_log_is_the_same_when_machines_are_cut(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    cuts = find_long_series(events, ["user_id"], 10)
    assert cuts is not None
    whole, cut = machine_log(events, cuts=None), machine_log(events, cuts=cuts)
    assert whole.count() == cut.count() and whole.exceptAll(cut).isEmpty()


def test_sinks(spark, tmp_path, history):
    df = history(reading())
    assert tables.write_frame(df, str(tmp_path / "f")).collect() == df.collect()
    tables.write_table_csv(df.select("entity", "value"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()[0].asDict() == {"entity": "CPR01", "value": "1.0"}
    tables.write_catalog_json(catalog(df), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 4


def test_empty_frames_are_an_error_on_request_only(history):
    empty = history(reading()).where(F.lit(False))
    with pytest.raises(ValueError):
        assert_not_empty(empty, "extract")
    assert assert_not_empty(history(reading()), "extract").count() == 1
