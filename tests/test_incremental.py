"""Logs that arrive one by one, and versions of tables."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import DAY0, as_set
from fleetspc.operators.extract import pm_event_history
from fleetspc.operators.ingest import derive_entity, spc_limits, unpivot_sensors
from fleetspc.plans.incremental import append_log, open_plant
from fleetspc.plans.outputs import monitored_history
from fleetspc.schemas import RAW, SENSORS
from fleetspc.sources.tables import read_limits
from fleetspc.sources.versions import current_path, drop_versions, finished_versions, replace_frame, replace_table
from fleetspc.sources.workspace import exists, new_path

RND = random.Random(31)


def log(machines=(1, 2, 3), ticks=40):
    """Ticks with maintenance, repeated times, other modes and missing readings."""
    rows = []
    for machine in machines:
        hours = RND.random() * 5
        for t in range(ticks):
            hours = RND.choice([0.0, 0.0, RND.random()]) if RND.random() < 0.12 else hours + 1
            for _ in range(RND.choice([1, 1, 1, 2])):
                values = [RND.choice([RND.gauss(0, 1), RND.gauss(0, 1), None]) for _ in SENSORS]
                ts = None if RND.random() < 0.02 else DAY0 + timedelta(hours=t)
                rows.append((ts, machine, RND.choice(["Pump"]), RND.choice(["normal", "normal", "idle"]), hours, 0, 1.0, RND.choice(["none", "F1"]), *values))
    return rows


def rounded(rows):
    return sorted((tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in r) for r in rows), key=repr)


def parts_of(rows, *cuts):
    """Rows by the hours they come before; those without a time come first."""
    hour = lambda r: -1 if r[0] is None else (r[0] - DAY0).total_seconds() / 3600
    bounds = [-2, *cuts, 10**9]
    return [[r for r in rows if a <= hour(r) < b] for a, b in zip(bounds, bounds[1:])]


def check(spark, parts):
    folder = new_path(spark, "plant")
    for part in parts:
        plant = append_log(spark.createDataFrame(part, RAW), folder)
    long = unpivot_sensors(derive_entity(spark.createDataFrame([r for p in parts for r in p], RAW)))
    limits = spc_limits(long)
    assert rounded(plant.limits().collect()) == rounded(limits.collect())
    assert as_set(plant.long()) == as_set(long)
    assert rounded(plant.processed().collect()) == rounded(monitored_history(long, limits).collect())
    assert rounded(plant.pm_event_history().collect()) == rounded(pm_event_history(long, limits).collect())
    return plant


def test_logs_in_order(spark):
    rows = log()
    plant = check(spark, parts_of(rows, 13, 14, 29))
    series = {tuple(r[:3]): r for r in plant.state("series").collect()}
    n = {tuple(r[:3]): r["count"] for r in plant.averages().groupBy("entity_group", "entity", "sensor").count().collect()}
    assert {k: r["rows"] for k, r in series.items()} == n


def test_late_and_new_machines(spark):
    """A machine that is late, one that comes with the second log, and one that is in the first only."""
    rows = log((1, 2, 3, 4))
    first, second = parts_of([r for r in rows if r[1] != 4], 20)
    late = [r for r in second if r[1] == 2][::3] + [r for r in first if r[1] == 2][::4]
    of = lambda part, *machines: [r for r in part if r[1] in machines and r not in late]
    plant = check(spark, [of(first, 1, 2, 3), of(second, 1, 2) + [r for r in rows if r[1] == 4], late])
    since = {r.entity: r.since for r in plant.state("entities").collect()}
    assert since == {"PMP01": 0, "PMP02": 2, "PMP03": 0, "PMP04": 1}


def test_history_is_not_read_again(spark):
    first, second = parts_of(log((1,)), 20)
    folder = new_path(spark, "plant")
    plant = append_log(spark.createDataFrame(first, RAW), folder)
    files = plant._path(0, "sensor_data"), plant._path(0, "averages"), plant._path(0, "events")
    from fleetspc.sources.workspace import file_system

    for path in files:
        fs, where = file_system(spark, path)
        fs.rename(where, file_system(spark, path + "-away")[1])
    assert append_log(spark.createDataFrame(second, RAW), folder).logs == [0, 1]


def test_a_log_that_fails_leaves_the_plant_as_it_was(spark):
    first, second = parts_of(log((1, 2)), 20)
    folder = new_path(spark, "plant")
    before = as_set(append_log(spark.createDataFrame(first, RAW), folder).processed())
    before_rows = open_plant(spark, folder).long().count()
    broken = spark.createDataFrame(second, RAW).withColumn("machine_type", F.when(F.col("machine_id") == 2, F.raise_error(F.lit("torn"))).otherwise(F.col("machine_type")))
    with pytest.raises(Exception, match="torn"):
        append_log(broken, folder)
    assert open_plant(spark, folder).logs == [0] and as_set(open_plant(spark, folder).processed()) == before
    after = append_log(spark.createDataFrame(second, RAW), folder)
    assert len(after.logs) == 2 and after.long().count() > before_rows
    with pytest.raises(ValueError, match="ewma_alpha"):
        append_log(spark.createDataFrame(second, RAW), folder, 0.5)
    assert open_plant(spark, new_path(spark, "nothing")) is None


LIMIT = "entity_group string, sensor string, mean double, std double, ucl double, centerline double, lcl double"


def test_a_write_that_is_killed_leaves_the_old_table(spark):
    table = new_path(spark, "limits")
    old = spark.createDataFrame([("CPR", "rpm", 1.0, 1.0, 4.0, 1.0, -2.0)], LIMIT)
    replace_frame(old, table)
    reader = read_limits(spark, current_path(spark, table))

    def killed(path):
        old.withColumn("mean", F.lit(9.0)).write.parquet(path)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        replace_table(spark, table, killed)
    assert as_set(read_limits(spark, current_path(spark, table))) == as_set(old)
    # A table may be replaced by what is read from it; a reader of the version before goes on.
    replace_frame(reader.withColumn("mean", F.col("mean") + 1), table)
    assert read_limits(spark, current_path(spark, table)).first()["mean"] == 2.0 and as_set(reader) == as_set(old)
    assert finished_versions(spark, table) == [0, 2]
    drop_versions(spark, table, keep=1)
    assert finished_versions(spark, table) == [2] and not exists(spark, f"{table}/data/{0:012d}") and not exists(spark, f"{table}/data/{1:012d}")
    assert read_limits(spark, current_path(spark, table)).count() == 1
    with pytest.raises(FileNotFoundError):
        current_path(spark, new_path(spark, "nothing"))


def test_a_log_is_dealt_by_ticks(spark):
    """A tick moves once with all its sensors: each task has a file of each sensor, not of some."""
    rows = [(DAY0 + timedelta(hours=t), 1, "Pump", "normal", float(t), 0, 1.0, "none", *[float(t)] * len(SENSORS)) for t in range(96)]
    plant = append_log(spark.createDataFrame(rows, RAW), new_path(spark, "plant"), files=2)
    assert plant.long().count() == 96 * len(SENSORS) and len(plant.long().inputFiles()) == 2 * len(SENSORS)
