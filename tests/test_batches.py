"""Many requests in one plan against one request at a time, and what their plans read."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import DAY0, as_set, reading
from fleetspc.operators import requests
from fleetspc.operators.health import HEALTH_PARAMETERS, multi_sensor_health
from fleetspc.operators.ranges import match_segments, range_segments
from fleetspc.operators.series import find_long_series
from fleetspc.operators.slices import sliced_within
from fleetspc.operators.spc import ewma_spc
from fleetspc.plans.outputs import sliced
from fleetspc.schemas import LIMITS, REQUESTS, SERIES_KEYS
from fleetspc.sources.tables import read_long, write_long
from fleetspc.sources.workspace import new_path

RND = random.Random(23)
ENTITIES = ["CPR01", "CPR02", "CPR03"]


def at(hours):
    return None if hours is None else DAY0 + timedelta(hours=hours)


@pytest.fixture(scope="module")
def plant(spark):
    from conftest import HISTORY_SCHEMA

    rows = [
        reading(e, s, at=round(h * 3 + RND.random(), 3), value=RND.gauss(0, 1), hours=float(h % 9))
        for e in (*ENTITIES, None) for s in ("rpm", "temp") for h in range(50)
    ]
    long = spark.createDataFrame(rows, HISTORY_SCHEMA).drop("ucl", "centerline", "lcl")
    limits = spark.createDataFrame([("CPR", s, 0.0, 1.0, 1.5, 0.0, -1.5) for s in ("rpm", "temp")], LIMITS)
    return long, limits


def ask(spark, *rows):
    return spark.createDataFrame([(i, "CPR", e, s, at(a), at(b)) for i, e, s, a, b in rows], REQUESTS)


def test_segments_are_disjoint_and_list_their_ranges(spark):
    ranges = [(k, RND.randint(0, 40), RND.randint(0, 40), f"r{i}") for i, k in enumerate("aab" * 8)]
    df = spark.createDataFrame([(k, at(a), at(b), i) for k, a, b, i in ranges], "k string, start_ts timestamp_ntz, end_ts timestamp_ntz, id string")
    rows = range_segments(df, ["k"]).collect()
    hours = lambda ts: (ts - DAY0).total_seconds() / 3600
    for k in "ab":
        own = sorted((hours(r.from_ts), hours(r.to_ts), {x.id for x in r.ranges}) for r in rows if r.k == k)
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:])) and all(ids for *_, ids in own)
        for hour in range(41):
            here = [ids for low, high, ids in own if low <= hour < high]
            assert (here[0] if here else set()) == {i for x, a, b, i in ranges if x == k and a <= hour < b}


@pytest.mark.parametrize("least_hours", [0.01, 1.0, 1000.0])
def test_readings_meet_every_range_once(spark, least_hours):
    """Long and short ranges of one key, and bins of any width."""
    ranges = [("a", 0, 10_000, "long"), *[("a", 500 + i / 10, 501 + i / 10, f"s{i}") for i in range(30)], ("b", 5, 6, "x"), ("b", 6, 6, "empty")]
    points = [(k, t) for k in "abc" for t in (0, 4.99, 5, 5.999, 6, 500, 500.05, 501.3, 503.9, 504, 9_999.99, 10_000)]
    df = spark.createDataFrame([(k, at(a), at(b), i) for k, a, b, i in ranges], "k string, start_ts timestamp_ntz, end_ts timestamp_ntz, id string")
    rows = spark.createDataFrame([(k, at(t), "kept") for k, t in points], "k string, ts timestamp_ntz, ranges string")
    got = as_set(match_segments(rows, df, ["k"], least_hours=least_hours), "k", "ts", "ranges", "id")
    assert got == sorted(((k, at(t), "kept", i) for k, t in points for x, a, b, i in ranges if x == k and at(a) <= at(t) < at(b)), key=repr)


def test_bins_follow_the_number_of_segments(spark):
    """A key's table has at most two rows a segment and one more, whether its ranges last seconds or centuries."""
    from fleetspc.operators.ranges import binned_segments

    ranges = [("a", 0, 24 * 365_000, "ages")] + [("a", 100 + i, 100.5 + i, f"{i}") for i in range(40)] + [("b", 0, 24 * 365_000, "ages")]
    df = spark.createDataFrame([(k, at(a), at(b), i) for k, a, b, i in ranges], "k string, start_ts timestamp_ntz, end_ts timestamp_ntz, id string")
    segments = range_segments(df, ["k"])
    n = {r["k"]: r["count"] for r in segments.groupBy("k").count().collect()}
    spread = binned_segments(segments, ["k"])
    assert all(r["count"] <= 2 * n[r["k"]] + 1 for r in spread.groupBy("k").count().collect())


def test_own_factors(spark, plant):
    long, limits = plant
    asked = ask(spark, ("a", None, "rpm", None, None), ("b", "CPR01", None, 20, 120), ("c", None, "rpm", 10, None))
    asked = asked.withColumn("ewma_alpha", F.when(F.col("request_id") == "a", 1.0).when(F.col("request_id") == "b", 0.63))
    rows = requests.request_rows(long, limits, asked)
    for cuts in (None, find_long_series(long, SERIES_KEYS, 9)):
        got = requests.batch_requests(long, limits, asked, 0.05, cuts=cuts)
        for name, alpha in (("a", 1.0), ("b", 0.63), ("c", 0.05)):
            mine = as_set(got.where(F.col("request_id") == name), *SERIES_KEYS, "ts", "spc_violation", "ewma")
            want = as_set(ewma_spc(rows.where(F.col("request_id") == name), alpha), *SERIES_KEYS, "ts", "spc_violation", "ewma")
            assert [r[:-1] for r in mine] == [r[:-1] for r in want]
            assert [r[-1] for r in mine] == pytest.approx([r[-1] for r in want])
    with pytest.raises(Exception, match="ewma_alpha must be"):
        requests.batch_requests(long, limits, asked.withColumn("ewma_alpha", F.lit(1.5))).collect()


def test_own_health(spark, plant):
    long, limits = plant
    own = {"a": {}, "b": {"ewma_alpha": 1.0, "window_days": 0, "slope_window_hours": 60}, "c": {"volatile_ooc_rate": 0.01, "drifting_slope_z_per_day": 0.1, "stable_slope_z_per_day": 0.05}}
    asked = ask(spark, ("a", None, None, None, None), ("b", None, None, 30, None), ("c", "CPR02", None, None, 100))
    for c, usual in HEALTH_PARAMETERS.items():
        value = F.coalesce(*[F.when(F.col("request_id") == i, F.lit(p[c])) for i, p in own.items() if c in p], F.lit(None))
        asked = asked.withColumn(c, value.cast("int" if isinstance(usual, int) else "double"))
    rows = requests.request_rows(long, limits, asked)
    for cuts in (None, find_long_series(long, SERIES_KEYS, 9)):
        got = requests.batch_health(long, limits, asked, cuts=cuts)
        assert got.count() == 8 + 8 + 2
        for name, parameters in own.items():
            mine = sorted(map(tuple, got.where(F.col("request_id") == name).drop("request_id").collect()), key=repr)
            want = sorted(map(tuple, multi_sensor_health(rows.where(F.col("request_id") == name), **parameters).collect()), key=repr)
            for a, b in zip(mine, want, strict=True):
                assert a[:3] + a[-2:] == b[:3] + b[-2:] and a[3:-2] == pytest.approx(b[3:-2])


SLICES = "request_id string, output string, slice_entities array<string>, slice_start_ts timestamp_ntz, slice_end_ts timestamp_ntz, slice_window_days int"


@pytest.mark.parametrize("mode", ["run", "replot"])
def test_slices_like_one_at_a_time(spark, plant, mode):
    long, limits = plant
    asked = ask(spark, ("a", None, "rpm", None, None), ("b", "CPR01", None, 20, 120), ("c", None, "temp", 10, None), ("none", "CPR03", "rpm", None, None))
    rows = requests.request_rows(long, limits, asked)
    cases = [
        ("a", "two", ["CPR01", " CPR03"], None, None, 1), ("a", "blank", [" ", None], None, None, 2), ("a", "zero", None, None, None, 0),
        ("a", "closed", None, 30, 60, 1), ("b", "start", None, 40, None, 2), ("b", "end", ["CPR01"], None, 70, 1),
        ("b", "nobody", ["CPR77"], None, None, 3), ("c", None, None, None, None, None),
    ]
    slices = spark.createDataFrame([(i, o, e, at(a), at(b), d) for i, o, e, a, b, d in cases], SLICES)
    got = as_set(sliced_within(rows, slices, mode), "request_id", "output", "entity", "sensor", "ts")
    want = [("none", None, "CPR03", "rpm", r.ts) for r in rows.where("request_id = 'none'").collect()]
    for i, o, e, a, b, d in cases:
        one = sliced(rows.where(F.col("request_id") == i), entities=e, start_ts=at(a), end_ts=at(b), window_days=d, mode=mode)
        want += [(i, o, r.entity, r.sensor, r.ts) for r in one.collect()]
    assert got == sorted(want, key=repr)
    rates = requests.batch_ooc(long, limits, asked, slices, mode=mode)
    assert sum(r.total_points for r in rates.collect()) == len(want)


def test_only_folders_that_are_asked_for_are_opened(spark, plant):
    long, limits = plant
    path = new_path(spark, "long")
    write_long(long.selectExpr("*", "0 as failure_within_24h", "0D as rul_hours").unionByName(
        long.selectExpr("*", "0 as failure_within_24h", "0D as rul_hours").withColumn("entity_group", F.lit("PMP"))), path, 4)
    stored = read_long(spark, path)
    asked = ask(spark, *[(f"r{i}", None, "rpm", i, 100 + i) for i in range(10)])
    rows = requests.request_rows(stored, limits, asked, series=requests.series_counts(stored, SERIES_KEYS))
    assert "dynamicpruning" in rows._jdf.queryExecution().executedPlan().toString()
    before = rows.count()
    assert before == sum(1 for r in long.where("sensor = 'rpm'").collect() for i in range(10) if at(i) <= r.ts < at(100 + i))

    def scans(node):
        if "FileSourceScan" in node.getClass().getSimpleName() and "sensor" in node.toString():
            yield node
        if "AdaptiveSparkPlan" in node.getClass().getSimpleName():
            yield from scans(node.executedPlan())
        if "QueryStage" in node.getClass().getSimpleName():
            yield from scans(node.plan())
        for i in range(node.children().size()):
            yield from scans(node.children().apply(i))

    frame = rows.select("request_id")
    frame.collect()
    found = [s.metrics().apply("numPartitions").value() for s in scans(frame._jdf.queryExecution().executedPlan()) if path in s.relation().location().rootPaths().toString()]
    assert found == [1]


def test_many_ranges_are_listed_by_many_tasks(spark, plant, monkeypatch):
    """Tasks follow from the number of ranges, pairs and readings; segments and averages are the same."""
    from fleetspc.operators import ranges, series

    long, limits = plant
    asked = spark.createDataFrame(
        [(f"r{i}", "CPR", e, s, at(i), at(i + 40)) for i, e in enumerate(ENTITIES) for s in ("rpm", None)]
        + [("all", "CPR", None, None, None, None)], REQUESTS,
    )
    wide = spark.range(60).selectExpr("id % 3 as k", "id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id % 7 as int)) as start_ts",
                                      "timestamp_ntz'2024-01-02' + make_dt_interval(0, cast(id % 5 as int)) as end_ts")

    def results():
        segments = range_segments(wide, ["k"])
        listed = segments.withColumn("ranges", F.sort_array("ranges"))
        averaged = requests.batch_requests(long, limits, asked).withColumn("ewma", F.round("ewma", 6))
        return segments, averaged, as_set(listed), as_set(averaged)

    _, _, *want = results()
    monkeypatch.setattr(ranges, "RANGES_PER_TASK", 5)
    monkeypatch.setattr(ranges, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(series, "ROWS_PER_TASK", 50)
    segments, averaged, *got = results()
    assert got == want
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (segments, averaged)]
    assert all("REPARTITION_BY_NUM" in p for p in plans)
    # Many segments are not sent to every task.
    assert "BroadcastHashJoin" not in plans[0] and "SortMergeJoin" in plans[0] and "SortMergeJoin" in plans[1]
