import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DAY0, as_set, reading
from fleetspc.operators import charts
from fleetspc.operators.series import find_long_series
from fleetspc.operators.slices import entity_subset, time_slice
from fleetspc.operators.spc import ewma_spc
from fleetspc.operators.summary import fleet_ooc_summary
from fleetspc.plans import outputs
from fleetspc.schemas import CHART_KEYS, SERIES_KEYS


def hours_left(df):
    return [None if r.ts is None else (r.ts - DAY0).total_seconds() / 3600 for r in df.orderBy("ts").collect()]


def at(hour):
    return str(DAY0 + timedelta(hours=hour))


@pytest.fixture
def days(history):
    return history(*[reading(at=h) for h in (0, 24, 48, 72, 96)])


def test_slice_bounds_are_closed(days):
    for mode in ("run", "replot"):
        assert hours_left(time_slice(days, at(24), at(72), mode=mode)) == [24, 48, 72]


def test_window_counts_back_from_the_last_row(days):
    for mode in ("run", "replot"):
        assert hours_left(time_slice(days, window_days=2, mode=mode)) == [48, 72, 96]


def test_window_with_an_end_differs_between_the_modes(days):
    assert hours_left(time_slice(days, end_ts=at(72), window_days=1)) == [0, 24, 48, 72]
    assert hours_left(time_slice(days, end_ts=at(72), window_days=1, mode="replot")) == [48, 72]
    assert hours_left(time_slice(days, at(24), window_days=1)) == [24, 48, 72, 96]
    assert hours_left(time_slice(days, at(24), window_days=1, mode="replot")) == [24, 48, 72, 96]


def test_zero_days(days):
    assert hours_left(time_slice(days, window_days=0)) == [96]
    assert hours_left(time_slice(days, window_days=0, mode="replot")) == [0, 24, 48, 72, 96]


def test_null_ts_is_kept_by_run_and_dropped_by_replot(history):
    df = history(reading(at=None), reading(at=1))
    assert time_slice(df).count() == 2 and time_slice(df, mode="replot").count() == 1


def test_frames_without_ts_are_left_alone(days):
    df = days.drop("ts")
    assert time_slice(df, window_days=1) is df and entity_subset(df.drop("entity"), ["x"]).count() == 5
    with pytest.raises(ValueError):
        time_slice(df, mode="other")


def test_entities_come_before_the_window(history):
    df = history(reading("CPR01", at=0), reading("CPR01", at=20), reading("CPR02", at=500))
    assert hours_left(outputs.sliced(df, entities=["CPR01"], window_days=1)) == [0, 20]
    assert entity_subset(df, []) is df


@pytest.mark.parametrize("total, ooc, percent", [
    (42, 1, 2.38095), (35, 1, 2.85714), (116, 4, 3.44828), (113, 24, 21.2389), (131, 1, 0.763359),
])
def test_percent(history, total, ooc, percent):
    df = history(*[reading(at=i, value=9.0 if i < ooc else 1.0, ucl=5.0, lcl=0.0) for i in range(total)])
    r = fleet_ooc_summary(df).collect()[0]
    assert (r.total_points, r.ooc_points) == (total, ooc) and r.percent_ooc == pytest.approx(percent, rel=1e-5)


def test_one_sided_and_absent_limits(history):
    sides = {"none": (None, None), "upper": (5.0, None), "lower": (None, 0.0), "both": (5.0, 0.0)}
    rows = [
        reading(e, at=i, value=v, ucl=u, lcl=l)
        for e, (u, l) in sides.items() for i, v in enumerate((9.0, -9.0, 1.0, None))
    ]
    got = {r.entity: (r.total_points, r.ooc_points) for r in fleet_ooc_summary(history(*rows)).collect()}
    # A missing reading fails a limit that exists.
    assert got == {"none": (4, 0), "upper": (4, 2), "lower": (4, 2), "both": (4, 3)}


def test_the_stored_flag_is_not_used_and_null_entities_count(history):
    df = history(reading(None, value=9.0, ucl=5.0), reading("CPR01", value=1.0, ucl=5.0))
    df = df.withColumn("spc_violation", F.lit(True))
    assert as_set(fleet_ooc_summary(df), "entity", "ooc_points") == sorted([(None, 1), ("CPR01", 0)], key=repr)
    assert fleet_ooc_summary(df.drop("ucl", "centerline", "lcl")).agg(F.sum("ooc_points")).collect()[0][0] == 0
    with pytest.raises(KeyError):
        fleet_ooc_summary(df.drop("value"))


def test_latest_limits_skip_nulls_one_by_one(history):
    df = history(reading(at=0, ucl=1.0, lcl=-1.0), reading(at=1, ucl=2.0), reading(at=2), reading("CPR02", at=3, lcl=-3.0))
    assert as_set(charts.latest_limits(df), "ucl", "centerline", "lcl") == [(2.0, None, -3.0)]
    assert as_set(charts.latest_limits(df, SERIES_KEYS), "entity", "ucl", "lcl") == [("CPR01", 2.0, -1.0), ("CPR02", None, -3.0)]


def test_chart_series(history):
    df = ewma_spc(history(
        reading(at=0, value=1.0, ucl=5.0), reading(at=1, value=9.0, ucl=5.0), reading("CPR02", at=0, value=9.0),
        reading(sensor="temp", value=0.0),
    ), 0.5, cuts=None)
    one = charts.spc_chart_series(df, "CPR", "CPR01", "rpm").orderBy("ts").collect()
    assert [(r.value, r.ewma, r.violation, r.ucl) for r in one] == [(1.0, 1.0, False, 5.0), (9.0, 5.0, True, 5.0)]
    fleet = charts.fleet_trend_series(df, "CPR", "rpm")
    assert as_set(fleet, "entity", "value", "violation_ewma", "ucl") == [
        ("CPR01", 1.0, None, 5.0), ("CPR01", 9.0, 5.0, 5.0), ("CPR02", 9.0, None, 5.0),
    ]
    plain = charts.fleet_trend_series(df.drop("spc_violation"), "CPR", "rpm")
    assert plain.where("violation_ewma is not null").count() == 0
    with pytest.raises(KeyError):
        charts.spc_chart_series(df.drop("ewma"), "CPR", "CPR01", "rpm")


def test_drawn_points_against_a_plain_loop(spark):
    """Ends and extremes of every column and all violations, with repeated rows, NULLs and NULL keys."""
    rnd, start = random.Random(3), datetime(2024, 1, 1)
    rows = []
    for entity in ("CPR01", "CPR02", None, "empty"):
        for _ in range(400 if entity != "empty" else 2):
            y = None if entity == "empty" or rnd.random() < 0.05 else float(rnd.randint(0, 30))
            ts = None if rnd.random() < 0.02 else start + timedelta(seconds=rnd.randint(0, 5_000))
            rows.append(("CPR", entity, "rpm", ts, y, rnd.choice([True, *[False] * 30, None])))
    rows += rows[:50]
    df = spark.createDataFrame(
        rows, "entity_group string, entity string, sensor string, ts timestamp_ntz, value double, violation boolean"
    )

    def plain(axis, pixels, low=None, high=None):
        out = set()
        for entity in {r[1] for r in rows}:
            times = [r[3] for r in rows if r[3] and (axis == CHART_KEYS or r[1] == entity)]
            a, b = (low, high) if low else (min(times), max(times))
            micro = timedelta(microseconds=1)
            width = (b - a) // micro // pixels + 1
            columns = {}
            for r in rows:
                if r[1] == entity and r[3] and r[4] is not None and a <= r[3] <= b:
                    pixel = (r[3] - a) // micro // width
                    if r[5]:
                        out.add((entity, pixel, r[3], r[4], True))
                    else:
                        columns.setdefault(pixel, set()).add((r[3], r[4]))
            for pixel, points in columns.items():
                by_height = sorted(points, key=lambda p: (p[1], p[0]))
                for ts, y in (min(points), max(points), by_height[0], by_height[-1]):
                    out.add((entity, pixel, ts, y, False))
        return sorted(out, key=repr)

    def got(**options):
        shown = charts.drawn_points(df, "value", **options)
        return as_set(shown, "entity", "pixel", "ts", "value", "violation")

    assert got(pixels=20) == plain(SERIES_KEYS, 20)
    assert got(pixels=20, axis=CHART_KEYS) == plain(CHART_KEYS, 20)
    assert got(pixels=1) == plain(SERIES_KEYS, 1)
    assert got() == plain(SERIES_KEYS, charts.PIXELS)
    bounds = (start + timedelta(seconds=1_000), start + timedelta(seconds=2_000))
    assert got(pixels=7, ts_range=bounds) == plain(SERIES_KEYS, 7, *bounds)
    assert charts.drawn_points(df.limit(0), "value").count() == 0
    for wrong in ({"y": "missing"}, {"y": "value", "pixels": 0}):
        with pytest.raises((KeyError, ValueError)):
            charts.drawn_points(df, **wrong)


def box_of(values):
    q1, median, q3 = np.percentile(values, [25, 50, 75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside_low, inside_high = [v for v in values if v >= low], [v for v in values if v <= high]
    return q1, median, q3, min(q1, *inside_low), max(q3, *inside_high), sum(v < low or v > high for v in values)


@pytest.mark.parametrize("counting", [False, True])
def test_box_statistics(history, counting):
    rng = random.Random(13)
    data = {"A": [4.0], "B": [1.0, 2.0], "C": [rng.gauss(0, 1) for _ in range(501)] + [50.0, -50.0],
            "D": [5.0] * 300 + [6.0, 7.0, 100.0], "E": [float(rng.randint(0, 9)) for _ in range(400)],
            None: [rng.random() for _ in range(60)]}
    df = history(*[reading(e, at=i, value=v) for e, vs in data.items() for i, v in enumerate(vs)], reading("A", value=None))
    cuts = find_long_series(df, SERIES_KEYS, 100) if counting else None
    assert counting == (cuts is not None)
    got = {r.entity: r for r in charts.fleet_boxplot_stats(df, "CPR", "rpm", cuts=cuts).collect()}
    assert set(got) == set(data)
    for e, values in data.items():
        r = got[e]
        assert r.n == len(values)
        assert (r.q1, r["median"], r.q3, r.whisker_low, r.whisker_high, r.outliers) == pytest.approx(box_of(values))
    beyond = charts.fleet_boxplot_outliers(df, "CPR", "rpm", cuts=cuts)
    assert beyond.count() == sum(r.outliers for r in got.values())
    assert {50.0, -50.0, 100.0} <= {r.y for r in beyond.collect()}


def test_quartiles_stay_exact_when_the_sketch_is_coarse(history):
    rng = random.Random(14)
    values = [rng.expovariate(0.1) for _ in range(3001)]
    rows = charts._box_rows(history(*[reading(value=v, at=i) for i, v in enumerate(values)]), False)
    r = charts._quartiles_by_counting(rows, accuracy=10).collect()[0]
    assert (r.q1, r["median"], r.q3) == pytest.approx(tuple(np.percentile(values, [25, 50, 75])))


def test_box_of_the_average(history):
    df = ewma_spc(history(reading(at=0, value=0.0), reading(at=1, value=8.0)), 0.5, cuts=None)
    assert charts.fleet_boxplot_stats(df, show_ewma=True, cuts=None).collect()[0]["median"] == 2.0
    assert charts.fleet_boxplot_stats(df, cuts=None).collect()[0]["median"] == 4.0
    assert charts.fleet_boxplot_stats(df.drop("ewma"), show_ewma=True, cuts=None).collect()[0]["median"] == 4.0


def test_many_outputs_of_one_stored_frame(history):
    df = ewma_spc(history(*[reading(at=24 * d, value=float(d), ucl=2.5) for d in range(6)]), cuts=None)
    ooc = lambda frame: frame.collect()[0].ooc_points
    named = outputs.shared_outputs(df, {
        "all": outputs.fleet_ooc_table,
        "window": lambda f: outputs.fleet_ooc_table(f, window_days=1),
        "early": lambda f: outputs.fleet_ooc_table(f, end_ts=at(72)),
        "chart": charts.spc_chart_series,
    })
    assert (ooc(named["all"]), ooc(named["window"]), ooc(named["early"]), named["chart"].count()) == (3, 2, 1, 6)
    assert ooc(outputs.replot(df, fleet_ooc_summary, end_ts=at(96), window_days=1)) == 2


def test_reports(spark, history):
    from fleetspc.schemas import LIMITS

    long = history(*[reading(e, at=i, value=v, hours=h) for e in ("CPR02", "CPR01")
                     for i, (v, h) in enumerate([(1.0, 3.0), (9.0, 4.0), (1.0, 0.0)])]).drop("ucl", "centerline", "lcl")
    limits = spark.createDataFrame([("CPR", "rpm", 1.0, 1.0, 4.0, 1.0, -2.0)], LIMITS)
    ooc = outputs.fleet_ooc_report(long, limits, "CPR", "rpm", cuts=None).collect()
    assert [(r.entity, r.total_points, r.ooc_points) for r in ooc] == [("CPR01", 3, 1), ("CPR02", 3, 1)]
    pm = outputs.pm_event_report(long, limits, "CPR", cuts=None).collect()
    assert [(r.entity, r.hours_since_last_maintenance, r.ooc_sensors) for r in pm] == [("CPR01", 4.0, "rpm"), ("CPR02", 4.0, "rpm")]
    health = outputs.health_report(long, limits, "CPR", "CPR01", cuts=None)
    assert health.count() == 1 and "latest_ewma" not in health.columns


def test_display_order(history):
    df = history(reading("B", "x", at=1), reading("A", "y", at=1), reading("A", "x", at=1), reading("C", "z", at=0))
    assert [(r.entity, r.sensor) for r in outputs.in_time_order(df).collect()] == [("C", "z"), ("A", "x"), ("A", "y"), ("B", "x")]


def test_limits_joined_late_give_the_same_rows(spark, history):
    from fleetspc.operators.extract import sensor_history
    from fleetspc.schemas import LIMITS

    long = history(*[reading(at=i, value=float(i), hours=float(i % 4)) for i in range(12)], reading(at=20, mode="idle"))
    long = long.drop("ucl", "centerline", "lcl")
    limits = spark.createDataFrame([("CPR", "rpm", 1.0, 1.0, 4.0, 1.0, 1.5)], LIMITS)
    early = ewma_spc(sensor_history(long, limits), cuts=None)
    late = outputs.monitored_history(long, limits, cuts=None)
    assert early.columns == late.columns and as_set(early) == as_set(late)


def test_box_finds_large_groups_itself(history, monkeypatch):
    rows = [reading(e, at=0, value=float(i)) for e, n in (("A", 50), ("B", 5)) for i in range(n)]
    df = history(*rows).drop("ts")
    want = as_set(charts.fleet_boxplot_stats(df))
    monkeypatch.setattr(charts, "ROWS_PER_CHUNK", 10)
    assert as_set(charts.fleet_boxplot_stats(df)) == want


def test_boxes_have_the_limits_of_their_chart(history):
    from fleetspc.operators.charts import fleet_boxplot_chart

    rows = [reading("CPR01", at=t, value=float(t), ucl=9.0 if t < 5 else 8.0, centerline=1.0) for t in range(8)]
    rows += [reading("CPR02", at=9, value=1.0), reading(None, "temp", at=1, value=2.0, group=None, lcl=-1.0)]
    got = as_set(fleet_boxplot_chart(history(*rows)), "entity", "n", "median", "ucl", "centerline", "lcl")
    assert got == sorted([("CPR01", 8, 3.5, 8.0, 1.0, None), ("CPR02", 1, 1.0, 8.0, 1.0, None), (None, 1, 2.0, None, None, -1.0)], key=repr)
    assert fleet_boxplot_chart(history(*rows), "CPR", "temp").count() == 0
