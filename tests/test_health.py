import random
from datetime import timedelta

import pytest

from conftest import DAY0, reading
from fleetspc.operators.health import by_severity, health_attention_flag, health_table, multi_sensor_health
from fleetspc.operators.series import find_long_series
from fleetspc.schemas import SERIES_KEYS

# Limits with a sigma of 1 around 0.
BAND = dict(ucl=3.0, centerline=0.0, lcl=-3.0)


def label(history, values, step_hours=1.0, alpha=0.2, band=BAND, **options):
    rows = [reading(at=i * step_hours, value=v, **band) for i, v in enumerate(values)]
    out = multi_sensor_health(history(*rows), ewma_alpha=alpha, cuts=None, **options).collect()
    assert len(out) == 1
    return out[0]


def loop_average(xs, a):
    y = xs[0]
    for x in xs[1:]:
        y = (1 - a) * y + a * x
    return y


def brute_force(points, a, days, hours):
    """points: (ts, value, ucl, centerline, lcl) in order."""
    last = points[-1][0]
    _, latest, ucl, center, lcl = points[-1]
    sigma = None if ucl is None or center is None or (ucl - center) / 3 <= 0 else (ucl - center) / 3
    mean = loop_average([p[1] for p in points], a)
    z = None if sigma is None else (mean - center) / sigma
    recent = [p for p in points if p[0] >= last - timedelta(days=days)]
    rate = sum(p[2] is not None and p[4] is not None and (p[1] > p[2] or p[1] < p[4]) for p in recent) / len(recent)
    inside = [p for p in points if p[0] >= last - timedelta(hours=hours)]
    span = (inside[-1][0] - inside[0][0]).total_seconds() / 86400
    slope = None
    if sigma is not None and len(inside) >= 2 and span > 0:
        slope = (loop_average([p[1] for p in inside], a) - inside[0][1]) / sigma / span
    return latest, mean, z, rate, slope


@pytest.mark.parametrize("alpha", [0.05, 0.2, 0.8, 1.0])
@pytest.mark.parametrize("rows_per_chunk", [None, 5, 60])
def test_matches_a_plain_loop(spark, history, alpha, rows_per_chunk):
    rng = random.Random(12)
    series, rows = {}, []
    for e, n in (("A", 1), ("B", 2), ("C", 40), ("D", 700)):
        at, points = 0.0, []
        for _ in range(n):
            at += rng.choice([0.2, 0.5, 6.0])
            points.append((DAY0 + timedelta(hours=at), rng.uniform(-5, 5), 3.0, 0.0, -3.0))
            rows.append(reading(e, at=at, value=points[-1][1], **BAND))
        series[e] = points
    df = history(*rows)
    cuts = None if rows_per_chunk is None else find_long_series(df, SERIES_KEYS, rows_per_chunk)
    got = multi_sensor_health(df, window_days=3, slope_window_hours=30, ewma_alpha=alpha, cuts=cuts).collect()
    assert len(got) == 4
    for r in got:
        latest, mean, z, rate, slope = brute_force(series[r.entity], alpha, 3, 30)
        assert r.latest_value == latest
        assert r.latest_ewma == pytest.approx(mean, rel=1e-9, abs=1e-12)
        assert r.latest_z_score == pytest.approx(z, rel=1e-9, abs=1e-12)
        assert r.ooc_rate_3d == pytest.approx(rate)
        assert (r.ewma_slope_z_per_day_30h is None) == (slope is None)
        if slope is not None:
            assert r.ewma_slope_z_per_day_30h == pytest.approx(slope, rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("values, options, trend, status", [
    ([0.0, 5.0], dict(alpha=1.0), "ooc", "ooc"),
    ([0.0] * 24 + [2.0], dict(alpha=1.0), "drifting_up", "attention"),
    ([0.0] * 24 + [-2.0], dict(alpha=1.0), "drifting_down", "attention"),
    ([0.0] * 5 + [4.0] + [0.0] * 10, dict(alpha=1.0), "volatile", "attention"),
    ([0.5] * 30, dict(), "stable_baseline", "stable"),
    ([1.5] * 30, dict(), "trending_baseline", "attention"),
    ([0.5] * 24 + [1.4], dict(alpha=1.0), "trending_baseline", "attention"),
    ([0.1] * 24 + [1.0], dict(alpha=1.0), "stable_baseline", "stable"),
    ([0.5], dict(), "stable_baseline", "stable"),
])
def test_labels(history, values, options, trend, status):
    r = label(history, values, **options)
    assert (r.baseline_trend, r.health_status) == (trend, status)


def test_single_reading_has_no_slope(history):
    assert label(history, [0.5]).ewma_slope_z_per_day_24h is None


def test_without_sigma_there_is_no_score(history):
    for band in (dict(ucl=0.0, centerline=0.0, lcl=-3.0), dict(ucl=None, centerline=0.0, lcl=-3.0), dict()):
        r = label(history, [0.5, 9.0], band=band)
        assert (r.latest_z_score, r.ewma_slope_z_per_day_24h, r["std"]) == (None, None, None)


def test_one_sided_limits_never_count_as_violations(history):
    r = label(history, [9.0, 9.0], band=dict(ucl=3.0, centerline=0.0, lcl=None))
    assert r.ooc_rate_2d == 0.0


def test_average_is_not_restarted_by_maintenance(history):
    df = history(*[reading(at=i, value=v, hours=0.0, **BAND) for i, v in enumerate([1.0, 2.0])])
    assert multi_sensor_health(df, ewma_alpha=0.5, cuts=None).collect()[0].latest_ewma == 1.5


def test_column_names_follow_the_windows(history):
    df = multi_sensor_health(history(reading(**BAND)), window_days=5, slope_window_hours=48, cuts=None)
    assert {"ooc_rate_5d", "ewma_slope_z_per_day_48h"} <= set(df.columns)


def test_order_by_severity(spark):
    rows = [("E1", "a", "stable", 0.5), ("E2", "b", "attention", -2.0), ("E3", "c", "ooc", 3.5),
            ("E4", "d", "attention", 1.0), ("E5", "e", "stable", None), ("E0", "a", "stable", -0.5)]
    df = spark.createDataFrame(rows, "entity string, sensor string, health_status string, latest_z_score double")
    assert [r.entity for r in by_severity(df).collect()] == ["E3", "E2", "E4", "E0", "E1", "E5"]


def test_table_and_attention_flag(spark, history):
    table = health_table(multi_sensor_health(history(reading(**BAND)), cuts=None))
    assert not {"latest_value", "latest_ewma", "centerline", "std"} & set(table.columns)
    with pytest.raises(KeyError):
        health_table(table)
    df = spark.createDataFrame(
        [("stable", "stable_baseline"), ("stable", "volatile"), ("ooc", "ooc"), (None, "stable_baseline")],
        "health_status string, baseline_trend string",
    )
    assert [r.needs_attention for r in health_attention_flag(df).collect()] == [False, True, True, True]
    assert [r.needs_attention for r in health_attention_flag(df.select("health_status")).collect()] == [False, False, True, True]
    assert health_attention_flag(df.selectExpr("1 as x")).columns == ["x"]
