import random
from datetime import timedelta

import pytest

from conftest import DAY0, as_set, reading
from fleetspc.operators import requests
from fleetspc.operators.ewma import ewma
from fleetspc.operators.series import find_long_series
from fleetspc.schemas import LIMITS, REQUESTS, SERIES_KEYS


@pytest.fixture
def plant(spark, history):
    rng = random.Random(15)
    rows = [
        reading(e, s, at=h * 5 + rng.random(), value=rng.random(), hours=float(h % 7), mode=rng.choice(["normal", "normal", "idle"]))
        for e in ("CPR01", "CPR02") for s in ("rpm", "temp") for h in range(60)
    ]
    long = history(*rows, reading(None, "rpm", at=3.0, value=0.5)).drop("ucl", "centerline", "lcl")
    limits = spark.createDataFrame([("CPR", "rpm", 0.5, 0.1, 0.8, 0.5, 0.2)], LIMITS)
    return long, limits


def ask(spark, *rows):
    when = lambda h: None if h is None else DAY0 + timedelta(hours=h)
    return spark.createDataFrame([(i, g, e, s, when(a), when(b)) for i, g, e, s, a, b in rows], REQUESTS)


@pytest.mark.parametrize("bin_hours", [1, 24, 1000])
def test_requests_match_brute_force(spark, plant, bin_hours):
    long, limits = plant
    asked = [
        ("all", "CPR", None, "rpm", None, None), ("blank", "CPR", " ", "temp", None, 100),
        ("one", "CPR", "CPR02", "rpm", 30, 90), ("late", "CPR", "CPR01", "temp", 200, None),
        ("none", "PMP", None, "rpm", None, None), ("after", "CPR", None, "rpm", 5000, 6000), ("before", "CPR", None, "rpm", -90, -50),
    ]
    got = as_set(requests.request_rows(long, limits, ask(spark, *asked), bin_hours=bin_hours), "request_id", "entity", "ts", "ucl")
    want = []
    for r in long.where("operating_mode = 'normal'").collect():
        for i, g, e, s, a, b in asked:
            hour = (r.ts - DAY0).total_seconds() / 3600
            if g == r.entity_group and s == r.sensor and (not (e or "").strip() or e == r.entity) \
                    and (a is None or hour >= a) and (b is None or hour < b):
                want.append((i, r.entity, r.ts, 0.8 if s == "rpm" else None))
    assert got == sorted(want, key=repr)


def test_each_request_is_averaged_on_its_own(spark, plant):
    long, limits = plant
    asked = ask(spark, ("all", "CPR", "CPR01", "rpm", None, None), ("part", "CPR", "CPR01", "rpm", 100, None))
    rows = requests.request_rows(long, limits, asked)
    whole = requests.batch_requests(long, limits, asked, cuts=None)
    cut = requests.batch_requests(long, limits, asked, cuts=find_long_series(long, SERIES_KEYS, 9))
    columns = ["request_id", "ts", "ewma"]
    part = ewma(rows.where("request_id = 'part'"), cuts=None)
    assert as_set(whole.where("request_id = 'part'"), "ts", "ewma") == as_set(part, "ts", "ewma")
    for a, b in zip(as_set(whole, *columns), as_set(cut, *columns)):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2])
    assert {"spc_violation", "ucl"} <= set(whole.columns)


def test_inventory(spark):
    asked = ask(spark, ("a", "CPR", None, "rpm", None, None), ("b", "CPR", "CPR01", "rpm", None, None), ("c", "PMP", "", "temp", None, None))
    assert as_set(requests.run_filter_inventory(asked)) == [
        ("entity", "CPR01"), ("entity_group", "CPR"), ("entity_group", "PMP"), ("sensor", "rpm"), ("sensor", "temp"),
    ]


def test_reasons(spark, history):
    long = history(reading("CPR01"), reading("PMP02", "temp", group="PMP"))
    rows = [
        ("ok", "entity_sensor_history", "CPR", "CPR01", "rpm", None),
        ("ok2", "pm_event_sensor_history", "PMP", None, None, None),
        ("k", "sales", "CPR", None, None, "unknown_kind"), ("k0", None, "CPR", None, None, "unknown_kind"),
        ("g", "fleet_sensor_history", None, None, "rpm", "missing_entity_group"),
        ("e", "entity_sensor_history", "CPR", "", "rpm", "missing_entity"),
        ("s", "fleet_sensor_history", "CPR", None, " ", "missing_sensor"),
        ("g2", "fleet_sensor_history", "ARM", None, "rpm", "unknown_entity_group"),
        ("e2", "entity_sensor_history", "CPR", "CPR77", "rpm", "unknown_entity"),
        ("s2", "fleet_sensor_history", "CPR", None, "torque", "unknown_sensor"),
        ("m", "entity_sensor_history", "CPR", "PMP02", "rpm", "entity_not_in_group"),
    ]
    asked = spark.createDataFrame([r[:5] for r in rows], "request_id string, kind string, entity_group string, entity string, sensor string")
    got = dict(as_set(requests.invalid_requests(asked, long), "request_id", "reason"))
    assert got == {r[0]: r[5] for r in rows if r[5]}


def test_windows_around_events_are_closed_and_may_overlap(spark, history):
    long = history(*[reading(at=24 * d, value=float(d)) for d in range(8)]).drop("ucl", "centerline", "lcl")
    limits = spark.createDataFrame([], LIMITS)
    events = spark.createDataFrame(
        [("CPR", "CPR01", DAY0 + timedelta(days=d)) for d in (2, 4)] + [("CPR", "CPR09", DAY0)],
        "entity_group string, entity string, ts timestamp_ntz",
    )
    got = as_set(requests.pm_event_windows(long, limits, events, days=2), "event_ts", "value")
    assert got == [(DAY0 + timedelta(days=d), float(v)) for d in (2, 4) for v in range(d - 2, d + 3)]


def test_the_session_time_zone_does_not_matter(spark, history):
    """New York skips 02:00-03:00 on 2024-03-10 and repeats 01:00-02:00 on 2024-11-03."""
    from fleetspc.operators.health import multi_sensor_health

    hours = [(69 * 24 + h) for h in range(0, 12)] + [(307 * 24 + h / 2) for h in range(0, 12)]
    df = history(*[reading(at=float(h), value=float(i % 5), ucl=9.0, centerline=0.0, lcl=-9.0) for i, h in enumerate(hours)])
    asked = ask(spark, ("r", "CPR", "CPR01", "rpm", 69 * 24 + 2, 307 * 24 + 2))
    limits = spark.createDataFrame([], LIMITS)

    def results():
        cuts = find_long_series(df, SERIES_KEYS, 5)
        rows = requests.request_rows(df.drop("ucl", "centerline", "lcl"), limits, asked, bin_hours=1)
        return as_set(multi_sensor_health(df, slope_window_hours=4, cuts=cuts)), as_set(rows, "ts", "value")

    want = results()
    assert len(want[1]) == 14
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert results() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_ranges_take_rows_by_their_number_not_by_the_calendar(spark):
    asked = [("o%d" % i, "CPR", None, "rpm", None, None) for i in range(50)]
    asked += [("century", "CPR", None, "rpm", 0, 24 * 36_500), ("year", "CPR", None, "rpm", 0, 24 * 365), ("day", "CPR", None, "rpm", 0, 24)]
    spread = requests.spread_ranges(ask(spark, *asked))
    n = {r["request_id"]: r["count"] for r in spread.groupBy("request_id").count().collect()}
    assert all(n[f"o{i}"] == 1 for i in range(50)) and max(n.values()) <= requests.FINER + 1


def test_all_sensors_and_several_entities(spark, plant):
    long, limits = plant
    asked = ask(spark, ("several", "CPR", " CPR02", None, None, None), ("group", "CPR", None, None, 10, 1e4))
    asked = asked.selectExpr("*", "array(entity, 'CPR01 ', '') as entities").where("request_id = 'several'").unionByName(
        asked.where("request_id = 'group'").selectExpr("*", "cast(null as array<string>) as entities")
    )
    got = as_set(requests.request_rows(long, limits, asked), "request_id", "entity", "sensor", "ts")
    normal = long.where("operating_mode = 'normal'").collect()
    want = [("several", r.entity, r.sensor, r.ts) for r in normal if r.entity]
    want += [("group", r.entity, r.sensor, r.ts) for r in normal if r.ts >= DAY0 + timedelta(hours=10)]
    assert got == sorted(want, key=repr)
