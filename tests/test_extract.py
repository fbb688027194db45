from datetime import datetime, timedelta

import pytest

from conftest import DAY0, as_set, reading
from fleetspc.functions.predicates import entity_list
from fleetspc.operators import extract
from fleetspc.operators.series import find_long_series
from fleetspc.operators.summary import pm_event_ooc_summary, pm_event_table
from fleetspc.schemas import ENTITY_KEYS, LIMITS


def limits(spark, *rows):
    return spark.createDataFrame([(g, s, None, None, u, c, l) for g, s, u, c, l in rows], LIMITS)


@pytest.fixture
def long(history):
    def make(*rows):
        return history(*rows).drop("ucl", "centerline", "lcl")

    return make


@pytest.mark.parametrize("given, names", [
    (None, []), ("", []), ("  ", []), ([], []), ("ARM20", ["ARM20"]), (" ARM20 ", ["ARM20"]),
    (["ARM20", None, " ", "ARM21 "], ["ARM20", "ARM21"]), (("ARM20",), ["ARM20"]), (5, ["5"]),
])
def test_entity_argument(given, names):
    assert entity_list(given) == names


def test_histories_filter_join_and_select(spark, long):
    df = long(
        reading("CPR01", "rpm", 0), reading("CPR02", "rpm", 1), reading("CPR01", "temp", 2),
        reading("CPR01", "rpm", 3, mode="idle"), reading("PMP01", "rpm", 4, group="PMP"),
    )
    lim = limits(spark, ("CPR", "rpm", 9.0, 5.0, 1.0))
    one = extract.entity_sensor_history(df, lim, "CPR", "CPR01", "rpm")
    assert one.columns == extract.SENSOR_HISTORY and one.count() == 1 and one.collect()[0].ucl == 9.0
    assert extract.fleet_sensor_history(df, lim, "CPR", "rpm").count() == 2
    every = extract.entity_all_sensor_history(df, lim, "CPR", ["CPR01", ""])
    assert every.columns == extract.ALL_SENSOR_HISTORY
    assert as_set(every, "sensor", "ucl") == [("rpm", 9.0), ("temp", None)]
    assert extract.entity_all_sensor_history(df, lim, "CPR").count() == 3
    assert extract.entity_all_sensor_history(df, lim, "CPR", "PMP01").count() == 0


@pytest.mark.parametrize("call", [
    lambda d, l: extract.entity_sensor_history(d, l, "CPR", None, "rpm"),
    lambda d, l: extract.entity_sensor_history(d, l, "CPR", "CPR01", ""),
    lambda d, l: extract.fleet_sensor_history(d, l, "CPR", None),
    lambda d, l: extract.entity_all_sensor_history(d, l, ""),
    lambda d, l: extract.pm_event_sensor_history(d, l, None),
])
def test_required_filters(spark, long, call):
    with pytest.raises(ValueError):
        call(long(reading()), limits(spark))


def test_extract_range_is_half_open_and_null_ts_never_passes(long):
    df = long(*[reading(at=h) for h in (0, 1, 2, None)])
    at = lambda **kw: extract.normal_readings(df, **kw).count()
    assert at() == 3
    assert at(start_ts="2024-01-01 00:00:00", end_ts="2024-01-01 02:00:00") == 2
    assert at(start_ts=datetime(2024, 1, 1, 1)) == 2 and at(end_ts="2024-01-01T01:00:00") == 1


def ticks(*hours, sensors=("rpm", "temp"), entity="CPR01", mode="normal"):
    return [reading(entity, s, at, hours=h, mode=mode, failure=f"F{at}") for at, h in enumerate(hours) for s in sensors]


def test_event_is_the_last_tick_before_hours_drop(long):
    df = long(*ticks(5.0, 6.0, 0.0, 1.0, 0.5))
    events = extract.pm_events(df, cuts=None)
    assert as_set(events) == [
        ("CPR", "CPR01", DAY0 + timedelta(hours=1), 6.0, "F1"),
        ("CPR", "CPR01", DAY0 + timedelta(hours=3), 1.0, "F3"),
    ]


def test_event_needs_its_next_tick_inside_the_range(long):
    df = long(*ticks(5.0, 6.0, 0.0))
    assert extract.pm_events(df, end_ts=DAY0 + timedelta(hours=2), cuts=None).count() == 0
    assert extract.pm_events(df, end_ts=DAY0 + timedelta(hours=2, seconds=1), cuts=None).count() == 1


def test_events_look_at_normal_ticks_only(long):
    df = long(*ticks(5.0, 6.0), reading(at=2, hours=0.0, mode="idle"), reading(at=3, hours=7.0))
    assert extract.pm_events(df, cuts=None).count() == 0


def test_events_are_the_same_when_entities_are_cut(long):
    hours = [(i * 7) % 23 / 2.0 for i in range(90)]
    df = long(*ticks(*hours), *ticks(1.0, 0.0, entity="CPR02"))
    cuts = find_long_series(df, ENTITY_KEYS, 8)
    assert cuts is not None
    whole = as_set(extract.pm_events(df, cuts=None))
    assert whole == as_set(extract.pm_events(df, cuts=cuts))
    assert len(whole) == sum(a > b for a, b in zip(hours, hours[1:])) + 1


def test_event_history_and_summary(spark, long):
    df = long(
        reading(sensor="b", at=0, hours=6.0, value=10.0), reading(sensor="a", at=0, hours=6.0, value=-10.0),
        reading(sensor="c", at=0, hours=6.0, value=10.0), reading(sensor="d", at=0, hours=6.0, value=1.0),
        reading(sensor="a", at=1, hours=0.0), reading("CPR02", "a", 0, hours=3.0), reading("CPR02", "a", 1, hours=2.0),
    )
    lim = limits(spark, ("CPR", "a", 5.0, 0.0, -5.0), ("CPR", "b", 5.0, 0.0, -5.0), ("CPR", "c", 5.0, 0.0, None))
    history_ = extract.pm_event_sensor_history(df, lim, "CPR", cuts=None)
    assert history_.columns == extract.PM_HISTORY and history_.count() == 5
    # A limit on one side only does not count at events.
    assert as_set(pm_event_ooc_summary(history_)) == [
        ("CPR01", DAY0, 6.0, "none", "a, b"), ("CPR02", DAY0, 3.0, "none", ""),
    ]
    table = pm_event_table(pm_event_ooc_summary(history_))
    assert table.columns == ["entity", "timestamp", "hours_since_last_maintenance", "failure_type", "ooc_sensors"]


def test_summary_rejects_other_histories(history):
    with pytest.raises(KeyError):
        pm_event_ooc_summary(history(reading()))
    with pytest.raises(KeyError):
        pm_event_table(history(reading()))
