import math
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import DAY0, HISTORY_SCHEMA, as_set, reading
from fleetspc.operators.ewma import ewma, maintenance_block
from fleetspc.operators.series import decayed_sum, find_long_series, split_series
from fleetspc.operators.spc import ewma_spc
from fleetspc.schemas import SERIES_KEYS


def plain_loop(series, alpha, reset=True):
    """series: (hours, value) in order -> averages."""
    out, y = [], None
    for hours, x in series:
        y = x if y is None or (reset and hours == 0) else (1 - alpha) * y + alpha * x
        out.append(y)
    return out


def span_of(alpha):
    return max(1, math.floor(200 / -math.log(1 - alpha))) if alpha < 1 else 1


def random_history(lengths, seed, reset_share=0.02, irregular=False):
    """Series of the given lengths: {entity: [(ts, hours, value)]}."""
    rng = random.Random(seed)
    series = {}
    for i, n in enumerate(lengths):
        at, hours, rows = DAY0, 5.0, []
        for _ in range(n):
            step = rng.choice([1, 1, 1, 400]) if irregular else 1
            at += timedelta(minutes=step)
            hours = 0.0 if rng.random() < reset_share else hours + 0.5
            rows.append((at, hours, rng.uniform(-50, 150)))
        series[f"E{i:02d}"] = rows
    return series


def frame(spark, series, group="G"):
    rows = [
        (group, e, "rpm", ts, value, hours, "normal", "none", None, None, None)
        for e, points in series.items()
        for ts, hours, value in points
    ]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, HISTORY_SCHEMA)


def check(df, series, alpha, reset=True):
    got = {(r.entity, r.ts): r.ewma for r in df.select("entity", "ts", "ewma").collect()}
    assert len(got) == sum(map(len, series.values()))
    for e, points in series.items():
        for (ts, _, _), want in zip(points, plain_loop([(h, x) for _, h, x in points], alpha, reset)):
            assert got[e, ts] == pytest.approx(want, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("alpha", [0.05, 0.2, 0.8, 0.99, 1.0])
def test_matches_the_recursion_at_span_edges(spark, alpha):
    span = span_of(alpha)
    lengths = [1, 2, max(1, span - 1), span, span + 1, min(5 * span, 6000)]
    series = random_history(lengths, seed=3)
    check(ewma(frame(spark, series), alpha, cuts=None), series, alpha)


@pytest.mark.parametrize("alpha", [0.2, 0.9])
def test_matches_the_recursion_over_a_whole_series(spark, alpha):
    series = random_history([1, 3000], seed=4)
    check(ewma(frame(spark, series), alpha, reset_on_maintenance=False, cuts=None), series, alpha, reset=False)


@pytest.mark.parametrize("alpha", [0.05, 0.3, 0.97, 1.0])
@pytest.mark.parametrize("reset_share", [0.0, 0.03])
@pytest.mark.parametrize("rows_per_chunk", [3, 100])
def test_cut_series_give_the_same_averages(spark, alpha, reset_share, rows_per_chunk):
    series = random_history([1, 2, 50, 900], seed=5, reset_share=reset_share, irregular=True)
    df = frame(spark, series)
    cuts = find_long_series(df, SERIES_KEYS, rows_per_chunk)
    assert cuts is not None
    check(ewma(df, alpha, cuts=cuts), series, alpha)


def test_cut_series_without_reset_and_with_tiny_alpha(spark):
    series = random_history([40, 700], seed=6)
    df = frame(spark, series)
    for alpha in (0.001, 0.4):
        cuts = find_long_series(df, SERIES_KEYS, 20)
        check(ewma(df, alpha, reset_on_maintenance=False, cuts=cuts), series, alpha, reset=False)


def test_cuts_serve_subsets_and_inner_divisions(spark):
    """A later start leaves the first chunks empty; a request id divides a series further."""
    series = random_history([600], seed=7)
    df = frame(spark, series)
    cuts = find_long_series(df, SERIES_KEYS, 50)
    late = df.where(F.col("ts") > F.lit(str(DAY0 + timedelta(minutes=300))).cast("timestamp_ntz"))
    check(ewma(late, 0.2, cuts=cuts), {"E00": series["E00"][300:]}, 0.2)
    two = df.withColumn("request_id", F.lit("a")).unionByName(late.withColumn("request_id", F.lit("b")))
    both = ewma(two, 0.2, within=("request_id",), cuts=cuts)
    check(both.where("request_id = 'a'"), series, 0.2)
    check(both.where("request_id = 'b'"), {"E00": series["E00"][300:]}, 0.2)


def test_null_keys_form_a_series_also_when_cut(spark):
    series = random_history([120], seed=8)
    df = frame(spark, series, group=None)
    check(ewma(df, 0.2, cuts=None), series, 0.2)
    check(ewma(df, 0.2, cuts=find_long_series(df, SERIES_KEYS, 10)), series, 0.2)


def test_reset_needs_a_zero_hour_row_in_normal_mode(history):
    rows = [reading(at=i, value=v, hours=h) for i, (v, h) in enumerate([(10.0, 5.0), (20.0, 6.0), (40.0, 0.0), (50.0, 1.0)])]
    seen = ewma_spc(history(*rows), 0.5, cuts=None).orderBy("ts").collect()
    assert [r.ewma for r in seen] == [10.0, 15.0, 40.0, 45.0]
    rows[2] = reading(at=2, value=40.0, hours=0.0, mode="idle")
    unseen = ewma_spc(history(*rows), 0.5, cuts=None).orderBy("ts").collect()
    assert [r.ewma for r in unseen] == [10.0, 15.0, 32.5]


def test_blocks_count_zero_hour_rows(spark):
    series = random_history([200, 7], seed=9, reset_share=0.1)
    df = frame(spark, series)
    whole = as_set(maintenance_block(df, cuts=None), "entity", "ts", "maintenance_block")
    cut = as_set(maintenance_block(df, cuts=find_long_series(df, SERIES_KEYS, 10)), "entity", "ts", "maintenance_block")
    assert whole == cut
    want, n = {}, 0
    for ts, hours, _ in series["E00"]:
        n += hours == 0
        want[ts] = n
    assert {ts: b for e, ts, b in whole if e == "E00"} == want


def test_equal_ts_is_ordered_by_hours_then_value(history):
    rows = [reading(at=0, value=v) for v in (3.0, 1.0, 2.0)]
    for order in (rows, rows[::-1]):
        got = {r.value: r.ewma for r in ewma(history(*order), 0.5, cuts=None).collect()}
        assert got == {1.0: 1.0, 2.0: 1.5, 3.0: 2.25}


def test_null_readings_are_left_out(history):
    df = history(reading(at=0, value=4.0), reading(at=1, value=None), reading(at=2, value=8.0))
    assert [r.ewma for r in ewma(df, 0.5, cuts=None).orderBy("ts").collect()] == [4.0, 6.0]


@pytest.mark.parametrize("alpha", [0, -0.1, 1.5])
def test_alpha_is_checked(history, alpha):
    with pytest.raises(ValueError):
        ewma_spc(history(reading()), alpha)


def test_missing_columns_are_named(history):
    with pytest.raises(KeyError, match="operating_mode"):
        ewma_spc(history(reading()).drop("operating_mode"))


def test_flag_follows_the_reading_or_the_average(history):
    rows = [reading(at=0, value=0.0, ucl=5.0), reading(at=1, value=8.0, ucl=5.0), reading(at=2, value=8.0, ucl=5.0)]
    by_value = ewma_spc(history(*rows), 0.5, cuts=None).orderBy("ts").collect()
    assert [r.spc_violation for r in by_value] == [False, True, True]
    by_average = ewma_spc(history(*rows), 0.5, violation_on="ewma", cuts=None).orderBy("ts").collect()
    assert [r.spc_violation for r in by_average] == [False, False, True]


def test_frames_without_limits_get_null_limits(history):
    df = ewma_spc(history(reading()).drop("ucl", "centerline", "lcl"), cuts=None)
    row = df.collect()[0]
    assert (row.ucl, row.lcl, row.spc_violation) == (None, None, False)


def test_no_normal_rows_give_an_empty_frame_with_the_new_columns(history):
    df = ewma_spc(history(reading(mode="idle")), cuts=None)
    assert df.collect() == [] and {"ewma", "spc_violation"} <= set(df.columns)


def test_decayed_sum_takes_positions_with_gaps(spark):
    rng = random.Random(10)
    position, points = 0, []
    for _ in range(300):
        position += rng.choice([0, 1, 3, 500, 2500])
        points.append((position, rng.uniform(1, 2)))
    df = spark.createDataFrame([("k", i, p, t) for i, (p, t) in enumerate(points)], "k string, i int, p long, t double")
    got = [r.y for r in decayed_sum(df, ["k"], ["i"], "p", "t", 0.8, "y").orderBy("i").collect()]
    y, last = 0.0, 0
    for (p, t), have in zip(points, got):
        y, last = y * 0.8 ** (p - last) + t, p
        assert have == pytest.approx(y, rel=1e-9)


def test_long_series_are_cut_below_the_limit(spark):
    df = frame(spark, random_history([1000, 10], seed=11))
    cuts = find_long_series(df, SERIES_KEYS, 100)
    assert [r.entity for r in cuts[0].collect()] == ["E00"]
    s = split_series(df, SERIES_KEYS, cuts)
    sizes = s.rows.groupBy(*s.by).count().collect()
    assert len(sizes) == 11 and max(r["count"] for r in sizes) <= 110
    assert find_long_series(df, SERIES_KEYS, 1000) is None


def test_bursts_and_stray_timestamps_are_cut_again(spark):
    """Almost all rows lie in one of the first chunks; it is cut until every chunk is small."""
    rng = random.Random(16)
    times = [DAY0 - timedelta(days=9000)] + [DAY0 + timedelta(seconds=i) for i in range(2000)]
    times += [DAY0 + timedelta(days=5, microseconds=i) for i in range(2000)]
    series = {"E00": [(t, rng.choice([0.0, 1.0, 2.0, 3.0]), rng.random()) for t in times]}
    df = frame(spark, series)
    cuts = find_long_series(df, SERIES_KEYS, 100)
    assert len(cuts) > 1
    s = split_series(df, SERIES_KEYS, cuts)
    assert max(r["count"] for r in s.rows.groupBy(*s.by).count().collect()) <= 400
    check(ewma(df, 0.2, cuts=cuts), series, 0.2)
    check(ewma(df, 0.2, reset_on_maintenance=False, cuts=cuts), series, 0.2, reset=False)


def test_rows_of_one_instant_stay_together(spark):
    series = {"E00": [(DAY0, 1.0, float(i)) for i in range(50)]}
    assert find_long_series(frame(spark, series), SERIES_KEYS, 10) is None


def recursion(values, alpha):
    out = []
    for x in values:
        out.append(x if not out else (1 - alpha) * out[-1] + alpha * x)
    return out


def test_repeated_rows_with_spilled_sorts(spark, history):
    """Rows that are equal in every column must keep their places through all sorts."""
    values = [((i * 7919) % 101) / 10 for i in range(1_500)]
    rows = [reading(at=i, value=v, hours=1.0 + i) for i, v in enumerate(values) for _ in range(3)]
    threshold = "spark.sql.windowExec.buffer.spill.threshold"
    kept = spark.conf.get(threshold)
    spark.conf.set(threshold, "2000")
    try:
        got = [r.ewma for r in ewma(history(*rows[::-1]), 0.2, cuts=None).orderBy("ts").collect()]
    finally:
        spark.conf.set(threshold, kept)
    expected = recursion([v for v in values for _ in range(3)], 0.2)
    for i in range(0, len(got), 3):
        assert sorted(got[i : i + 3]) == pytest.approx(sorted(expected[i : i + 3]), abs=1e-9)


@pytest.mark.parametrize("alpha", [0.2, 0.9, 1e-17])
def test_large_first_reading_fades_but_never_goes(history, alpha):
    values = [1e250] + [1.0] * 2_699
    rows = [reading(at=i, value=v, hours=1.0 + i) for i, v in enumerate(values)]
    got = [r.ewma for r in ewma(history(*rows), alpha, cuts=None).orderBy("ts").collect()]
    assert got == pytest.approx(recursion(values, alpha), rel=1e-9)
