import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from waymark import api
from waymark.functions import expressions as X
from waymark.functions import units
from waymark.operators import timeseries as T

D0 = date(2026, 1, 5)


def series(spark, values):
    return spark.createDataFrame([(1, k, D0 + timedelta(days=k), v) for k, v in enumerate(values)], "k int, t int, day date, x double")


def test_min_periods():
    assert [units.ewm_min_periods(h, c) for h, c in ((3.0, 0.5), (9.0, 0.67), (9.0, 0.95), (10.0, 0.1))] == [4, 15, 39, 2]
    assert units.ewm_min_periods(10.0, 0.1, floor=5) == 5
    for h, c in ((10.0, 1.0), (0.0, 0.5)):
        with pytest.raises(ValueError):
            units.ewm_min_periods(h, c)


def test_power_windows():
    w = units.power_windows(60, 10)
    assert w[0] == 1 and w[-1] == 60 and w == sorted(set(w))
    full = units.power_windows()
    assert len(full) == 186 and full[-1] == 43200 and 1200 not in full


def test_resample_fills_calendar(spark):
    df = spark.createDataFrame([(1, D0, 2.0), (1, D0, 4.0), (1, D0 + timedelta(days=2), 5.0)], "k int, day date, x double")
    got = lambda how: [r.x for r in T.resample(df, ["k"], "day", "x", how).orderBy("day").collect()]
    assert got("mean") == [3.0, None, 5.0]
    assert got("sum") == [6.0, None, 5.0]
    assert got("sum_zero") == [6.0, 0.0, 5.0]


def test_week_ends_on_sunday(spark):
    days = [date(2026, 1, 5), date(2026, 1, 11), date(2026, 1, 12)]
    got = spark.createDataFrame([(d,) for d in days], "d date").select(X.week_ending(F.col("d"))).collect()
    assert [r[0] for r in got] == [date(2026, 1, 11), date(2026, 1, 11), date(2026, 1, 18)]


def test_ewm_carries_nulls_and_matches_definition(spark):
    values = [1.0, None, 4.0, 2.0, None]
    got = [r.m for r in T.ewm(series(spark, values), ["k"], "t", "x", "m", 3.0, 2).orderBy("t").collect()]
    for i, m in enumerate(got):
        seen = [(j, v) for j, v in enumerate(values[: i + 1]) if v is not None]
        if len(seen) < 2:
            assert m is None
        else:
            w = [2 ** ((j - i) / 3) for j, _ in seen]
            assert m == pytest.approx(sum(a * v for a, (_, v) in zip(w, seen)) / sum(w), rel=1e-12)


def test_ewm_carries_the_mean_over_a_long_gap(spark):
    """The mean of day 4 still stands at day 259."""
    values = {0: 10.0, 2: 14.0, 4: 13.0}
    days = [0, 1, 2, 4, 100, 184, 185, 186, 259, 700]
    df = spark.createDataFrame([(1, t, values.get(t)) for t in days] + [(1, 701, 20.0), (1, 702, None), (2, 259, None)], "k int, t int, x double")
    got = {(r.k, r.t): r.m for r in T.ewm(df, ["k"], "t", "x", "m", 3.0, 2).collect()}
    w = {t: 2 ** ((t - 4) / 3) for t in values}
    mean = sum(w[t] * v for t, v in values.items()) / sum(w.values())
    assert got[1, 1] is None and got[2, 259] is None
    assert [got[1, t] for t in days[3:]] == pytest.approx([mean] * 7, rel=1e-12)
    assert [got[1, 701], got[1, 702]] == pytest.approx([20.0] * 2, rel=1e-12)


def test_ewm_over_many_blocks(spark):
    """Long series, with gaps around the length of a block, against the definition."""
    import numpy as np

    rng = np.random.default_rng(7)
    t = np.cumsum(np.concatenate([rng.uniform(0.1, 40, 300), [700, 0.5, 1.0, 768, 2.0, 0.1, 5000, 3.0], rng.uniform(0.1, 3, 100)]))
    x = [None if rng.random() < 0.2 else float(v) for v in rng.normal(100, 30, len(t))]
    df = spark.createDataFrame([(1, float(a), b) for a, b in zip(t, x)], "k int, t double, x double")
    got = [r.m for r in T.ewm(df, ["k"], "t", "x", "m", 3.0, 1).orderBy("t").collect()]
    mean, weight, last = 0.0, 0.0, t[0]
    for a, b, m in zip(t, x, got):
        if b is not None:
            fade = 2 ** ((last - a) / 3.0)
            mean, weight, last = (mean * weight * fade + b) / (weight * fade + 1), weight * fade + 1, a
        assert m is None if not weight else m == pytest.approx(mean, rel=1e-9)


def test_rolling_slope(spark):
    got = lambda v, *a, **k: [r.s for r in T.rolling_slope(series(spark, v), ["k"], "t", "x", "s", *a, **k).orderBy("t").collect()]
    assert got([2.0 * k for k in range(10)], 5, 2) == pytest.approx([2.0] * 10)
    holed = [2.0 * k if k != 4 else None for k in range(10)]
    assert got(holed, 5, 2) == pytest.approx([2.0] * 10)
    trailing = got([2.0 * k for k in range(5)], 3, 2, center=False)
    assert trailing[0] is None and trailing[1:] == pytest.approx([2.0] * 4)
    assert got([1.0], 5, 1) == [None]


def test_asof_keeps_null_payload(spark):
    left = spark.createDataFrame([(1, t) for t in (0, 2, 5, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 1, 10.0), (1, 4, None), (1, 9, 7.0)], "k int, t int, v double")
    assert [r.v for r in T.asof(left, right, ["k"], "t", ["v"]).orderBy("t").collect()] == [None, 10.0, None, 7.0]


def test_eer_pins(spark):
    row = spark.range(1).select(
        X.eer_male(F.lit(150.0), F.lit(70.0), F.lit("2000-01-05").cast("date"), F.lit("2010-01-05").cast("date")).alias("m"),
        X.eer_female(F.lit(130.0), F.lit(65.0), F.lit("2000-01-05").cast("date"), F.lit("2010-01-05").cast("date")).alias("f"),
    ).first()
    assert row.m == pytest.approx(2759.803037) and row.f == pytest.approx(2149.666069)


def test_diary_settles(spark):
    days = [D0 + timedelta(days=k) for k in range(60)]
    frame = lambda rows, c: spark.createDataFrame(rows, f"day date, {c} double")
    weight, cal = api.diary_tables(frame([(d, 180 - k / 7) for k, d in enumerate(days)], "lb"), frame([(d, 2000.0) for d in days], "kcal"), frame([(D0, 0.0)], "kcal"), lambda w, d: w * 0 + 2000)
    tail = cal.orderBy(F.desc("date")).limit(10).collect()
    for r in tail:
        assert r.net_recorded == pytest.approx(0, abs=1e-6)
        assert r.net_observed == pytest.approx(-500)
        assert r.accuracy == pytest.approx(2000 / 1500)
    assert [r.rate for r in weight.orderBy(F.desc("day")).limit(3).collect()] == pytest.approx([-1.0] * 3)


def test_utm_and_haversine(spark):
    x, y = X.utm(F.lit(37.7749), F.lit(-122.4194), F.lit(10))
    row = spark.range(1).select(x.alias("x"), y.alias("y"), X.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d"), X.utm_zone(F.lit(-122.4)).alias("z")).first()
    assert row.x == pytest.approx(551130.77, abs=0.05) and row.y == pytest.approx(4180998.88, abs=0.05)
    assert row.d == pytest.approx(6371009 * math.pi / 180) and row.z == 10
