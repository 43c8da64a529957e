import numpy as np
import pytest

from waymark.functions import units
from waymark.operators import activity as A


def rows(spark, times, values, name="v"):
    return spark.createDataFrame([(1, float(t), k, None if v is None else float(v)) for k, (t, v) in enumerate(zip(times, values))], f"k int, t double, seq int, {name} double")


def flags(spark, times, values, threshold, seconds):
    return [r.inactive for r in A.inactive(rows(spark, times, values), ["k"], "t", "seq", "v", threshold, seconds).orderBy("seq").collect()]


def test_inactive_runs(spark):
    minutes = [60 * k for k in range(10)]
    assert flags(spark, minutes, [0.0] * 4 + [5.0, 10.0] + [15.0] * 4, 0.01, 120) == [True] * 4 + [False] * 3 + [True] * 3
    assert flags(spark, [0, 60, 120], [0.0, 0.0, 0.0], 0.01, 120) == [True] * 3
    assert flags(spark, [0, 60, 60, 120], [0.0, 0.0, 0.0, 0.0], 0.01, 100) == [True] * 4
    assert flags(spark, [0, 60, 60, 120], [0.0, 0.0, 9.0, 9.0], 0.01, 1000) == [False] * 4


def test_segments_number_from_one(spark):
    times = [0, 10, 20, 20 + 3 * 3600, 30 + 3 * 3600]
    assert [r.segment for r in A.segments(rows(spark, times, times), ["k"], "t", "seq", 5400).orderBy("seq").collect()] == [1, 1, 1, 2, 2]
    assert [r.segment for r in A.segments(rows(spark, [0, 5400], [0.0, 1.0]), ["k"], "t", "seq", 5400).collect()] == [None, None]


def test_trim_and_first_position(spark):
    df = spark.createDataFrame([(1, float(k), k, lat, 1.0) for k, lat in enumerate([None, 5.0, None, 6.0, None])], "k int, t double, seq int, latitude double, longitude double")
    assert [r.seq for r in A.trim_valid(df, ["k"], "t", "seq").orderBy("seq").collect()] == [1, 2, 3]
    assert A.first_position(df, ["k"], "t", "seq").first().lat == 5.0
    none = df.selectExpr("k", "t", "seq", "cast(null as double) latitude", "longitude")
    assert A.first_position(none, ["k"], "t", "seq").first().lat is None


def test_power_curve_and_ftp(spark):
    df = rows(spark, range(20), [100.0] * 10 + [200.0] * 10, "p")
    curve = A.power_curve(df, ["k"], "t", "p", [1, 5, 10, 20, 30])
    assert [r.watts for r in curve.orderBy("window_s").collect()] == pytest.approx([200, 200, 200, 150])
    flat = A.power_curve(rows(spark, range(5), [200.0] * 5, "p"), ["k"], "t", "p", units.power_windows())
    assert A.estimated_ftp(flat, ["k"]).first().ftp == pytest.approx(190)
    gap = A.power_curve(rows(spark, [0, 3], [100.0, 100.0], "p"), ["k"], "t", "p", [4])
    assert gap.first().watts == pytest.approx(50)  # missing seconds are 0 W


def test_curve_brute_force():
    p = np.random.default_rng(0).random(50) * 300
    want = [max(p[i : i + w].mean() for i in range(51 - w)) for w in (1, 3, 17, 50)]
    assert A.curve(p, [1, 3, 17, 50]) == pytest.approx(want)


def test_segment_metrics_without_distance(spark):
    df = rows(spark, [0, 10, 30], [None, None, None])
    m = A.segment_metrics(df, ["k"], "t", "seq", "v", 1.0, 10).first()
    assert (m.elapsed_s, m.moving_s, m.distance) == (30.0, None, None)
