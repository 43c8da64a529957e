import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import graph, models, routes


def brute_frechet(p, q):
    d = np.hypot(p[:, None, 0] - q[None, :, 0], p[:, None, 1] - q[None, :, 1])
    best = np.full(d.shape, np.inf)
    for i in range(len(p)):
        for j in range(len(q)):
            before = 0.0 if i == j == 0 else min(best[a, b] for a, b in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if a >= 0 and b >= 0)
            best[i, j] = max(d[i, j], before)
    return best[-1, -1]


def test_frechet_brute_force():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (1, 4), (7, 5), (20, 20)):
        p, q = rng.random((n, 2)), rng.random((m, 2))
        assert routes.frechet(p, q) == pytest.approx(brute_frechet(p, q))


def test_resample_counts():
    line = np.column_stack([np.linspace(0, 5200, 30), np.zeros(30)])
    got, length = routes.evenly(line, routes.RouteClusterConfig())
    assert len(got) == 20 and length == pytest.approx(5200)
    assert routes.evenly(np.zeros((3, 2)), routes.RouteClusterConfig()) is None


def test_dbscan_noise_and_border(spark):
    nodes = spark.createDataFrame([(k,) for k in range(7)], "node int")
    links = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 3), (5, 6)], "a int, b int")
    got = {r.node: r.cluster for r in graph.dbscan(nodes, links, 3).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: -1, 5: -1, 6: -1}
    assert {r.node: r.cluster for r in graph.dbscan(nodes, links, 2).collect()}[6] == 1


def test_components_chain(spark):
    n = 40
    links = spark.createDataFrame([(k, k + 1) for k in range(n - 1) if k != 20], "a int, b int")
    nodes = spark.createDataFrame([(k,) for k in range(n)], "node int")
    got = {r.node: r.comp for r in graph.components(nodes, links).collect()}
    assert got == {k: 0 if k <= 20 else 21 for k in range(n)}


def test_clusters_by_route_and_name(spark):
    def line(node, bulge):
        return [(node, k, 37.7749 + (bulge * np.sin(np.pi * k / 29)).item(), -122.4194 + 0.0594 * k / 29) for k in range(30)]

    points = spark.createDataFrame([*line(0, 0.0), *line(1, 0.0003), *line(6, 0.02)], "node int, at int, latitude double, longitude double")
    names = spark.createDataFrame([(0, "A", True, True), (1, "A", True, True), (2, "T", True, False), (3, "T", True, False), (4, "T", True, False), (5, "B", False, False), (6, "A", True, True)], "node int, name string, has_file boolean, has_gps boolean")
    got = {r.node: r for r in routes.cluster(points, names).collect()}
    assert [got[k].cluster_id for k in range(7)] == [1, 1, 0, 0, 0, None, None]
    assert got[0].cluster_name == "A" and got[0].start_lat == pytest.approx(37.7749, abs=1e-3)
    assert got[5].start_lat is None and got[6].start_lat is not None and got[2].start_lat is None


def optimal(x, penalty, min_size):
    cost = lambda a, b: ((x[a:b] - x[a:b].mean(0)) ** 2).sum()
    best = {0: (-penalty, [])}
    for t in range(min_size, len(x) + 1):
        best[t] = min(((best[s][0] + cost(s, t) + penalty, [*best[s][1], t]) for s in best if t - s >= min_size), key=lambda z: z[0])
    return best[len(x)]


def test_pelt_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(20):
        x = np.concatenate([rng.normal(m, 1, (rng.integers(2, 15), 2)) for m in rng.normal(0, 3, 4)])
        for penalty in (1.0, 5.0, 30.0):
            assert models.pelt(x, penalty, 2) == optimal(x, penalty, 2)[1]
    assert models.pelt(np.zeros((0, 1)), 1.0) == [] and models.pelt(np.zeros((1, 1)), 1.0) == [1]
    step = np.array([0.0] * 10 + [10.0] * 10)
    assert models.pelt(((step - 5) / 5)[:, None], 10.0) == [10, 20]


def test_commute_spans(spark):
    rows = [("k", 10 * k, "Morning", 1.0 if k < 4 else 9.0, 1.0, 5.0, 5.0, "old" if k < 4 else "new", "work") for k in range(8)]
    df = spark.createDataFrame(rows, "k string, d int, direction string, start_lat double, start_lon double, end_lat double, end_lon double, start_address string, end_address string")
    df = df.selectExpr("*", "cast(date_add(date'2026-01-05', d) as timestamp_ntz) as date")
    got = models.commute_spans(df, ["k"], 6.0).orderBy("start_date").collect()
    assert [(r.n_commutes, r.home_address, r.work_address) for r in got] == [(4, "old", "work"), (4, "new", "work")]
    assert models.commute_spans(df, ["k"], 100.0).count() == 1
    assert models.commute_spans(df.limit(0), ["k"]).count() == 0


def two_lines(spark, n=30):
    return spark.createDataFrame([(1, 86400.0 * d, 100.0 - d if d <= 15 else 85.0 + 2 * (d - 15)) for d in range(n)], "k int, t double, x double")


def test_piecewise(spark):
    df = two_lines(spark)
    fixed = models.piecewise(df, ["k"], "t", "x", n_segments=2).orderBy("at").collect()
    assert [r.value for r in fixed] == pytest.approx([100, 85, 113], abs=1e-2)
    assert [r.rate for r in fixed][:2] == pytest.approx([-1, 2], abs=1e-2) and fixed[2].rate is None
    assert abs(fixed[1].at - 15 * 86400) < 3600
    given = models.piecewise(df, ["k"], "t", "x", breaks=[0.0, 15 * 86400.0, 29 * 86400.0]).orderBy("at").collect()
    assert [r.value for r in given] == pytest.approx([100, 85, 113])
    auto = models.piecewise(df, ["k"], "t", "x", max_segments=2).count()
    assert auto == 3


def test_piecewise_limits():
    with pytest.raises(ValueError):
        models.fit_segments(np.arange(5.0), np.arange(5.0), 3, 2.0)
    assert models.spaced(np.zeros(3), 0.0, 4.0).tolist() == [4.0, 8.0, 12.0]
    score = {n: models.bic(s, 30, n) for n, s in ((1, 1000.0), (2, 1.0), (3, 0.95))}
    assert min(score, key=score.get) == 2 and models.bic(0.0, 30, 1) == -np.inf


def test_piecewise_against_every_pair_of_breaks():
    """The search finds breaks no worse than the best of a fine grid."""
    rng = np.random.default_rng(4)
    for k in range(6):
        x = np.sort(rng.random(40)) * 86400 * 30
        y = np.interp(x, [0, 86400 * rng.uniform(5, 12), 86400 * rng.uniform(15, 25), 86400 * 30], rng.normal(0, 10, 4)) + rng.normal(0, 0.5, 40)
        grid = np.linspace(x.min(), x.max(), 60)[1:-1]
        for segments, sets in ((2, [(b,) for b in grid]), (3, [(a, b) for i, a in enumerate(grid) for b in grid[i + 1 :]])):
            best = min(models.hinge_fit(x, y, np.array([x.min(), *s, x.max()]))[1] for s in sets)
            breaks, values, ssr = models.fit_segments(x, y, segments)
            assert ssr <= best * (1 + 1e-6) and np.all(np.diff(breaks) >= 0)
            assert ssr == pytest.approx(models.hinge_fit(x, y, breaks)[1])
        sums = models.Sums((x - x.min()) / np.ptp(x), (y - y.mean()) / y.std())
        u = np.sort(rng.random((5, 3)), axis=1)
        want = [models.hinge_fit((x - x.min()) / np.ptp(x), (y - y.mean()) / y.std(), np.array([0, *r, 1]))[1] for r in u]
        assert sums.residuals(u) == pytest.approx(want, rel=1e-6, abs=1e-8)


def test_frechet_of_many_pairs_is_quick():
    p, q = np.random.default_rng(4).random((2, 10_000, 20, 2))
    routes.frechet_many(p[:10], q[:10])
    start = time.process_time()
    got = routes.frechet_many(p, q)
    assert time.process_time() - start < 0.3
    assert got[:20] == pytest.approx([brute_frechet(a, b) for a, b in zip(p[:20], q[:20], strict=True)])


def test_frechet_pairs_make_their_routes_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    df = spark.createDataFrame([(0, k, 1000.0, [0.0, 1.0 * k], [0.0, 1000.0]) for k in range(30)], "part int, node int, length_m double, xs array<double>, ys array<double>")
    assert routes.frechet_pairs(df.mapInArrow(counted, df.schema), "part", "node").count() == 30 * 29 // 2
    assert made.value == 30


def test_resample_over_batches(spark):
    rng = np.random.default_rng(5)
    lines = {k: np.cumsum(rng.random((int(rng.integers(1, 30)), 2)) * 900, axis=0) for k in range(25)} | {25: np.zeros((4, 2)), None: np.array([[0.0, 0.0], [3000.0, 0.0]])}
    rows = [((k, "r"), int(t), *map(float, at)) for k, line in lines.items() for t, at in enumerate(line)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "key struct<k int, s string>, at int, x double, y double")
    want = {k: got for k, line in lines.items() if (got := routes.evenly(line, routes.RouteClusterConfig()))}
    for most in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            found = {r.key.k: r for r in routes.resample(df, ["key"], "at", "x", "y").collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert found.keys() == want.keys()
        for k, (xy, length) in want.items():
            assert found[k].length_m == pytest.approx(length)
            assert np.column_stack([found[k].xs, found[k].ys]) == pytest.approx(xy)


def test_frechet_pairs_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(40):
        n, scale = int(rng.integers(2, 6)), float(rng.uniform(900, 1500))
        line = np.cumsum(rng.random((n, 2)) * scale / n, axis=0)
        rows.append((k % 2, k, float(scale), line[:, 0].tolist(), line[:, 1].tolist()))
    df = spark.createDataFrame(rows, "part int, node int, length_m double, xs array<double>, ys array<double>")
    config = routes.RouteClusterConfig()
    want = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[0] == b[0] and max(a[2], b[2]) <= 1.2 * min(a[2], b[2]):
                d = brute_frechet(np.column_stack(a[3:]), np.column_stack(b[3:]))
                want[a[1], b[1]] = d / (50 + 0.018 * (a[2] + b[2]) / 2)
    for block in (256, 3):
        monkeypatch.setattr(routes, "BLOCK", block)
        assert {(r.a, r.b): r.distance for r in routes.frechet_pairs(df, "part", "node", config).collect()} == pytest.approx(want)
        limit = float(np.median(list(want.values())))
        near = {(r.a, r.b): r.distance for r in routes.frechet_pairs(df, "part", "node", config, within=limit).collect()}
        assert near == pytest.approx({k: d for k, d in want.items() if d <= limit})
    assert routes.frechet_pairs(df.limit(0), "part", "node", config).count() == 0


def test_chain_links_connect_as_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for k, (lat, lon) in enumerate([(0.0, 0.0), (60.0, 10.0), (-45.0, -70.0), (37.0, -122.0)]):
        for j in range(60):
            r = 0.02 / np.cos(np.radians(lat))
            rows.append((100 * k + j, lat + float(rng.uniform(-0.02, 0.02)), lon + float(rng.uniform(-r, r))))
    rows += [(1000 + j, 37.5 + 1e-5 * (j % 7), -122.5) for j in range(50)] + [(2000, 37.5 + 0.0013, -122.5)]
    df = spark.createDataFrame(rows, "node int, lat double, lon double")
    for within, block in ((150.0, 2000), (400.0, 3)):
        monkeypatch.setattr(graph, "BLOCK", block)
        labels = lambda links: {r.node: r.comp for r in graph.components(df.select("node"), links).collect()}
        want = labels(graph.neighbours(df, "node", "lat", "lon", within))
        assert labels(graph.chain_links(df, "node", "lat", "lon", within)) == want
        assert 1 < len(set(want.values())) < len(rows)
    assert graph.chain_links(df.limit(0), "node", "lat", "lon", 10.0).count() == 0


def test_numbered_is_one_order(spark):
    df = spark.range(1000).selectExpr("id % 37 as a", "id as b").repartition(7)
    order = [F.desc("a"), F.col("b")]
    got = [r.k for r in graph.numbered(df, order, "k").orderBy(*order).collect()]
    assert got == list(range(1000))
    assert graph.numbered(df.limit(0), order, "k").count() == 0
