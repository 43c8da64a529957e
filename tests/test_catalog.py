"""Each registered query against its SQL, on the smallest tables."""

import math
import os

import pytest

from waymark.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(rows, cols):
    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted([tuple(value(r[k]) for k in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in catalog.ORACLES:
        assert got
        return
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    a, b = plain(got, df.columns), plain(want.fetchall(), want.columns)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or isinstance(u, float) and isinstance(v, float) and u == pytest.approx(v, rel=1e-9, abs=1.1e-4)


def test_piecewise_bic_is_whole(spark):
    """Every activity has its joined lines, and more than three of them where the criterion asks for them."""
    points = {r.activity_id: r["count"] for r in catalog.piecewise_bic(spark, SF).groupBy("activity_id").count().collect()}
    assert set(points) == {r.activity_id for r in catalog.rec(spark, SF).select("activity_id").distinct().collect()}
    assert max(points.values()) > 4 and all(2 <= n <= 7 for n in points.values())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_public_names():
    import waymark

    assert set(waymark.__all__) >= {"ActivitiesConfig", "CommuteConfig", "GeocodingConfig", "MndTuning", "RouteClusterConfig", "cluster_routes", "piecewise_fit_cached"}
    assert all(callable(getattr(waymark, n)) for n in waymark.__all__)
    with pytest.raises(AttributeError):
        waymark.nothing


def test_package_reaches_workers_elsewhere(tmp_path):
    """A driver that knows the package by its own path only, in another folder."""
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys
sys.path.insert(0, {str(Path(catalog.__file__).parents[2])!r})
from pyspark.sql import SparkSession
from waymark.session import ship
from waymark.plans import catalog
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", {str(tmp_path)!r}).getOrCreate()
ship(spark); ship(spark)
print("rows", catalog.power_curve_long(spark, {SF!r}).count())
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert "rows " in out.stdout, out.stderr[-2000:]
