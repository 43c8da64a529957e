"""Set and row changes on keyed tables, as plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import units
from waymark.functions.expressions import haversine_m


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def split_hits(wanted: DataFrame, cached: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The cached rows of wanted keys, and the wanted rows that are not cached."""
    asked = wanted.select(*keys).distinct()
    return cached.join(asked, same(cached, asked, keys), "left_semi"), wanted.join(cached, same(wanted, cached, keys), "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of their keys."""
    return old.join(new, same(old, new, keys), "left_anti").unionByName(new)


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone, same(old, gone, keys), "left_anti")


def update(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Old rows with the values of their key in ``new``; keys without one keep theirs."""
    side = new.select(*keys, *[F.col(v).alias(f"__{v}") for v in values], F.lit(True).alias("__hit"))
    out = old.join(side, same(old, side, keys), "left").select(*[old[c] for c in old.columns if c not in values], *[F.when(side["__hit"], side[f"__{v}"]).otherwise(old[v]).alias(v) for v in values])
    return out.select(*old.columns)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def least_recent(df: DataFrame, at: str, keep: int, *keys: str) -> DataFrame:
    """All rows but the ``keep`` latest; ``keys`` tell rows apart and order equal times.  Only ``keep`` rows meet in one place."""
    latest = df.select(at, *keys).orderBy(F.desc(at), *keys).limit(keep)
    return df.join(latest, same(df, latest, [at, *keys]), "left_anti")


def fingerprint(df: DataFrame, groups: list[str], cols: list, config: str = "") -> DataFrame:
    """(groups, fingerprint): an md5 of the distinct keys, in whatever order, and of the configuration.

    Keys are hashed one by one and their hashes added up, so no task holds
    them all.  A null in a key counts as the empty text.
    """
    key = F.md5(F.concat_ws("|", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]).cast("binary"))
    keys = df.select(*groups, key.alias("__key")).distinct()
    part = lambda a: F.sum(F.conv(F.substring("__key", a, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    text = F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.coalesce(part(1), F.lit("0")), F.coalesce(part(17), F.lit("0")), F.lit(config))
    return keys.groupBy(*groups).agg(F.md5(text.cast("binary")).alias("fingerprint"))


def nearest_within(points: DataFrame, key: str, places: DataFrame, within_m: float, payload: str) -> DataFrame:
    """(key, payload, found): the place at the point's rounded position, else the nearest within the radius.

    points: (key, lat, lon); places: (lat, lon, payload).  An equi-join of grid
    cells; a found place may have a null payload.
    """
    size = within_m / units.EARTH_M_PER_DEG
    exact = (F.round("lat", 4) == F.col("p_lat")) & (F.round("lon", 4) == F.col("p_lon"))
    wide = lambda cy: F.lit(size) / F.greatest(F.cos(F.radians(F.least(F.lit(89.9), F.greatest(F.abs(cy * size), F.abs((cy + 1) * size))))), F.lit(1e-3))
    rows = points.select(key, "lat", "lon", F.explode(F.sequence(F.floor(F.col("lat") / size) - 1, F.floor(F.col("lat") / size) + 1)).alias("cy"))
    at = F.floor(F.col("lon") / wide(F.col("cy")))
    rows = rows.select(key, "lat", "lon", "cy", F.explode(F.sequence(at - 1, at + 1)).alias("cx"))
    side = places.select(F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), F.col(payload).alias("p")).withColumn("cy", F.floor(F.col("p_lat") / size))
    side = side.withColumn("cx", F.floor(F.col("p_lon") / wide(F.col("cy"))))
    dist = haversine_m(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))
    near = rows.join(side, ["cy", "cx"]).withColumn("d", dist).withColumn("far", ~exact).where((F.col("d") <= within_m) | exact)
    best = near.groupBy(key).agg(F.min(F.struct("far", "d", "p_lat", "p_lon", "p")).alias("best"))
    return points.select(key).join(best, key, "left").select(key, F.col("best.p").alias(payload), F.col("best").isNotNull().alias("found"))
