"""Operators on activity records: (keys, t in seconds, seq, sensor columns)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(keys: Sequence[str], at: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*at)


def below_threshold(df: DataFrame, keys: list[str], t: str, seq: str, value: str, threshold: float, out: str = "below") -> DataFrame:
    """Whether the value's velocity is below the threshold.

    The first row and a missing difference are; at equal times an unchanged or
    falling value is and a rising one is not.
    """
    w = _order(keys, (t, seq))
    dv, dt = F.col(value) - F.lag(value).over(w), F.col(t) - F.lag(t).over(w)
    low = F.when(dv.isNull() | dt.isNull(), True).when(dt == 0, dv <= 0).otherwise(F.try_divide(dv, dt) < threshold)
    return df.withColumn(out, low)


def inactive(df: DataFrame, keys: list[str], t: str, seq: str, value: str, threshold: float, min_seconds: float, out: str = "inactive") -> DataFrame:
    """Flags the rows of every run below the threshold that lasts ``min_seconds`` or more."""
    w = _order(keys, (t, seq))
    df = below_threshold(df, keys, t, seq, value, threshold, "__below")
    df = df.withColumn("__new", F.coalesce((F.col("__below") != F.lag("__below").over(w)).cast("int"), F.lit(1)))
    df = df.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*keys, "__run")
    long = F.max(t).over(run) - F.min(t).over(run) >= min_seconds
    return df.withColumn(out, F.col("__below") & long).drop("__below", "__new", "__run")


def sessions(df: DataFrame, keys: list[str], t: str, seq: str, gap: float, out: str = "session") -> DataFrame:
    """Numbers stretches from 0; a pause longer than ``gap`` starts a new one."""
    w = _order(keys, (t, seq))
    df = df.withColumn("__cut", F.coalesce((F.col(t) - F.lag(t).over(w) > gap).cast("int"), F.lit(0)))
    return df.withColumn(out, F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__cut")


def segments(df: DataFrame, keys: list[str], t: str, seq: str, gap: float, out: str = "segment") -> DataFrame:
    """Sessions numbered from 1; null where there is only one."""
    df = sessions(df, keys, t, seq, gap, "__s")
    return df.withColumn(out, F.when(F.max("__s").over(Window.partitionBy(*keys)) > 0, F.col("__s") + 1)).drop("__s")


def moving_time(df: DataFrame, keys: list[str], t: str, seq: str, flag: str = "inactive") -> DataFrame:
    """Seconds that end in an active row."""
    dt = F.coalesce(F.col(t) - F.lag(t).over(_order(keys, (t, seq))), F.lit(0.0))
    return df.withColumn("__dt", dt).groupBy(*keys).agg(F.sum(F.when(~F.col(flag), F.col("__dt")).otherwise(0.0)).alias("moving_s"))


def segment_metrics(df: DataFrame, keys: list[str], t: str, seq: str, distance: str, threshold: float, min_seconds: float) -> DataFrame:
    """Start, elapsed and moving seconds, and distance of each group; without distances the distance and the moving seconds are null."""
    flagged = inactive(df, keys, t, seq, distance, threshold, min_seconds)
    dt = F.coalesce(F.col(t) - F.lag(t).over(_order(keys, (t, seq))), F.lit(0.0))
    out = flagged.withColumn("__dt", dt).groupBy(*keys).agg(
        F.min(t).alias("start_s"), (F.max(t) - F.min(t)).alias("elapsed_s"), (F.max(distance) - F.min(distance)).alias("distance"),
        F.sum(F.when(~F.col("inactive"), F.col("__dt")).otherwise(0.0)).alias("__moving"), F.count(distance).alias("__n"),
    )
    return out.withColumn("moving_s", F.when(F.col("__n") > 0, F.col("__moving"))).drop("__moving", "__n")


def trim_valid(df: DataFrame, keys: list[str], t: str, seq: str, lat: str = "latitude") -> DataFrame:
    """The rows from the first to the last valid latitude; groups without one vanish."""
    w = Window.partitionBy(*keys)
    place = F.row_number().over(_order(keys, (t, seq)))
    df = df.withColumn("__k", place)
    valid = F.when(F.col(lat).isNotNull(), F.col("__k"))
    return df.withColumn("__a", F.min(valid).over(w)).withColumn("__b", F.max(valid).over(w)).where("__k between __a and __b").drop("__k", "__a", "__b")


def first_position(df: DataFrame, keys: list[str], t: str, seq: str, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """The first valid latitude and the longitude of that row; null where there is none."""
    spot = F.min(F.when(F.col(lat).isNotNull(), F.struct(F.col(t), F.col(seq), F.col(lat).alias("lat"), F.col(lon).alias("lon"))))
    return df.groupBy(*keys).agg(spot.alias("p")).select(*keys, F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))


def one_hertz(df: DataFrame, keys: list[str], t: str, power: str) -> DataFrame:
    """Mean power of every second from first to last; a second without any is 0 W."""
    secs = df.where(F.col(power).isNotNull()).groupBy(*keys, F.floor(t).alias("s")).agg(F.avg(power).alias("p"))
    ends = secs.groupBy(*keys).agg(F.min("s").alias("a"), F.max("s").alias("b"))
    grid = ends.select(*keys, F.explode(F.sequence("a", "b")).alias("s"))
    return grid.join(secs, [*keys, "s"], "left").fillna({"p": 0.0})


def prefix_sums(df: DataFrame, keys: list[str], at: str, value: str, out: str = "prefix") -> DataFrame:
    return df.withColumn(out, F.sum(value).over(_order(keys, (at,)).rowsBetween(Window.unboundedPreceding, 0)))


def curve(powers: np.ndarray, windows: Sequence[int]) -> np.ndarray:
    """The greatest mean of each number of consecutive seconds; NaN where there are fewer."""
    sums = np.concatenate([[0.0], np.cumsum(powers)])
    return np.array([(sums[w:] - sums[:-w]).max() / w if w <= len(powers) else np.nan for w in windows])


def power_curve(df: DataFrame, keys: list[str], t: str, power: str, windows: Sequence[int]) -> DataFrame:
    """(keys, window_s, watts): one activity at a time is in memory, its windows share one prefix sum."""
    windows = list(windows)

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.groupby(np.floor(pdf["t"]).astype("int64"))["p"].mean()
        grid = np.zeros(int(rows.index.max() - rows.index.min()) + 1)
        grid[(rows.index - rows.index.min()).to_numpy()] = rows.to_numpy()
        out = pd.DataFrame({"window_s": windows, "watts": curve(grid, windows)})
        out = out[out["watts"].notna()]
        for c in keys:
            out[c] = pdf[c].iloc[0]
        return out[[*keys, "window_s", "watts"]]

    rows = df.where(F.col(power).isNotNull()).select(*keys, F.col(t).alias("t"), F.col(power).cast("double").alias("p"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    return rows.groupBy(*keys).applyInPandas(best, f"{kinds}, window_s int, watts double")


def interpolate(xs: Column, ys: Column, x: float) -> Column:
    """Linear between the points of two arrays in step, xs rising; clamped at both ends, null for none."""
    pts = F.arrays_zip(xs.alias("x"), ys.alias("y"))
    below, above = F.filter(pts, lambda p: p.x <= x), F.filter(pts, lambda p: p.x >= x)
    lo, hi = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    return F.when(lo.isNull(), hi["y"]).when(hi.isNull() | (hi["x"] == lo["x"]), lo["y"]).otherwise(lo["y"] + (hi["y"] - lo["y"]) * (F.lit(float(x)) - lo["x"]) / (hi["x"] - lo["x"]))


def estimated_ftp(curves: DataFrame, keys: list[str], seconds: float = 1200.0, share: float = 0.95) -> DataFrame:
    """Functional threshold power from long-form curves."""
    pts = F.array_sort(F.collect_list(F.struct(F.col("window_s").cast("double").alias("x"), F.col("watts").alias("y"))))
    out = curves.groupBy(*keys).agg(pts.alias("p"))
    return out.select(*keys, (interpolate(F.col("p.x"), F.col("p.y"), seconds) * share).alias("ftp"))
