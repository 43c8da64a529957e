"""Operators on time series: (keys, ordering column, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar(df: DataFrame, keys: list[str], day: str, every: str = "1 day") -> DataFrame:
    """Every day (or week) between a series' first and last one."""
    ends = df.groupBy(*keys).agg(F.min(day).alias("__a"), F.max(day).alias("__b"))
    return ends.select(*keys, F.explode(F.sequence("__a", "__b", F.expr(f"interval {every}"))).alias(day))


def resample(df: DataFrame, keys: list[str], day: str, value: str, how: str = "mean", every: str = "1 day") -> DataFrame:
    """Mean or sum on a complete calendar; a day without values is null, or 0 with how='sum_zero'."""
    agg = {"mean": F.avg(value), "sum": F.sum(value), "sum_zero": F.sum(value)}[how].alias(value)
    out = calendar(df, keys, day, every).join(df.groupBy(*keys, day).agg(agg), [*keys, day], "left")
    return out.fillna({value: 0.0}) if how == "sum_zero" else out


#: Half-lives of a block of ``ewm``: weights inside stay between 1 and 2**256, those of the block before last are below 2**-256.
EWM_BLOCK = 256


def ewm(df: DataFrame, keys: list[str], at: str, value: str, out: str, halflife: float, min_periods: int) -> DataFrame:
    """Mean weighted by 2 to the (age / halflife); ``at`` is numeric, in the halflife's unit.

    Null rows carry the mean on; null until ``min_periods`` values are seen.
    Sums run along blocks of time, with weights from each block's start, so
    they never overflow and a row costs the same however long a series is; what
    the block before adds is put in by its weight, and older blocks weigh
    nothing.  The mean is taken at values only, where the newest weight is 1;
    the ratio stands until the next value, after any gap.
    """
    span = EWM_BLOCK * halflife
    t, x = F.col(at).cast("double"), F.col(value).cast("double")
    df = df.withColumn("__block", F.floor(t / span))
    df = df.withColumn("__w", F.when(x.isNotNull(), F.pow(F.lit(2.0), (t - F.col("__block") * span) / halflife)))
    df = df.withColumn("__wx", F.col("__w") * x)
    by = Window.partitionBy(*keys).orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    here = Window.partitionBy(*keys, "__block").orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__block").rangeBetween(-1, -1)
    total = lambda c: F.coalesce(F.sum(c).over(here), F.lit(0.0)) + F.coalesce(F.sum(c).over(before), F.lit(0.0)) * 2.0**-EWM_BLOCK
    mean = F.when(x.isNotNull(), total("__wx") / total("__w"))
    df = df.withColumn("__mean", mean).withColumn("__seen", F.count(value).over(by)).withColumn("__held", F.last("__mean", ignorenulls=True).over(by))
    return df.withColumn(out, F.when(F.col("__seen") >= min_periods, F.col("__held"))).drop("__block", "__w", "__wx", "__mean", "__seen", "__held")


def rolling_slope(df: DataFrame, keys: list[str], at: str, value: str, out: str, window: int, min_periods: int, per_step: float = 1.0, center: bool = True) -> DataFrame:
    """Least-squares slope over a window of rows, per step times ``per_step``; nulls are left out."""
    first, last = (-(window // 2), (window - 1) // 2) if center else (-(window - 1), 0)
    order = Window.partitionBy(*keys).orderBy(at)
    frame = order.rowsBetween(first, last)
    pos = F.row_number().over(order).cast("double")
    slope = F.regr_slope(F.col(value), F.col("__pos")).over(frame) * per_step
    return df.withColumn("__pos", pos).withColumn(out, F.when(F.count(value).over(frame) >= min_periods, slope)).drop("__pos")


def grid_step(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The median distance of neighbouring rows of a series."""
    gap = F.col(at) - F.lag(at).over(Window.partitionBy(*keys).orderBy(at))
    return df.withColumn("__gap", gap).groupBy(*keys).agg(F.median("__gap").alias("step"))


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, payload: list[str]) -> DataFrame:
    """The payload of the latest right row at or before each left row; a null payload counts.

    Both sides go through one shuffle by key and one sort, instead of a range join.
    """
    rows = left.withColumn("__side", F.lit(1)).withColumn("__p", F.lit(None).cast(right.select(F.struct(*payload).alias("p")).schema["p"].dataType))
    more = right.select(*keys, at, F.lit(0).alias("__side"), F.struct(*payload).alias("__p"))
    last = F.last("__p", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0))
    both = rows.unionByName(more, allowMissingColumns=True).withColumn("__p", last)
    return both.where("__side = 1").select(*left.columns, *[F.col(f"__p.{c}").alias(c) for c in payload])


def impute(df: DataFrame, value: str, by: str, out: str) -> DataFrame:
    return df.withColumn(out, F.coalesce(value, by))
