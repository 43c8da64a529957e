"""Bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounded(rows: DataFrame, stratum: Column, most: int, id_col: str, seed: int = 3) -> DataFrame:
    """Of each stratum the ``most`` rows with the least hash of their id.

    The strata are counted first; from the counts follows a hash that a few
    more than ``most`` rows of each lie below, so only about so many rows are
    shuffled and ranked.  Rows that repeat an id may all count.
    """
    share = F.xxhash64(F.lit(seed), F.col(id_col)) / F.lit(2.0**64) + F.lit(0.5)
    keyed = rows.withColumn("__stratum", stratum)
    counts = keyed.groupBy(F.col("__stratum").alias("__of")).agg(F.count(F.lit(1)).alias("__count"))
    near = keyed.join(F.broadcast(counts), F.col("__stratum").eqNullSafe(F.col("__of"))).where(share * F.col("__count") <= most + 6 * most**0.5 + 10)
    rank = F.row_number().over(Window.partitionBy("__stratum").orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col))
    return near.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank", "__stratum", "__of", "__count")
