"""The corpus pipeline: five of the corpus operators, one after the other.

Every stage takes all that its predecessor kept.  ``run`` writes each stage to
the shared folder and reads it again, as the stages are meant to be run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import decontaminate, exact_dedup, mixing, near_dedup, quality
from waymark.llm.common import release, shared_table, table

#: The stages learn or decide in ways that SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; it learns from all labelled positives, on a bounded sample."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates."""
    return near_dedup.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: the documents that it takes, their size in words and how often each is taken."""
    taken = mixing.mixed_rows(docs)
    return taken.select(*docs.columns, F.col("__size").alias("size"), F.col("__copies").alias("copies"), (F.col("__size") * F.col("__copies")).alias("taken"))


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_duplicates),
    ("near dedup", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared_table(docs, f"stage-{k}")
            release(before)
    return docs
