"""Helpers that the corpus operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.scratch import release, stored

__all__ = ["PLACE", "SPACE", "bit", "crc_mod", "held_out", "marked", "placed", "release", "row_hash", "shared_table", "table", "without"]

#: The ASCII white space of the exact operators.
SPACE = r"[\x20\x09-\x0D]"
#: Where a row lies: 128 bits of its file's path, and its number in the file.
PLACE = ["__waymark_f1", "__waymark_f2", "__waymark_at"]
#: Bits of a bitmap, as Spark's bitmap functions make them.
BLOCK = 32768
#: Bitmaps of one pass: 4 KB each, so 32 MB are broadcast.
PASS_BLOCKS = 8192
shared_table = stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32(id as text) mod n; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(n))


def held_out(id_col: Column, n: int, remainder: int) -> Column:
    """Whether a row belongs to the fold kept from training; false for a null id."""
    return F.coalesce(crc_mod(id_col, n) == remainder, F.lit(False))


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """A hash of all columns of a row, whatever their names and nulls."""
    flat = [F.to_json(F.struct(F.col(f"`{c.name}`"))) if c.dataType.typeName() in ("map", "variant") else F.col(f"`{c.name}`") for c in df.schema]
    return F.xxhash64(F.lit(seed), *[x for c in flat for x in (c.isNull(), c)])


def _scan(docs: DataFrame) -> bool:
    """Whether every row of ``docs`` is one row of a file: a scan, perhaps filtered and projected."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``PLACE``, which tells rows apart and stays the same in every scan.

    What is no scan of Parquet files is written as such first.
    """
    for rows in (docs, None):
        if rows is None or not _scan(rows):
            rows = stored(docs, "rows")
        try:
            at = rows.metadataColumn("_metadata")
            path = at["file_path"]
            return rows.select(*[F.col(f"`{c}`") for c in rows.columns], F.xxhash64(F.lit(1), path).alias(PLACE[0]), F.xxhash64(F.lit(2), path).alias(PLACE[1]), at["row_index"].alias(PLACE[2]))
        except AnalysisException:
            continue
    raise TypeError("rows of files have no place here")


def bit(bitmap: Column, place: Column) -> Column:
    """Whether a bit of a bitmap is set; null for none."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1


def marked(rows: DataFrame, marks: DataFrame, value: str, bits: int = 1) -> DataFrame:
    """``rows`` of ``placed`` with the number that ``marks`` (``PLACE`` and value, below 2**bits) gives them, else 0.

    No row of ``rows`` is shuffled: marks become bitmaps over the rows of a
    file, a bit a row, and each row looks itself up.  The bitmaps of a pass
    are broadcast and bounded by ``PASS_BLOCKS``; more of them make more
    passes, each over its own share of the files.
    """
    at = F.col(PLACE[2])
    picks = [F.expr(f"bitmap_construct_agg(pmod(`{PLACE[2]}`, {BLOCK})) filter (where (`{value}` & {1 << b}) <> 0)").alias(f"__waymark_m{b}") for b in range(bits)]
    block = F.floor(at / BLOCK).cast("long")
    maps = stored(marks.where(F.col(value) != 0).groupBy(*PLACE[:2], block.alias("__waymark_b")).agg(*picks), "marks")
    passes = max(1, -(-maps.count() // PASS_BLOCKS))
    cols = rows.columns

    def one(k: int) -> DataFrame:
        share = F.pmod(F.col(PLACE[0]), F.lit(passes)) == k
        part, side = (rows.where(share), maps.where(share)) if passes > 1 else (rows, maps)
        side = side.select(F.col(PLACE[0]).alias("__waymark_1"), F.col(PLACE[1]).alias("__waymark_2"), "__waymark_b", *[f"__waymark_m{b}" for b in range(bits)])
        same = (F.col(PLACE[0]) == F.col("__waymark_1")) & (F.col(PLACE[1]) == F.col("__waymark_2")) & (block == F.col("__waymark_b"))
        found = reduce(lambda a, b: a + b, [F.coalesce(bit(F.col(f"__waymark_m{b}"), F.pmod(at, F.lit(BLOCK))), F.lit(False)).cast("int") * (1 << b) for b in range(bits)])
        return part.join(F.broadcast(side), same, "left").select(*[F.col(f"`{c}`") for c in cols], found.alias(value))

    return reduce(DataFrame.unionByName, [one(k) for k in range(passes)])


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``placed`` whose place is not in ``gone``, without ``PLACE``."""
    left = marked(rows, gone.select(*PLACE, F.lit(1).alias("__waymark_gone")), "__waymark_gone").where("__waymark_gone = 0")
    return left.select(*[F.col(f"`{c}`") for c in rows.columns if c not in PLACE])
