"""Exact deduplication by two passes over a Bloom filter.

Pass one hashes each normalised text to two positions of a bit array and
keeps the positions hit at least twice.  Pass two probes that filter: a text
with a position hit once is unique for certain and goes straight through; only
the rest is shuffled by digest to find its group.  False positives of the
filter only cost a shuffle of their slim row, never a wrong group.

The filter has 16 bits a row, but never more than ``MOST_BITS``, and is
broadcast.  Only slim rows (id, digest) meet it.  Of a corpus so large that
the filter fills up, more slim rows are shuffled than need be, up to all of
them; the groups are the same.  Texts are never shuffled: ``keep_first`` marks
the rows that go by their places in the files.

Defined cases: a null text is the empty text; a null id sorts after all
others; repeated rows are separate members of their group, and of rows that
also share the id one stays; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import BLOCK, PLACE, SPACE, bit, placed, release, row_hash, shared_table, without

BITS_PER_ROW = 16
#: 64 MB.
MOST_BITS = 1 << 29


def digest(text: Column) -> Column:
    """SHA-256 (hex) of the text without its ASCII white space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", "").cast("binary"), 256)


def _positions(sha: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), sha), F.lit(bits)) for seed in (11, 23)]


def repeated_filter(slim: DataFrame, sha: str, bits: int) -> DataFrame:
    """Blocks (blk, bitmap) of the positions that at least two hashes hit."""
    hits = slim.select(F.explode(F.array(*_positions(F.col(sha), bits))).alias("p")).groupBy("p").count().where("count > 1")
    return hits.groupBy(F.floor(F.col("p") / BLOCK).cast("long").alias("blk")).agg(F.bitmap_construct_agg(F.pmod(F.col("p"), F.lit(BLOCK))).alias("bitmap"))


def filter_bits(rows: int) -> int:
    bits = BLOCK
    while bits < min(BITS_PER_ROW * rows, MOST_BITS):
        bits *= 2
    return bits


def probe(df: DataFrame, sha: str, blocks: DataFrame, bits: int) -> DataFrame:
    """``df`` with __maybe: false only where the digest occurs once for certain."""
    for k, p in enumerate(_positions(F.col(sha), bits)):
        side = F.broadcast(blocks.select(F.col("blk").alias(f"__b{k}"), F.col("bitmap").alias(f"__m{k}")))
        df = df.withColumn(f"__p{k}", p).withColumn(f"__b{k}", F.floor(F.col(f"__p{k}") / BLOCK).cast("long")).join(side, f"__b{k}", "left")
        hit = F.coalesce(bit(F.col(f"__m{k}"), F.pmod(f"__p{k}", F.lit(BLOCK))), F.lit(False))
        df = df.withColumn(f"__h{k}", hit).drop(f"__p{k}", f"__b{k}", f"__m{k}")
    return df.withColumn("__maybe", F.col("__h0") & F.col("__h1")).drop("__h0", "__h1")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of ``docs``."""
    slim = shared_table(
        docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("text_sha256"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("len"), F.monotonically_increasing_id().alias("rid")),
        "exact-slim",
    )
    bits = filter_bits(slim.count())
    blocks = shared_table(repeated_filter(slim, "text_sha256", bits), "exact-filter")
    probed = probe(slim, "text_sha256", blocks, bits)
    maybe = probed.where("__maybe")
    best = F.min(F.struct(-F.col("len"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("rid"))).alias("best")
    found = maybe.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), best)
    # Written, so that both sides of the join are plain shuffles, which adaptive execution splits at a hot group.
    found = shared_table(found.select("text_sha256", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid")), "exact-groups")
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    alone = probed.where("not __maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    grouped = maybe.join(found, "text_sha256").withColumn("kept", F.col("rid") == F.col("keep_rid"))
    return alone.select(cols).unionByName(grouped.select(cols))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Groups are found over slim rows; the rows that go are then left out where
    they lie, so no text is shuffled, whether it is unique or not.
    """
    rows = placed(docs)
    rank = F.struct((-F.length(F.coalesce(F.col(text_col), F.lit("")))).alias("len"), F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), row_hash(docs).alias("h"), *PLACE)
    slim = shared_table(rows.select(digest(F.col(text_col)).alias("sha"), rank.alias("rank")), "exact-slim")
    bits = filter_bits(slim.count())
    blocks = shared_table(repeated_filter(slim, "sha", bits), "exact-filter")
    maybe = probe(slim, "sha", blocks, bits).where("__maybe").select("sha", "rank")
    # Written, so that both sides of the join are plain shuffles, which adaptive execution splits at a hot group.
    best = shared_table(maybe.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("best")).where("n > 1").select("sha", "best"), "exact-best")
    gone = shared_table(maybe.join(best, "sha").where("rank <> best").select("rank.*").select(*PLACE), "exact-gone")
    release(slim, blocks, best)
    return without(rows, gone)


ORACLE_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256 from documents),
r as (select doc_id, text_sha256, count(*) over (partition by text_sha256) as group_size,
  first_value(doc_id) over (partition by text_sha256 order by length(t) desc, doc_id nulls last) as keep_id,
  row_number() over (partition by text_sha256 order by length(t) desc, doc_id nulls last) as k from d)
select doc_id, keep_id, group_size, k = 1 as kept, text_sha256 from r
"""
