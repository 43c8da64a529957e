"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length.  A source's target holds
every document ``floor(target / source size)`` times; what remains of the
budget is fitted, for each source, over the counts alone: a proportional share
of every length, then longest lengths first while much is left, then bounded
knapsack dynamic programming (a bit set of the reachable sums) over the last
few thousand words, and over second and third copies where single documents
cannot fill the budget.  The documents of a length are then taken in the order of
a seeded hash: a threshold hash for each source and length, found in two
levels, so that neither a hot source nor a hot length meets in one task.  All
of this goes over slim rows (source, length, hash, place); ``mixed_rows`` then
marks the rows where they lie, and no text is shuffled.

Defined cases: a null text has size 0; null is a source like any other and
comes last; a source without words has target 0 and nothing is taken from it;
rows that repeat an id share its hash, and where the threshold falls on them
the least hashes of whole rows are taken, and of equal rows the first places;
an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import PLACE, marked, placed, row_hash, shared_table

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
#: Above this many words, the remaining budget is taken greedily, below it by dynamic programming.
DP_WORDS = 1 << 13
#: A hash bucket of the first level holds so many documents at most, if they are spread evenly.
BUCKET_ROWS = 20_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill(sizes: list[int], weights: list[float], total: float, most: float = MOST_COPIES) -> list[float]:
    """Targets that share ``total`` by weight, none above ``most`` times its size; the excess is shared again."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_ and left > 0:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / whole > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = float(most * sizes[i])
            open_.discard(i)
        left = float(total) - sum(out)
    return out


def reachable(items: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """The counts n <= count of (length, count) whose sum is the largest within ``budget``, by a bit set of sums."""
    sets, parts, mask = [1], [], (1 << budget + 1) - 1
    for length, count in items:
        count, k = min(count, budget // length), 1
        while count > 0 and not sets[-1] >> budget & 1:
            n = min(k, count)
            parts.append((length, n))
            sets.append((sets[-1] | sets[-1] << length * n) & mask)
            count -= n
            k *= 2
    at, taken = sets[-1].bit_length() - 1, {}
    for k in range(len(parts) - 1, -1, -1):
        if not sets[k] >> at & 1:
            length, n = parts[k]
            taken[length] = taken.get(length, 0) + n
            at -= length * n
    return taken


def fit(counts: list[tuple[int, int]], budget: int, most: int = 1) -> dict[int, int]:
    """How many times to take documents of each length, for a sum near ``budget``; (length, count) with length > 0.

    Each document once at first; only what single documents cannot fill is
    filled by taking some up to ``most`` times.
    """
    counts = sorted(counts, reverse=True)
    whole = sum(n * c for n, c in counts)
    if budget <= 0 or not whole:
        return {}
    left = min(budget, most * whole)
    share = min(left, whole)
    taken = {n: c * share // whole for n, c in counts}
    left -= sum(n * k for n, k in taken.items())
    for times in sorted({1, most}):
        for n, c in counts:
            if left <= DP_WORDS:
                break
            more = max(0, min(times * c - taken[n], (left - DP_WORDS) // n + (n <= DP_WORDS), left // n))
            taken[n] += more
            left -= more * n
        if left <= 2 * DP_WORDS:
            for n, k in reachable([(n, times * c - taken[n]) for n, c in counts if n <= left and times * c > taken[n]], left).items():
                taken[n] += k
                left -= k * n
    # One more may come nearer than staying below the budget.
    over = [n for n, c in counts if most * c > taken[n] and n < 2 * left]
    if over:
        taken[min(over, key=lambda n: abs(left - n))] += 1
    return taken


def _fit_source(counts: pd.DataFrame) -> pd.DataFrame:
    budget, most = int(counts["budget"].iloc[0]), int(counts["most"].iloc[0])
    taken = fit([(int(n), int(c)) for n, c in zip(counts["size"], counts["n"], strict=True) if n > 0], budget, most)
    extra = pd.Series([taken.get(int(n), 0) for n in counts["size"]], index=counts.index)
    return counts.assign(times=extra // counts["n"], extra=extra % counts["n"])[["source", "size", "times", "extra"]]


def plan(slim: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """From (source, size, h, id): the targets of sources, and the thresholds of lengths that are taken in part.

    One row for each source goes to the driver, counts of lengths never do.
    """
    spark = slim.sparkSession
    hist = shared_table(slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    sums = sorted(((r.source, int(r.words)) for r in hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    goals = fill([n for _, n in sums], [weights[k % len(weights)] for k in range(len(sums))], share * sum(n for _, n in sums))
    rows = []
    for (source, n), goal in zip(sums, goals, strict=True):
        copies = min(MOST_COPIES, int(goal // n)) if n else 0
        rows.append((source, n, goal, copies, round(goal - copies * n) if copies < MOST_COPIES else 0))
    targets = spark.createDataFrame(rows, "source string, source_size long, target double, copies int, budget long").coalesce(1).withColumn("most", F.greatest(F.lit(1), MOST_COPIES - F.col("copies")))
    fitted = (
        hist.join(F.broadcast(targets), hist.source.eqNullSafe(targets.source)).select(hist.source, "size", "n", "budget", "most")
        .groupBy("source").applyInPandas(_fit_source, "source string, size long, times long, extra long")
    )
    fitted = shared_table(fitted.where("times > 0 or extra > 0"), "mix-fitted")
    return targets, fitted


def thresholds(slim: DataFrame, fitted: DataFrame) -> DataFrame:
    """(t_source, t_size, times, h_top, id_top, ties, all_ties), a row for each fitted source and length.

    All its rows are taken ``times`` times more, those below (h_top, id_top)
    once more, and of those equal to it so many as ties says.
    """
    same = lambda a, b, *more: reduce(lambda x, c: x & (a[c] == b[c]), more, a["source"].eqNullSafe(b["source"]) & (a["size"] == b["size"]))
    buckets = max(256, -(-slim.count() // BUCKET_ROWS))
    cut = slim.withColumn("hb", F.floor((F.col("h") / 2.0**64 + 0.5) * buckets).cast("int"))
    # Of a length taken whole the last hash is the threshold, too; all lengths go one way.
    cells = cut.groupBy("source", "size", "hb").agg(F.count(F.lit(1)).alias("c"))
    cells = cells.join(part := fitted.where("extra > 0"), same(cells, part)).select(cells.source, cells.size, "hb", "c", "extra")
    upto = F.sum("c").over(Window.partitionBy("source", "size").orderBy("hb"))
    edge = shared_table(cells.withColumn("upto", upto).where("upto >= extra and upto - c < extra").select("source", "size", "hb", (F.col("extra") - F.col("upto") + F.col("c")).alias("need")), "mix-edges")
    near = cut.join(edge, same(cut, edge, "hb")).select(cut.source, cut.size, cut.hb, "h", "id", "need")
    near = near.groupBy("source", "size", "hb", "h", "id", "need").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("source", "size", "hb").orderBy("h", F.col("id").asc_nulls_last()))
    tops = near.withColumn("upto", upto).where("upto >= need and upto - c < need").select("source", "size", F.col("h").alias("h_top"), F.col("id").alias("id_top"), (F.col("need") - F.col("upto") + F.col("c")).alias("ties"), (F.col("c") == F.col("need") - F.col("upto") + F.col("c")).alias("all_ties"))
    return fitted.join(tops, same(fitted, tops), "left").select(fitted.source.alias("t_source"), fitted.size.alias("t_size"), "times", "h_top", "id_top", "ties", "all_ties")


def _decide(rows: DataFrame, targets: DataFrame, tops: DataFrame) -> DataFrame:
    """Slim rows (source, size, h, id, tie) with target, source_size and copies.

    Targets are one row for each source.  The thresholds meet the rows in a
    plain join; adaptive execution splits it where a source and length is hot.
    """
    targets = F.broadcast(targets.select(F.col("source").alias("s"), "source_size", "target", F.col("copies").alias("base")))
    out = rows.join(targets, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    out = out.join(tops, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("size") == F.col("t_size")), "left").drop("t_source", "t_size")
    after = F.struct(F.col("id").isNull(), F.col("id"))
    top = F.struct(F.col("id_top").isNull(), F.col("id_top"))
    tied = (F.col("h") == F.col("h_top")) & after.eqNullSafe(top)
    below = (F.col("h") < F.col("h_top")) | ((F.col("h") == F.col("h_top")) & (after < top))
    out = out.withColumn("tied", F.coalesce(tied & ~F.col("all_ties"), F.lit(False))).withColumn("more", F.coalesce(below | tied, F.lit(False)).cast("int"))
    free = out.where("not tied")
    rank = F.row_number().over(Window.partitionBy("source", "size", "h", "id").orderBy("tie", *PLACE))
    held = out.where("tied").withColumn("more", (rank <= F.col("ties")).cast("int"))
    copies = F.coalesce(F.col("base"), F.lit(0)) + F.coalesce(F.col("times"), F.lit(0)) + F.col("more")
    return free.unionByName(held).withColumn("copies", copies.cast("long")).drop("times", "h_top", "id_top", "ties", "all_ties", "tied", "more", "base")


def _mixed(rows: DataFrame, tie: Column, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, seed: int) -> DataFrame:
    """The decisions for rows with a place."""
    slim = rows.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"), tie.alias("tie"), *PLACE)
    slim = shared_table(slim, "mix-slim")
    targets, fitted = plan(slim, weights, share)
    return _decide(slim, targets, shared_table(thresholds(slim, fitted), "mix-tops"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, seed: int = 7) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken), a row for each row of ``docs``."""
    out = _mixed(placed(docs), row_hash(docs), id_col, text_col, source_col, weights, share, seed)
    return out.select(F.col("id").alias("doc_id"), "size", "source", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all their columns, __size and __copies (1 to 3 times a row)."""
    rows = placed(docs)
    out = _mixed(rows, row_hash(docs), id_col, text_col, source_col, weights, share, seed)
    taken = marked(rows, out.select(*PLACE, F.col("copies").alias("__copies")), "__copies", bits=2).where("__copies > 0")
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns], words(F.col(text_col)).alias("__size"), F.col("__copies").cast("long").alias("__copies"))
