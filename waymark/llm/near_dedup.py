"""Near-duplicate classes by DartMinHash.

The similarity of two texts is the weighted Jaccard of their five-word
shingles, each weighted by its count.  A shingle of weight w owns w unit
regions; every region throws darts, a Poisson process of ranks that only the
region's hash decides.  A text looks at the darts whose rank is below
t / (its total weight), about t darts whatever its length, and keeps the
earliest dart for each of ``COORDS`` coordinates; where a coordinate stays
empty the ranks are doubled.  Equal coordinates have the probability of the
weighted Jaccard.  ``BANDS`` bands of the signature propose candidates: at
0.8 a pair shares none with a probability of 5e-8.

Texts with equal words collapse to one representative first.  A bucket's
members are then compared with each other exactly, over all shingles (64-bit
hashes of them), where they lie.  A bucket of bounded size is one cell, whose
comparisons are products of its incidence matrix.  In a larger one every
member first meets a few leaders, one at a time, in rows; what these links
leave apart from the bucket's main part then meets all its members in cells
of bounded size.  So the near copies of one text, however many, cost so many
comparisons, and only texts that share a bucket without a link cost pairs.
No pair becomes a row; a cell gives the links of a spanning forest, at most
one for each member, and components of the links are the classes.

Defined cases: a null or empty text, or one without words, is a class of its
own; a text of one to four words is one shingle; repeated rows are members of
their class each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import PLACE, marked, placed, release, row_hash, shared_table, without
from waymark.llm.words import Hashes, U, give_back, hashed, mix, slices
from waymark.operators import graph

SHINGLE = 5
SIMILAR = 0.8
COORDS = 128
BANDS = 32
#: A block of a bucket holds about so many texts, and so many shingles, at most.
BLOCK_TEXTS = 1000
BLOCK_SHINGLES = 400_000
#: How many leaders the members of a large bucket meet, one after the other.
LEADERS = 3
_STEP = U(0x9E3779B97F4A7C15)


def regions(text_words: np.ndarray) -> np.ndarray:
    """The hashes of a text's unit regions: of each shingle the first, second, ... occurrence."""
    n = len(text_words)
    if not n:
        return text_words
    k = min(SHINGLE, n)
    with np.errstate(over="ignore"):
        s = np.full(n - k + 1, U(k))
        for j in range(k):
            s = mix(s * U(0x100000001B3) + text_words[j : n - k + 1 + j])
        s.sort()
        at = np.arange(len(s))
        first = np.maximum.accumulate(np.where(np.concatenate([[True], s[1:] != s[:-1]]), at, 0))
        return mix(s + (at - first).astype(U) * _STEP)


def signatures(sets: list[np.ndarray], coords: int = COORDS) -> np.ndarray:
    """(texts, coords) 64-bit darts: rank above, value below; texts are not empty."""
    t = coords * math.log(coords) + 2 * coords
    sig = np.full((len(sets), coords), np.iinfo(U).max, U)
    todo, bound = np.arange(len(sets)), np.array([t / len(s) for s in sets])
    with np.errstate(over="ignore"):
        while len(todo):
            e = np.concatenate([sets[k] for k in todo])
            own = np.repeat(todo, [len(sets[k]) for k in todo])
            rank, j, flat = np.zeros(len(e)), 0, sig.reshape(-1)
            while len(e):
                h = mix(e + U(2 * j + 1) * _STEP)
                rank = rank - np.log1p(-((h >> U(11)).astype(float) * 2.0**-53))
                near = rank < bound[own]
                e, own, rank = e[near], own[near], rank[near]
                g = mix(h[near] ^ _STEP)
                dart = (rank.astype(np.float32).view(np.uint32).astype(U) << U(32)) | (g & U(0xFFFFFFFF))
                np.minimum.at(flat, own * coords + ((g >> U(32)) % U(coords)).astype(np.int64), dart)
                j += 1
            todo = todo[(sig[todo] == np.iinfo(U).max).any(axis=1)]
            bound[todo] *= 2
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sig.shape[1] // bands
    values = (sig & U(0xFFFFFFFF)).reshape(len(sig), bands, rows)
    with np.errstate(over="ignore"):
        key = np.tile(np.arange(bands, dtype=U) * _STEP, (len(sig), 1))
        for j in range(rows):
            key = mix(key * U(0x100000001B3) + values[:, :, j])
    return key.view(np.int64)


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = Hashes()
    for batch in batches:
        for part, texts in slices(batch):
            words = [hashed(t, cache) for t in texts]
            keys = [None if not len(w) else _key(w) for w in words]
            sets = [regions(w) for w in words]
            some = [k for k, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(texts)
            if some:
                for k, row in zip(some, band_keys(signatures([sets[k] for k in some])), strict=True):
                    bands[k] = row
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("at"), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "at", "key", "weight", "bands"],
            )


def _key(words: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(words.tobytes())


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = Hashes()
    for batch in batches:
        for part, texts in slices(batch):
            words = [hashed(t, cache) for t in texts]
            keys = [None if not len(w) else _key(w) for w in words]
            sets = [regions(w).view(np.int64) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["key", "shingles"])


def forest(keys: list[bytes], side: np.ndarray, sets: list[np.ndarray], parts: list[bytes] | None = None) -> list[tuple[bytes, bytes]]:
    """Links that connect what similar pairs connect; if side has both values, only pairs across it are compared.

    Texts of one part are connected already, so a part needs one link at most.
    """
    n, sizes = len(keys), np.array([len(x) for x in sets])
    rows = np.flatnonzero(side == side[0])
    cols = np.flatnonzero(side != side[0]) if len(rows) < n else rows
    flat, own = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, term, df = np.unique(flat, return_inverse=True, return_counts=True)
    shared = df[term] > 1
    term, own = term[shared], own[shared]
    order = np.argsort(term, kind="stable")
    term, own = term[order], own[order]
    both = np.zeros((len(rows), len(cols)), np.float32)
    first = np.concatenate([[True], term[1:] != term[:-1]]) if len(term) else np.zeros(0, bool)
    rank = np.cumsum(first) - 1
    for a in range(0, int(rank[-1]) + 1 if len(rank) else 0, 2048):
        part = slice(*np.searchsorted(rank, (a, a + 2048)))
        incidence = np.zeros((n, min(2048, int(rank[-1]) + 1 - a)), np.float32)
        incidence[own[part], rank[part] - a] = 1
        both += incidence[rows] @ incidence[cols].T
    near = both >= SIMILAR * (sizes[rows][:, None] + sizes[cols][None, :] - both) - 1e-3
    at = np.arange(n)
    if parts is not None:
        first_of: dict[bytes, int] = {}
        for k, part in enumerate(parts):
            at[k] = first_of.setdefault(part, k)

    def root(x: int) -> int:
        while at[x] != x:
            at[x] = x = at[at[x]]
        return x

    links = []
    for i in range(len(rows)):
        for j in np.flatnonzero(near[i]):
            x, y = int(rows[i]), int(cols[j])
            if x != y and (rx := root(x)) != (ry := root(y)):
                at[rx] = ry
                links.append((keys[x], keys[y]))
    return links


def _lists(column: pa.Array) -> list[np.ndarray]:
    values, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    ends = ends - ends[0]
    return [values[a:z] for a, z in zip(ends, ends[1:], strict=False)]


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of their cells; a cell may reach over batches."""
    held: list[tuple] = []
    cell = None

    def links() -> pa.RecordBatch:
        found = forest([r[0] for r in held], np.array([r[1] for r in held]), [r[2] for r in held], [r[3] for r in held]) if len(held) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        sets = _lists(batch.column("shingles"))
        for values, here, key, side, part in zip(sets, zip(*(batch.column(c).to_pylist() for c in ("band", "i", "j")), strict=True), *(batch.column(c).to_pylist() for c in ("key", "side", "part")), strict=True):
            if here != cell:
                yield links()
                held, cell = [], here
            held.append((key, side, values.copy(), part))
    yield links()
    held.clear()
    give_back()


def _cells(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of the cells (band, i, j, key, side, part)."""
    # In the order of keys, so that cells of the same texts give the same links.
    ordered = cells.join(sets, "key").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "key")
    return ordered.select("band", "i", "j", "key", "side", "part", "shingles").mapInArrow(_compare, "a binary, b binary").distinct()


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, x, y) those whose texts are similar."""
    for batch in batches:
        near = []
        for x, y in zip(_lists(batch.column("x")), _lists(batch.column("y")), strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            near.append(both >= SIMILAR * (len(x) + len(y) - both) - 1e-9)
        yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def _parts(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(key, comp): the part of the graph of links that each of the nodes (key) and the links' own ends is in."""
    every = found.select(F.col("a").alias("node")).union(found.select("b")).union(nodes.select("key")).distinct()
    return graph.components(every, found).select(F.col("node").alias("key"), "comp")


def _joined(parts: DataFrame, more: DataFrame) -> DataFrame:
    """``parts`` after further links: only the parts that these connect are looked at, each as one node."""
    end = lambda c: parts.select(F.col("key").alias(c), F.col("comp").alias(f"{c}_part"))
    across = more.join(end("a"), "a").join(end("b"), "b").where("a_part <> b_part").select(F.col("a_part").alias("a"), F.col("b_part").alias("b")).distinct()
    across = shared_table(across, "near-across")
    if not across.limit(1).count():
        return parts
    whole = graph.components(across.select(F.col("a").alias("node")).union(across.select("b")).distinct(), across)
    whole = whole.select(F.col("node").alias("comp"), F.col("comp").alias("whole"))
    return shared_table(parts.join(whole, "comp", "left").select("key", F.coalesce("whole", "comp").alias("comp")), "near-parts")


def _large(members: DataFrame, sets: DataFrame, parts: DataFrame) -> DataFrame:
    """``parts`` with the links of the buckets of more than one block: by leaders, then among what these leave apart.

    Members: (band, key, blocks).  A bucket's leader is the least member of its
    main part at first, later of any part of it.
    """
    for k in range(LEADERS):
        state = shared_table(members.join(parts, "key"), "near-state")
        sizes = shared_table(state.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lead")), "near-sizes")
        main = sizes.groupBy("band").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "comp", "lead")).alias("main"), F.max(F.struct(F.xxhash64(F.lit(k), "lead"), F.col("lead").alias("lead"), F.col("comp").alias("comp"))).alias("any"))
        lead = F.col("main") if k == 0 else F.col("any")
        leaders = main.where("parts > 1").select("band", lead["lead"].alias("a"), lead["comp"].alias("__c"))
        # A member that several buckets give a leader meets the one that most of them give.
        pairs = state.join(leaders, "band").where("comp <> __c").groupBy(F.col("key").alias("b"), "a").agg(F.count(F.lit(1)).alias("n"))
        pairs = pairs.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a"))
        pairs = pairs.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a")
        more = shared_table(pairs.select("a", "b", "x", "y").mapInArrow(_meet, "a binary, b binary"), "near-led")
        release(state, sizes)
        if not more.limit(1).count():
            break
        parts = _joined(parts, more)
    # Of each bucket the members apart from the main part meet each other and the main part.
    state = shared_table(members.join(parts, "key"), "near-state")
    sizes = shared_table(state.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n")), "near-sizes")
    whole = sizes.groupBy("band").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("all")).select("band", F.col("main.comp").alias("main"), (F.col("all") - F.col("main.n")).alias("rest"), "all").where("rest > 0")
    rows = state.join(whole, "band").withColumn("apart", F.col("comp") != F.col("main"))
    share = lambda n: F.ceil(F.col("blocks") * n / F.col("all")).cast("int")
    rows = rows.withColumn("k_rest", share(F.col("rest"))).withColumn("k_main", share(F.col("all") - F.col("rest")))
    block = F.pmod(F.xxhash64("key"), F.when(F.col("apart"), F.col("k_rest")).otherwise(F.col("k_main"))).cast("int")
    rows = rows.withColumn("block", block)
    seats = lambda k, f: F.transform(F.sequence(F.lit(0), F.col(k) - 1), f)
    seat = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    b = F.col("block")
    each = seats("k_rest", lambda c: seat(F.least(b, c), F.greatest(b, c), b))
    # Blocks of the main part are numbered behind those of the rest, from -1 down.
    across = F.when(F.col("apart"), F.concat(each, seats("k_main", lambda c: seat(b, -1 - c, F.lit(0))))).otherwise(seats("k_rest", lambda c: seat(c, -1 - b, F.lit(1))))
    cells = rows.select("band", "key", F.col("comp").alias("part"), F.explode(across).alias("s")).select("band", "key", "part", "s.*")
    return _joined(parts, shared_table(_cells(cells, sets), "near-rest"))


def parts_of(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """(key, comp) of the representatives that are linked to others; ``rows`` are (text, ``PLACE``)."""
    reps = shared_table(sketches.where("key is not null").groupBy("key").agg(F.min_by(F.struct("at", "weight", "bands"), "at").alias("r")).select("key", "r.*"), "near-reps")
    held = reps.select("key", "weight", F.explode("bands").alias("band"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_TEXTS, F.sum("weight") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    # Buckets of the same members are compared once: two hashes over the members tell them apart.
    same = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y")]
    buckets = held.groupBy("band").agg(*same, blocks).where("n > 1").groupBy("n", "x", "y").agg(F.min("band").alias("band"), F.max("blocks").alias("blocks"))
    buckets = shared_table(buckets.select("band", "blocks"), "near-buckets")
    members = shared_table(held.join(buckets, "band").select("band", "key", "blocks"), "near-members")
    # Second reading of the texts: only those of the representatives that some bucket holds leave the scan.
    wanted = members.select("key").distinct().join(reps.select("key", "at"), "key").select("at.*").withColumn("want", F.lit(1))
    texts = marked(rows, wanted, "want").where("want = 1").select("text")
    sets = shared_table(texts.mapInArrow(_sets, "key binary, shingles array<long>"), "near-sets")
    zero = F.lit(0)
    small = members.where("blocks = 1").select("band", zero.alias("i"), zero.alias("j"), "key", zero.alias("side"), F.col("key").alias("part"))
    found = shared_table(_cells(small, sets), "near-links")
    large = members.where("blocks > 1")
    parts = shared_table(_parts(large.select("key"), found), "near-parts")
    if large.limit(1).count():
        parts = _large(large, sets, parts)
    release(reps, buckets, members, sets, found)
    return parts


def _sketches(rows: DataFrame) -> DataFrame:
    """Of (doc_id, text, ``PLACE``): doc_id, at (the place), key, weight and bands of each row."""
    slim = rows.select("doc_id", "text", F.struct(*PLACE).alias("at"))
    kind = {c: slim.schema[c].dataType.simpleString() for c in ("doc_id", "at")}
    return shared_table(slim.mapInArrow(_sketch, f"doc_id {kind['doc_id']}, at {kind['at']}, key binary, weight long, bands array<long>"), "near-sketches")


def _classed(rows: DataFrame) -> DataFrame:
    """(doc_id, at, key, comp) of all rows; key is null for texts without words, comp for texts without links."""
    sketches = _sketches(rows)
    parts = parts_of(rows.select("text", *PLACE), sketches)
    return shared_table(sketches.select("doc_id", "at", "key").join(parts, "key", "left"), "near-rows")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, class_size, n_texts), a row for each row of ``docs``.

    class_id: the least doc_id of the class (null if all are); n_texts: how many different texts
    (by words) the class holds.
    """
    rows = _classed(placed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))))
    known = rows.where("key is not null").withColumn("comp", F.coalesce("comp", "key"))
    found = known.groupBy("comp", "key").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    found = shared_table(found.groupBy("comp").agg(F.min("class_id").alias("class_id"), F.sum("class_size").alias("class_size"), F.count(F.lit(1)).alias("n_texts")), "near-found")
    cols = ["doc_id", "class_id", "class_size", "n_texts"]
    one = F.lit(1).cast("long")
    bare = rows.where("key is null").select("doc_id", F.col("doc_id").alias("class_id"), one.alias("class_size"), one.alias("n_texts"))
    return known.join(found, "comp").select(cols).unionByName(bare)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns.

    The row with the least (id, hash of all columns) stays; texts without
    words all stay.  Rows equal in every column are one row, but for those
    without words.  The rows that go are left out where they lie.
    """
    rows = placed(docs)
    rank = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), row_hash(docs).alias("h"), *PLACE)
    known = _classed(rows.select(rank.alias("doc_id"), F.col(text_col).alias("text"), *PLACE)).where("key is not null")
    known = known.select(F.coalesce("comp", "key").alias("comp"), F.col("doc_id").alias("rank"))
    first = shared_table(known.groupBy("comp").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("comp", "first"), "near-first")
    gone = shared_table(known.join(first, "comp").where("rank <> first").select("rank.*").select(*PLACE), "near-gone")
    return without(rows, gone)
