"""Toxicity by FTRL-proximal logistic regression (McMahan et al. 2013).

Features are hashed word n-grams (one and two words), skip-grams (two words
with one between) and word stems (the first five characters) with how often a
text has them and their share of its words, each once a text, of the value 1.  Each
coordinate has its own rate, and the L1 term keeps weights at zero until the
evidence is enough, so the model is a short list of (bucket, weight).

It is fitted on a bounded sample, ``MOST_TOXIC`` and ``MOST_CLEAN`` labelled
texts.  Their coordinates are worked out in parallel and streamed in a fixed
order through one task whose state is the table of ``BUCKETS`` coordinates;
only the non-zero weights come to the driver, at most ``BUCKETS``.  All texts
are scored whole.

Defined cases: a null text is the empty text, whose score is that of the bias;
without labelled texts of both sorts every score is 0; a document with several
labels is toxic if one says so; repeated rows are scored each; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import crc_mod, held_out, shared_table
from waymark.llm.sampling import bounded
from waymark.llm.words import MOST_WORDS, Hashes, U, mix, slices, tokens

BUCKETS = 1 << 20
MOST_TOXIC = 3000
MOST_CLEAN = 6000
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.1
EPOCHS = 8
#: Letters of a stem, and the counts and shares of a text's words (two at least) at which it has a coordinate of its own.
STEM = 5
COUNTS = (1, 2, 3, 5, 8)
SHARES = (0.005, 0.01, 0.02, 0.04)


class Stems(dict):
    """word -> 64-bit hash of its stem, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word[:STEM], seed=STEM)
        return h


def buckets(text: str | None, words: Hashes, stems: Stems) -> np.ndarray:
    """The distinct coordinates of a text, sorted."""
    found = tokens(text)
    w, s = (np.fromiter(map(cache.__getitem__, found), U, len(found)) for cache in (words, stems))
    with np.errstate(over="ignore"):
        grams = [mix(w + U(1))]
        for gap in (1, 2):
            if len(w) > gap:
                grams.append(mix(w[:-gap] * U(0x100000001B3) + mix(w[gap:] + U(gap))))
        stem, count = np.unique(s, return_counts=True)
        grams += [mix(stem[count >= n] + U(100 + n)) for n in COUNTS]
        grams += [mix(stem[count >= max(2, r * len(s))] + U(200 + k)) for k, r in enumerate(SHARES)]
    at = (np.concatenate(grams) & U(BUCKETS - 1)).astype(np.int64)
    at.sort()
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at


class Ftrl:
    """The last coordinate is the bias."""

    def __init__(self):
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == BUCKETS, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, BUCKETS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        rate = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - rate * w
        self.n[at] += g * g


def train(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) that are not zero; rows are (buckets, label) in any order, as the seed shuffles them."""
    model, rng = Ftrl(), np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            model.learn(*rows[k])
    every = np.arange(BUCKETS + 1)
    w = model.weights(every)
    return every[w != 0], w[w != 0]


class Model:
    def __init__(self, at: np.ndarray, w: np.ndarray, both: bool = True):
        self.at, self.w, self.both, self.dense = at, w.astype(np.float64), both, None
        self.caches = None

    def __getstate__(self):
        return {"at": self.at, "w": self.w, "both": self.both, "dense": None, "caches": None}

    def scores(self, texts: list) -> np.ndarray:
        if not self.both:
            return np.zeros(len(texts))
        if self.dense is None:
            self.dense, self.caches = np.zeros(BUCKETS + 1), (Hashes(), Stems())
            self.dense[self.at] = self.w
        out = np.zeros(len(texts))
        for k, t in enumerate(texts):
            at = buckets(t, *self.caches)
            out[k] = self.dense[at].sum() + self.dense[BUCKETS]
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def _coordinates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    caches = Hashes(), Stems()
    for batch in batches:
        for part, texts in slices(batch):
            at = [buckets(t, *caches).astype(np.int32) for t in texts]
            order = [xxhash.xxh3_64_intdigest(t or "") >> 1 for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(order, pa.int64()), pa.array(at, pa.list_(pa.int32()))], ["toxic", "place", "at"])


def _task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        lists = batch.column("at")
        values, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        ends = ends - ends[0]
        rows += [(place, values[a:z].astype(np.int64), label) for place, label, a, z in zip(batch.column("place").to_pylist(), batch.column("toxic").to_pylist(), ends, ends[1:], strict=False)]
    rows.sort(key=lambda r: (r[0], r[2], len(r[1])))
    at, w = train([r[1:] for r in rows]) if {r[2] for r in rows} == {0, 1} else (np.zeros(0, np.int64), np.zeros(0))
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], ["at", "w"])


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Model:
    """From (doc_id, text) and (doc_id, toxic); of rows that repeat an id one counts, so that the bound holds."""
    labels = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = labels.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    picked = bounded(known.where("toxic = 1"), F.lit(1), most_toxic, "doc_id").unionByName(bounded(known.where("toxic = 0"), F.lit(1), most_clean, "doc_id"))
    sample = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    at = shared_table(sample.mapInArrow(_coordinates, "toxic int, place long, at array<int>"), "tox-sample")
    rows = at.repartition(1).mapInArrow(_task, "at long, w double").toPandas()
    return Model(rows["at"].to_numpy(), rows["w"].to_numpy(), len(rows) > 0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted), a row for each row of ``docs``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(texts), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score_held_out(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """Learns labels from all but one fold and scores every row."""
    ours = F.coalesce(crc_mod(F.col("doc_id"), folds) != fold, F.lit(False))
    model = fit(docs.select("doc_id", "text").where(ours), labels.where(ours))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", "predicted")
