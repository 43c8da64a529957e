"""Quality classifier by positive-unlabelled learning.

A small network over statistics of a text's form is trained with the
non-negative unbiased risk (Kiryo et al. 2017): trusted positives, unlabelled
web text, and a class prior.  Labels of poor quality are never used.  The
prior is estimated by the best bin: a first network that tells positives from
unlabelled text ranks both, and among its highest scores the share of
unlabelled rows for each positive one bounds the share of positives; the bin is the one
with the least upper confidence bound.

The statistics of all texts are worked out once, whole, and written; the rest
reads only these.  Both networks are fitted on a bounded sample,
``MOST_POSITIVE`` and ``MOST_UNLABELLED`` rows; the prior's shares of
unlabelled rows are counted over all of them.

Defined cases: a null text is the empty text and is scored like any other;
without positives or unlabelled text every score is 0.5; a document with
several labels is positive if one says so; repeated rows are scored each; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import PLACE, crc_mod, held_out, placed, shared_table, without
from waymark.llm.sampling import bounded
from waymark.llm.words import slices

MOST_POSITIVE = 4000
MOST_UNLABELLED = 6000
HIDDEN = 24
EPOCHS = 300
BATCH = 512
RATE = 0.003
_SYMBOLS = re.compile(r"[^\w\s]")
_RUNS = re.compile(r"([^\w\s])\1+")
_UPPER = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{2,}\b")
_DIGITS = re.compile(r"\d")
_ENDS = re.compile(r"[.!?](?=\s|$)")
FEATURES = 20


def features(text: str | None) -> list[float]:
    """Statistics of a text's form, all of the order of 1."""
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    common = counts.most_common(3)
    pairs = Counter(zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    symbols = _SYMBOLS.findall(text)
    by = Counter(symbols)
    runs = _RUNS.findall(text)
    return [
        math.log1p(len(words)) / 5,
        sum(map(len, words)) / n / 10,
        max(map(len, words), default=0) / 50,
        len(counts) / n,
        (common[0][1] if common else 0) / n,
        sum(c for _, c in common) / n,
        sum(c for _, c in pairs.items() if c > 1) / n,
        sum(1 for a, b in zip(words, words[1:], strict=False) if a == b) / n,
        len(symbols) / chars * 10,
        (len(symbols) - by["."] - by[","]) / n,
        len(runs) / n,
        by["|"] / n,
        by["!"] / n,
        len(_UPPER.findall(text)) / n,
        sum(map(str.isupper, text)) / chars * 10,
        len(_DIGITS.findall(text)) / chars * 10,
        len(_ENDS.findall(text)) / n * 5,
        len(lines) / n * 5,
        len(set(lines)) / max(1, len(lines)),
        sum(x.rstrip()[-1] in ".!?" for x in lines) / max(1, len(lines)),
    ]


class Network:
    """One hidden layer; the output is a logit."""

    def __init__(self, seed: int, n: int):
        rng = np.random.default_rng(seed)
        self.p = [rng.normal(0, (2 / n) ** 0.5, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(x) for x in self.p], [np.zeros_like(x) for x in self.p], 0
        self.mean, self.std = np.zeros(n), np.ones(n)

    def scale(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(self.scale(x) @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]

    def step(self, x: np.ndarray, slope: np.ndarray, decay: float = 1e-4) -> None:
        """One Adam step; slope: the risk's derivative by each row's logit."""
        x = self.scale(x)
        hidden = np.maximum(x @ self.p[0] + self.p[1], 0)
        back = np.outer(slope, self.p[2]) * (hidden > 0)
        self.t += 1
        for k, g in enumerate((x.T @ back, back.sum(0), hidden.T @ slope, np.array([slope.sum()]))):
            g = g + decay * self.p[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.p[k] = self.p[k] - RATE * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risk_slope(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Derivatives of the non-negative risk with the sigmoid loss l(z) = sigmoid(-z), and its negative part.

    R = prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]); where the
    second term is below zero the step goes the other way along it.
    """
    sp, su = _sigmoid(zp), _sigmoid(zu)
    part = su.mean() - prior * sp.mean()
    up, uu = sp * (1 - sp) / len(zp), su * (1 - su) / len(zu)
    if part >= 0:
        return -2 * prior * up, uu, part
    return prior * up, -uu, part


def _fit(pos: np.ndarray, unl: np.ndarray, slope, seed: int, epochs: int = EPOCHS) -> Network:
    net, rng = Network(seed, pos.shape[1]), np.random.default_rng(seed)
    both = np.concatenate([pos, unl])
    net.mean, net.std = both.mean(0), np.maximum(both.std(0), 1e-6)
    steps = max(1, math.ceil(len(unl) / BATCH))
    for _ in range(epochs):
        order = rng.permutation(len(unl))
        for k in range(steps):
            u = unl[order[k::steps]]
            p = pos[rng.integers(0, len(pos), min(len(pos), BATCH))]
            sp, su = slope(net.logits(p), net.logits(u))
            net.step(np.concatenate([p, u]), np.concatenate([sp, su]))
    return net


def ranker(pos: np.ndarray, unl: np.ndarray, seed: int = 1) -> Network:
    """A network that tells positives from unlabelled rows, from every other row."""
    def plain(zp, zu):
        return (_sigmoid(zp) - 1) / len(zp) / 2, _sigmoid(zu) / len(zu) / 2

    return _fit(pos[::2], unl[::2], plain, seed, epochs=60)


def best_bin(zp: np.ndarray, cuts: np.ndarray, above: np.ndarray, rows: int) -> float:
    """The share of positives, from held-back positives and how many of the unlabelled rows score at least each cut."""
    best, found = math.inf, 1.0
    for z, n in zip(cuts, above, strict=True):
        # Share of each above a threshold, with a margin for chance.
        p, u = (zp >= z).mean(), n / rows
        margin = (math.log(40) / 2) ** 0.5 * (rows**-0.5 + len(zp) ** -0.5)
        if p > 4 * margin and (u + margin) / p < best:
            best, found = (u + margin) / p, u / p
    return float(min(max(found, 0.05), 0.98))


def cuts_of(zp: np.ndarray) -> np.ndarray:
    return np.quantile(zp, np.linspace(0.02, 0.98, 97))


class Model:
    """Scores of statistics; ``net`` is None where there is nothing to learn from."""

    def __init__(self, pos: np.ndarray, unl: np.ndarray, prior: float, seed: int = 5):
        self.prior, self.net = prior, None
        if len(pos) > 1 and len(unl) > 1:
            self.net = _fit(pos, unl, lambda zp, zu: risk_slope(zp, zu, self.prior)[:2], seed)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.net.logits(x)) if self.net and len(x) else np.full(len(x), 0.5)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, FEATURES)


def measured(rows: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """The kept columns and x, the statistics of each row's text; written."""
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text_col):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array([features(t) for t in texts], pa.list_(pa.float64()))], [*keep, "x"])

    return shared_table(rows.select(*keep, text_col).mapInArrow(run, ", ".join([*kinds, "x array<double>"])), "quality-measures")


def _sampled(measures: DataFrame, picked: DataFrame) -> np.ndarray:
    """The statistics of the picked ids, one row of each, in an order of their own."""
    rows = measures.join(F.broadcast(picked.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x")).select("x").toPandas()
    x = np.array(rows["x"].tolist()).reshape(len(rows), FEATURES)
    return x[np.random.default_rng(2).permutation(np.lexsort(x.T))] if len(x) else x


def _above(measures: DataFrame, net: Network, cuts: np.ndarray) -> np.ndarray:
    """How many rows score at least each cut: counted in the tasks, a few numbers of each are added up."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(cuts), np.int64)
        for batch in batches:
            z = np.sort(net.logits(_matrix(batch)))
            n += len(z) - np.searchsorted(z, cuts, "left")
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array(n, pa.int64())], ["k", "n"])

    rows = measures.select("x").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(cuts), np.int64)
    for r in rows:
        out[r.k] = r.n
    return out


def fit(measures: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, prior: float | None = None) -> Model:
    """From (doc_id, x), all of them unlabelled web text, and (doc_id, quality), of which only positives count.

    Of rows that repeat an id one is in the sample, so that its bound holds.
    """
    ids = measures.select("doc_id").where("doc_id is not null").distinct()
    good = labels.where("quality = 1").select("doc_id").distinct()
    pos = _sampled(measures, bounded(ids.join(good, "doc_id", "left_semi"), F.lit(1), most_positive, "doc_id"))
    unl = _sampled(measures, bounded(ids, F.lit(1), most_unlabelled, "doc_id", seed=4))
    if prior is None:
        prior = 0.5
        if len(pos) > 3 and len(unl) > 3:
            net = ranker(pos, unl)
            zp = np.sort(net.logits(pos[1::2]))
            cuts = cuts_of(zp)
            prior = best_bin(zp, cuts, _above(measures, net, cuts), measures.count())
    return Model(pos, unl, prior)


def _scored(measures: DataFrame, model: Model, *keep: str) -> DataFrame:
    kinds = [f"`{c}` {measures.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(model.scores(_matrix(batch)), pa.float64())], [*keep, "score"])

    return measures.mapInArrow(run, ", ".join([*kinds, "score double"])).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score_held_out(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted): learns from all but one fold and scores every row."""
    measures = measured(docs.select("doc_id", "text"), "text", "doc_id")
    ours = F.coalesce(crc_mod(F.col("doc_id"), folds) != fold, F.lit(False))
    model = fit(measures.where(ours), labels.where(ours))
    return _scored(measures, model, "doc_id").select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores ``threshold`` or more, with all their columns.

    Learns from all rows of ``labels``.  The rows that go are left out where
    they lie, so whole rows never pass through Python.
    """
    rows = placed(docs)
    measures = measured(rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *PLACE), "text", "doc_id", *PLACE)
    scores = _scored(measures, fit(measures, labels), *PLACE)
    return without(rows, scores.where(F.col("score") < threshold))
