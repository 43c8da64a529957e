"""Language identification by rank-order profiles (Cavnar and Trenkle 1994).

A profile lists the most frequent n-grams (one to three code points, words
padded by blanks) of a language or a text in the order of frequency.  A text's
distance to a language is the sum, over the text's profile, of how far each
n-gram is out of place; one that the language lacks counts the greatest
distance.  The language of the least distance is predicted.

Profiles are learnt from a bounded sample: ``MOST_DOCS`` documents of each
language.  All texts are scored whole.

Defined cases: a null text or one without letters is ``und`` with score 0;
where distances are equal the language first in code point order wins; without
any labelled document every text is ``und``; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import held_out
from waymark.llm.sampling import bounded
from waymark.llm.words import slices

ORDERS = (1, 2, 3)
PROFILE = 400
MOST_DOCS = 1500
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """For each code point its lower-case form if it is a letter, else a blank."""
    if not hasattr(_letters, "table"):
        table = np.full(0x110000, 32, np.int64)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters.table = table
    return _letters.table


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text, 21 bits for each code point, and their counts."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.concatenate([[32], codes, [32]])
    codes = codes[1:][(codes[1:] != 32) | (codes[:-1] != 32)]  # one blank between words
    codes = np.concatenate([[32], codes])
    found, gram = [], codes
    for n in ORDERS:
        if n > 1:
            gram = (gram[:-1] << 21) | codes[n - 1 :]
            inner = gram if n == 2 else gram[(gram >> 21 & 0x1FFFFF) != 32]  # no n-gram spans two words
        else:
            inner = gram[gram != 32]
        found.append(inner | (n << 60 if n < 3 else 0))
    grams = np.concatenate(found)
    grams.sort()
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    return grams[first], np.diff(np.append(first, len(grams)))


def top(grams: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The n-grams most frequent first; equally frequent ones in their own order."""
    if len(counts) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        near = counts >= least
        grams, counts = grams[near], counts[near]
    return grams[np.lexsort((grams, -counts))][:size]


def train(rows: Iterable[tuple[str, str]]) -> list[tuple[str, np.ndarray]]:
    """(language, profile) in code point order, from (language, text)."""
    sums: dict[str, dict[int, int]] = {}
    for lang, text in rows:
        own = sums.setdefault(lang, {})
        for g, c in zip(*(x.tolist() for x in ngrams(text or "")), strict=True):
            own[g] = own.get(g, 0) + c
    return [(lang, top(np.array(list(s), np.int64), np.array(list(s.values()), np.int64))) for lang, s in sorted(sums.items()) if s]


class Profiles:
    """All languages' ranks by n-gram, for one lookup of a text's profile."""

    def __init__(self, profiles: list[tuple[str, np.ndarray]]):
        self.names = [name for name, _ in profiles]
        self.grams = np.unique(np.concatenate([p for _, p in profiles])) if profiles else np.zeros(0, np.int64)
        self.ranks = np.full((len(profiles), len(self.grams) + 1), -1, np.int64)
        for k, (_, p) in enumerate(profiles):
            self.ranks[k, np.searchsorted(self.grams, p)] = np.arange(len(p))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names:
            return UNKNOWN, 0.0
        own = top(*ngrams(text))
        if not len(own):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        at = np.where(self.grams[at] == own, at, len(self.grams))
        ranks = self.ranks[:, at]
        away = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(own)))).sum(axis=1) / (PROFILE * len(own))
        best = int(away.argmin())
        return self.names[best], float(1 - away[best])


def _partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of the sample, a row for each language and n-gram of a partition."""
    sums: dict[tuple[str, int], int] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for g, c in zip(*(x.tolist() for x in ngrams(text or "")), strict=True):
                sums[lang, g] = sums.get((lang, g), 0) + c
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int64()), pa.array(list(sums.values()), pa.int64())], ["lang", "gram", "n"])


def fit(docs: DataFrame, most_docs: int = MOST_DOCS) -> Profiles:
    """Profiles from (doc_id, text, lang): of each language ``PROFILE`` n-grams come to the driver."""
    from pyspark.sql import Window

    ids = bounded(docs.where("lang is not null").select("doc_id", "lang"), F.col("lang"), most_docs, "doc_id")
    ids = ids.select("doc_id").distinct()
    sample = docs.where("lang is not null").join(F.broadcast(ids), "doc_id", "left_semi").select("lang", "text")
    counts = sample.mapInArrow(_partial, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = counts.withColumn("k", rank).where(F.col("k") <= PROFILE).collect()
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.k)):
        by.setdefault(r.lang, []).append(r.gram)
    return Profiles([(lang, np.array(g, np.int64)) for lang, g in sorted(by.items())])


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score), a row for each row of ``docs``."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                found = [profiles.predict(t) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def identify_held_out(docs: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """Learns from all but one fold of the labelled rows and scores every row."""
    profiles = fit(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"), folds, fold)))
    return identify(docs, profiles).select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "lang_pred", "score")
