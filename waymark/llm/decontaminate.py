"""Benchmark decontamination by a BM25 index with block-max WAND.

Test items are indexed by their words.  A posting's impact is its BM25 weight
as a share of what the item needs: the least weight that a passage can hold
and still pass verification, given how many words its missing shingles can
hide.  So an item is retrieved at a score of 1, whatever its length, and no
passage that verification would accept is missed.  Passages are overlapping
windows of three stretches, each as long as the longest item of an index, so
a copy of an item lies whole in one of them even with as many words put into
it as the longest item has.  A window whose words' greatest
impacts sum to less than that in every range of items cannot hold an item and
is left at once; the others run block-max WAND, which retrieves every item at
or above it.  A retrieved item is then verified by five-word shingles: the
share of the question's and of the answer's shingles that the window holds.

Items are grouped by length (64, 256, 1024, ... words), each group with its
own index and window.  The index is sent to the executors in blocks of at most
``BLOCK_WORDS`` words; a larger benchmark takes more blocks, each a pass.

Defined cases: a null or empty text holds no item; an item without words is
never found; items of equal text are each found; repeated rows are each
reported; empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import PLACE, placed, shared_table, without
from waymark.llm.words import WORD, slices, tokens

K1, B = 1.2, 0.75
RETRIEVE = 1.0
SIMILAR = 0.8
SHINGLE = 5
POSTINGS = 16
BLOCK_WORDS = 2_000_000
RANGES = 64
_END = 1 << 60


def parts(text: str | None) -> tuple[list[str], list[str]]:
    """Question and answer words of an item: the answer is its last line, or else its last sentence."""
    text = (text or "").strip()
    cut = text.rfind("\n")
    if cut < 0:
        ends = [k for k in (text.rfind(x, 0, -1) for x in (". ", "? ", "! ")) if k >= 0]
        cut = max(ends) + 1 if ends else len(text)
    return tokens(text[:cut]), tokens(text[cut:])


def grams(words: list[str]) -> Counter:
    n = min(SHINGLE, len(words))
    return Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if words else Counter()


def overlap(part: list[str], window: list[str]) -> float:
    """The share of a part's shingles that the window holds; 1 for an empty part."""
    want = grams(part)
    if not want:
        return 1.0
    n = min(SHINGLE, len(part))
    have = Counter(tuple(window[k : k + n]) for k in range(len(window) - n + 1))
    return sum((want & have).values()) / sum(want.values())


def hidden(words: list[str]) -> int:
    """How many words of a part a window may lack at most while it holds ``SIMILAR`` of the shingles: each that is missing breaks a shingle of its own."""
    shingles = max(1, len(words) - SHINGLE + 1)
    return int((1 - SIMILAR) * shingles + 1e-9)


def least_share(score: dict[str, float], counts: Counter, missing: int) -> float:
    """The least share of the weight that is left when ``missing`` words, all occurrences of each, are taken away (a bound: the last in part)."""
    lost, left = 0.0, missing
    for w in sorted(score, key=lambda w: score[w] / counts[w], reverse=True):
        if left <= 0:
            break
        lost += score[w] * min(1.0, left / counts[w])
        left -= counts[w]
    return 1 - lost / sum(score.values())


class Postings:
    """One term: items in order, impacts, the greatest impact of each block and of all."""

    __slots__ = ("items", "impacts", "ends", "tops", "top")

    def __init__(self, items: list[int], impacts: list[float]):
        self.items, self.impacts = items, impacts
        self.ends = [items[min(k + POSTINGS, len(items)) - 1] for k in range(0, len(items), POSTINGS)]
        self.tops = [max(impacts[k : k + POSTINGS]) for k in range(0, len(items), POSTINGS)]
        self.top = max(impacts)


class Index:
    def __init__(self, items: list[tuple[object, str]]):
        """Items of one length group; (id, text)."""
        self.items = []
        for i, text in items:
            q, a = parts(text)
            if q or a:
                self.items.append((i, q, a))
        counts = [Counter(q + a) for _, q, a in self.items]
        lengths = [sum(c.values()) for c in counts]
        self.longest = max(lengths, default=0)
        df = Counter(w for c in counts for w in c)
        mean, n = sum(lengths) / max(1, len(lengths)), len(counts)
        idf = {w: np.log(1 + (n - k + 0.5) / (k + 0.5)) for w, k in df.items()}
        lists: dict[str, tuple[list, list]] = {}
        self.needs = []
        for k, (c, size) in enumerate(zip(counts, lengths, strict=True)):
            _, q, a = self.items[k]
            score = {w: idf[w] * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean)) for w, f in c.items()}
            self.needs.append(least_share(score, c, max(hidden(q + a), hidden(q) + hidden(a) if q and a else 0)))
            whole = sum(score.values()) * self.needs[k]
            for w, s in score.items():
                at = lists.setdefault(w, ([], []))
                at[0].append(k)
                at[1].append(float(s / whole))
        self.terms = {w: k + 1 for k, w in enumerate(lists)}
        self.lists = [None, *(Postings(*x) for x in lists.values())]
        # The greatest impact of each term in each of up to ``RANGES`` ranges of items.
        width = -(-n // RANGES) if n else 1
        self.ranges = np.zeros((len(self.lists), -(-n // width) if n else 1), np.float32)
        for t, p in enumerate(self.lists[1:], 1):
            np.maximum.at(self.ranges[t], np.array(p.items) // width, p.impacts)

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (item, score) with a score of at least ``threshold`` for the distinct terms, by block-max WAND."""
        slack = threshold - 1e-6
        cursors = [[self.lists[t].items[0], 0, self.lists[t]] for t in terms]
        found = []
        while True:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                if c[0] == _END:
                    break
                bound += c[2].top
                if bound >= slack:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            blocked, jump = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else _END
            for c in cursors[: pivot + 1]:
                p, b = c[2], c[1] // POSTINGS
                while b < len(p.ends) and p.ends[b] < item:
                    b += 1
                if b < len(p.ends):
                    blocked += p.tops[b]
                    jump = min(jump, p.ends[b] + 1)
            if blocked >= slack:
                if cursors[0][0] == item:
                    score = sum(c[2].impacts[c[1]] for c in cursors[: pivot + 1])
                    if score >= slack:
                        found.append((item, score))
                    goal = item + 1
                else:
                    goal = item
            else:
                goal = max(jump, item + 1)
            for c in cursors[: pivot + 1]:
                p, k = c[2], c[1]
                while k < len(p.items) and p.items[k] < goal:
                    k += POSTINGS - k % POSTINGS if p.ends[k // POSTINGS] < goal else 1
                c[1] = k
                c[0] = p.items[k] if k < len(p.items) else _END

    def search(self, texts: list) -> list[dict]:
        """For each text the verified items: item position -> (score, question, answer, whole overlap)."""
        out: list[dict] = [{} for _ in texts]
        if not self.items:
            return out
        get, half = self.terms.get, self.longest
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        sizes = np.array([len(w) for w in words])
        ids = np.fromiter(map(get, chain.from_iterable(words), repeat(0)), np.int64, int(sizes.sum()))
        # Each text is cut into stretches of ``half`` words; three neighbours are a window, or all of a shorter text.
        cuts = -(-sizes // half)
        text = np.repeat(np.arange(len(texts)), cuts)
        first = np.repeat(np.cumsum(cuts) - cuts, cuts)
        start = np.repeat(np.cumsum(sizes) - sizes, cuts) + (np.arange(len(text)) - first) * half
        if not len(start):
            return out
        ends = np.append(start, len(ids))
        known = np.flatnonzero(ids)
        if not len(known):
            return out
        # The distinct terms of each half, and what they can give the items of each range at most.
        stretch = np.searchsorted(start, known, "right") - 1
        keys = stretch * len(self.lists) + ids[known]
        keys.sort()
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        stretch, term = np.divmod(keys, len(self.lists))
        sums = np.zeros((len(start) + 1, self.ranges.shape[1]), np.float32)
        at = np.flatnonzero(np.concatenate([[True], stretch[1:] != stretch[:-1]]))
        for a in range(0, len(at), 4096):
            z = at[a + 4096] if a + 4096 < len(at) else len(term)
            sums[stretch[at[a : a + 4096]]] = np.add.reduceat(self.ranges[term[at[a] : z]], at[a : a + 4096] - at[a])
        # Windows start at every stretch that two more follow, or at a text's first.
        last = first + np.repeat(cuts, cuts) - 1
        stop = np.minimum(np.arange(len(text)) + 2, last)
        opens = (np.arange(len(text)) + 2 <= last) | (np.arange(len(text)) == first)
        bound = sums[:-1].copy()
        for ahead in (1, 2):
            some = np.flatnonzero(np.arange(len(text)) + ahead <= last)
            bound[some] += sums[some + ahead]
        at = np.append(at, len(term))
        spans = dict(zip(stretch[at[:-1]].tolist(), zip(at[:-1].tolist(), at[1:].tolist(), strict=True), strict=True))
        for k in np.flatnonzero(opens & (bound >= RETRIEVE - 1e-3).any(axis=1)).tolist():
            window = slice(ends[k], ends[stop[k] + 1])
            terms = np.unique(np.concatenate([term[slice(*spans.get(j, (0, 0)))] for j in range(k, int(stop[k]) + 1)]))
            if (self.ranges[terms].sum(axis=0) < RETRIEVE - 1e-3).all():
                continue
            hits = self.wand(terms.tolist(), RETRIEVE)
            if hits:
                base = int(start[k] - (k - first[k]) * half)
                own = words[text[k]][window.start - base : window.stop - base]
                for item, score in hits:
                    _, q, a = self.items[item]
                    row = (score * self.needs[item], overlap(q, own), overlap(a, own), overlap(q + a, own))
                    if row[3] >= SIMILAR or (q and a and min(row[1:3]) >= SIMILAR):
                        out[text[k]][item] = max(row, out[text[k]].get(item, row), key=lambda r: r[3])
        return out


def indexes(items: list[tuple[object, str]]) -> list[Index]:
    groups: dict[int, list] = {}
    for i, t in items:
        size, top = len(tokens(t)), 64
        while size > top:
            top *= 4
        groups.setdefault(top, []).append((i, t))
    return [Index(g) for _, g in sorted(groups.items())]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, most_words: int) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of a bounded number of words; one block is on the driver at a time."""
    block, n = [], 0
    for r in benchmark.select(id_col, text_col).orderBy(id_col, text_col).toLocalIterator():
        block.append((r[0], r[1] or ""))
        n += len(block[-1][1]) // 2 + 1
        if n >= most_words:
            yield block
            block, n = [], 0
    if block:
        yield block


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, item_overlap): the items that a document holds."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = [x.dataType.simpleString() for x in (rows.schema["doc_id"], benchmark.schema[item_col])]
    schema = f"doc_id {kind[0]}, item_id {kind[1]}, score double, question_overlap double, answer_overlap double, item_overlap double"

    def searcher(found: list[Index]):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in slices(batch):
                    rows = [(k, ix.items[i][0], *v) for ix in found for k, x in enumerate(ix.search(texts)) for i, v in x.items()]
                    cols = list(zip(*rows, strict=True)) if rows else [()] * 6
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], item_type), *(pa.array(c, pa.float64()) for c in cols[2:])], names)

        names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "item_overlap"]
        return run

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    # Each block's hits are written before the next block is read, so one index is with the driver at a time.
    result = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark, item_col, item_text, most_words):
        result = result.unionByName(shared_table(rows.mapInArrow(searcher(indexes(block)), schema), "leaks"))
    return result


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; those that do are left out where they lie."""
    rows = placed(docs)
    texts = rows.select(F.col(text_col).alias("text"), F.struct(*PLACE).alias("at"))
    found = hits(texts, benchmark, "at", "text", item_col, item_text, most_words)
    return without(rows, found.select("doc_id.*").distinct())
