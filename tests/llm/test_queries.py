"""The registered queries that SQL cannot express, over whole tables, against brute force."""

import html.parser
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from waymark.llm import mixing, quality, queries
from waymark.llm.common import shared_table, table
from waymark.llm.words import tokens

SF = "/root/testdata/sf0.001"
MORE = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def shingles(text):
    w = tokens(text)
    n = min(5, len(w))
    return Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else Counter()


def near_classes(rows):
    """(class of each row) by comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    sizes = [sum(s.values()) for s in sets]
    holders = {}
    for k, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(k)
    both = Counter()
    for g, ks in holders.items():
        for i, a in enumerate(ks):
            for b in ks[i + 1 :]:
                both[a, b] += min(sets[a][g], sets[b][g])
    at = list(range(len(rows)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for (a, b), n in both.items():
        if n >= 0.8 * (sizes[a] + sizes[b] - n):
            at[root(a)] = root(b)
    return [root(k) for k in range(len(rows))]


def held_items(docs, items):
    """(doc, item) pairs with four fifths of an item's shingles in the whole text."""
    need = {i: shingles(t) for i, t in items}
    out = set()
    for d, t in docs:
        have = {}
        w = tokens(t)
        for i, want in need.items():
            if not want:
                continue
            n = len(next(iter(want)))
            if n not in have:
                have[n] = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
            if sum((want & have[n]).values()) >= 0.8 * sum(want.values()):
                out.add((d, i))
    return out


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_op3(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, MORE, "documents").collect()]
    by = {}
    for (i, _), c in zip(rows, near_classes(rows)):
        by.setdefault(c, []).append(i)
    want = {i: (min(g), len(g)) for g in by.values() for i in g}
    got = {r.doc_id: (r.class_id, r.class_size) for r in queries.op3_near_dedup(spark, MORE).collect()}
    assert got == want and max(n for _, n in want.values()) > 2


def test_op4(spark):
    """Profiles and out-of-place distances from strings, one at a time."""
    rows = table(spark, SF, "documents").collect()

    def profile(texts):
        out = Counter()
        for t in texts:
            for w in re.findall(r"[^\W\d_]+", t.lower()):
                p = f" {w} "
                for n in (1, 2, 3):
                    out.update(g for k in range(len(p) - n + 1) if (g := p[k : k + n]) != " ")
        # Ties in the order of the operator: by length, then by code points (a shorter one's are above the others' pairs).
        key = lambda g: (len(g) << 60 if len(g) < 3 else 0) | sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
        return {g: k for k, g in enumerate(sorted(out, key=lambda g: (-out[g], key(g)))[:400])}

    learnt = {}
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            learnt.setdefault(r.lang, []).append(r.text or "")
    profiles = {lang: profile(t) for lang, t in sorted(learnt.items())}
    got = {r.doc_id: r for r in queries.op4_language_id(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        own = profile([r.text or ""])
        if not own:
            assert got[r.doc_id].lang_pred == "und"
            continue
        away = {lang: sum(abs(p[g] - k) if g in p else 400 for g, k in own.items()) / (400 * len(own)) for lang, p in profiles.items()}
        best = min(away, key=away.get)
        assert got[r.doc_id].lang_pred == best and got[r.doc_id].score == pytest.approx(1 - away[best])


class Words(html.parser.HTMLParser):
    """The words that a page shows, in order, by another parser and without layout."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        void = tag in "area base br col embed hr img input link meta param source track wbr".split()
        if not void and (self.hidden or tag in ("script", "style", "title", "noscript", "template", "head") or "hidden" in a or "display:none" in (a.get("style") or "").replace(" ", "")):
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.hidden:
            self.out += re.findall(r"\w+", data)


def test_op6(spark):
    pages = {r.page_id: r.html for r in table(spark, MORE, "pages").collect()}
    got = {r.page_id: r.text for r in queries.op6_html_text(spark, MORE).collect()}
    assert set(got) == set(pages)
    for i, page in pages.items():
        words = Words()
        words.feed(page or "")
        words.close()
        # Numbers of list items are layout; cells of several lines change the order of words, not the words.
        shown = Counter(re.findall(r"\w+", re.sub(r"(?m)^( *)\d+\. ", r"\1", got[i])))
        assert shown == Counter(words.out), i


def test_op7(spark):
    rows = {r.doc_id: (len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.source) for r in table(spark, MORE, "documents").collect()}
    whole = Counter()
    for n, s in rows.values():
        whole[s] += n
    order = sorted(s for s in whole if s is not None) + [s for s in whole if s is None]
    goals = dict(zip(order, mixing.fill([whole[s] for s in order], [(5.0, 2.0, 1.0)[k % 3] for k in range(len(order))], sum(whole.values()))))
    got = queries.op7_mix_sources(spark, MORE).collect()
    taken = Counter()
    for r in got:
        n, s = rows[r.doc_id]
        taken[s] += r.taken
        assert r.size == n and r.source_size == whole[s] and r.target == pytest.approx(goals[s]) and 0 <= r.taken <= 3 * n and (n == 0 or r.taken % n == 0)
    assert len(got) == len(rows) and all(abs(taken[s] - goals[s]) <= 3 for s in order)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, queries.op7_mix_sources(spark, MORE).collect()), key=repr)


def test_op8_scores_are_those_of_a_plain_run(spark):
    """Statistics, networks and prior in one place, without Spark."""
    docs = table(spark, MORE, "documents").collect()
    labels = {r.doc_id for r in table(spark, MORE, "labels").where("quality = 1").collect()}
    got = {r.doc_id: r for r in queries.op8_quality(spark, MORE).collect()}
    ours = [r for r in docs if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    x = {r.doc_id: np.array(quality.features(r.text)) for r in docs}
    put = lambda rows: np.array(rows)[np.random.default_rng(2).permutation(np.lexsort(np.array(rows).T))]
    pos, unl = put([x[r.doc_id] for r in ours if r.doc_id in labels]), put([x[r.doc_id] for r in ours])
    net = quality.ranker(pos, unl)
    zp = np.sort(net.logits(pos[1::2]))
    cuts = quality.cuts_of(zp)
    prior = quality.best_bin(zp, cuts, np.array([(net.logits(unl) >= z).sum() for z in cuts]), len(unl))
    want = quality.Model(pos, unl, prior).scores(np.array([x[r.doc_id] for r in docs]))
    assert [got[r.doc_id].score for r in docs] == pytest.approx(want.tolist(), abs=1e-6)


def test_op10(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, MORE, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, MORE, "benchmark").collect()]
    got = queries.op10_decontaminate(spark, MORE).collect()
    want = held_items(docs, items)
    whole = {(r.doc_id, r.item_id) for r in got if r.item_overlap >= 0.8}
    assert whole == want and len(want) > 10
    assert {(r.doc_id, r.item_id) for r in got} - whole == {(r.doc_id, r.item_id) for r in got if min(r.question_overlap, r.answer_overlap) >= 0.8 > r.item_overlap}


def test_pipeline_against_brute_force(spark):
    """Each stage on all that its predecessor kept; then ``run``, whose rows are the last stage's."""
    docs = table(spark, MORE, "documents")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    left = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = shared_table(stage(spark, docs, MORE), f"test-{k}")
        rows = docs.collect()
        after = {r.doc_id: r for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before), name
        assert all(tuple(after[i][c] for c in columns) == tuple(before[i][c] for c in columns) for i in after), name
        if k < 4:
            assert docs.columns == columns
        left.append((before, after))
        before = after
    good = {r.doc_id: r.quality for r in table(spark, MORE, "labels").collect()}
    all_, kept = left[0]
    assert np.mean([i in kept for i in all_ if good.get(i) == 1]) >= 0.99 and np.mean([i in kept for i in all_ if good.get(i) == 0]) <= 0.2
    all_, kept = left[1]
    first = {}
    for i, r in all_.items():
        rank = (-len(r.text or ""), i)
        first[normal(r.text)] = min(first.get(normal(r.text), rank), rank)
    assert set(kept) == {i for _, i in first.values()}
    all_, kept = left[2]
    rows = [(i, r.text) for i, r in all_.items()]
    least = {}
    for (i, t), c in zip(rows, near_classes(rows)):
        least.setdefault(c, []).append(i)
    assert set(kept) == {min(g) for g in least.values()}
    all_, kept = left[3]
    hit = {d for d, _ in held_items([(i, r.text) for i, r in all_.items()], [(r.item_id, r.text) for r in table(spark, MORE, "benchmark").collect()])}
    assert hit <= set(all_) - set(kept) and len(set(all_) - set(kept) - hit) <= 2 and hit
    all_, kept = left[4]
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in all_.items()}
    whole, taken = Counter(), Counter()
    for i, r in all_.items():
        whole[r.source] += size[i]
    for i, r in kept.items():
        taken[r.source] += r.taken
        assert r["size"] == size[i] and r.taken == r.copies * size[i] and 1 <= r.copies <= 3
    order = sorted(whole)
    goals = dict(zip(order, mixing.fill([whole[s] for s in order], [(5.0, 2.0, 1.0)[k % 3] for k in range(len(order))], sum(whole.values()))))
    assert all(abs(taken[s] - goals[s]) <= 3 for s in order)
    run = corpus_pipeline.run(spark, MORE)
    assert run.columns == docs.columns and sorted(map(tuple, run.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)


def test_pipeline_stages_on_odd_rows(spark):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 80_000, None, None, 5)], docs.schema)
    for rows in (docs.limit(0), odd):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, rows, SF)
            assert out.columns[: len(docs.columns)] == docs.columns and out.count() <= rows.count(), name
