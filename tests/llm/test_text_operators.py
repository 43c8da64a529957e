import hashlib
import itertools
import re
import textwrap
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from waymark.llm import common, decontaminate, exact_dedup, html_text, language, licenses, mixing, near_dedup, secrets
from waymark.llm.words import slices, tokens

DOCS = "doc_id long, text string, lang string, source string, size string, rid string, `__row` string, `key` string"


def docs(spark, rows):
    """Rows of (doc_id, text, source), with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", s, "x", None, "y", "z") for i, t, s in rows], DOCS)


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), 4)) for _ in range(n))


MIXED = [(1, "a b", "s"), (2, "ab", "s"), (3, None, None), (4, "", "t"), (None, "ab\n", "t"), (5, "a b", "s"), (5, "a b", "s"), (6, "x" * 50_000, "s")]


def test_exact_groups(spark):
    got = exact_dedup.groups(docs(spark, MIXED)).collect()
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _ in MIXED]
    want = []
    for (i, t, _), n in zip(MIXED, norm):
        group = [(-len(t2 or ""), i2 is None, i2 or 0) for (i2, t2, _), n2 in zip(MIXED, norm) if n2 == n]
        best = min(group)
        want.append((i, None if best[1] else best[2], len(group), hashlib.sha256(n.encode()).hexdigest()))
    key = lambda r: repr(r)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == len(set(norm))
    assert exact_dedup.groups(docs(spark, [])).count() == 0


def test_exact_keep_first(spark):
    df = docs(spark, MIXED)
    got = exact_dedup.keep_first(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted([1, 3, 5, 6], key=str)
    assert exact_dedup.keep_first(df.limit(0)).count() == 0


def test_exact_with_a_full_filter(spark, monkeypatch):
    """A filter far too small only lets more rows be looked at."""
    monkeypatch.setattr(exact_dedup, "MOST_BITS", 0)
    rows = [(k, f"text {k % 700}", "s") for k in range(1000)] + MIXED
    df = docs(spark, rows)
    assert {r.group_size for r in exact_dedup.groups(df).where("doc_id = 8").collect()} == {2}
    assert exact_dedup.keep_first(df).count() == 700 + 4


@pytest.mark.parametrize("blocks", [8192, 1])
def test_no_text_is_shuffled(spark, tmp_path, monkeypatch, blocks):
    """The rows that stay pass straight from the scan, over several files and passes."""
    monkeypatch.setattr(common, "PASS_BLOCKS", blocks)
    rows = near_fixture() + [(None, None, None), (7, "x y z", "s"), (7, "x y z", "s")]
    docs(spark, rows).repartition(5).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    for keep in (exact_dedup.keep_first, near_dedup.keep_one, lambda d: decontaminate.keep_clean(d, spark.createDataFrame([(1, rows[0][1])], "item_id int, text string")), lambda d: mixing.mixed_rows(d)):
        out = keep(df)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange (hash|range|single|round)", plan) and "BroadcastExchange" in plan
        assert out.columns[: len(df.columns)] == df.columns and 0 < out.count() < len(rows)
    assert sorted(map(repr, exact_dedup.keep_first(df).collect())) == sorted(map(repr, exact_dedup.keep_first(docs(spark, rows)).collect()))


def test_marks_reach_their_rows(spark, tmp_path, monkeypatch):
    spark.range(200_000).selectExpr("id", "id % 4 as want").repartition(3).write.parquet(str(tmp_path / "t"))
    rows = common.placed(spark.read.parquet(str(tmp_path / "t")).where("id % 3 > 0"))
    for blocks in (8192, 2):
        monkeypatch.setattr(common, "PASS_BLOCKS", blocks)
        got = common.marked(rows, rows.select(*common.PLACE, "want").withColumnRenamed("want", "v"), "v", bits=2)
        assert got.where("v <> want").count() == 0 and got.count() == rows.count()


BSD = """Copyright (c) 2020, A. Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""


MIT = next(t for n, t in licenses.KNOWN if n == "MIT" and t.startswith("Permission"))


def rewrapped(text, width, indent=""):
    paragraphs = re.split(r"\n[ \t]*\n", text)
    return "\n\n".join("\n".join(indent + x for x in textwrap.wrap(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False)) for p in paragraphs)


def test_licenses(spark):
    rows = [
        (1, "Copyright (c) 2020 A. Person\n\n" + MIT.replace("sublicense", "sub-license").upper(), "s"),
        (2, "Some text.\nLICENCED under CC BY-NC 4.0\nreleased under the MIT licence!\nmore", "s"),
        (3, "a license to fish", "s"), (4, None, "s"), (5, "", "s"), (5, "", "s"),
    ]
    got = sorted(((r.doc_id, r.licenses, r.whole_license, r.n_notices) for r in licenses.scan(docs(spark, rows)).collect()), key=repr)
    assert got[0][:3] == (1, "MIT", "MIT") and got[1] == (2, "CC-BY-NC-4.0,MIT", None, 2)
    assert [g[1:] for g in got[2:]] == [("", None, 0)] * 4
    assert licenses.scan(docs(spark, [])).count() == 0


def test_licenses_at_any_width():
    """Every known text, wrapped anew at 40 to 120 columns, plain and indented, has its digest still."""
    for name, text in licenses.KNOWN:
        want = licenses._digest(text)
        for width in (*range(40, 121, 9), 61, 62, 80, 118):
            assert licenses._digest(rewrapped(text, width)) == want, (name, width)
        assert licenses._digest(rewrapped(text, 71, "    ")) == want, name


def test_licenses_in_their_usual_dress(spark):
    heads = ["The MIT License (MIT)\n\nCopyright (c) 2020 A. Person\n\n", "MIT License\n\nCopyright © 2020 A. Person. All rights reserved.\n\n", "Copyright 2019-2021, A. Person\nCopyright (C) B. Person\nAll rights reserved.\n\n", "MIT License\n=====\n"]
    rows = [(10 * k + j, head + rewrapped(MIT, w), "s") for k, head in enumerate(heads) for j, w in enumerate((50, 62, 80, 118))]
    rows += [(100, "README\n\nA tool.\n\n## Licence\n\n" + rewrapped(MIT, 72, "> ") + "\n\nSee also the wiki.", "s"), (101, "\n\n".join(MIT.split("\n\n")[1:]), "s"), (102, (MIT + "\n\n") * 300 + "word " * 100_000, "s")]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert [i for i in range(40) if i in got and (got[i].licenses, got[i].whole_license) != ("MIT", "MIT")] == []
    assert (got[100].licenses, got[100].whole_license) == ("MIT", None) and got[101].licenses == "" and got[102].licenses == "MIT"


def test_licenses_common_texts_and_headers(spark):
    texts = Path(licenses.__file__).with_name("license_texts")
    whole = {name: (texts / f"{name}.txt").read_text() for name in licenses.TEXTS}
    whole["BSD-2-Clause"] = BSD
    whole["BSD-3-Clause"] = "BSD 3-Clause License\n\n" + BSD.replace("\nTHIS SOFTWARE", "\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n\nTHIS SOFTWARE")
    head = {
        "Apache-2.0": '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n# Unless required by applicable law or agreed to in writing, software\n# distributed under the License is distributed on an "AS IS" BASIS,\n# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n# See the License for the specific language governing permissions and\n# limitations under the License.',
        "GPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
        "AGPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
        "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    }
    rows = [(f"w {n}", t, "s") for n, t in whole.items()] + [(f"h {n}", f"import os\n\n{t}\n\ncode", "s") for n, t in head.items()]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for n in whole:
        assert got[f"w {n}"].whole_license == n and n in got[f"w {n}"].licenses.split(",")
    for n in head:
        assert (got[f"h {n}"].licenses, got[f"h {n}"].whole_license, got[f"h {n}"].n_notices) == (n, None, 1)
    assert all(re.search(licenses.ANCHOR, t) for _, t in licenses.KNOWN)
    assert len({d for _, d in licenses.known_digests()}) == len(licenses.known_digests())


def brute_spans(text):
    out = []
    word = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    for m in re.finditer(word + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark):
    texts = [
        "x password=hunter22 and Token: 'abc'; token = \"" + "0a" * 20 + "\" AKIA" + "Z" * 16, "é😀 api_key=é api-key=zzzzzzz APIKEY = zzzzzzz", "secret: token: abcdefgh", "AKIAAKIA" + "B" * 8 + " " + "f" * 24,
        None, "", "password=shared1", "passwd==shared1", "tokenpassword=aaaaaa" * 300,
    ]
    rows = [(k, t, f"s{k % 4}") for k, t in enumerate(texts)] + [(100 + k, "password=shared1", f"s{k}") for k in range(4)]
    got = {r.doc_id: r for r in secrets.scan(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        spans = brute_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest(), t
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
    assert got[100].n_example == 1 and got[100].n_live == 0 and got[0].n_live == 4 and got[0].live_spans and (got[100].most_owners, got[100].most_repos) == (4, 5)
    assert secrets.scan(docs(spark, [])).count() == 0


def test_secrets_widely_copied_by_few_owners(spark):
    """Very many repositories of one owner, too, mean a copied example; repeated rows are one repository."""
    rows = [(k, "password=copied99", "one") for k in range(25)] + [(100 + k, "password=mine1234", "one") for k in range(5)] + [(200, "password=again123", "one")] * 40
    got = {r.doc_id: r for r in secrets.scan(docs(spark, rows)).collect()}
    assert secrets.scan(docs(spark, rows)).count() == len(rows)
    assert (got[0].n_live, got[0].n_example, got[0].most_repos) == (0, 1, 25)
    assert (got[100].n_live, got[100].most_repos) == (1, 5) and (got[200].n_live, got[200].most_repos) == (1, 1)


def test_secrets_many_spans(spark):
    text = " ".join(f"{k:032x} " for k in range(30_000))
    row = secrets.scan(docs(spark, [(1, text, "s")])).first()
    spans = brute_spans(text)
    assert row.n_hex == len(spans) == 30_000 and row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()


def shingles(text):
    w = tokens(text)
    n = min(5, len(w))
    return Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else Counter()


def near_fixture():
    base = [prose(k, 200).split() for k in range(6)]
    rows, i = [], 1
    for b in base:
        rows.append((i, " ".join(b), "s"))
        i += 1
        for e in (1, 3, 5, 9, 20):
            v = list(b)
            for k in range(e):
                v[(37 * k + 11 * e) % len(v)] = f"edit{e}x{k}"
            rows.append((i, " ".join(v), "s"))
            i += 1
    rows += [(i, None, "s"), (i + 1, "", "s"), (i + 2, "!!!", "s"), (i + 3, "one two", "s"), (i + 4, "One, two!", "s"), (1, rows[0][1], "s"), (None, rows[0][1], "s")]
    return rows


def brute_classes(rows):
    at = list(range(len(rows)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    sets = [shingles(t) for _, t, _ in rows]
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and sum((sets[a] & sets[b]).values()) >= 0.8 * sum((sets[a] | sets[b]).values()):
            at[root(a)] = root(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(k)
    return groups


@pytest.mark.parametrize("block", [1000, 2])
def test_near_classes(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", block)
    rows = near_fixture()
    got = sorted(((r.doc_id, r.class_id, r.class_size) for r in near_dedup.classes(docs(spark, rows)).collect()), key=repr)
    want = []
    for g in brute_classes(rows).values():
        ids = [rows[k][0] for k in g]
        want += [(i, min(x for x in ids if x is not None), len(g)) for i in ids]
    assert got == sorted(want, key=repr)


def test_near_large_bucket(spark, monkeypatch):
    """Many near copies of one text, others that share half of it, and texts that chain two groups, in buckets of many blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", 7)
    rng = np.random.default_rng(11)
    base = prose(1, 120).split()
    rows = []
    for k in range(60):
        v = list(base)
        for j in rng.choice(120, int(rng.integers(0, 7)), replace=False):
            v[j] = f"n{k}x{j}"
        rows.append((k, " ".join(v), "s"))
    rows += [(100 + k, " ".join(base[:60] + prose(50 + k, 60).split()), "s") for k in range(25)]
    rows += [(200 + k, " ".join(base[: 120 - 4 * k] + prose(99, 4 * k).split()), "s") for k in range(20)]
    got = sorted((r.doc_id, r.class_id, r.class_size) for r in near_dedup.classes(docs(spark, rows)).collect())
    want = [(rows[k][0], min(rows[j][0] for j in g), len(g)) for g in brute_classes(rows).values() for k in g]
    assert got == sorted(want)


def test_near_keep_one(spark):
    rows = near_fixture()
    df = docs(spark, rows)
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(brute_classes(rows))
    assert near_dedup.keep_one(df.limit(0)).count() == 0 and near_dedup.classes(df.limit(0)).count() == 0


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**63, 400, dtype=np.uint64), rng.integers(0, 2**63, 100, dtype=np.uint64)
    x, y = np.concatenate([a, b]), a
    sig = near_dedup.signatures([x, y], 1024)
    assert (sig[0] == sig[1]).mean() == pytest.approx(0.8, abs=0.05)
    assert (near_dedup.signatures([x], 64)[0] == near_dedup.signatures([b, x], 64)[1]).all()


def test_language(spark):
    text = {"en": "the quick brown fox and the lazy dog that was there with them ", "fr": "le renard brun et la fille qui était dans une maison avec des amis "}
    rows = [(k, text["en" if k % 2 else "fr"] * (1 + k % 3), "en" if k % 2 else "fr") for k in range(60)] + [(60, None, None), (61, "123 !?", "en"), (62, "", "fr"), (None, text["en"], "en"), (63, text["fr"] * 3000, None), (1, text["en"], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify_held_out(df).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == ("en" if k % 2 else "fr") for k in range(60)) and by[63].lang_pred == "fr" and by[None].lang_pred == "en"
    assert {by[k].lang_pred for k in (60, 61, 62)} == {"und"}
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    learnt = [(lang, t) for i, t, lang in rows if lang and (i is None or zlib.crc32(str(i).encode()) % 5)]
    profiles = language.Profiles(language.train(learnt))
    assert all(profiles.predict(t)[0] == by[i].lang_pred for i, t, _ in rows if i not in (1, None))
    assert language.identify_held_out(df.limit(0)).count() == 0


def test_language_ties_and_clashing_names(spark):
    """Equal distances go to the first language; columns named like results are no input."""
    rows = [(k, "abc abc", "zz" if k % 2 else "aa", "q", 0.5, True) for k in range(40)] + [(100, "abc", None, "q", 0.5, True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double, held_out boolean")
    got = language.identify_held_out(df).collect()
    assert len(got) == 41 and {r.lang_pred for r in got} == {"aa"} and got[0].score > 0.9


def brute_ngrams(text):
    out = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        p = f" {w} "
        for n in (1, 2, 3):
            out.update(g for k in range(len(p) - n + 1) if (g := p[k : k + n]) != " ")
    return out


def test_ngrams_brute_force():
    for t in ("", "Hello, wörld! hello", "a", "...", "ab1cd", "x" * 5):
        grams, counts = language.ngrams(t)
        assert sorted(counts.tolist()) == sorted(brute_ngrams(t).values()), t


def test_html():
    page = html_text.page_text
    assert page("<ul><li>x<li>y<ol start=3><li>1<li>2</ol></ul><p>p1<p>p2") == "- x\n- y\n  3. 1\n  4. 2\n\np1\n\np2"
    assert page("<table><tr><th>a<th>bbb<tr><td>cccc<td>d</table>") == "a     bbb\ncccc  d"
    assert page("<head><title>t</title><style>x</style></head>a<script>'</p>'</script>b<div hidden>no</div><span style='display: none'>no</span>") == "ab"
    assert page("<pre>a\n  b</pre>x<br>y &amp; &lt;z&gt;") == "a\n  b\n\nx\ny & <z>"
    assert page(None) == page("") == "" and page("a < b") == "a < b" and page("<!-- x --><p>t") == "t"
    assert page("<p>" + "<b>" * 3000 + "deep") == "deep" and page("<a" * 2000) == "<a" * 2000
    assert page('<p title="a>b">q</p><img alt="x"><input type=hidden value=no><input type=submit value=Go>') == "q\n\nGo"


def test_html_svg_math_and_open_head():
    page = html_text.page_text
    assert page("a <math><semantics><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></semantics></math> b") == "a x=2 b"
    assert page("<svg><title>t</title><desc>d</desc><metadata>m</metadata><defs><text>u</text></defs><text>A</text><text>B</text></svg>") == "A B"
    assert page("<svg><title/><desc/><path d='M0'/><text>A</text></svg> b") == "A b"
    assert page("<svg><foreignObject><p>f</p></foreignObject></svg><p>g") == "f\n\ng"
    assert page("<map name='m'>go <a href='#'>there</a><area></map>") == "go there"
    assert page("<desc>d</desc><metadata>m</metadata>") == "dm"
    assert page("<head><title>t</title>Hello <b>x</b><p>y") == "Hello x\n\ny"
    assert page("<html><head>\n<meta charset=u><style>s</style>\n<a>l</a><p>y") == "l\n\ny"
    assert page("<head><title>t</title>tail") == "tail"
    assert page("<head><noscript><img>n</noscript><template><div>d</div></template><title>t</title></head><body>b") == "b"


def test_html_tables_keep_their_grid():
    page = html_text.page_text
    assert page("<table><tr><td rowspan=2>A<td>b1<td>c1<tr><td>b2<td>c2</table>") == "A  b1  c1\n   b2  c2"
    long = "y" * 70
    assert page(f"<table><tr><td>x<td>{long}<td>r<tr><td>p<td>q<td>s</table>") == f"x  {long}  r\np  q{' ' * 69}  s"
    assert page("<table><tr><td colspan=3>wide as three columns<td>e<tr><td>a<td>b<td>c<td>f</table>") == "wide as three columns  e\na  b  c                f"
    assert page("<table><tr><td colspan=1000>a<td>b</table>") == "a  b"
    assert page("<table><tbody><tr><td rowspan=9>A<td>b<tbody><tr><td>c<td>d</table>") == "A  b\nc  d"
    assert page("<table><tr><td rowspan=0>A<td>b<tr><td>c<tr><td>d</table>") == "A  b\n   c\n   d"


def test_html_wide_cells():
    """Running text is wrapped; a word wider than any column stands alone, and what is beside it keeps its place."""
    page = html_text.page_text
    lines = page("<table><tr><td>" + "word " * 60 + "<td>side<tr><td>a<td>b</table>").split("\n")
    assert lines[0].index("side") == lines[-1].index("b") == 101 and sum(x.count("word") for x in lines) == 60 and len(lines) == 4
    lines = page("<table><tr><td>" + "z" * 500 + "<td>side<tr><td>a<td>b</table>").split("\n")
    assert lines[0] == "z" * 500 and lines[1].index("side") == lines[2].index("b") == 402


def test_html_grid_brute_force():
    """Random tables with spans: the text of each cell starts where its column does, by a grid that is filled in square by square."""
    rng = np.random.default_rng(12)
    for _ in range(60):
        n_rows, n_cols = int(rng.integers(1, 6)), int(rng.integers(1, 6))
        taken, cells, page = {}, [], "<table>"
        for r in range(n_rows):
            page += "<tr>"
            for c in range(n_cols):
                if (r, c) in taken:
                    continue
                across = 1
                while across < 3 and c + across < n_cols and (r, c + across) not in taken and rng.random() < 0.3:
                    across += 1
                down = int(rng.integers(1, 4)) if rng.random() < 0.3 else 1
                text = f"t{r}x{c}" + "w" * int(rng.integers(0, 12))
                for i in range(down):
                    for j in range(across):
                        taken[r + i, c + j] = True
                cells.append((r, c, text))
                page += f"<td colspan={across} rowspan={down}>{text}"
        lines = html_text.page_text(page + "</table>").split("\n")
        at = {}
        for r, c, text in cells:
            where = [(k, x.index(text)) for k, x in enumerate(lines) if re.search(rf"(^| ){text}( |$)", x)]
            assert len(where) == 1, (page, lines)
            at.setdefault(c, set()).add(where[0][1])
        assert all(len(v) == 1 for v in at.values()), (page, lines)
        assert sorted(at) == sorted(at, key=lambda c: (min(at[c]), c))


def test_html_visibility():
    page = html_text.page_text
    assert page("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>end") == "yes\nend"
    assert page("<div style='visibility:hidden; visibility:visible'>yes<i style='VISIBILITY: collapse'>no</i></div>") == "yes"
    assert page("<ul style='visibility:hidden'><li>no<li style='visibility:visible'>yes</ul>") == "- yes"
    assert page("<p style='display:none'>no<b style='visibility:visible'>no</b></p>x") == "x"


def test_html_very_long_page():
    page = "<p>" + "word " * 200_000 + "<table>" + "<tr><td>a<td>" + "b " * 50 + "</table>" + "<div>" * 20_000 + "deep"
    text = html_text.page_text(page)
    assert text.count("word") == 200_000 and text.endswith("deep")
    rows = html_text.page_text("<table>" + "<tr><td>k<td>v" * 30_000 + "</table>")
    assert rows.count("\n") == 29_999 and set(rows.split("\n")) == {"k  v"}


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", "u"), (1, "<p>a</p>", "u"), (None, None, None)], "page_id long, html string, text string")
    assert sorted(((r.page_id, r.text) for r in html_text.extract(df).collect()), key=str) == [(1, "a"), (1, "a"), (None, "")]
    assert html_text.extract(df.limit(0)).count() == 0


def test_subset_sum_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(40):
        counts = [(int(n), int(c)) for n, c in zip(rng.choice(np.arange(1, 40), 5, replace=False), rng.integers(1, 4, 5))]
        sums = {sum(n * k for (n, _), k in zip(counts, ks)) for ks in itertools.product(*[range(c + 1) for _, c in counts])}
        budget = int(rng.integers(1, max(sums) + 5))
        got = mixing.reachable(counts, budget)
        assert sum(n * k for n, k in got.items()) == max(s for s in sums if s <= budget)
        assert all(k <= dict(counts)[n] for n, k in got.items())
        fit = mixing.fit(counts, budget)
        assert all(k <= dict(counts)[n] for n, k in fit.items())
        assert abs(sum(n * k for n, k in fit.items()) - min(budget, max(sums))) <= 40
        double = mixing.fit(counts, budget, 2)
        assert all(k <= 2 * dict(counts)[n] for n, k in double.items())
    assert sum(n * k for n, k in mixing.fit([(5000, 1), (3, 100)], 600, 3).items()) == 600


def test_fill_targets():
    assert mixing.fill([100, 100, 100], [5, 2, 1], 300) == pytest.approx([187.5, 75, 37.5])
    got = mixing.fill([10, 100, 100], [5, 2, 1], 210)
    assert got[0] == 30 and sum(got) == pytest.approx(210) and got[1] == pytest.approx(120)
    assert mixing.fill([0, 10], [5, 2], 10) == pytest.approx([0, 10])


def test_mix(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), " ".join(["w"] * int(rng.integers(0, 30))), f"s{i % 3}") for i in range(300)]
    rows += [(1000, None, None), (1001, "a b c", None), (None, "a b", "s0"), (2000, "q " * 7, "s1"), (2000, "q " * 7, "s1"), (3000, "z " * 5000, "s2")]
    df = docs(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    words = Counter()
    for _, t, s in rows:
        words[s] += len((t or "").split())
    order = sorted([s for s in words if s is not None]) + [None]
    goals = dict(zip(order, mixing.fill([words[s] for s in order], [(5.0, 2.0, 1.0)[k % 3] for k in range(4)], sum(words.values()))))
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(goals[r.source]) and r.source_size == words[r.source] and 0 <= r.taken <= 3 * r.size
    for s in order:
        assert abs(taken[s] - goals[s]) <= 5
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda rs: sorted(((r.doc_id, r.size, r.taken) for r in rs), key=repr)
    assert key(again) == key(got)
    used = mixing.mixed_rows(df)
    assert used.columns == [*df.columns, "__size", "__copies"]
    whole = Counter()
    for r in used.collect():
        whole[r.source] += r["__size"] * r["__copies"]
        assert 1 <= r["__copies"] <= 3 and r["__size"] == len((r.text or "").split())
    assert whole == Counter({s: n for s, n in taken.items() if n})
    assert mixing.mix(df.limit(0)).count() == 0


def test_wand_brute_force():
    items = [(k, prose(k % 13, 12) + " " + prose(100 + k, 8)) for k in range(60)]
    ix = decontaminate.Index(items)
    dense = np.zeros((len(ix.lists), len(items)))
    for t, p in enumerate(ix.lists[1:], 1):
        dense[t, p.items] = p.impacts
    rng = np.random.default_rng(5)
    for _ in range(100):
        terms = rng.choice(np.arange(1, len(ix.lists)), 40, replace=False).tolist()
        for k in rng.integers(0, 60, 2):
            terms = sorted({*terms, *(ix.terms[w] for w in tokens(items[k][1])[: rng.integers(0, 21)])})
        score = dense[terms].sum(0)
        for threshold in (0.2, 0.6):
            assert {i for i, _ in ix.wand(terms, threshold)} == set(np.flatnonzero(score >= threshold - 1e-6).tolist())


def test_retrieval_misses_nothing_that_verifies():
    rng = np.random.default_rng(9)
    common = prose(50, 12).split()
    items, texts = [], []
    for k in range(60):
        # Much of an item's weight lies in the rare words at its ends.
        size, rare = int(rng.integers(1, 40)), prose(200 + k, 8).split()
        body = rng.choice(common, size).tolist()
        body = rare[:4] + body + rare[4:]
        items.append((k, " ".join(body) + (f"\n{' '.join(rng.choice(common, int(rng.integers(1, 12))))}" if k % 2 else "")))
    items += [(100, "same " * 30), (101, "one"), (102, "one two three four"), (103, " ".join(["same", "other"] * 15))]
    for _, text in items:
        words = text.split()
        for cut in (0, 2, 4, 6):
            texts.append(prose(int(rng.integers(1000)), int(rng.integers(0, 60))) + " " + " ".join(words[cut:]) + " " + " ".join(rng.choice(common, 5)))
            texts.append(" ".join(words[: len(words) - cut]))
    texts += ["", None]
    ix = decontaminate.Index(items)
    got = ix.search(texts)
    found = 0
    for text, own in zip(texts, got):
        words, half, want = tokens(text), ix.longest, set()
        for start in range(0, max(1, len(words) - 2 * half), half):
            window = words[start : start + 3 * half]
            for k, (_, q, a) in enumerate(ix.items):
                if set(window) & set(q + a) and (decontaminate.overlap(q + a, window) >= 0.8 or (q and a and min(decontaminate.overlap(q, window), decontaminate.overlap(a, window)) >= 0.8)):
                    want.add(k)
        assert set(own) == want
        found += len(want)
    assert found > 200 and min(ix.needs) < 0.6


def test_retrieval_against_whole_texts():
    """Copies with words put into them, wherever they stand in the text: by overlap with the whole text."""
    rng = np.random.default_rng(13)
    items = [(k, prose(700 + k, int(rng.integers(40, 60)))) for k in range(12)]
    ix = decontaminate.Index(items)
    texts, want = [], []
    for _ in range(150):
        k = int(rng.integers(12))
        words = items[k][1].split()
        cut = int(rng.integers(5, len(words) - 5))
        own = words[:cut] + prose(int(rng.integers(1000, 9000)), int(rng.integers(0, 41))).split() + words[cut:]
        texts.append(" ".join(prose(int(rng.integers(9000)), int(rng.integers(0, 300))).split() + own + prose(int(rng.integers(9000)), 30).split()))
        want.append({j for j, (_, q, a) in enumerate(ix.items) if decontaminate.overlap(q + a, tokens(texts[-1])) >= 0.8})
    assert [set(x) for x in ix.search(texts)] == want and sum(map(len, want)) >= 140


def test_decontaminate(spark):
    bench = spark.createDataFrame([(1, "What is " + prose(1, 30) + "?\nIt is " + prose(2, 10)), (2, prose(3, 15)), (3, None), (4, prose(6, 300)), (None, prose(7, 20))], "item_id long, text string")
    item = {r.item_id: r.text for r in bench.collect()}
    rows = [
        (1, prose(10, 500) + " " + item[1].upper().replace(" ", "  ") + " " + prose(11, 500), "s"), (2, prose(12, 100) + item[2][:30], "s"), (3, None, "s"), (4, item[2], "s"), (4, item[2], "s"),
        (5, prose(13, 20) + " " + item[4] + " " + item[2], "s"), (6, " ".join(reversed(item[1].split())), "s"), (None, item[None], "s"), (7, "", "s"), (8, prose(14, 30_000) + " " + item[2], "s"),
    ]
    df = docs(spark, rows)
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.hits(df, bench).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        for j, it in item.items():
            have, need = shingles(t or ""), shingles(it or "")
            if need and sum((have & need).values()) >= 0.8 * sum(need.values()):
                want.append((i, j))
    assert got == sorted(want, key=repr)
    blocks = decontaminate.hits(df, bench, most_words=20)
    assert sorted(((r.doc_id, r.item_id) for r in blocks.collect()), key=repr) == got
    kept = decontaminate.keep_clean(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {2, 3, 6, 7}
    assert decontaminate.hits(df.limit(0), bench).count() == 0 and decontaminate.hits(df, bench.limit(0)).count() == 0


def test_slices_cover():
    import pyarrow as pa

    texts = ["a" * 10, None, "b" * 30, "", "c"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(5))], ["text", "k"])
    parts = list(slices(batch, most=15))
    assert [t for _, x in parts for t in x] == texts and [k for p, _ in parts for k in p.column("k").to_pylist()] == list(range(5)) and len(parts) == 2
    assert list(slices(batch[:0])) == []


def test_batches_to_python_are_small(spark):
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(batch)], "bytes": [batch.nbytes]})

    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, texts = spark.conf.get(limit), spark.range(0, 6000, 1, 1).selectExpr("repeat('abcdefgh', 300) as text")
    got = common.shared_table(texts.mapInArrow(sizes, "n long, bytes long"), "sizes").collect()
    assert sum(r.n for r in got) == 6000 and max(r.bytes for r in got) < 5 << 20
    assert spark.conf.get(limit) == before
