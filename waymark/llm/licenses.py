"""License scan by canonical digests.

A text, each of its paragraphs and each of its lines are brought to a
canonical form (lower case, no copyright lines, titles and reservations,
equivalent spellings made one, punctuation and white space to one blank) and
hashed whole; the digest is joined to the digests of known licence texts and
notices.  A licence of several paragraphs is also found where all of these
stand in a longer text.  The table of known digests is fixed with the code, so
broadcasting it is bounded.

Defined cases: a null or empty text has no licence; repeated rows each get
their own result; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from importlib import resources
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Fixed values: (SPDX name, text).
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]
#: Whole texts as they are published, in ``license_texts``; AGPL-3.0 is known by its header and identifiers only.
TEXTS = ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense")
GNU = [("GPL", "General", "2", "program"), ("GPL", "General", "3", "program"), ("LGPL", "Lesser General", "2.1", "library"), ("LGPL", "Lesser General", "2.1", "program"), ("LGPL", "Lesser General", "3", "library"), ("LGPL", "Lesser General", "3", "program"), ("AGPL", "Affero General", "3", "program")]
TITLES = {"Apache-2.0": "Apache License 2.0", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "MPL-2.0": "Mozilla Public License 2.0", "Unlicense": "Unlicense", "CC0-1.0": "CC0 1.0", "LGPL-2.1": "GNU Lesser General Public License, version 2.1", "LGPL-3.0": "GNU Lesser General Public License, version 3", "AGPL-3.0": "GNU Affero General Public License, version 3", "GPL-2.0": "GNU General Public License, version 2"}


def _whole() -> list[tuple[str, str]]:
    """Each text as published, and up to its terms' end."""
    out = []
    for name in TEXTS:
        text = (resources.files("waymark.llm") / "license_texts" / f"{name}.txt").read_text()
        cut = text.find("END OF TERMS AND CONDITIONS")
        out += [(name, t) for t in (text, *([text[: cut + 27], text[:cut]] if cut >= 0 else []))]
        if name == "CC0-1.0":
            out.append((name, text.replace("Creative Commons Legal Code", "", 1)))
    return out


def _bsd() -> list[tuple[str, str]]:
    """The 2 and 3 clauses with and without numbers, for the usual names of the holder."""
    out = []
    holders = [("COPYRIGHT HOLDERS", "COPYRIGHT HOLDER"), ("COPYRIGHT HOLDERS", "COPYRIGHT OWNER"), ("COPYRIGHT HOLDERS", "COPYRIGHT HOLDERS"), ("REGENTS", "REGENTS"), ("AUTHOR", "AUTHOR"), ("AUTHORS", "AUTHORS")]
    names = ["", "Neither the name of the copyright holder nor the names of its contributors", "Neither the name of the University nor the names of its contributors", "Neither the name of the author nor the names of its contributors", "Neither the name of the copyright holders nor the names of its contributors"]
    for (many, one), neither, numbered in product(holders, names, (True, False)):
        clauses = ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]
        if neither:
            clauses.append(f"{neither} may be used to endorse or promote products derived from this software without specific prior written permission.")
        text = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
        text += "\n\n".join((f"{k}. " if numbered else "* ") + c for k, c in enumerate(clauses, 1))
        text += f"""\n\nTHIS SOFTWARE IS PROVIDED BY THE {many} AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE {one} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
        out.append((f"BSD-{len(clauses)}-Clause", text))
    return out


def _headers() -> list[tuple[str, str]]:
    """The notices at the head of files: the paragraph that names the licence, and the whole notice."""
    out = []
    use = 'under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'
    asf = "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to you "
    rest = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
    for lead in ("Licensed ", asf):
        at = f"{lead}{use} http://www.apache.org/licenses/LICENSE-2.0"
        out += [("Apache-2.0", t) for t in (lead + use, at, f"{at} {rest}")]
    for (short, kind, version, this), terms in product(GNU, ("either version {} of the License, or (at your option) any later version.", "version {}.", "version {} of the License.")):
        name = f"{short}-{version}" if "." in version else f"{short}-{version}.0"
        grant = f"This {this} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation, {terms.format(version)}"
        hope = f"This {this} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details."
        got = f"You should have received a copy of the GNU {kind} Public License along with this {this}"
        ends = ["If not, see <http://www.gnu.org/licenses/>."] + [f"if not, write to the Free Software Foundation, Inc., {at} USA" for at in ("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301", "59 Temple Place, Suite 330, Boston, MA 02111-1307")]
        out += [(name, grant), *[(name, f"{grant} {hope} {got}. {end}") for end in ends]]
    out.append(("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."))
    for name, title in TITLES.items():
        out += [(name, f"{verb} under the {title}.") for verb in ("Licensed", "Released")]
        out += [(name, f"SPDX-License-Identifier: {name}{end}") for end in (("", "-only", "-or-later") if "GPL" in name else ("",))]
    out += [("GPL-3.0", f"SPDX-License-Identifier: GPL-3.0{end}") for end in ("", "-or-later")]
    out += [(name, f"SPDX-License-Identifier: {name}") for name in ("CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")]
    return out


KNOWN += _whole() + _bsd() + _headers()
#: The canonical form of lower-case text, as substitutions in this order (the syntax of both Java and RE2).
STEPS = [
    # Copyright phrases that stand inside a paragraph of a licence, then lines that are a copyright notice: the word with a sign or a year.
    (r"copyright\s+\(c\)\s+[0-9,\s]*free\s+software\s+foundation,\s+inc\.?", " "),
    (r"copyright\s+(\(c\)\s+<year>\s+<name\s+of\s+author>|\[yyyy\]\s+\[name\s+of\s+copyright\s+owner\])", " "),
    (r"(^|\n)[^\p{L}\p{N}\n©(]*(copyright[ \t,:]*(\(c\)|©|&copy;|<year>|\[year\]|[0-9]{4})|\(c\)[ \t]*(copyright|[0-9]{4})|©)[^\n]*", "\n"),
    (r"all\s+rights\s+reserved\b", " "),
    (r"(^|\n)[ \t#*=/]*(the )?(mit|isc|expat|x11|(new|modified|revised|simplified) bsd|bsd[ -][23][ -]clause( \"(new|revised|simplified)\"( or \"(revised|simplified)\")?)?) licen[cs]e[ \t]*(\([a-z0-9/ -]+\))?[ \t#*=:.]*(\n|$)", "\n"),
    (r"\blicen[cs]e", "license"),
    (r"\bsub[ -]licen", "sublicen"),
    (r"\bnon-?infringement", "noninfringement"),
    (r"https://", "http://"),
    (r"[^\p{L}\p{N}]+", " "),
]
#: Every known text holds one of these words, in any spelling, so a unit without them needs no digest.
ANCHOR = r"(?i)licen[cs]|permission|redistribut|released under"
#: What parts paragraphs, and lets a paragraph of a longer licence count.
BREAK = r"\n[ \t]*\n"


def canonical_text(text: str) -> str:
    text = text.lower()
    for pattern, put in STEPS:
        text = re.sub(pattern.replace(r"\p{L}\p{N}", r"\w").replace(r"[^\w]", r"[\W_]"), put, text)
    return text.strip(" ")


def canonical(c: Column) -> Column:
    c = F.lower(c)
    for pattern, put in STEPS:
        c = F.regexp_replace(c, pattern, put)
    return F.trim(c)


def _digest(text: str) -> str:
    return hashlib.sha256(canonical_text(text).encode()).hexdigest()


def known_digests() -> list[tuple[str, str]]:
    return sorted({(name, _digest(t)) for name, t in KNOWN})


def known_parts() -> list[tuple[str, int, str, int]]:
    """(licence, form, digest, number of them): the paragraphs of each known text of more than one that has words."""
    forms = sorted({(name, tuple(sorted({_digest(p) for p in re.split(BREAK, t) if canonical_text(p)}))) for name, t in KNOWN})
    return [(name, k, d, len(parts)) for k, (name, parts) in enumerate(forms) if len(parts) > 1 for d in parts]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, licenses, whole_license, n_notices), a row for each row of ``docs``.

    licenses: the distinct SPDX names found, sorted and comma-joined;
    whole_license: the name that the entire text is, or null; n_notices: how
    many paragraphs and lines are a known text.
    """
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame(known_digests(), "license string, digest string"))
    parts = F.broadcast(spark.createDataFrame(known_parts(), "part_of string, form int, digest string, n int"))
    t = F.coalesce(F.col(text_col), F.lit(""))
    named = lambda kind, parts: F.transform(parts, lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("u")))
    # Paragraphs without an anchor word count as parts of a longer licence only.
    some = lambda kind, units: F.filter(named(kind, units), lambda x: x.u.rlike(ANCHOR))
    units = F.concat(named("whole", F.array(t)), named("paragraph", F.split(t, BREAK)), some("line", F.split(t, r"\n")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.when(t.rlike(ANCHOR), units).alias("units"))
    rows = rows.select("doc_id", "rid", F.explode_outer("units").alias("unit")).select("doc_id", "rid", "unit.kind", F.sha2(canonical(F.col("unit.u")).cast("binary"), 256).alias("digest"))
    hit = rows.join(known, "digest", "left").join(parts.withColumnRenamed("digest", "p_digest"), (F.col("kind") == "paragraph") & (F.col("digest") == F.col("p_digest")), "left")
    # One row for each form that a paragraph is part of: a unit's own licence counts once, at its first form.
    first = F.coalesce(F.col("form") == F.col("least"), F.lit(True))
    least = parts.groupBy(F.col("digest").alias("l_digest")).agg(F.min("form").alias("least"))
    hit = hit.join(F.broadcast(least), F.col("p_digest") == F.col("l_digest"), "left").withColumn("own", F.when(first, F.col("license")))
    forms = hit.groupBy("rid", "form", "part_of", "n").agg(
        F.first("doc_id").alias("doc_id"), F.collect_set("own").alias("own"), F.max(F.when(F.col("kind") == "whole", F.col("license"))).alias("whole"),
        F.count(F.when((F.col("kind") != "whole") & F.col("own").isNotNull(), 1)).alias("notices"), F.count_distinct("p_digest").alias("held"),
    )
    found = forms.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(F.flatten(F.collect_list("own")), F.collect_set(F.when(F.col("held") == F.col("n"), F.col("part_of"))))))).alias("licenses"),
        F.max("whole").alias("whole_license"), F.sum("notices").alias("n_notices"),
    )
    return found.select("doc_id", "licenses", "whole_license", "n_notices")


def oracle_sql() -> str:
    """The same from the plain texts, whose canonical forms and digests are made in SQL."""
    def form(column: str) -> str:
        out = f"lower({column})"
        for pattern, put in STEPS:
            out = f"regexp_replace({out}, '{pattern}', E'{put.encode('unicode_escape').decode()}', 'g')"
        return f"trim({out}, ' ')"

    quote = lambda t: "'" + t.replace("'", "''") + "'"
    known = ", ".join(f"({quote(name)}, {quote(t)})" for name, t in sorted(set(KNOWN)))
    return rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
plain(license, t) as (values {known}),
k as (select distinct license, sha256({form('t')}) as digest from plain),
pieces as (select distinct license, t, sha256(c) as digest from (select license, t, {form('p')} as c from (select license, t, unnest(string_split_regex(t, '{BREAK}')) as p from plain)) where c <> ''),
f as (select license, t, list_sort(list(digest)) as ds from pieces group by 1, 2 having count(*) > 1),
u as (select rid, doc_id, 'whole' as kind, t as u from d where regexp_matches(t, '{ANCHOR}')
  union all select rid, doc_id, 'paragraph', unnest(string_split_regex(t, '{BREAK}')) from d where regexp_matches(t, '{ANCHOR}')
  union all select rid, doc_id, 'line', u from (select rid, doc_id, unnest(string_split(t, chr(10))) as u from d) where regexp_matches(u, '{ANCHOR}')),
c as (select rid, doc_id, kind, sha256({form('u')}) as digest from u),
h as (select rid, kind, license from c join k using (digest)),
p as (select rid, list(distinct digest) as ds from c where kind = 'paragraph' group by 1),
held as (select distinct rid, license from p, (select distinct license, ds as need from f) where list_has_all(ds, need)),
names as (select rid, string_agg(distinct license, ',' order by license) as licenses from (select rid, license from h union all select rid, license from held) group by 1),
n as (select rid, max(license) filter (where kind = 'whole') as whole_license, count(*) filter (where kind <> 'whole') as n_notices from h group by 1)
select doc_id, coalesce(licenses, '') as licenses, whole_license, coalesce(n_notices, 0) as n_notices from d left join names using (rid) left join n using (rid)
"""
