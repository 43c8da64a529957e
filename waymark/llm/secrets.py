"""Secret scan with corpus-wide ownership frequency.

Patterns give candidate spans.  The hash of each candidate's value is then
counted over the whole corpus by distinct repositories and distinct owners: a
value that many owners hold, or very many repositories of few owners, is a
copied example; one that few of either hold looks like a live credential.  The spans of each text are found once, written
to the shared folder, and only texts with candidates take part in the joins.

Defined cases: a null text is the empty text; null owners count as one owner;
repeated rows each get their own result; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import shared_table

#: Kind, pattern of the whole match, least length of what counts.  Letters are spelt out in both cases, as engines fold different ones.
_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""(?:{_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Issuers' own formats; spans that the base patterns do not define.
ISSUED = r"gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
KINDS = [("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("issued", ISSUED)]


#: Matches in a stretch of ``_ends``.
STRETCH = 128


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _ends(gaps: Column, lens: Column) -> Column:
    """Where each match ends: running sums of the gaps and the matches.

    Sums of whole stretches and sums inside a stretch, so that a text with
    many matches costs little more than their number.
    """

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, b: a + b)

    def stretch(i: Column) -> Column:
        return F.floor(i / STRETCH).cast("int")

    def sums(steps: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), stretch(F.size(steps) - 1)), lambda q: total(F.slice(steps, q * STRETCH + 1, F.lit(STRETCH))))
        before = _let(whole, lambda w: F.transform(w, lambda _, q: total(F.slice(w, F.lit(1), q))))
        return _let(before, lambda held: F.transform(steps, lambda _, i: F.get(held, stretch(i)) + total(F.slice(steps, stretch(i) * STRETCH + 1, i % STRETCH + 1))))

    steps = _let(lens, lambda n: F.zip_with(n, F.slice(gaps, F.lit(1), F.size(n)), lambda a, b: a + b))
    return _let(steps, sums)


def _spans(text: Column, kind: str, order: int, pattern: str) -> Column:
    """All matches as structs; the pieces between matches give their places."""
    p = F.lit(pattern)
    found = F.struct(F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.transform(F.split(text, pattern, -1), F.length).alias("gap"))

    def place(x: Column) -> Column:
        spans = F.transform(
            F.arrays_zip(x.m.alias("m"), _ends(x.gap, F.transform(x.m, F.length)).alias("e")),
            lambda z: F.struct(
                (z.e - F.length(z.m)).alias("start"), F.lit(order).alias("ord"), z.e.alias("end"), F.lit(kind).alias("kind"),
                (F.regexp_extract(z.m, pattern, 1) if kind == "assign" else z.m).alias("value"),
            ),
        )
        return F.filter(spans, lambda s: F.length(s.value) >= 6) if kind == "assign" else spans

    none = F.expr("cast(array() as array<struct<start:int,ord:int,end:int,kind:string,value:string>>)")
    return F.when(text.rlike(pattern), F.element_at(F.transform(F.array(found), place), 1)).otherwise(none)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def find(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """rid, doc_id, repo, owner and the sorted spans of each text, with their values."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    spans = F.array_sort(F.concat(*[_spans(t, kind, k, pattern) for k, (kind, pattern) in enumerate(KINDS)]))
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), spans.alias("found"))


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners) over the corpus; each level is combined before its shuffle."""
    count = lambda c: candidates.select("hash", c).distinct().groupBy("hash").agg(F.count(F.lit(1)).alias(f"n_{c}s"))
    return count("repo").join(count("owner"), "hash")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", example_owners: int = 3, example_repos: int = 20) -> DataFrame:
    """A row for each row of ``docs``.

    Without a repository column each document is its own repository and its
    source the owner.  A value that ``example_owners`` owners or more hold, or
    ``example_repos`` repositories, is a copied example; most_owners and
    most_repos are those of the text's most widely held value.  n_live and n_example count a text's spans of either
    sort; live_spans lists the first.
    """
    found = find(docs, id_col, text_col, repo_col, owner_col)
    # Values leave this step as hashes only.
    hashed = F.transform(F.col("found"), lambda s: F.struct(s.start, s.ord, s.end, s.kind, F.sha2(s.value.cast("binary"), 256).alias("hash")))
    slim = shared_table(found.withColumn("found", hashed), "secret-spans")
    base = F.filter("found", lambda s: s.ord < 3)
    n = lambda k: F.size(F.filter("found", lambda s: s.ord == k)).cast("long")
    cols = ["doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans")]
    some = slim.where(F.size("found") > 0)
    rows = some.select("rid", "repo", "owner", F.explode("found").alias("s")).select("rid", "repo", "owner", "s.*")
    stats = shared_table(ownership(rows.select("hash", "repo", "owner")), "secret-owners")
    live = (F.col("n_owners") < example_owners) & (F.col("n_repos") < example_repos)
    span = F.struct("start", "ord", "end", "kind")
    judged = rows.select("rid", "start", "ord", "end", "kind", "hash").join(stats, "hash").groupBy("rid").agg(
        F.count(F.when(live, 1)).alias("n_live"), F.count(F.when(~live, 1)).alias("n_example"), F.max("n_owners").alias("most_owners"), F.max("n_repos").alias("most_repos"), F.array_sort(F.collect_list(F.when(live, span))).alias("live")
    )
    judged = some.join(judged, "rid").select(*cols, "n_live", "n_example", "most_owners", "most_repos", _joined(F.col("live")).alias("live_spans"))
    zero = F.lit(0).cast("long")
    none = slim.where(F.size("found") == 0).select(*cols, zero.alias("n_live"), zero.alias("n_example"), zero.alias("most_owners"), zero.alias("most_repos"), F.lit("").alias("live_spans"))
    return judged.unionByName(none)


def oracle_sql(example_owners: int = 3, example_repos: int = 20) -> str:
    def spans(kind: str, order: int, pattern: str) -> str:
        p = pattern.replace("'", "''")
        value = f"regexp_extract(m[i], '{p}', 1)" if kind == "assign" else "m[i]"
        return f"""select rid, {order} as ord, '{kind}' as kind, length(m[i]) as n, {value} as value,
  (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::bigint as s
  from (select rid, m, g, unnest(generate_series(1, len(m))) as i from (select rid, regexp_extract_all(t, '{p}') as m, string_split_regex(t, '{p}') as g from d) where len(m) > 0)"""

    union = "\nunion all ".join(spans(kind, k, p) for k, (kind, p) in enumerate(KINDS))
    text = "kind || ':' || s || ':' || (s + n)"
    live = f"(n_owners < {example_owners} and n_repos < {example_repos})"
    return f"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as t from documents),
f as (select * from ({union}) where ord > 0 or length(value) >= 6),
o as (select value, count(distinct coalesce(source, chr(0))) as n_owners, count(distinct coalesce(doc_id::varchar, chr(0))) as n_repos from f join d using (rid) group by value),
a as (select rid, count(*) filter (where ord = 0) as n_assign, count(*) filter (where ord = 1) as n_access, count(*) filter (where ord = 2) as n_hex,
  coalesce(string_agg({text}, ',' order by s, ord) filter (where ord < 3), '') as base, string_agg({text}, ',' order by s, ord) as spans,
  count(*) filter (where {live}) as n_live, count(*) filter (where not {live}) as n_example, max(n_owners) as most_owners, max(n_repos) as most_repos,
  coalesce(string_agg({text}, ',' order by s, ord) filter (where {live}), '') as live_spans from f join o using (value) group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
  coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example, coalesce(most_owners, 0) as most_owners, coalesce(most_repos, 0) as most_repos, coalesce(live_spans, '') as live_spans
from d left join a using (rid)
"""
