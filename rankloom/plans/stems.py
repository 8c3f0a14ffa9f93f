"""Queries of Porter's stems and of retrieval over them, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stem import porter
from ..operators import retrieval as R
from ..sources import io
from .registry import ASCII, KEYS, STOP, query, strategies, table

# The rules for the SQL, written out apart from the engine's: suffix and what takes its place, longest first.
TWO = "ational>ate ization>ize iveness>ive fulness>ful ousness>ous tional>tion biliti>ble entli>ent ousli>ous ation>ate alism>al aliti>al iviti>ive enci>ence anci>ance izer>ize alli>al ator>ate logi>log bli>ble eli>e"
THREE = "icate>ic ative> alize>al iciti>ic ical>ic ness> ful>"
FOUR = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic ou"

# m > 0, m > 1, m = 1, a vowel, consonant-vowel-consonant with m = 1. A first y is written Y, as it is a consonant.
C, V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
M0, M1, ONE, HAS = f"^({C})?{V}{C}", f"^({C})?{V}{C}{V}{C}", f"^({C})?{V}{C}({V})?$", f"^({C})?{V}"
CVC = "^[^aeiou][^aeiouy]*[aeiouy][^aeiouwxyY]$"


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _cut(n: int | str) -> str:
    return f"left(x, length(x) - {n})"


def _cases(rules: str) -> str:
    """The first suffix that fits decides; what stands before it has to have m > 0."""
    whens = []
    for rule in rules.split():
        suffix, new = rule.split(">")
        whens.append(f"WHEN suffix(x, '{suffix}') THEN CASE WHEN {_has(_cut(len(suffix)), M0)} THEN {_cut(len(suffix))} || '{new}' ELSE x END")
    return f"CASE {' '.join(whens)} ELSE x END"


def _fixed(n: int) -> str:
    """What is left without -ed or -ing (n characters), mended."""
    s = _cut(n)
    twice = f"right({s}, 1) = left(right({s}, 2), 1) AND length({s}) > 1"
    y = rf"{_has(s, '(^Y|[aeiou]y)y(yy)*y$')} OR {_has(s, '[^aeiouyY](yy)+$')}"
    return f"CASE WHEN {_has(s, '(at|bl|iz)$')} OR {_has(s, CVC)} THEN {s} || 'e' WHEN ({twice} AND NOT {_has(s, '[aeiouylszY]$')}) OR {y} THEN {_cut(n + 1)} ELSE {s} END"


STEPS = [
    f"CASE WHEN suffix(x, 'sses') OR suffix(x, 'ies') THEN {_cut(2)} WHEN suffix(x, 's') AND NOT suffix(x, 'ss') THEN {_cut(1)} ELSE x END",
    f"CASE WHEN suffix(x, 'eed') THEN CASE WHEN {_has(_cut(3), M0)} THEN {_cut(1)} ELSE x END WHEN suffix(x, 'ed') AND {_has(_cut(2), HAS)} THEN {_fixed(2)} WHEN suffix(x, 'ing') AND {_has(_cut(3), HAS)} THEN {_fixed(3)} ELSE x END",
    f"CASE WHEN suffix(x, 'y') AND {_has(_cut(1), HAS)} THEN {_cut(1)} || 'i' ELSE x END",
    _cases(TWO),
    _cases(THREE),
    f"CASE {' '.join(f'WHEN suffix(x, {s!r}) THEN CASE WHEN {_has(_cut(len(s)), M1)} THEN {_cut(len(s))} ELSE x END' for s in FOUR.split())} WHEN (suffix(x, 'sion') OR suffix(x, 'tion')) AND {_has(_cut(3), M1)} THEN {_cut(3)} ELSE x END",
    f"CASE WHEN suffix(x, 'e') AND ({_has(_cut(1), M1)} OR ({_has(_cut(1), ONE)} AND NOT {_has(_cut(1), CVC)})) THEN {_cut(1)} ELSE x END",
    f"CASE WHEN suffix(x, 'll') AND {_has('x', M1)} THEN {_cut(1)} ELSE x END",
]


def stems_sql(words: str) -> str:
    """Tables from word (w) to stem (s): one step a table."""
    out = [f"p0 AS (SELECT DISTINCT w, CASE WHEN left(w, 1) = 'y' THEN 'Y' || substr(w, 2) ELSE w END AS x FROM {words})"]
    out += [f"p{i + 1} AS (SELECT w, {step} AS x FROM p{i})" for i, step in enumerate(STEPS)]
    return ", ".join(out) + f", st AS (SELECT w, CASE WHEN length(w) > 2 THEN lower(x) ELSE w END AS s FROM p{len(STEPS)})"


VOCABULARY = f"vo AS (SELECT DISTINCT unnest({ASCII}) AS w FROM documents UNION SELECT DISTINCT unnest({ASCII}) FROM benchmark UNION SELECT DISTINCT unnest({ASCII}) FROM conversations)"


@query(f"WITH {VOCABULARY}, {stems_sql('vo')} SELECT w AS word, s AS stem FROM st")
def porter_stems(spark, d):
    """The stem of each different word of three tables."""
    texts = [table(spark, d, t).select("text") for t in ("documents", "benchmark", "conversations")]
    split = lambda t: t.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))).alias("word"))
    words = split(texts[0]).union(split(texts[1])).union(split(texts[2])).distinct()
    return words.select("word", F.get(porter(F.array("word")), F.lit(0)).alias("stem"))


def indexed(spark, d):
    return R.Index.of(table(spark, d, "documents"), io.work_dir(spark), stem=True)


STEMMED = f"""WITH {VOCABULARY}, {stems_sql('vo')}, po AS (SELECT doc_id, s AS term, count(*) AS tf FROM (SELECT doc_id, unnest({ASCII}) AS w FROM documents) JOIN st USING (w) GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf) AS dl FROM po GROUP BY doc_id), cs AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), ts AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM po GROUP BY term),
bq AS (SELECT item_id AS qid, {ASCII} AS w FROM benchmark), qs AS (SELECT qid, 'original' AS strategy, w[1:12] AS w FROM bq UNION ALL SELECT qid, 'short', w[1:5] FROM bq UNION ALL SELECT qid, 'content', list_filter(w[1:12], lambda t: NOT list_contains({STOP}, t)) FROM bq),
qt AS (SELECT qid, strategy, s AS term, count(*) AS qtf FROM (SELECT qid, strategy, unnest(w) AS w FROM qs) JOIN st USING (w) GROUP BY ALL),
sc AS (SELECT qid, strategy, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9::DOUBLE / (tf + 0.9::DOUBLE * (0.6::DOUBLE + 0.4::DOUBLE * dl / avgdl))), 6) AS score FROM qt JOIN ts USING (term) JOIN po USING (term) JOIN dl USING (doc_id), cs GROUP BY qid, strategy, doc_id)"""

query(STEMMED + " SELECT term, df, cf FROM ts", "bm25_porter_terms")(lambda s, d: indexed(s, d).terms)
query(STEMMED + " SELECT * FROM (SELECT qid, strategy, doc_id, score, row_number() OVER (PARTITION BY qid, strategy ORDER BY score DESC, doc_id)::INT AS rank FROM sc) WHERE rank <= 20", "bm25_topk_porter")(
    lambda s, d: R.top_k(indexed(s, d), strategies(s, d), 20, "lucene", KEYS))
