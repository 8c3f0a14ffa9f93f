"""Named queries over the tables, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores, text as T
from ..operators import cohort, groups, logs, reports, retrieval as R
from ..sources import io
from ..streaming import logs as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- text: user turn and the answer that follows it -------------------------------------------

def pairs(spark, d):
    c = table(spark, d, "conversations")
    a = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("raw"))
    return a.join(b, ["conv_id", "turn"])


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


# The SQL has its own fixed values, written out apart from those of the engine, so that a wrong one shows as different rows.
SQL_EXPLAIN = r"(?i)\b(because|therefore|explanation|reasoning|step[- ]?by[- ]?step|user query|search query|rewritten query|i (?:think|believe)|let(?:'s| us))\b"
SQL_PREFIXES = "['query', 'search query', 'rewritten query', 'explanation', 'reasoning']"
SQL_POLLUTION = r"(?i)(<think|thinking process|analysis:|assistant:|search query:|rewritten query:)"
SQL_NUMBER = r"(?i)\b\d+(?:\.\d+)?(?:%|[a-z]+)?\b"
SQL_UNREADABLE = r"""[^\s\x1C-\x1F\x{85}\p{Z}\p{L}\p{N}\-_.,:;!?()/\[\]'"]"""
SQL_QUESTIONS = "['what', 'when', 'where', 'which', 'who', 'whom', 'whose', 'why', 'how', 'can', 'could', 'would', 'should', 'please']"
SQL_NEGATIONS = "['no', 'not', 'without', 'except', 'excluding', 'exclude']"
SQL_STOPWORDS = SQL_QUESTIONS[:-1] + ", 'a', 'an', 'and', 'are', 'as', 'at', 'be', 'been', 'being', 'between', 'but', 'by', 'for', 'from', 'if', 'in', 'into', 'is', 'it', 'its', 'of', 'on', 'or', 'that', 'the', 'their', 'them', 'then', 'there', 'these', 'those', 'to', 'was', 'were', 'will', 'with']"
SQL_TAILS = "['a', 'an', 'and', 'by', 'for', 'in', 'of', 'on', 'or', 'the', 'to', 'with']"
SQL_MARKER_LINE = r"(?i)^(?:rewritten\s+query|search\s+query|better\s+bm25\s+query)\s*:\s*(.*)$"
SQL_MARKER_INLINE = r"(?i)(?:rewritten\s+query|search\s+query|better\s+bm25\s+query)\s*:\s*([^\n\r]+)"
SQL_LABEL_LINES = "['assistant:', 'search query:', 'rewritten query:', 'better bm25 query:', 'better bm25 query', 'better bm25', 'better bm2']"
SQL_NOISE = "(?i)(user query|better bm25|example|bm25 rules)"
SQL_STOPS = ["\nUser query:", "\nBetter BM25 query:", "\nSearch query:", "\nRewritten query:", "\nExample"]
SQL_STOP_MARKERS = ["\nuser query:", "\nbetter bm25 query:", "\nsearch query:", "\nrewritten query:", "\nexample\n"]

P = "WITH p AS (SELECT a.conv_id, a.turn, a.text AS source, b.text AS raw FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"
SPACES = q(r"[\s\x1C-\x1F\x{85}\p{Z}]+")
norm = lambda x: f"trim(regexp_replace({x}, {SPACES}, ' ', 'g'))"
strip = lambda x: f"regexp_replace({x}, {q(r'^[\s\x1C-\x1F\x{85}\p{Z}]+|[\s\x1C-\x1F\x{85}\p{Z}]+$')}, '', 'g')"
tok = lambda x: f"regexp_extract_all(lower({x}), {q(r'[\p{L}\p{N}_]+')})"
explains = lambda x: f"(regexp_matches({x}, {q(SQL_EXPLAIN)}) OR (contains({x}, ':') AND list_contains({SQL_PREFIXES}, lower({strip('split_part(' + x + chr(44) + chr(39) + ':' + chr(39) + ', 1)')}))))"
polluted = lambda x: f"regexp_matches({x}, {q(SQL_POLLUTION)})"
numbers = lambda x: f"list_transform(regexp_extract_all({x}, {q(SQL_NUMBER)}), lambda n: lower(n))"
caps = lambda x: f"list_transform(list_filter(regexp_extract_all({x}, {q(r'[\p{L}\p{N}_]+')}), lambda w: regexp_full_match(w, '[A-Z]{{2,}}')), lambda n: lower(n))"
negs = lambda x: f"list_filter({tok(x)}, lambda t: list_contains({SQL_NEGATIONS}, t))"
words = lambda x: f"list_filter({tok(x)}, lambda t: length(t) > 1 AND NOT list_contains({SQL_STOPWORDS}, t) AND NOT list_contains({SQL_NEGATIONS}, t) AND NOT list_contains({numbers(x)}, t) AND NOT list_contains({caps(x)}, t))"
over = lambda a, b: f"(CASE WHEN len({tok(a)}) = 0 OR len({tok(b)}) = 0 THEN 0.0 ELSE len(list_intersect({tok(a)}, {tok(b)}))::DOUBLE / len(list_distinct(list_concat({tok(a)}, {tok(b)}))) END)"
kept = lambda a, b: f"(CASE WHEN len({a}) = 0 THEN 1.0 ELSE coalesce(list_sum(list_transform(list_distinct({a}), lambda t: least(len(list_filter({a}, lambda x: x = t)), len(list_filter({b}, lambda y: y = t))))), 0)::DOUBLE / len({a}) END)"
english = lambda x: f"(CASE WHEN length(regexp_replace(lower({x}), {q(r'[^\p{L}]')}, '', 'g')) = 0 THEN 0.0 ELSE length(regexp_replace(lower({x}), '[^a-z]', '', 'g'))::DOUBLE / length(regexp_replace(lower({x}), {q(r'[^\p{L}]')}, '', 'g')) END)"
unread = lambda x: f"(CASE WHEN length({x}) = 0 THEN 1.0 ELSE (length({x}) - length(regexp_replace({x}, {q(SQL_UNREADABLE)}, '', 'g')))::DOUBLE / length({x}) END)"
bad = lambda x: f"(CASE WHEN {strip(x)} = '' THEN 1.0 ELSE least(1.5, (CASE WHEN contains({strip(x)}, chr(10)) OR contains({strip(x)}, chr(13)) THEN 0.5 ELSE 0 END) + (CASE WHEN {explains(strip(x))} OR {polluted(strip(x))} THEN 0.5 ELSE 0 END) + (CASE WHEN len({tok(x)}) > 12 THEN least(0.5, (len({tok(x)}) - 12) * 0.03) ELSE 0 END) + (CASE WHEN {english(x)} < 0.85 THEN least(0.5, 0.5 * (0.85 - {english(x)}) / 0.85) ELSE 0 END) + (CASE WHEN {unread(strip(x))} > 0.2 THEN least(0.5, 0.5 * ({unread(strip(x))} - 0.2) / 0.8) ELSE 0 END))::DOUBLE END)"
ready = lambda x: f"(len({tok(x)}) BETWEEN 2 AND 8 AND NOT contains({x}, '?') AND NOT list_has_any({tok(x)}, {SQL_QUESTIONS}))"
locked = lambda a, b: f"coalesce(((CASE WHEN len({numbers(a)}) > 0 THEN {kept(numbers(a), numbers(b))} ELSE 0 END) + (CASE WHEN len({caps(a)}) > 0 THEN {kept(caps(a), tok(b))} ELSE 0 END) + (CASE WHEN len({negs(a)}) > 0 THEN {kept(negs(a), tok(b))} ELSE 0 END)) / nullif((len({numbers(a)}) > 0)::INT + (len({caps(a)}) > 0)::INT + (len({negs(a)}) > 0)::INT, 0), 1.0)"
length_sql = lambda x: f"(CASE WHEN len({tok(x)}) <= 1 OR len({tok(x)}) >= 20 THEN 0.0 WHEN len({tok(x)}) < 4 THEN (len({tok(x)}) - 1) / 3.0 WHEN len({tok(x)}) <= 12 THEN 1.0 ELSE (20 - len({tok(x)})) / 8.0 END)::DOUBLE"
learnable_sql = lambda x: f"(NOT regexp_matches({x}, {q('[' + chr(10) + chr(13) + ']')}) AND {norm(x)} <> '' AND NOT {polluted(norm(x))} AND {english(norm(x))} >= 0.7 AND {unread(norm(x))} <= 0.25 AND len({tok(x)}) BETWEEN 3 AND 12 AND len(list_filter({tok(x)}, lambda t: NOT list_contains({SQL_STOPWORDS}, t))) >= 0.4 * len({tok(x)}) AND (len({words(norm(x))}) >= 2 OR len({numbers(norm(x))}) + len({caps(norm(x))}) + len({negs(norm(x))}) >= 1))"



def cut_sql(x: str, marker: str) -> str:
    """x up to the first of the marker, the fixed stop strings and, in any case, the fixed markers; trimmed."""
    at = [f"nullif(instr({x}, {q(v)}), 0)" for v in [marker, *SQL_STOPS]] + [f"nullif(instr(lower({x}), {q(v)}), 0)" for v in SQL_STOP_MARKERS]
    label = f"regexp_matches(lower({x}), '^(user query:|better bm25 query:|search query:|rewritten query:|example' || chr(10) || ')')"
    return f"CASE WHEN {label} THEN '' ELSE {strip(f'left({x}, coalesce(least({chr(44).join(at)}) - 1, length({x})))')} END"


SIMPLE = {
    "normalize_text": (lambda S, W: T.normalize(W), norm("raw")),
    "tokenize_ascii": (lambda S, W: F.array_join(T.tokens_ascii(W), " "), "array_to_string(regexp_extract_all(lower(raw), '[a-z0-9_]+'), ' ')"),
    "tokenize_unicode": (lambda S, W: F.array_join(T.tokens(W), " "), f"array_to_string({tok('raw')}, ' ')"),
    "lexical_overlap": (lambda S, W: F.round(T.overlap(S, W), 6), f"round({over('source', 'raw')}, 6)"),
    "copy_penalty": (lambda S, W: F.round(T.copy_penalty(T.overlap(S, W), 0.05), 6), f"round(greatest(0.0, {over('source', 'raw')} - 0.05::DOUBLE), 6)"),
    "unreadable_ratio": (lambda S, W: F.round(T.unreadable_ratio(W), 6), f"round({unread('raw')}, 6)"),
    "english_ratio": (lambda S, W: F.round(T.english_ratio(W), 6), f"round({english('raw')}, 6)"),
    "explanation_flag": (lambda S, W: T.is_explanation(W), explains("raw")),
    "pollution_flag": (lambda S, W: T.is_polluted(W), polluted("raw")),
    "numeric_tokens": (lambda S, W: F.array_join(F.array_sort(T.numeric_tokens(W)), " "), f"array_to_string(list_sort(list_distinct({numbers('raw')})), ' ')"),
    "acronym_tokens": (lambda S, W: F.array_join(F.array_sort(T.acronyms(W)), " "), f"array_to_string(list_sort(list_distinct({caps('raw')})), ' ')"),
    "keyword_terms": (lambda S, W: F.array_join(T.keywords(S), " "), f"array_to_string({words('source')}, ' ')"),
    "keyword_preserve": (lambda S, W: F.round(T.keyword_preserve(S, W), 6), f"round({kept(words('source'), tok('raw'))}, 6)"),
    "locked_preserve": (lambda S, W: F.round(T.locked_preserve(S, W), 6), f"round({locked('source', 'raw')}, 6)"),
    "term_preserve": (lambda S, W: F.round(T.term_preserve(S, W), 6), f"round(0.5 * {kept(words('source'), tok('raw'))} + 0.5 * {locked('source', 'raw')}, 6)"),
    "length_score": (lambda S, W: F.round(T.length_score(W), 6), f"round({length_sql('raw')}, 6)"),
    "bad_format_penalty": (lambda S, W: F.round(T.bad_format_penalty(W), 6), f"round({bad('raw')}, 6)"),
    "clean_format_score": (lambda S, W: F.when(T.bad_format_penalty(W) == 0, 1.0).otherwise(0.0), f"(CASE WHEN {bad('raw')} = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE"),
    "exact_copy_penalty": (lambda S, W: T.exact_copy_penalty(S, W), f"(CASE WHEN lower({norm('source')}) = lower({norm('raw')}) AND {norm('source')} <> '' THEN 1.0 ELSE 0.0 END)::DOUBLE"),
    "unsafe_copy_penalty": (lambda S, W: T.unsafe_copy_penalty(S, S), f"(CASE WHEN {norm('source')} <> '' AND NOT {ready('source')} THEN 1.0 ELSE 0.0 END)::DOUBLE"),
    "retrieval_ready": (lambda S, W: T.is_retrieval_ready(S), ready("source")),
    "doc_id_sha1": (lambda S, W: F.concat(F.lit("D"), F.sha1(T.normalize(W).cast("binary"))), f"'D' || sha1({norm('raw')})"),
    "truncate_generation": (lambda S, W: T.truncate_generation(F.concat(S, F.when(F.col("turn") % 4 == 1, "\n").when(F.col("turn") % 4 == 3, "\nEXAMPLE\n").otherwise("\nUser query: "), W), "and"), cut_sql("source || CASE turn % 4 WHEN 1 THEN chr(10) WHEN 3 THEN chr(10) || 'EXAMPLE' || chr(10) ELSE chr(10) || 'User query: ' END || raw", "and")),
    "stop_strings": (lambda S, W: F.lit("|".join(T.stop_strings("</s>", ("\nExample", "END")))), "array_to_string(['</s>', chr(10) || 'Example', 'END', chr(10) || 'User query:', chr(10) || 'Better BM25 query:', chr(10) || 'Search query:', chr(10) || 'Rewritten query:'], '|')"),
    "postprocess_single_line": (lambda S, W: T.first_line(W), f"coalesce(list_filter(list_transform(regexp_split_to_array(split_part(raw, chr(10) || chr(10), 1), {q(chr(13) + chr(10) + '|[' + chr(10) + chr(13) + ']')}), lambda x: {norm('x')}), lambda x: x <> '')[1], '')"),
    "learnable_flag": (lambda S, W: T.is_learnable(S), learnable_sql("source")),
    "sanitize_name": (lambda S, W: T.slug(W), "coalesce(nullif(trim(regexp_replace(lower(raw), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'summary')"),
}
for _name, (_column, _sql) in SIMPLE.items():
    query(f"{P} SELECT conv_id, turn, {_sql} AS value FROM p", _name)(lambda s, d, c=_column: pairs(s, d).select("conv_id", "turn", c(F.col("source"), F.col("raw")).alias("value")))

LINES = f"list_filter(list_transform(string_split(replace(raw, chr(13), chr(10)), chr(10)), lambda x: {norm('x')}), lambda x: x <> '')"
CAND = lambda x: f"{norm('regexp_replace(regexp_replace(regexp_replace(regexp_replace(' + strip(x) + ', ' + q(chr(94) + chr(39) + '+|' + chr(39) + '+$') + ', ' + q('') + ', ' + q('g') + '), ' + q('^\"+|\"+$') + ', ' + q('') + ', ' + q('g') + '), ' + q('^`+|`+$') + ', ' + q('') + ', ' + q('g') + '), ' + q(r'^[-*.)\]\s\x1C-\x1F\x{85}\p{Z}\p{Nd}]+') + ', ' + q('') + ')')}"
CLEAN = f"""{P}, l AS (SELECT *, {LINES} AS lines, {norm('source')} AS own FROM p),
e AS (SELECT conv_id, turn, own, lines, unnest(range(1, len(lines) + 1)) AS i FROM l),
m AS (SELECT *, lines[i] AS line, {norm(f"regexp_extract(lines[i], {q(SQL_MARKER_LINE)}, 1)")} AS tail FROM e),
c AS (SELECT conv_id, turn, own, i, CASE WHEN regexp_matches(line, {q(SQL_MARKER_LINE)}) THEN CASE WHEN tail <> '' THEN tail ELSE lines[i + 1] END
        WHEN regexp_matches(line, {q(SQL_MARKER_INLINE)}) THEN regexp_extract(line, {q(SQL_MARKER_INLINE)}, 1)
        WHEN regexp_matches(line, '(?i)^user\\s+query\\s*:') OR starts_with(lower(line), 'example') OR starts_with(lower(line), 'bm25 rules') OR line[1:1] IN ('-', '*')
          OR list_contains({SQL_LABEL_LINES}, lower(line)) OR (ends_with(line, ':') AND len(string_split(line, ' ')) <= 4) THEN NULL ELSE line END AS x FROM m),
n AS (SELECT conv_id, turn, own, i, {CAND('x')} AS x FROM c WHERE x IS NOT NULL),
f AS (SELECT conv_id, turn, any_value(own) AS own, min(i) AS i, x FROM n WHERE x <> '' GROUP BY conv_id, turn, x),
k AS (SELECT conv_id, turn, x, row_number() OVER (PARTITION BY conv_id, turn ORDER BY (CASE WHEN regexp_matches(x, {q(SQL_NOISE)}) OR {explains('x')} THEN 0 ELSE 1 END) DESC, {over('own', 'x')} DESC,
        (CASE WHEN list_contains({SQL_TAILS}, coalesce({tok('x')}[-1], '')) THEN 0 ELSE 1 END) DESC, i) AS r, i FROM f)"""


@query(f"{CLEAN} SELECT p.conv_id, p.turn, CASE WHEN {norm('raw')} = '' THEN '' ELSE coalesce(k.x, {CAND('raw')}) END AS value FROM p LEFT JOIN k ON p.conv_id = k.conv_id AND p.turn = k.turn AND k.r = 1")
def clean_query(spark, d):
    return pairs(spark, d).select("conv_id", "turn", T.clean_query(F.col("raw"), T.normalize(F.col("source"))).alias("value"))


@query(f"{CLEAN} SELECT conv_id, turn, array_to_string(list(x ORDER BY i), ' / ') AS value FROM k GROUP BY conv_id, turn")
def candidate_extract(spark, d):
    return pairs(spark, d).select("conv_id", "turn", F.array_join(T.candidates(F.col("raw")), " / ").alias("value")).where("value <> ''")


STAB = f"{CLEAN}, z AS (SELECT p.*, {norm('source')} AS own, {norm(f'CASE WHEN {norm(chr(114) + chr(97) + chr(119))} = {q(str())} THEN {q(str())} ELSE coalesce(k.x, {CAND(chr(114) + chr(97) + chr(119))}) END')} AS clean FROM p LEFT JOIN k ON p.conv_id = k.conv_id AND p.turn = k.turn AND k.r = 1), y AS (SELECT *, CASE WHEN clean = '' THEN own ELSE clean END AS final FROM z)"


@query(f"{STAB} SELECT conv_id, turn, final AS final_query, clean = '' AS fallback_to_original, {polluted('raw')} AS raw_contains_label, contains({strip('raw')}, chr(10)) OR contains({strip('raw')}, chr(13)) AS raw_multiline, round({bad('raw')}, 6) AS raw_format_penalty, round({over('own', 'final')}, 6) AS final_overlap, len({tok('final')})::INT AS final_term_count FROM y")
def stabilize_rewrite(spark, d):
    x = pairs(spark, d).select("conv_id", "turn", T.stabilized(F.col("raw"), F.col("source")).alias("x"))
    return x.select("conv_id", "turn", "x.final_query", "x.fallback_to_original", "x.raw_contains_label", "x.raw_multiline", F.round("x.raw_format_penalty", 6).alias("raw_format_penalty"), F.round("x.final_overlap", 6).alias("final_overlap"), "x.final_term_count")


RATES = {
    "changed_rate": "final <> own", "effective_rewrite_rate": "final <> own AND clean <> ''", "fallback_rate": "clean = ''", "raw_format_fail_rate": f"{bad('raw')} > 0",
    "raw_multiline_rate": f"contains({strip('raw')}, chr(10)) OR contains({strip('raw')}, chr(13))", "raw_think_rate": "regexp_matches(raw, '(?i)<think|thinking process')", "raw_label_rate": polluted("raw"),
}
# Every fourth answer is blank, every fifth thinks aloud.
THINKING = P.replace("b.text AS raw", "CASE WHEN a.conv_id % 4 = 0 THEN ' ' WHEN a.conv_id % 5 = 0 THEN '<THINK> ' || b.text ELSE b.text END AS raw")
DIAGNOSTICS = STAB.replace(P, THINKING) + f" SELECT count(*) AS n, {', '.join(f'round(avg(({x})::INT), 6) AS {n}' for n, x in RATES.items())}, round(avg({over('own', 'final')}), 6) AS mean_final_overlap, round(avg(len({tok('final')})), 6) AS mean_final_terms FROM y"


@query(DIAGNOSTICS)
def rewrite_diagnostics(spark, d):
    raw = F.when(F.col("conv_id") % 4 == 0, " ").when(F.col("conv_id") % 5 == 0, F.concat(F.lit("<THINK> "), F.col("raw"))).otherwise(F.col("raw"))
    records = pairs(spark, d).select(T.normalize(F.col("source")).alias("source"), T.stabilized(raw, F.col("source")).alias("x")).select("source", "x.*")
    return reports.rewrite_diagnostics(records).select("n", *[F.round(c, 6).alias(c) for c in (*RATES, "mean_final_overlap", "mean_final_terms")])


# ---- corpus preparation -----------------------------------------------------------------------

D = "WITH d AS (SELECT doc_id AS ord, 'D' || sha1(" + norm("text") + ") AS id, " + norm("text") + " AS contents FROM documents WHERE length(" + norm("text") + ") > 0)"


def prepared(spark, d):
    t = T.normalize(F.col("text"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("ord"), t.alias("contents")).where(F.length("contents") > 0).withColumn("id", F.concat(F.lit("D"), F.sha1(F.col("contents").cast("binary"))))


@query(f"{D} SELECT id, min(ord) AS first_ordinal, count(*) AS n, any_value(contents) AS contents FROM d GROUP BY id")
def corpus_dedup(spark, d):
    return prepared(spark, d).groupBy("id").agg(F.min("ord").alias("first_ordinal"), F.count(F.lit(1)).alias("n"), F.first("contents").alias("contents"))


@query(f"{D}, q AS (SELECT l.doc_id, d.id, l.quality FROM labels l JOIN d ON d.ord = l.doc_id) SELECT id, count(*) AS judged, sum(quality)::BIGINT AS positive FROM q GROUP BY id HAVING sum(quality) > 0")
def qrels_positive(spark, d):
    j = table(spark, d, "labels").join(prepared(spark, d).select(F.col("ord").alias("doc_id"), "id"), "doc_id")
    return j.groupBy("id").agg(F.count(F.lit(1)).alias("judged"), F.sum("quality").alias("positive")).where("positive > 0")


@query(f"{D} SELECT l.doc_id, d.id AS content_id, l.quality FROM labels l JOIN d ON d.ord = l.doc_id")
def id_remap_join(spark, d):
    return table(spark, d, "labels").join(prepared(spark, d).select(F.col("ord").alias("doc_id"), F.col("id").alias("content_id")), "doc_id").select("doc_id", "content_id", "quality")


@query(f"{D} SELECT (SELECT count(DISTINCT id) FROM d) AS num_docs, (SELECT count(*) FROM benchmark) AS num_queries, (SELECT count(*) FROM labels WHERE quality > 0) AS num_positive, round((SELECT avg((l.doc_id IS NOT NULL)::INT) FROM d LEFT JOIN labels l ON l.doc_id = d.ord), 6) AS coverage")
def corpus_stats(spark, d):
    p = prepared(spark, d)
    one = p.agg(F.count_distinct("id").alias("num_docs")).crossJoin(table(spark, d, "benchmark").agg(F.count(F.lit(1)).alias("num_queries"))).crossJoin(table(spark, d, "labels").where("quality > 0").agg(F.count(F.lit(1)).alias("num_positive")))
    cover = p.join(table(spark, d, "labels").select(F.col("doc_id").alias("ord"), F.lit(1).alias("j")), "ord", "left").agg(F.round(F.avg(F.col("j").isNotNull().cast("int")), 6).alias("coverage"))
    return one.crossJoin(cover)


@query("WITH a AS (SELECT conv_id, list(text ORDER BY turn) AS t, list(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END ORDER BY turn) AS s FROM conversations GROUP BY conv_id), e AS (SELECT conv_id, unnest(range(0, len(t)))::INT AS pos, t, s FROM a) SELECT conv_id, pos, t[pos + 1] AS passage, s[pos + 1] = 1 AS is_selected FROM e WHERE length(trim(t[pos + 1])) > 0")
def flatten_passages(spark, d):
    a = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", (F.col("role") == "assistant").cast("int").alias("s")))).alias("r"))
    e = a.select("conv_id", F.posexplode(F.arrays_zip(F.col("r.text").alias("text"), F.col("r.s").alias("s"))).alias("pos", "x"))
    return e.select("conv_id", "pos", F.col("x.text").alias("passage"), (F.col("x.s").eqNullSafe(1)).alias("is_selected")).where("length(trim(passage)) > 0")


# ---- retrieval --------------------------------------------------------------------------------

STOP = SQL_STOPWORDS
ASCII = "regexp_extract_all(lower(text), '[a-z0-9_]+')"
BM = f"""WITH dt AS (SELECT doc_id, {ASCII} AS w FROM documents), dl AS (SELECT doc_id, len(w) AS dl FROM dt WHERE len(w) > 0),
po AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM dt) GROUP BY ALL), cs AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
ts AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM po GROUP BY term),
ra AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM ts, cs), ok AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM ra) ELSE raw END AS idf FROM ra),
lu AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM ts, cs),
bq AS (SELECT item_id AS qid, {ASCII} AS w, text FROM benchmark),
qs AS (SELECT qid, 'original' AS strategy, array_to_string(w[1:12], ' ') AS text FROM bq UNION ALL SELECT qid, 'short', array_to_string(w[1:5], ' ') FROM bq
  UNION ALL SELECT qid, 'content', array_to_string(list_filter(w[1:12], lambda t: NOT list_contains({STOP}, t)), ' ') FROM bq)"""


def hits_sql(idf: str, k1: float, b: float, k: int, asked: str = "qs", more: str = "") -> str:
    return f"""{BM}{more}, qt AS (SELECT qid, strategy, term, count(*) AS qtf FROM (SELECT qid, strategy, unnest({ASCII}) AS term FROM {asked}) GROUP BY ALL),
sc AS (SELECT qid, strategy, doc_id, round(sum(qtf * idf * tf * ({k1}::DOUBLE + 1) / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * dl / avgdl))), 6) AS score FROM qt JOIN {idf} USING (term) JOIN po USING (term) JOIN dl USING (doc_id), cs GROUP BY qid, strategy, doc_id),
hi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, strategy ORDER BY score DESC, doc_id)::INT AS rank FROM sc) WHERE rank <= {k})"""


HITS = hits_sql("ok", 1.5, 0.75, 50)
METRICS_ONLY = """, qr AS (SELECT DISTINCT b.item_id AS qid, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), tot AS (SELECT qid, count(*) AS total FROM qr GROUP BY qid),
fd AS (SELECT h.qid, h.strategy, min(CASE WHEN rank <= 20 THEN rank END) AS hit_rank, count(*) FILTER (rank <= 20) AS found, count(*) FILTER (rank <= 50) AS found_aux FROM hi h JOIN qr USING (qid, doc_id) GROUP BY ALL),
me AS (SELECT q.qid, q.strategy, q.text, hit_rank, coalesce(1.0::DOUBLE / hit_rank, 0) AS mrr, coalesce(found::DOUBLE / total, 0) AS recall, coalesce(found_aux::DOUBLE / total, 0) AS recall_aux, coalesce(found, 0) AS retrieved_relevant, coalesce(total, 0) AS relevant_total,
  (CASE WHEN hit_rank IS NULL THEN 0 WHEN hit_rank <= 1 THEN 1 WHEN hit_rank <= 3 THEN 0.8 WHEN hit_rank <= 5 THEN 0.5 WHEN hit_rank <= 10 THEN 0.3 WHEN hit_rank <= 20 THEN 0.15 ELSE 0 END)::DOUBLE AS rank_bonus
  FROM qs q LEFT JOIN fd USING (qid, strategy) LEFT JOIN tot USING (qid))"""
METRICS = HITS + METRICS_ONLY
REWARD = METRICS + f""", o AS (SELECT qid, text AS otext, mrr AS o_mrr, recall AS o_recall, recall_aux AS o_recall_aux FROM me WHERE strategy = 'original'),
jo AS (SELECT m.*, otext, o_mrr, o_recall, o_recall_aux, m.mrr - o_mrr AS delta_mrr, m.recall - o_recall AS delta_recall, m.recall_aux - o_recall_aux AS delta_recall_aux,
  {kept(words('otext'), tok('text'))} AS keyword_preserve, {bad('text')} AS bad_format_penalty, (CASE WHEN lower({norm('otext')}) = lower({norm('text')}) AND {norm('otext')} <> '' AND NOT {ready('otext')} THEN 1.0 ELSE 0.0 END)::DOUBLE AS unsafe_copy_penalty FROM me m JOIN o USING (qid)),
rw AS (SELECT *, 0.52::DOUBLE * delta_mrr + 0.22::DOUBLE * delta_recall + 0.16::DOUBLE * delta_recall_aux + 0.1::DOUBLE * rank_bonus AS main_reward,
  (CASE WHEN mrr >= o_mrr - 1e-12 AND recall >= o_recall - 1e-12 AND (mrr > o_mrr + 1e-12 OR recall > o_recall + 1e-12) THEN 0.05 ELSE 0 END)::DOUBLE AS anchor_bonus,
  0.8::DOUBLE * greatest(0, o_recall - recall) AS recall_drop_penalty, greatest(0, 0.45::DOUBLE - keyword_preserve) AS overedit_penalty FROM jo),
al AS (SELECT *, main_reward + anchor_bonus - 0.18::DOUBLE * bad_format_penalty - 0.14::DOUBLE * unsafe_copy_penalty - 0.08::DOUBLE * overedit_penalty - recall_drop_penalty AS total FROM rw)"""


def strategies(spark, d):
    w = T.tokens_ascii(F.col("text"))
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.slice(w, 1, 12).alias("w"))
    some = F.filter("w", lambda t: ~t.isin(*T.STOPWORDS))
    return b.select("qid", F.explode(F.array(F.struct(F.lit("original").alias("strategy"), F.array_join("w", " ").alias("text")), F.struct(F.lit("short").alias("strategy"), F.array_join(F.slice("w", 1, 5), " ").alias("text")), F.struct(F.lit("content").alias("strategy"), F.array_join(some, " ").alias("text")))).alias("x")).select("qid", "x.*")


KEYS = ("qid", "strategy")


def index(spark, d):
    return R.Index.of(table(spark, d, "documents"), io.work_dir(spark))


def all_hits(spark, d, variant="okapi", k=50):
    return R.top_k(index(spark, d), strategies(spark, d), k, variant, KEYS)


def judged(spark, d):
    return R.containment_qrels(index(spark, d), table(spark, d, "documents"), table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text"))


def all_metrics(spark, d):
    q_ = strategies(spark, d)
    return R.metrics(q_, all_hits(spark, d), judged(spark, d), KEYS).join(q_, list(KEYS))


def all_rewards(spark, d):
    m = all_metrics(spark, d)
    o = m.where("strategy = 'original'").select("qid", F.col("text").alias("otext"), F.col("mrr").alias("o_mrr"), F.col("recall").alias("o_recall"), F.col("recall_aux").alias("o_recall_aux"))
    t, s = F.col("text"), F.col("otext")
    x = m.join(o.select("qid", "otext"), "qid").withColumn("keyword_preserve", T.keyword_preserve(s, t)).withColumn("bad_format_penalty", T.bad_format_penalty(t)).withColumn("unsafe_copy_penalty", T.unsafe_copy_penalty(s, t))
    return R.reward(x, o.drop("otext"))


def rounded(df, keep, nums):
    return df.select(*keep, *[F.round(c, 6).alias(c) for c in nums])


def rounded_sql(src, keep, nums):
    return f" SELECT {', '.join([*keep, *[f'round({c}, 6) AS {c}' for c in nums]])} FROM {src}"


query(f"{BM} SELECT term, df, cf FROM ts", "bm25_term_stats")(lambda s, d: index(s, d).terms)
query(f"{BM} SELECT doc_id, dl::INT AS dl FROM dl", "bm25_doc_lengths")(lambda s, d: index(s, d).lengths)
query(HITS + " SELECT qid, strategy, doc_id, score, rank FROM hi WHERE rank <= 20", "bm25_topk_okapi")(lambda s, d: all_hits(s, d, k=20))
query(hits_sql("lu", 0.9, 0.4, 20) + " SELECT qid, strategy, doc_id, score, rank FROM hi", "bm25_topk_lucene")(lambda s, d: all_hits(s, d, "lucene", 20))
query("SELECT DISTINCT b.item_id AS qid, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)", "containment_qrels")(judged)
query(METRICS + rounded_sql("me", ["qid", "strategy", "hit_rank"], ["mrr"]), "mrr_at_k")(lambda s, d: rounded(all_metrics(s, d), ["qid", "strategy", "hit_rank"], ["mrr"]))
query(METRICS + rounded_sql("me", ["qid", "strategy", "retrieved_relevant", "relevant_total"], ["recall", "recall_aux"]), "recall_at_k")(lambda s, d: rounded(all_metrics(s, d), ["qid", "strategy", "retrieved_relevant", "relevant_total"], ["recall", "recall_aux"]))
query(METRICS + rounded_sql("me", ["qid", "strategy"], ["rank_bonus"]), "rank_bonus")(lambda s, d: rounded(all_metrics(s, d), ["qid", "strategy"], ["rank_bonus"]))
query(METRICS + rounded_sql("me WHERE strategy = 'original'", ["qid", "hit_rank"], ["mrr", "recall", "recall_aux", "rank_bonus"]), "original_baseline")(lambda s, d: rounded(all_metrics(s, d).where("strategy = 'original'"), ["qid", "hit_rank"], ["mrr", "recall", "recall_aux", "rank_bonus"]))
for _name, _nums in {"delta_metrics": ["delta_mrr", "delta_recall", "delta_recall_aux"], "anchor_bonus": ["anchor_bonus"], "recall_drop": ["recall_drop_penalty"], "overedit": ["overedit_penalty"], "compose_reward": ["main_reward", "total"], "score_breakdown": ["mrr", "recall", "recall_aux", "rank_bonus", "keyword_preserve", "bad_format_penalty", "unsafe_copy_penalty", "delta_mrr", "delta_recall", "delta_recall_aux", "anchor_bonus", "overedit_penalty", "recall_drop_penalty", "main_reward", "total"]}.items():
    query(REWARD + rounded_sql("al", ["qid", "strategy"], _nums), _name)(lambda s, d, n=_nums: rounded(all_rewards(s, d), ["qid", "strategy"], n))


# ---- reports ----------------------------------------------------------------------------------

@query(REWARD + " SELECT strategy, count(*) AS n, round(avg(total), 6) AS reward_mean, round(avg(mrr), 6) AS mrr_mean, round(avg(recall), 6) AS recall_mean, round(avg((anchor_bonus > 0)::INT), 6) AS anchor_ratio, round(avg((recall_drop_penalty > 0)::INT), 6) AS recall_drop_ratio, round(avg(keyword_preserve), 6) AS keyword_mean FROM al GROUP BY strategy")
def reward_summary(spark, d):
    r = lambda c: F.round(F.avg(c), 6)
    return all_rewards(spark, d).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), r("total").alias("reward_mean"), r("mrr").alias("mrr_mean"), r("recall").alias("recall_mean"), r((F.col("anchor_bonus") > 0).cast("int")).alias("anchor_ratio"), r((F.col("recall_drop_penalty") > 0).cast("int")).alias("recall_drop_ratio"), r("keyword_preserve").alias("keyword_mean"))


@query(METRICS + " SELECT a.qid, a.text AS original, b.text AS short, c.text AS content, round(a.mrr, 6) AS original_mrr, round(b.mrr, 6) AS short_mrr, round(c.mrr, 6) AS content_mrr FROM me a JOIN me b ON a.qid = b.qid JOIN me c ON a.qid = c.qid WHERE a.strategy = 'original' AND b.strategy = 'short' AND c.strategy = 'content'")
def per_qid_compare(spark, d):
    p = all_metrics(spark, d).groupBy("qid").pivot("strategy", ["original", "short", "content"]).agg(F.first("text").alias("text"), F.round(F.first("mrr"), 6).alias("mrr"))
    return p.select("qid", *[F.col(f"{s}_text").alias(s) for s in ("original", "short", "content")], *[f"{s}_mrr" for s in ("original", "short", "content")])


WTL = METRICS + ", wt AS (SELECT b.strategy, count(*) FILTER (b.mrr > a.mrr + 1e-12) AS win, count(*) FILTER (abs(b.mrr - a.mrr) <= 1e-12) AS tie, count(*) FILTER (b.mrr < a.mrr - 1e-12) AS loss, count(*) AS total, avg(b.mrr) - avg(a.mrr) AS delta_mrr, avg(b.recall) - avg(a.recall) AS delta_recall, avg(b.mrr) AS mrr, avg(b.recall) AS recall, avg(b.rank_bonus) AS reward_mean FROM me a JOIN me b ON a.qid = b.qid AND a.strategy = 'original' GROUP BY b.strategy)"


def versus_original(spark, d):
    m = all_metrics(spark, d)
    a = m.where("strategy = 'original'").select("qid", F.col("mrr").alias("m0"), F.col("recall").alias("r0"))
    g = m.join(a, "qid").groupBy("strategy").agg(F.count_if(F.col("mrr") > F.col("m0") + 1e-12).alias("win"), F.count_if(F.abs(F.col("mrr") - F.col("m0")) <= 1e-12).alias("tie"), F.count_if(F.col("mrr") < F.col("m0") - 1e-12).alias("loss"), F.count(F.lit(1)).alias("total"), (F.avg("mrr") - F.avg("m0")).alias("delta_mrr"), (F.avg("recall") - F.avg("r0")).alias("delta_recall"), F.avg("mrr").alias("mrr"), F.avg("recall").alias("recall"), F.avg("rank_bonus").alias("reward_mean"))
    return g


query(WTL + " SELECT strategy, win, tie, loss, total, round(coalesce(win::DOUBLE / nullif(total, 0), 0), 6) AS win_rate FROM wt", "win_tie_loss")(lambda s, d: versus_original(s, d).select("strategy", "win", "tie", "loss", "total", F.round(F.coalesce(F.try_divide("win", "total"), F.lit(0.0)), 6).alias("win_rate")))
query(WTL + " SELECT strategy, round(delta_mrr, 6) AS delta_mrr, round(delta_recall, 6) AS delta_recall FROM wt", "metric_deltas")(lambda s, d: rounded(versus_original(s, d), ["strategy"], ["delta_mrr", "delta_recall"]))
RANKED = "row_number() OVER (ORDER BY round(mrr, 9) DESC, round(recall, 9) DESC, round(reward_mean, 9) DESC, strategy)"


def leaderboard(spark, d):
    return reports.leaderboard(versus_original(spark, d), ["mrr", "recall", "reward_mean"], "strategy")


query(WTL + f" SELECT {RANKED} AS rank, strategy, round(mrr, 6) AS mrr, round(recall, 6) AS recall FROM wt", "prompt_leaderboard")(lambda s, d: rounded(leaderboard(s, d), ["rank", "strategy"], ["mrr", "recall"]))
query(WTL + f" SELECT strategy, mrr FROM (SELECT strategy, round(mrr, 6) AS mrr, {RANKED} AS r FROM wt) WHERE r = 1", "best_prompt")(lambda s, d: rounded(leaderboard(s, d).where("rank = 1"), ["strategy"], ["mrr"]))
SWEEP = WTL + ", sh AS (SELECT mrr AS short_mrr FROM wt WHERE strategy = 'short')"


@query(SWEEP + " SELECT strategy, round(delta_mrr, 6) AS delta_mrr, round(mrr - short_mrr, 6) AS delta_short, delta_mrr >= 0.01 AS meets_target, row_number() OVER (ORDER BY round(delta_mrr, 9) DESC, round(mrr - short_mrr, 9) DESC, round(recall, 9) DESC, strategy DESC) AS rank FROM wt, sh")
def sweep_leaderboard(spark, d):
    w = versus_original(spark, d)
    short = w.where("strategy = 'short'").select(F.col("mrr").alias("short_mrr"))
    w = w.join(F.broadcast(short)).withColumn("delta_short", F.col("mrr") - F.col("short_mrr"))  # one row
    return reports.leaderboard(w, ["delta_mrr", "delta_short", "recall"], "strategy", name_descending=True).select("strategy", F.round("delta_mrr", 6).alias("delta_mrr"), F.round("delta_short", 6).alias("delta_short"), (F.col("delta_mrr") >= 0.01).alias("meets_target"), "rank")


query(METRICS + " SELECT strategy, round(avg(mrr), 6) AS avg_reward, round(avg((mrr > 0)::INT), 6) AS nonzero, avg(mrr) > 0.2 AND avg((mrr > 0)::INT) > 0.5 AS passed FROM me GROUP BY strategy", "threshold_gate")(lambda s, d: all_metrics(s, d).groupBy("strategy").agg(F.avg("mrr").alias("a"), F.avg((F.col("mrr") > 0).cast("int")).alias("z")).select("strategy", F.round("a", 6).alias("avg_reward"), F.round("z", 6).alias("nonzero"), ((F.col("a") > 0.2) & (F.col("z") > 0.5)).alias("passed")))

# ---- cohorts ----------------------------------------------------------------------------------

H = "md5('42:' || {0}::VARCHAR)"
query(f"SELECT item_id, CASE WHEN row_number() OVER (ORDER BY {H.format('item_id')}, item_id) <= least(greatest(floor(count(*) OVER () * 0.8::DOUBLE), 1), count(*) OVER () - 1) THEN 'train' ELSE 'validation' END AS part FROM benchmark", "split_queries")(lambda s, d: cohort.split(table(s, d, "benchmark").select("item_id"), "item_id", 0.8))
query(f"SELECT item_id FROM benchmark ORDER BY {H.format('item_id')}, item_id LIMIT 20", "sample_queries")(lambda s, d: cohort.sample(table(s, d, "benchmark").select("item_id"), "item_id", 20))
BUCKETS = METRICS + f", bk AS (SELECT qid, strategy, CASE WHEN recall_aux > 0 AND mrr < 0.35 THEN 'A' WHEN mrr >= 0.35 THEN 'C' WHEN recall_aux = 0 AND {learnable_sql('text')} THEN 'B' ELSE 'DROP' END AS bucket FROM me)"


def bucketed(spark, d):
    return all_metrics(spark, d).select("qid", "strategy", cohort.bucket(F.col("mrr"), F.col("recall_aux"), T.is_learnable(F.col("text"))).alias("bucket"))


query(BUCKETS + " SELECT qid, strategy, bucket FROM bk", "curriculum_buckets")(bucketed)
query(BUCKETS + " SELECT b.bucket, count(k.qid) AS n FROM (VALUES ('A'), ('B'), ('C'), ('DROP')) b(bucket) LEFT JOIN bk k USING (bucket) GROUP BY b.bucket", "bucket_counts")(lambda s, d: cohort.bucket_counts(bucketed(s, d)))
query(BUCKETS + " SELECT qid, strategy, bucket FROM bk WHERE bucket <> 'DROP'", "curriculum_filter")(lambda s, d: bucketed(s, d).where("bucket <> 'DROP'"))
query("WITH w AS (SELECT o_orderpriority AS bucket, count(*)::DOUBLE AS weight FROM orders GROUP BY 1), e AS (SELECT *, weight / sum(weight) OVER () * 101 AS exact FROM w), b AS (SELECT *, floor(round(exact, 9)) AS base FROM e) SELECT bucket, weight, (base + CASE WHEN row_number() OVER (ORDER BY round(exact - base, 9) DESC, weight DESC, bucket DESC) <= 101 - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM b", "bucket_quotas")(lambda s, d: cohort.quotas(table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("bucket")).agg(F.count(F.lit(1)).cast("double").alias("weight")), 101))


@query("WITH i AS (SELECT lang AS bucket, doc_id, count(*) OVER (PARTITION BY lang) AS n FROM documents), r AS (SELECT *, unnest(range(0, ceil(1500.0 / n)::BIGINT))::INT AS round FROM i), s AS (SELECT bucket, doc_id, round, row_number() OVER (PARTITION BY bucket ORDER BY round, md5('42:' || round::VARCHAR || ':' || doc_id::VARCHAR), doc_id) AS slot FROM r) SELECT bucket, slot, round, doc_id FROM s WHERE slot <= 1500")
def cyclic_sample(spark, d):
    items = table(spark, d, "documents").select(F.col("lang").alias("bucket"), "doc_id")
    return cohort.cyclic_draw(items, items.select("bucket").distinct().withColumn("quota", F.lit(1500)), "doc_id").select("bucket", F.col("slot").cast("long").alias("slot"), "round", "doc_id")


query("SELECT b.item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))", "metadata_coverage")(lambda s, d: table(s, d, "benchmark").select("item_id").join(QUERIES["containment_qrels"](s, d).select(F.col("qid").alias("item_id")), "item_id", "left_anti"))

# ---- rollout groups: events by user and day ---------------------------------------------------

G = "WITH g AS (SELECT user_id AS grp, event_id AS idx, event_type AS query, round(value, 4) AS reward, round(value * 0.5 + (event_id % 7), 4) AS mrr FROM events WHERE value IS NOT NULL)"


def rollouts(spark, d):
    return table(spark, d, "events").where("value is not null").select(F.col("user_id").alias("grp"), F.col("event_id").alias("idx"), F.col("event_type").alias("query"), F.round("value", 4).alias("reward"), F.round(F.col("value") * 0.5 + F.col("event_id") % 7, 4).alias("mrr"))


query(G + " SELECT grp, idx, round(CASE WHEN stddev_pop(reward) OVER (PARTITION BY grp) < 1e-8 THEN 0 ELSE (reward - avg(reward) OVER (PARTITION BY grp)) / (stddev_pop(reward) OVER (PARTITION BY grp) + 1e-8) END, 4) AS advantage FROM g", "advantages")(lambda s, d: groups.advantages(rollouts(s, d), "grp", "reward").select("grp", "idx", F.round("advantage", 4).alias("advantage")))
query(G + ", q AS (SELECT grp, query, max(reward) AS hi, min(reward) AS lo FROM g GROUP BY ALL), a AS (SELECT grp, round(CASE WHEN count(*) < 2 THEN 0 ELSE max(hi) - min(lo) END, 4) AS reward_gap, count(*) = 1 AS collapsed FROM q GROUP BY grp), b AS (SELECT grp, max(reward) = min(reward) AS flat_reward, max(mrr) = min(mrr) AS flat_mrr, first(mrr ORDER BY reward DESC, idx) = max(mrr) AS best_reward_hits_best_mrr FROM g GROUP BY grp) SELECT * FROM a JOIN b USING (grp)", "group_flags")(lambda s, d: groups.flags(rollouts(s, d), "grp", "query", "reward", "mrr", "idx").withColumn("reward_gap", F.round("reward_gap", 4)))
query(G + ", r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY reward DESC, idx) AS k FROM g) SELECT grp, idx, query, reward FROM r WHERE k = 1", "best_rewrite")(lambda s, d: groups.best(rollouts(s, d), "grp", "reward", "idx", ["idx", "query", "reward"]))
query(G + ", o AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY grp, query ORDER BY idx) = 1 THEN reward END AS own FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY idx) AS n, CASE WHEN count(own) OVER w < 2 THEN 0 ELSE max(own) OVER w - min(own) OVER w END AS gap FROM o WINDOW w AS (PARTITION BY grp ORDER BY idx ROWS UNBOUNDED PRECEDING)), h AS (SELECT grp, min(n) FILTER (n >= 2 AND gap >= 60) AS hit_at, max(n) AS last FROM r WHERE n <= 8 GROUP BY grp) SELECT grp, coalesce(hit_at, last)::INT AS generated, hit_at IS NOT NULL AS gap_met, CASE WHEN hit_at IS NOT NULL THEN 'threshold_reached' ELSE 'max_group_size_reached' END AS stop_reason FROM h", "gap_stop_index")(lambda s, d: groups.gap_stop(rollouts(s, d), "grp", "query", "reward", "idx", 60.0, 2, 8))
query(G + " SELECT grp, array_to_string(list(query ORDER BY idx), ',') AS queries, count(*) AS n FROM g GROUP BY grp", "nest_group_trace")(lambda s, d: groups.nest(rollouts(s, d), "grp", "idx", ["query", "reward"]).select("grp", F.array_join("group_query", ",").alias("queries"), F.size("group_query").cast("long").alias("n")))
query(G + " SELECT grp, (row_number() OVER (PARTITION BY grp ORDER BY idx) - 1)::INT AS idx, query, reward FROM g", "unnest_group_trace")(lambda s, d: groups.unnest(groups.nest(rollouts(s, d), "grp", "idx", ["query", "reward"]), "grp", ["query", "reward"]))
query("SELECT vec_id, round(list_sum(list_transform(list_zip(embedding[1:32], embedding[33:64]), lambda z: least(exp(z[1]::DOUBLE - z[2]::DOUBLE), least(greatest(exp(z[1]::DOUBLE - z[2]::DOUBLE), 0.8), 1.2)))) / 32, 5) AS objective, round(list_sum(list_transform(list_zip(embedding[1:32], embedding[33:64]), lambda z: z[1]::DOUBLE - z[2]::DOUBLE)) / 32, 5) AS kl FROM embeddings", "clipped_objective")(lambda s, d: (lambda n, o: table(s, d, "embeddings").select("vec_id", F.round(F.aggregate(scores.clipped_objective(n, o, F.lit(1.0)), F.lit(0.0), lambda a, x: a + x) / 32, 5).alias("objective"), F.round(F.aggregate(F.zip_with(n, o, lambda x, y: x - y), F.lit(0.0), lambda a, x: a + x) / 32, 5).alias("kl")))(F.slice("embedding", 1, 32).cast("array<double>"), F.slice("embedding", 33, 32).cast("array<double>")))
query("SELECT n, i::INT AS i, round(least(1.35, 0.8 + 0.05 * i), 6)::DOUBLE AS temperature, round(least(0.995, 0.92 + 0.01 * i), 6)::DOUBLE AS top_p FROM (SELECT DISTINCT l_linenumber AS n FROM lineitem), LATERAL (SELECT unnest(range(0, n)) AS i)", "sampling_schedule")(lambda s, d: table(s, d, "lineitem").select(F.col("l_linenumber").alias("n")).distinct().select("n", F.posexplode(scores.sampling_schedule(F.col("n").cast("int"), 0.8, 0.92)).alias("i", "x")).select("n", "i", "x.temperature", "x.top_p"))

# ---- logs: events by day (epoch) and hour (step) ----------------------------------------------

L = "WITH s AS (SELECT date_diff('day', DATE '1970-01-01', ts::DATE)::INT AS epoch, hour(ts)::INT AS step, avg(value) AS reward_mean, max(value) AS reward_max, count(*) AS sampled FROM events GROUP BY ALL), l AS (SELECT *, row_number() OVER (ORDER BY epoch, step)::INT AS global_step_idx FROM s)"


def steps(spark, d):
    e = table(spark, d, "events").select(F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("epoch"), F.hour("ts").alias("step"), "value")
    return logs.with_step_index(e.groupBy("epoch", "step").agg(F.avg("value").alias("reward_mean"), F.max("value").alias("reward_max"), F.count(F.lit(1)).alias("sampled")))


query(L + " SELECT epoch, step, round(reward_mean, 6) AS reward_mean, round(reward_max, 6) AS reward_max, sampled, global_step_idx FROM l", "train_steps")(lambda s, d: steps(s, d).select("epoch", "step", F.round("reward_mean", 6).alias("reward_mean"), F.round("reward_max", 6).alias("reward_max"), "sampled", "global_step_idx"))


@query(L + ", r AS (SELECT epoch, step, CASE WHEN step % 2 = 0 THEN sampled + 1 END AS sampled, reward_max - reward_mean AS spread FROM l WHERE step < 12) SELECT l.epoch, l.step, CASE WHEN r.step IS NULL THEN l.sampled ELSE r.sampled END AS sampled, round(spread, 6) AS spread FROM l LEFT JOIN r USING (epoch, step)")
def merge_steps(spark, d):
    """The right rows come twice; the first ones, of a lower number, must not count, and later nulls must."""
    s = steps(spark, d)
    r = s.where("step < 12").select("epoch", "step", F.when(F.col("step") % 2 == 0, F.col("sampled") + 1).alias("sampled"), (F.col("reward_max") - F.col("reward_mean")).alias("spread"), "global_step_idx")
    older = r.select("epoch", "step", F.lit(-1).cast("long").alias("sampled"), F.lit(-1.0).alias("spread"), (F.col("global_step_idx") - 100_000).alias("global_step_idx"))
    return logs.merge_steps(s, older.union(r)).select("epoch", "step", "sampled", F.round("spread", 6).alias("spread"))


query(L + " SELECT round(corr(reward_mean, reward_max), 6) AS r FROM l", "pearson")(lambda s, d: steps(s, d).agg(F.round(logs.pearson("reward_mean", "reward_max"), 6).alias("r")))
query(L + ", n AS (SELECT *, count(*) OVER () AS c FROM l) SELECT round(avg(reward_mean) FILTER (global_step_idx <= greatest(c // 3, 1)), 6) AS first_third, round(avg(reward_mean) FILTER (global_step_idx > c - greatest(c // 3, 1)), 6) AS last_third FROM n", "trend_thirds")(lambda s, d: logs.trend_thirds(steps(s, d), "reward_mean", "global_step_idx").select(F.round("first_third", 6).alias("first_third"), F.round("last_third", 6).alias("last_third")))
query(L + " SELECT epoch, step, round(reward_mean, 6) AS reward_mean FROM l ORDER BY reward_mean DESC, global_step_idx LIMIT 1", "best_row")(lambda s, d: logs.best_row(steps(s, d), "reward_mean", "global_step_idx", ["epoch", "step", "reward_mean"]).withColumn("reward_mean", F.round("reward_mean", 6)))
query(L + " SELECT count(*) AS n, count(DISTINCT epoch) AS epochs, min(step) AS min_step, max(step) AS max_step, round(avg(reward_mean), 6) AS reward_mean, sum(sampled)::BIGINT AS sampled FROM l", "log_summary")(lambda s, d: steps(s, d).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("epoch").alias("epochs"), F.min("step").alias("min_step"), F.max("step").alias("max_step"), F.round(F.avg("reward_mean"), 6).alias("reward_mean"), F.sum("sampled").alias("sampled")))
query(L + " SELECT epoch, step, global_step_idx FROM l WHERE global_step_idx % 5 = 0", "eval_cadence")(lambda s, d: steps(s, d).where("global_step_idx % 5 = 0").select("epoch", "step", "global_step_idx"))
query(L + " SELECT global_step_idx, ((global_step_idx - 1) // 24)::BIGINT AS batch FROM l", "batch_index")(lambda s, d: steps(s, d).select("global_step_idx", F.floor((F.col("global_step_idx") - 1) / 24).cast("long").alias("batch")))
query(L + ", b AS (SELECT *, max(reward_mean) OVER (PARTITION BY epoch ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l) SELECT epoch, step, before IS NULL OR reward_mean > before AS should_save FROM b", "best_checkpoint")(lambda s, d: steps(s, d).withColumn("b", F.max("reward_mean").over(Window.partitionBy("epoch").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))).select("epoch", "step", (F.col("b").isNull() | (F.col("reward_mean") > F.col("b"))).alias("should_save")))
EARLY = L + """, o AS (SELECT epoch, step::BIGINT AS step, reward_mean AS m, row_number() OVER (PARTITION BY epoch ORDER BY step) AS n, max(reward_mean) OVER (PARTITION BY epoch ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM l),
f AS (SELECT *, b IS NOT NULL AND m < b AND n > 3 AND b - m >= 5 AS dropped FROM o), g AS (SELECT *, sum((NOT dropped)::INT) OVER (PARTITION BY epoch ORDER BY step) AS grp FROM f),
k AS (SELECT *, CASE WHEN dropped THEN sum(dropped::INT) OVER (PARTITION BY epoch, grp ORDER BY step) ELSE 0 END::INT AS streak FROM g)
SELECT epoch, step, streak, streak >= 2 AS should_stop, CASE WHEN b IS NULL OR m > b THEN 'new_best' WHEN m = b THEN 'matched_best' WHEN n <= 3 THEN 'warmup_baseline' WHEN dropped THEN CASE WHEN streak >= 2 THEN 'significant_drop_stop' ELSE 'significant_drop' END ELSE 'within_tolerance' END AS reason FROM k"""
query(EARLY, "early_stop")(lambda s, d: logs.early_stop(steps(s, d), "epoch", "step", "reward_mean", threshold=5.0).select("epoch", "step", "streak", "should_stop", "reason"))
query(L + " SELECT (epoch - (SELECT min(epoch) FROM l))::INT AS day, count(*) AS n, least(23, floor((max(reward_mean) - min(reward_mean)) / 1000 * 24))::INT AS bin FROM l GROUP BY epoch", "plot_histogram")(lambda s, d: (lambda t: t.crossJoin(t.agg(F.min("epoch").alias("e0"))).groupBy((F.col("epoch") - F.col("e0")).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.least(F.lit(23), F.floor((F.max("reward_mean") - F.min("reward_mean")) / 1000 * 24)).cast("int").alias("bin")))(steps(s, d)))


# ---- sources, sinks, streams ------------------------------------------------------------------

@query("SELECT item_id::VARCHAR AS id, text AS contents FROM benchmark")
def jsonl_roundtrip(spark, d):
    path = io.scratch(spark)
    io.write_jsonl(table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("contents")), path)
    return io.read_jsonl(spark, path, "id string, contents string", strict=True)


@query("SELECT n_regionkey::VARCHAR AS qid, n_nationkey::VARCHAR AS docid FROM nation")
def qrels_json_scan(spark, d):
    path = io.scratch(spark)
    by = table(spark, d, "nation").groupBy(F.col("n_regionkey").cast("string").alias("qid")).agg(F.collect_list(F.col("n_nationkey").cast("string")).alias("docs"))
    by.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("qid", "docs")))).alias("value")).write.text(path)  # 25 nations: one object
    return io.read_qrels_json(spark, path)


@query("SELECT event_type AS run_id, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def history_append(spark, d):
    path = io.scratch(spark)
    e = table(spark, d, "events").select(F.col("event_type").alias("run_id"), F.col("user_id").cast("string").alias("prompt_id"), F.col("value").alias("metric"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("at"))
    io.append_history(e.where("metric < 50"), path)
    io.append_history(e.where("metric >= 50 or metric is null"), path)
    return io.history(spark, path).select("run_id", F.size("results").cast("long").alias("n"))


def event_log(spark, d, path):
    e = table(spark, d, "events").select(F.col("event_type").alias("run"), F.dayofyear("ts").alias("epoch"), F.hour("ts").alias("step"), "ts", F.col("value").alias("metric"))
    io.write_jsonl(e, path)
    return stream.read_log(spark, path)


def drained(df: DataFrame, path: str, mode: str) -> DataFrame:
    """What a stream gives once it has read all that is there, as a written table: rows appended, or in complete mode the
    last batch's whole result."""
    spark, out = df.sparkSession, f"{path}-out"
    writer = df.writeStream.option("checkpointLocation", f"{path}-c").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
    else:
        writer.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query("SELECT dayofyear(ts)::INT AS epoch, hour(ts)::INT AS step, round(avg(value), 6) AS metric_mean, round(max(value), 6) AS metric_max, count(*) AS n FROM events GROUP BY 1, 2")
def stream_step_rollup(spark, d):
    path = io.scratch(spark)
    out = drained(stream.step_rollup(event_log(spark, d, path)), path, "complete")
    return out.select("epoch", "step", F.round("metric_mean", 6).alias("metric_mean"), F.round("metric_max", 6).alias("metric_max"), "n")


@query("WITH e AS (SELECT event_type AS run, event_id, value AS m FROM events WHERE value IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY event_id) AS n, max(m) OVER (PARTITION BY run ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e), f AS (SELECT *, b IS NOT NULL AND m < b AND n > 3 AND b - m >= 5 AS dropped FROM o), g AS (SELECT *, sum((NOT dropped)::INT) OVER (PARTITION BY run ORDER BY event_id) AS grp FROM f) SELECT run, event_id AS step, (CASE WHEN dropped THEN sum(dropped::INT) OVER (PARTITION BY run, grp ORDER BY event_id) ELSE 0 END)::INT AS streak FROM g")
def stream_early_stop(spark, d):
    path = io.scratch(spark)
    e = table(spark, d, "events").where("value is not null").select(F.col("event_type").alias("run"), F.lit(1).alias("epoch"), F.col("event_id").cast("int").alias("step"), "ts", F.col("value").alias("metric"))
    io.write_jsonl(e.coalesce(1), path)
    return drained(stream.early_stop(stream.read_log(spark, path), threshold=5.0), path, "append").select("run", "step", "streak")


def entry_query(spark, d):
    """Mean reciprocal rank and recall of every benchmark query, judged or not."""
    return rounded(all_metrics(spark, d).where("strategy = 'original'"), ["qid", "hit_rank"], ["mrr", "recall", "recall_aux", "rank_bonus"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
