"""Queries on prompts, cohorts, judgements and retrieval reports beyond those of the registry, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cohort, reports
from ..operators import retrieval as R
from ..operators.ranks import placed
from ..sources import io
from .registry import BM, BUCKETS, CLEAN, HITS, KEYS, METRICS, P, QUERIES, REWARD, STAB, D, all_hits, all_metrics, all_rewards, bucketed, norm, pairs, prepared, index, q, query, strategies, strip, table

SYSTEM, TEMPLATE = "Rewrite the query for lexical search.", "Query: {query}\nRewritten:"
CONSTRAINT, HEADING, SUFFIX = "Keep entities and numbers; don't repeat earlier rewrites.", "Earlier rewrites:", "Rewritten:"
PHASE_WEIGHTS = {"A": 0.65, "B": 0.25, "C": 0.10}


# ---- prompts ----------------------------------------------------------------------------------

query(f"{P} SELECT conv_id, turn, {q(SYSTEM)} || chr(10) || chr(10) || 'Query: ' || {norm('source')} || chr(10) || 'Rewritten:' AS value FROM p", "prompt_build")(
    lambda s, d: pairs(s, d).select("conv_id", "turn", T.prompt(SYSTEM, TEMPLATE, F.col("source")).alias("value")))


@query(f"""WITH t AS (SELECT conv_id, turn, {norm("text")} AS x FROM conversations), u AS (SELECT conv_id, x, turn, row_number() OVER (PARTITION BY conv_id, lower(x) ORDER BY turn) AS k FROM t WHERE x <> ''),
v AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM u WHERE k = 1)
SELECT conv_id, 'Query: ' || conv_id::VARCHAR || chr(10) || {q(CONSTRAINT)} || chr(10) || {q(HEADING)} || chr(10) || string_agg('- ' || x, chr(10) ORDER BY turn) || chr(10) || {q(SUFFIX)} AS value FROM v WHERE n <= 8 GROUP BY conv_id""")
def retry_prompt(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("x")))).alias("r"))
    base = F.concat(F.lit("Query: "), F.col("conv_id").cast("string"), F.lit("\n" + SUFFIX))
    return c.select("conv_id", T.retry_prompt(base, F.col("r.x"), CONSTRAINT, HEADING, SUFFIX).alias("value"))


query(f"SELECT conv_id, count(DISTINCT {strip("coalesce(role || '  ' || turn % 2, 'None')")}) FILTER ({strip("coalesce(role, 'None')")} <> '')::INT AS n FROM conversations GROUP BY conv_id", "unique_nonempty")(
    lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.concat(F.col("role"), F.lit("  "), (F.col("turn") % 2).cast("string"))).alias("r")).select("conv_id", T.unique_nonempty(F.col("r")).alias("n")))

PATTERNS = "WITH p AS (SELECT 'p' || r_regionkey::VARCHAR AS code, r_name AS name FROM region), f AS (SELECT * FROM (VALUES ('a', 'Short', 'terse', 0.2), ('b', 'Wide', 'broad', 0.7)) f(suffix, fname, frame, temperature))"


def prompts(spark, d):
    r = table(spark, d, "region")
    one = lambda s, n, f, t: F.struct(F.lit(s).alias("suffix"), F.lit(n).alias("name"), F.lit(f).alias("frame"), F.lit(t).alias("temperature"))
    return reports.grid(r.select(F.concat(F.lit("p"), F.col("r_regionkey").cast("string")).alias("code"), F.col("r_name").alias("name"), F.array(F.lit("retrieval")).alias("tags"), F.array(one("a", "Short", "terse", 0.2), one("b", "Wide", "broad", 0.7)).alias("profiles")))


query(PATTERNS + " SELECT code || '_' || suffix AS prompt_id, upper(code) || ' ' || name || ' [' || fname || ']' AS prompt_name, code || ',retrieval,frame-' || frame || ',temp-' || printf('%.2f', temperature::DOUBLE) AS tags, temperature::DOUBLE AS temperature FROM p, f", "prompt_grid")(
    lambda s, d: prompts(s, d).withColumn("tags", F.array_join("tags", ",")))
query(PATTERNS + " SELECT place::BIGINT AS place, code || '_' || suffix AS prompt_id FROM p, f JOIN (VALUES (0, 'p3_b'), (1, 'p0_a'), (2, 'p2_b')) w(place, id) ON w.id = code || '_' || suffix", "prompt_filter")(
    lambda s, d: reports.pick(prompts(s, d), "prompt_id", ["p3_b", "p0_a", "p2_b", "p1_a"], 3).select("place", "prompt_id"))
query("SELECT page_id, regexp_replace(url, '^https?://blog', 'https://mirror') AS url FROM pages", "url_rewrite")(lambda s, d: table(s, d, "pages").select("page_id", io.rewrite_host(F.col("url"), "blog", "https://mirror").alias("url")))
SAME = """WITH m AS (SELECT page_id, page_id % 6 AS k, lower(rtrim(url, '/')) AS u FROM pages), n AS (SELECT *, split_part(u, '/', -1) AS tail FROM m)
SELECT page_id, u <> '' AND CASE k WHEN 0 THEN tail <> '' WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN false ELSE tail = 'base' END AS same FROM n"""


@query(SAME)
def same_model(spark, d):
    """The tail of a path, other letters and slashes, another folder with the same tail; another name, nothing, a fixed name."""
    url, k = F.col("url"), F.col("page_id") % 6
    tail = F.substring_index(F.rtrim(url, F.lit("/")), "/", -1)
    other = F.when(k == 0, tail).when(k == 1, F.replace(F.upper(url), F.lit("/"), F.lit("\\"))).when(k == 2, F.concat(F.lit("cache/"), tail, F.lit("/"))).when(k == 3, F.concat(url, F.lit("-merged"))).when(k == 4, F.lit(" ")).otherwise(F.lit("models/Base"))
    return table(spark, d, "pages").select("page_id", T.same_model(url, other).alias("same"))


query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND trim(role) <> '' THEN trim(role) WHEN trim(text) <> '' THEN trim(text) END AS value FROM conversations", "topic_text")(
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", io.topic_text(F.create_map(F.lit("title"), F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("  "), F.lit("other"), F.col("text"))).alias("value")))
query("WITH k AS (SELECT item_id::VARCHAR AS qid FROM benchmark UNION ALL SELECT lang || doc_id::VARCHAR FROM documents) SELECT qid, row_number() OVER (ORDER BY TRY_CAST(qid AS BIGINT) IS NULL, TRY_CAST(qid AS BIGINT), qid)::BIGINT AS place FROM k", "numeric_sort")(
    lambda s, d: ordered_ids(table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("qid")).union(table(s, d, "documents").select(F.concat("lang", F.col("doc_id").cast("string"))))))


def ordered_ids(ids: DataFrame) -> DataFrame:
    return placed(ids, reports.numeric_first(F.col("qid")), "place").select("qid", "place")


# ---- cleaning ---------------------------------------------------------------------------------

query(f"{CLEAN} SELECT conv_id, turn, r AS rank, x AS candidate FROM k", "candidate_rank")(
    lambda s, d: pairs(s, d).select("conv_id", "turn", F.posexplode(T.ranked_candidates(T.candidates(F.col("raw")), T.normalize(F.col("source")))).alias("p", "candidate")).select("conv_id", "turn", (F.col("p") + 1).cast("long").alias("rank"), "candidate"))
# Every third answer holds nothing but marks that cleaning takes away.
BLANKED = P.replace("b.text AS raw", "CASE WHEN a.conv_id % 3 = 0 THEN ' - 1) ]' ELSE b.text END AS raw")


@query(STAB.replace(P, BLANKED) + " SELECT CASE WHEN clean = '' THEN 'empty_after_clean' END AS reason, count(*) AS n FROM y GROUP BY 1")
def reason_histogram(spark, d):
    raw = F.when(F.col("conv_id") % 3 == 0, " - 1) ]").otherwise(F.col("raw"))
    reasons = pairs(spark, d).select(F.explode_outer(T.stabilized(raw, F.col("source")).getField("fallback_reasons")).alias("reason"))
    return reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# ---- judgements and retrieval -----------------------------------------------------------------

@query(f"{D} SELECT l.quality, count(*) AS judged, round(avg((d.id IS NOT NULL)::INT), 6) AS coverage FROM labels l LEFT JOIN d ON d.ord = l.doc_id GROUP BY l.quality")
def qrels_coverage(spark, d):
    j = table(spark, d, "labels").join(prepared(spark, d).select(F.col("ord").alias("doc_id"), "id"), "doc_id", "left")
    return j.groupBy("quality").agg(F.count(F.lit(1)).alias("judged"), F.round(F.avg(F.col("id").isNotNull().cast("int")), 6).alias("coverage"))


query("SELECT item_id AS qid, text FROM benchmark b WHERE EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))", "topics_with_qrels")(
    lambda s, d: table(s, d, "benchmark").select(F.col("item_id").alias("qid"), "text").join(QUERIES["containment_qrels"](s, d), "qid", "left_semi"))
query(HITS + " SELECT q.qid, q.strategy, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY rank) FILTER (rank <= 10), '') AS hits FROM qs q LEFT JOIN hi h USING (qid, strategy) GROUP BY q.qid, q.strategy", "bm25_batch_distinct")(
    lambda s, d: strategies(s, d).select(*KEYS).join(all_hits(s, d, k=10).groupBy(*KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x.getField("doc_id").cast("string")), ",").alias("hits")), list(KEYS), "left").select(*KEYS, F.coalesce("hits", F.lit("")).alias("hits")))


def rare_queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.concat_ws(" ", F.lit("zzqx"), F.concat(F.lit("qq"), F.col("item_id").cast("string")), F.when(F.col("item_id") % 2 == 0, F.element_at(T.tokens_ascii(F.col("text")), -1))).alias("text"))


@query(BM.split(",\nbq AS")[0] + """, rq AS (SELECT item_id AS qid, 'zzqx qq' || item_id::VARCHAR || CASE WHEN item_id % 2 = 0 THEN ' ' || regexp_extract_all(lower(text), '[a-z0-9_]+')[-1] ELSE '' END AS text FROM benchmark),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM rq) GROUP BY ALL),
sc AS (SELECT qid, doc_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM qt JOIN ok USING (term) JOIN po USING (term) JOIN dl USING (doc_id), cs GROUP BY qid, doc_id),
al AS (SELECT rq.qid, dl.doc_id, coalesce(score, 0)::DOUBLE AS score FROM rq CROSS JOIN dl LEFT JOIN sc ON sc.qid = rq.qid AND sc.doc_id = dl.doc_id)
SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM al) WHERE rank <= 5""")
def bm25_topk_padded(spark, d):
    asked, found = rare_queries(spark, d), index(spark, d)
    return R.padded(R.top_k(found, asked, 5), found, asked, 5)


SUMMARY = REWARD + ", w AS (SELECT a.*, o.rank_bonus AS o_rank_bonus, a.rank_bonus - o.rank_bonus AS delta_rank_bonus FROM al a JOIN al o ON a.qid = o.qid AND o.strategy = 'original')"


def scored_rewrites(spark, d):
    a = all_rewards(spark, d)
    o = a.where("strategy = 'original'").select("qid", F.col("rank_bonus").alias("o_rank_bonus"))
    return a.join(o, "qid").withColumn("delta_rank_bonus", F.col("rank_bonus") - F.col("o_rank_bonus"))


SUMMARY_COLS = [f"round(avg({c}), 6) AS {n}" for n, c in reports.MEANS.items()] + [f"round(avg(({c} > 0)::INT), 6) AS {n}" for n, c in reports.SHARES.items()]
query(SUMMARY + f" SELECT strategy, {', '.join(SUMMARY_COLS)}, count(*)::DOUBLE AS count FROM w GROUP BY strategy", "breakdown_summary")(
    lambda s, d: reports.breakdown_summary(scored_rewrites(s, d), ("strategy",)).select("strategy", *[F.round(n, 6).alias(n) for n in [*reports.MEANS, *reports.SHARES]], "count"))
query(METRICS + " SELECT a.qid, a.text AS original, b.text AS rewrite FROM me a JOIN me b ON a.qid = b.qid AND a.strategy = 'original' AND b.strategy = 'short' ORDER BY a.qid LIMIT 8", "sample_preview")(
    lambda s, d: (lambda t: t.where("strategy = 'original'").select("qid", F.col("text").alias("original")).orderBy("qid").limit(8).join(t.where("strategy = 'short'").select("qid", F.col("text").alias("rewrite")), "qid"))(strategies(s, d)))
query(METRICS + " SELECT * FROM (SELECT qid, row_number() OVER (ORDER BY qid)::BIGINT AS n FROM me WHERE strategy = 'short' AND mrr = 0) WHERE n <= 20", "zero_cases")(
    lambda s, d: zero_cases(all_metrics(s, d).where("strategy = 'short' and mrr = 0"), 20))


def zero_cases(rows: DataFrame, n: int) -> DataFrame:
    from pyspark.sql import Window

    first = rows.select("qid").orderBy("qid").limit(n)
    return first.select("qid", F.row_number().over(Window.orderBy("qid")).cast("long").alias("n"))


# ---- cohorts ----------------------------------------------------------------------------------

@query(f"""WITH i AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'A' WHEN 'de' THEN 'B' ELSE 'C' END AS bucket FROM documents), w AS (SELECT bucket, weight::DOUBLE AS weight, (SELECT count(*) FROM i) AS total FROM (VALUES ('A', 0.65), ('B', 0.25), ('C', 0.10)) v(bucket, weight) WHERE bucket IN (SELECT bucket FROM i)),
e AS (SELECT *, weight / sum(weight) OVER () * total AS exact FROM w), b AS (SELECT *, floor(round(exact, 9)) AS base FROM e),
q AS (SELECT bucket, (base + CASE WHEN row_number() OVER (ORDER BY round(exact - base, 9) DESC, weight DESC, bucket DESC) <= total - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM b),
n AS (SELECT i.*, count(*) OVER (PARTITION BY bucket) AS n FROM i), r AS (SELECT *, unnest(range(0, ceil(quota / n)::BIGINT)) AS round FROM n JOIN q USING (bucket) WHERE quota > 0),
dr AS (SELECT bucket, doc_id, row_number() OVER (PARTITION BY bucket ORDER BY round, md5('42:' || round::VARCHAR || ':' || doc_id::VARCHAR), doc_id) AS slot FROM r),
sl AS (SELECT bucket, unnest(range(1, quota + 1)) AS s FROM q), pl AS (SELECT bucket, row_number() OVER (ORDER BY h) AS place, row_number() OVER (PARTITION BY bucket ORDER BY h) AS slot FROM (SELECT *, md5('42:' || bucket || ':' || s::VARCHAR) AS h FROM sl))
SELECT place::BIGINT AS place, bucket, doc_id FROM pl JOIN dr USING (bucket, slot)""")
def epoch_schedule(spark, d):
    bucket = F.when(F.col("lang") == "en", "A").when(F.col("lang") == "de", "B").otherwise("C")
    return cohort.epoch_sample(table(spark, d, "documents").select("doc_id", bucket.alias("bucket")), PHASE_WEIGHTS, "doc_id")


query(BUCKETS + " SELECT bucket, strategy, count(*) AS n FROM bk GROUP BY ROLLUP (bucket, strategy)", "bucket_rollup")(lambda s, d: bucketed(s, d).rollup("bucket", "strategy").agg(F.count(F.lit(1)).alias("n")))


# ---- files ------------------------------------------------------------------------------------

@query("SELECT n_nationkey AS id, n_name AS name, NULL::VARCHAR AS region FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")
def csv_union_header(spark, d):
    path = io.scratch(spark)
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    b = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("region"))
    both = io.union_rows([a, b])
    io.write_csv(both, path)
    return spark.read.schema(both.schema).option("header", True).csv(path)


query("SELECT user_id AS qid, arg_max(event_type, event_id) AS bucket, max(event_id) AS ordinal FROM events GROUP BY user_id", "metadata_read")(
    lambda s, d: io.last_by_key(table(s, d, "events").select(F.col("user_id").alias("qid"), F.col("event_type").alias("bucket"), F.col("event_id").alias("ordinal")), "qid", "ordinal"))
