"""Queries that build a corpus, score cleaned rewrites and keep curriculum metadata, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort, corpus, reports
from ..operators import retrieval as R
from ..operators.ranks import placed
from ..sources import io
from .registry import HITS, KEYS, METRICS_ONLY, all_hits, all_metrics, bad, caps, hits_sql, index, judged, kept, learnable_sql, negs, norm, numbers, over, q, query, ready, strategies, table, tok, words
from .registry import locked as locked_sql

# ---- corpora ----------------------------------------------------------------------------------

ID = "'D' || sha1({0})"
NESTED = f"""WITH u AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS ask, list({{'t': text, 's': CASE WHEN turn % 4 = 1 THEN 1 ELSE 0 END}} ORDER BY turn) FILTER (role = 'assistant') AS p FROM conversations GROUP BY conv_id),
r AS (SELECT 'Q' || (row_number() OVER (ORDER BY conv_id) - 1)::VARCHAR AS query_id, CASE WHEN conv_id % 5 = 0 THEN '' ELSE {norm("coalesce(ask, '')")} END AS text, p FROM u),
e AS (SELECT query_id, unnest(p) AS x FROM r WHERE text <> ''), d AS (SELECT query_id, {norm("x.t")} AS contents, x.s AS s FROM e)"""


def nested(spark, d):
    """One record a conversation, in order, written as JSON lines and read back; every fifth has a blank query."""
    c = table(spark, d, "conversations")
    said = F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text"))))
    ask = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    rows = c.groupBy("conv_id").agg(F.when(F.col("conv_id") % 5 == 0, "  ").otherwise(ask).alias("query"), said.alias("said"))
    mark = F.transform("said", lambda x: (x.getField("turn") % 4 == 1).cast("int"))
    rows = rows.select("conv_id", "query", F.struct(F.col("said.text").alias("passage_text"), mark.alias("is_selected")).alias("passages"))
    path = io.scratch(spark)
    rows.orderBy("conv_id").drop("conv_id").write.json(path)
    return corpus.from_nested(io.read_jsonl(spark, path, "query string, passages struct<passage_text: array<string>, is_selected: array<int>>"))


query(NESTED + f" SELECT DISTINCT {ID.format('contents')} AS id, contents FROM d WHERE contents <> ''", "corpus_nested_documents")(lambda s, d: nested(s, d).documents)
query(NESTED + " SELECT query_id, text FROM r WHERE text <> ''", "corpus_nested_queries")(lambda s, d: nested(s, d).queries)
query(NESTED + f" SELECT query_id, array_to_string(list_sort(list_distinct(list({ID.format('contents')}))), ',') AS docs FROM d WHERE s = 1 AND contents <> '' GROUP BY query_id", "corpus_nested_judgements")(
    lambda s, d: nested(s, d).judgements.withColumn("docs", F.array_join("docs", ",")))
TABLES = f"""WITH c AS (SELECT doc_id::VARCHAR AS raw, {norm("lang || ' ' || coalesce(text, '')")} AS contents FROM documents), k AS (SELECT raw, max({ID.format('contents')}) AS doc FROM c WHERE contents <> '' GROUP BY raw),
b AS (SELECT item_id::VARCHAR AS raw, 'Q' || (row_number() OVER (ORDER BY item_id) - 1)::VARCHAR AS query_id, {norm('text')} AS text FROM benchmark),
j AS (SELECT query_id, list_sort(list_distinct(list(doc))) AS docs FROM labels l JOIN b ON b.raw = (l.doc_id % 50)::VARCHAR JOIN k ON k.raw = l.doc_id::VARCHAR WHERE l.quality > 0 AND l.doc_id % 7 > 0 AND b.text <> '' GROUP BY query_id)"""


def tables(spark, d):
    """Documents, benchmark and labels under other names; the score is a text, and for every seventh id none."""
    path = io.scratch(spark)
    table(spark, d, "benchmark").orderBy("item_id").select(F.col("item_id").cast("string").alias("_id"), "text").write.json(path)
    asked = io.read_jsonl(spark, path, "_id string, text string")
    judged_ = table(spark, d, "labels").select((F.col("doc_id") % 50).alias("query-id"), F.col("doc_id").alias("corpus-id"), F.when(F.col("doc_id") % 7 == 0, "none").otherwise(F.col("quality").cast("string")).alias("score"))
    return corpus.from_tables(table(spark, d, "documents").select(F.col("doc_id").alias("_id"), F.col("lang").alias("title"), "text"), asked, judged_)


query(TABLES + " SELECT query_id, array_to_string(docs, ',') AS docs FROM j", "corpus_tables_judgements")(lambda s, d: tables(s, d).judgements.withColumn("docs", F.array_join("docs", ",")))
query(TABLES + f""", n AS (SELECT (SELECT count(DISTINCT contents) FROM c WHERE contents <> '') AS num_docs, (SELECT count(*) FROM b WHERE text <> '') AS num_queries, (SELECT count(*) FROM j) AS num_qrels_queries)
SELECT *, num_queries - num_qrels_queries AS num_empty_qrels_queries, (SELECT round(avg(len(docs)), 6) FROM j) AS avg_positive_docs, 1.0::DOUBLE AS qrels_coverage FROM n""", "corpus_tables_stats")(
    lambda s, d: corpus.stats(tables(s, d)).withColumn("avg_positive_docs", F.round("avg_positive_docs", 6)))
query("SELECT event_type AS qid, event_id::VARCHAR AS docid FROM events WHERE event_id % 3 = 1 AND value > 0", "qrels_positive_map")(
    lambda s, d: io.positive_qrels(table(s, d, "events").select(F.col("event_type").alias("qid"), F.create_map(F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 1, F.col("value").cast("string")).when(F.col("event_id") % 3 == 2, "high").otherwise("-1")).alias("judgements"))))



@query("WITH j AS (SELECT DISTINCT (doc_id % 50)::VARCHAR AS qid FROM labels WHERE quality > 0 AND doc_id % 3 > 0) SELECT item_id::VARCHAR AS qid, CASE WHEN item_id % 4 = 0 THEN 'topic ' || item_id::VARCHAR ELSE trim(text) END AS text, row_number() OVER (ORDER BY item_id)::BIGINT AS place FROM benchmark WHERE item_id::VARCHAR IN (SELECT qid FROM j) AND item_id % 5 > 0")
def topics_connector(spark, d):
    """Topics of several fields, some of them blank, with judgements of which some are no numbers; in order of their ids."""
    title, text = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("topic "), F.col("item_id").cast("string"))).otherwise("  "), F.when(F.col("item_id") % 5 == 0, " ").otherwise(F.col("text"))
    topics = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.create_map(F.lit("title"), F.when(F.col("item_id") % 5 > 0, title).otherwise(""), F.lit("note"), text).alias("payload"))
    rows = table(spark, d, "labels").groupBy((F.col("doc_id") % 50).cast("string").alias("qid"))
    score = F.when(F.col("doc_id") % 3 == 0, "n/a").otherwise(F.col("quality").cast("string"))
    judgements = rows.agg(F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string").alias("docid"), score.alias("score")))).alias("judgements"))
    queries, _ = io.topics_qrels(topics, judgements)
    return placed(queries, reports.numeric_first(F.col("qid")), "place")


# ---- scored rewrites --------------------------------------------------------------------------

CLEANED = norm("regexp_replace('1. ' || text, " + q(r"^[-*.)\]\s\p{Nd}]+") + ", '')")
ASKED = f", rq AS (SELECT qid, strategy, {CLEANED} AS text FROM qs UNION ALL SELECT qid, 'source', text FROM qs WHERE strategy = 'original')"
JUDGED = hits_sql("ok", 1.5, 0.75, 50, "rq", ASKED) + METRICS_ONLY.replace("FROM qs q", "FROM rq q")
SCORED = JUDGED + f""", o AS (SELECT qid, text AS otext, mrr AS orig_mrr, recall AS orig_recall, recall_aux AS orig_recall_aux, rank_bonus AS orig_rank_bonus FROM me WHERE strategy = 'source'),
p AS (SELECT m.*, o.* EXCLUDE (qid), mrr - orig_mrr AS delta_mrr, recall - orig_recall AS delta_recall, recall_aux - orig_recall_aux AS delta_recall_aux, rank_bonus - orig_rank_bonus AS delta_rank_bonus,
  {over('otext', 'text')} AS overlap, {kept(words('otext'), tok('text'))} AS keyword_preserve, {locked_sql('otext', 'text')} AS locked_term_preserve, {kept(numbers('otext'), numbers('text'))} AS number_preserve,
  {kept(caps('otext'), tok('text'))} AS acronym_preserve, {kept(negs('otext'), tok('text'))} AS negation_preserve, {bad('text')} AS bad_format_penalty,
  (CASE WHEN lower({norm('otext')}) = lower({norm('text')}) AND {norm('otext')} <> '' AND NOT {ready('otext')} THEN 1.0 ELSE 0.0 END)::DOUBLE AS unsafe_copy_penalty FROM me m JOIN o USING (qid) WHERE strategy <> 'source'),
f AS (SELECT *, 0.52::DOUBLE * delta_mrr + 0.22::DOUBLE * delta_recall + 0.16::DOUBLE * delta_recall_aux + 0.1::DOUBLE * rank_bonus AS main_reward,
  (CASE WHEN (mrr > 1e-12 OR recall > 1e-12) AND mrr + 1e-12 >= orig_mrr AND recall + 1e-12 >= orig_recall AND (mrr > orig_mrr + 1e-12 OR recall > orig_recall + 1e-12) THEN 0.05 ELSE 0 END)::DOUBLE AS anchor_bonus,
  0.8::DOUBLE * greatest(0, orig_recall - recall) AS recall_drop_penalty, greatest(0, 0.45::DOUBLE - keyword_preserve) AS overedit_penalty FROM p),
z AS (SELECT *, main_reward + anchor_bonus - 0.18::DOUBLE * bad_format_penalty - 0.14::DOUBLE * unsafe_copy_penalty - 0.08::DOUBLE * overedit_penalty - recall_drop_penalty AS total, recall_aux AS recall_dense, retrieved_relevant AS retrieved_relevant_count FROM f)"""
COUNTS = ("hit_rank", "retrieved_relevant_count", "relevant_total")
NUMBERS = [c for c in R.BREAKDOWN if c not in COUNTS]


def scored(spark, d):
    """Answers with a label line, a numbered rewrite and an empty label, cleaned and then scored."""
    s = strategies(spark, d)
    own = s.where("strategy = 'original'").select("qid", F.col("text").alias("source"))
    raw = F.concat(F.lit("User query: x\n1. "), F.col("text"), F.lit("\nExplanation:\n"))
    return R.score_rewrites(index(spark, d), judged(spark, d), s.join(own, "qid").select("qid", "strategy", "source", raw.alias("raw")), "strategy")


query(SCORED + f" SELECT qid, strategy, text AS rewritten_query, {', '.join(COUNTS)}, {', '.join(f'round({c}, 6) AS {c}' for c in NUMBERS)} FROM z", "score_rewrites")(
    lambda s, d: scored(s, d).select("qid", "strategy", "rewritten_query", *COUNTS, *[F.round(c, 6).alias(c) for c in NUMBERS]))
query(SCORED + " SELECT strategy, count(*) AS n, round(avg(total), 6) AS reward_mean, round(avg(mrr), 6) AS mrr_mean, round(avg(orig_mrr), 6) AS orig_mrr20_mean, round(avg((delta_mrr > 0)::INT), 6) AS delta_mrr20_positive_ratio FROM z GROUP BY strategy", "evaluate_policy")(
    lambda s, d: scored(s, d).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("total"), 6).alias("reward_mean"), F.round(F.avg("mrr"), 6).alias("mrr_mean"), F.round(F.avg("orig_mrr"), 6).alias("orig_mrr20_mean"), F.round(F.avg((F.col("delta_mrr") > 0).cast("int")), 6).alias("delta_mrr20_positive_ratio")))
query(HITS + ", qr AS (SELECT DISTINCT b.item_id AS qid, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)) SELECT h.qid, h.strategy, min(CASE WHEN qr.doc_id IS NOT NULL THEN rank END) AS hit_rank, round(coalesce(1.0::DOUBLE / min(CASE WHEN qr.doc_id IS NOT NULL THEN rank END), 0), 6) AS reward FROM hi h LEFT JOIN qr USING (qid, doc_id) GROUP BY h.qid, h.strategy", "reciprocal_rank_uncut")(
    lambda s, d: R.reciprocal_rank(all_hits(s, d), judged(s, d), KEYS).withColumn("reward", F.round("reward", 6)))
THREE = HITS + METRICS_ONLY + " SELECT a.qid, round(a.mrr, 6) AS original_mrr, round(b.mrr, 6) AS zero_mrr, round(c.mrr, 6) AS tuned_mrr FROM me a JOIN me b USING (qid) JOIN me c USING (qid) WHERE a.strategy = 'original' AND b.strategy = 'short' AND c.strategy = 'content'"


@query(THREE)
def three_way_compare(spark, d):
    m = all_metrics(spark, d)
    one = lambda s, n: m.where(F.col("strategy") == s).select("qid", F.round("mrr", 6).alias(n))
    return reports.three_way(one("original", "original_mrr"), one("short", "zero_mrr"), one("content", "tuned_mrr"))


# ---- curriculum metadata ----------------------------------------------------------------------

META = hits_sql("ok", 1.5, 0.75, 100) + f""", qr AS (SELECT DISTINCT b.item_id AS qid, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), tot AS (SELECT qid, count(*) AS total FROM qr GROUP BY qid),
fd AS (SELECT h.qid, h.strategy, min(CASE WHEN rank <= 20 THEN rank END) AS hit_rank, count(*) FILTER (rank <= 20) AS found, count(*) AS found100 FROM hi h JOIN qr USING (qid, doc_id) GROUP BY ALL),
me AS (SELECT q.qid, q.text, hit_rank AS orig_best_hit_rank, coalesce(1.0::DOUBLE / hit_rank, 0) AS orig_mrr20, coalesce(found::DOUBLE / total, 0) AS orig_recall20, coalesce(found100::DOUBLE / total, 0) AS orig_recall100 FROM qs q LEFT JOIN fd USING (qid, strategy) LEFT JOIN tot USING (qid) WHERE q.strategy = 'original'),
mb AS (SELECT *, CASE WHEN orig_recall100 > 0 AND orig_mrr20 < 0.35 THEN 'A' WHEN orig_mrr20 >= 0.35 THEN 'C' WHEN orig_recall100 = 0 AND {learnable_sql('text')} THEN 'B' ELSE 'DROP' END AS bucket FROM me)"""


def metadata(spark, d, some=None):
    s = strategies(spark, d).where("strategy = 'original'").select("qid", "text")
    s = s if some is None else s.where(some)
    return cohort.build_metadata(index(spark, d), s, judged(spark, d))


@query(META + " SELECT qid, text, round(orig_mrr20, 6) AS orig_mrr20, round(orig_recall20, 6) AS orig_recall20, round(orig_recall100, 6) AS orig_recall100, orig_best_hit_rank, bucket FROM mb")
def curriculum_metadata(spark, d):
    """Metadata of half the queries are written first; asked for all, the store is built anew, and found again after that."""
    s, path = strategies(spark, d).where("strategy = 'original'").select("qid", "text"), io.scratch(spark)
    cohort.ensure_metadata(s.where("qid % 2 = 0"), path, lambda: metadata(spark, d, "qid % 2 = 0"))
    cohort.ensure_metadata(s, path, lambda: metadata(spark, d))
    found = cohort.ensure_metadata(s, path, lambda: s.limit(0))
    return found.select("qid", "text", *[F.round(c, 6).alias(c) for c in ("orig_mrr20", "orig_recall20", "orig_recall100")], "orig_best_hit_rank", "bucket")


@query(META + " SELECT b.item_id AS qid, CASE WHEN b.item_id % 4 = 0 THEN 'DROP' ELSE m.bucket END AS bucket FROM benchmark b LEFT JOIN mb m ON m.qid = b.item_id")
def curriculum_defaults(spark, d):
    known = metadata(spark, d).where("qid % 4 > 0")
    return cohort.with_buckets(table(spark, d, "benchmark").select(F.col("item_id").alias("qid")), known)
