"""A retrieval corpus of nested records or of normalised tables: documents, queries and judgements under stable ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import maybe_float
from ..functions.text import normalize
from ..sources.io import ordinals


@dataclass(frozen=True)
class Corpus:
    """documents (id, contents), queries (query_id, text), judgements (query_id, docs: sorted ids)."""

    documents: DataFrame
    queries: DataFrame
    judgements: DataFrame


def content_id(contents: Column) -> Column:
    return F.concat(F.lit("D"), F.sha1(contents.cast("binary")))


def sorted_set(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Each key with its different values, sorted."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(out))


def field(df: DataFrame, names: list[str], default: str | None = None) -> Column:
    """The first of the columns that df has, whatever it holds (a null stays null); else the default."""
    return next((F.col(n) for n in names if n in df.columns), F.lit(default))


def distinct_documents(contents: DataFrame) -> DataFrame:
    return contents.where("contents <> ''").groupBy("contents").agg(F.lit(1)).select(content_id(F.col("contents")).alias("id"), "contents")


def from_nested(records: DataFrame) -> Corpus:
    """records in order: query, passages (struct of passage_text and is_selected, arrays). A query's id is Q and its place
    among all records, from 0; a record with a blank query gives nothing. Passages that are equal up to white space are one
    document; blank ones are left out, and a passage without a mark isn't judged."""
    rows = ordinals(records.select("query", "passages"), "Q", "query_id").withColumn("text", normalize(F.coalesce("query", F.lit("")))).where("text <> ''")
    texts, marks = F.col("passages.passage_text"), F.col("passages.is_selected")
    each = rows.select("query_id", F.posexplode(texts).alias("at", "passage"), marks.alias("marks"))
    each = each.select("query_id", normalize(F.coalesce("passage", F.lit(""))).alias("contents"), F.coalesce(F.get("marks", "at") == 1, F.lit(False)).alias("relevant"))
    found = each.where("relevant and contents <> ''").select("query_id", content_id(F.col("contents")).alias("doc"))
    return Corpus(distinct_documents(each.select("contents")), rows.select("query_id", "text"), sorted_set(found, "query_id", "doc", "docs"))


def from_tables(corpus: DataFrame, queries: DataFrame, judgements: DataFrame) -> Corpus:
    """Tables under any of the usual names of their columns. A document is its title and text; the ids of equal ones
    become one, by their content, and of rows that repeat a raw id the last by content counts. Queries in order: Q and
    the place. A judgement counts if its score is above 0 (1 where there is no such column; what isn't a number never
    does) and both its ids are known."""
    blank = lambda df, *names: F.coalesce(field(df, list(names)).cast("string"), F.lit(""))
    docs = corpus.select(blank(corpus, "_id", "doc_id", "corpus_id", "id").alias("raw"), normalize(F.concat_ws(" ", blank(corpus, "title"), blank(corpus, "text", "contents"))).alias("contents")).where("contents <> ''")
    doc_of = docs.where("raw <> ''").groupBy("raw").agg(F.max(content_id(F.col("contents"))).alias("doc")).withColumnRenamed("raw", "raw_doc")
    asked = ordinals(queries, "Q", "_qid")
    raw_query = F.coalesce(field(queries, ["_id", "query_id", "qid", "id"]).cast("string"), F.substring("_qid", 2, 20))
    asked = asked.select(raw_query.alias("raw_query"), F.col("_qid").alias("query_id"), normalize(blank(queries, "text", "query")).alias("text")).where("text <> ''")
    score = next((F.col(n) for n in ("score", "relevance", "label") if n in judgements.columns), F.lit(1))
    j = judgements.where(maybe_float(score.cast("string")) > 0).select(blank(judgements, "query-id", "query_id", "qid", "query").alias("raw_query"), blank(judgements, "corpus-id", "corpus_id", "doc_id", "docid").alias("raw_doc"))
    j = j.where("raw_query <> '' and raw_doc <> ''").join(asked.groupBy("raw_query").agg(F.max_by("query_id", F.struct(F.length("query_id"), "query_id")).alias("query_id")), "raw_query").join(doc_of, "raw_doc")
    return Corpus(distinct_documents(docs.select("contents")), asked.select("query_id", "text"), sorted_set(j, "query_id", "doc", "docs"))


def stats(c: Corpus) -> DataFrame:
    """One row: documents, queries, judged and unjudged queries, mean judged documents of a judged query, and the share of
    judged documents that the corpus has (0 of none)."""
    docs, queries = c.documents.agg(F.count(F.lit(1)).alias("num_docs")), c.queries.agg(F.count(F.lit(1)).alias("num_queries"))
    judged = c.judgements.agg(F.count(F.lit(1)).alias("num_qrels_queries"), F.coalesce(F.avg(F.size("docs")), F.lit(0.0)).alias("avg_positive_docs"))
    each = c.judgements.select(F.explode("docs").alias("id"))
    cover = each.join(c.documents.select("id", F.lit(1).alias("known")), "id", "left").agg(F.coalesce(F.avg(F.col("known").isNotNull().cast("int")), F.lit(0.0)).alias("qrels_coverage"))
    one = docs.crossJoin(queries).crossJoin(judged).crossJoin(cover)  # one row each
    return one.withColumn("num_empty_qrels_queries", F.col("num_queries") - F.col("num_qrels_queries"))
