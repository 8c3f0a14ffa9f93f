"""One query opN_<name> for each operator, over its whole table, and the SQL that checks it where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import erasure, fingerprints, hamming, hardneg, licenses, mixing, packing, quality, repeats, secrets, similarity, tokencount, toxicity
from .shared import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_pairs(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.near_duplicates(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(licenses.as_files(table(spark, sf_dir, "documents")))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.strip_repeats(table(spark, sf_dir, "documents"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.top_k(table(spark, sf_dir, "embeddings"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(rows.select("vec_id", label.alias("label"), hardneg.quantised(F.col("embedding")).alias("v")), F.col("vec_id") % 50 == 0)


def op13_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients, clicks, sales, lines = (table(spark, sf_dir, t) for t in ("clients", "clicks", "sales", "sale_lines"))
    return erasure.erase(erasure.shop_layers(clients, clicks, sales, lines), erasure.chosen_masters(clients, clicks), erasure.new_folder(spark))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_fingerprints, op3_packing, op4_toxicity, op5_mixing, op6_ngram_join, op7_secrets, op8_licenses, op9_repeats, op10_top_k, op11_token_counts, op12_hard_negatives, op13_erasure)}


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u,
         1.0::DOUBLE / (1.0::DOUBLE + 20.0::DOUBLE * (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '*#$%&|@{}<>\^~_', '')))::DOUBLE / greatest(length(coalesce(text, '')), 1)::DOUBLE) AS w
  FROM documents),
k AS (SELECT *, -ln(u) / w AS key FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM k GROUP BY source),
r AS (SELECT *, 3 * source_size::DOUBLE AS cap, 3 * source_size::DOUBLE / weight AS ratio, sum(source_size) OVER ()::DOUBLE AS total FROM s),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY ratio, source NULLS LAST) AS place FROM r),
t AS (
  SELECT source, source_size, least(cap, (SELECT level FROM l WHERE level <= ratio ORDER BY place LIMIT 1) * weight) AS target FROM l),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size + 1e-9), 3) ELSE 0 END::BIGINT AS epochs FROM t),
b AS (SELECT *, greatest(0, round(target - epochs * source_size))::BIGINT AS budget FROM e),
a AS (
  SELECT k.doc_id, k.size, b.source_size, b.target, b.epochs, b.budget,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, round(target, 4) AS target, (epochs * size + greatest(0, least(size, budget - ahead)))::BIGINT AS taken FROM a
"""

TOP_K_SQL = """
WITH c AS (
  SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64),
p AS (
  SELECT q.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(q.bits, b.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))::BIGINT AS distance
  FROM c q JOIN c b ON q.vec_id % 100 = 0 AND b.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p)
SELECT query_id, rank::BIGINT AS rank, vec_id, distance FROM r WHERE rank <= 10
"""


HARD_NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": MIX_SQL, "op10_top_k": TOP_K_SQL, "op12_hard_negatives": HARD_NEGATIVES_SQL}
