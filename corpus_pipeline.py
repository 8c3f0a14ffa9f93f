"""The corpus pipeline: five operators of rankloom.llm in a row, each stage written as Parquet and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import mixing, packing, queries, secrets, similarity, toxicity
from rankloom.llm.shared import shared_dir, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    Without labels of both kinds every document stays. Null and empty texts are judged as texts without hits, repeated
    rows alike; an empty table stays empty; columns of any name stay as they are."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the least id, null ids last.

    Null, empty and blank texts are one group; rows that share an id but not the text are documents of their own; equal
    rows count once; an empty table stays empty; columns of any name stay as they are."""
    return similarity.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts and n_chars is counted anew; every row stays, repeated ones too.

    Null texts stay null, an empty table stays empty; other columns of any name stay as they are."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0 to 3 times. Only whole documents are taken.

    Texts without words (null, empty) are never taken; null sources are one source; repeated rows are taken alike; an
    empty table stays empty; columns of any name stay as they are."""
    return mixing.take(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of 2048 tokens; the last stage, so not in the columns of documents.

    Null texts count as empty and still have their end id; a document that comes several times is packed as often; an
    empty table gives no pieces; other columns are dropped."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# Learned scores, a randomised join and a tokenizer can't be put as SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
