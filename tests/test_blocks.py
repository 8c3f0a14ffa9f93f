"""Postings as blocks: texts inverted within tasks, repeated ids, and both ways to look terms up."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.operators import index as I
from rankloom.operators import retrieval as R


@pytest.mark.parametrize("size", [1 << 24, 40, 1])
def test_inverted_equals_counting(monkeypatch, size):
    monkeypatch.setattr(I, "BLOCK_BYTES", size)
    rnd = random.Random(size)
    for _ in range(100):
        texts = ["zz zz"] + [None if rnd.random() < 0.1 else "".join(rnd.choices("ab1_ -é中", k=rnd.choice([0, 0, 1, 3, 20]))) for _ in range(rnd.randint(0, 12))]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"]).slice(rnd.randint(0, 1))
        got, lengths = [], []
        for row in (x for b in I._inverted([batch]) for x in b.to_pylist()):
            one = list(zip(row["docs"], row["tfs"], row["dls"], strict=True))
            assert row["cf"] == sum(t for _, t, _ in one)
            lengths += [(d, n) for d, _, n in one] if row["term"] is None else []
            got += [(row["term"], *x) for x in one] if row["term"] is not None else []
        words = {r["doc_id"]: re.findall("[a-z0-9_]+", r["text"] or "") for r in batch.to_pylist()}
        assert sorted(got) == sorted((t, d, n, len(w)) for d, w in words.items() for t, n in Counter(w).items())
        assert sorted(lengths) == [(d, len(w)) for d, w in sorted(words.items()) if w]


def test_a_build_deals_out_blocks_not_single_postings(spark, tmp_path):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("Common words of all"), F.concat(F.lit("w"), F.col("id") % 50)).alias("text")).repartition(8)
    made = R.Index.build(docs, str(tmp_path / "i"))
    assert made.postings.count() == 20000 and made.blocks.count() <= 8 * 60
    assert {tuple(r) for r in made.terms.where("term in ('common', 'w7')").collect()} == {("common", 4000, 4000), ("w7", 80, 80)}
    assert (made.n, made.avgdl, made.lengths.count()) == (4000, 5.0, 4000)


def test_repeated_ids_and_both_joins(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox"), (1, "red red hen"), (2, "red"), (3, None), (4, "fox")], "doc_id long, text string")
    made = R.Index.build(docs, str(tmp_path / "i"), shard_rows=1)
    assert sorted(tuple(r) for r in made.terms.collect()) == [("fox", 2, 2), ("hen", 1, 1), ("red", 2, 4)]
    assert sorted(r["dl"] for r in made.lengths.collect()) == [1, 1, 2, 3] and made.n == 4
    terms = spark.createDataFrame([("red", 1), ("fox", 2), ("none", 3)], "term string, q int")
    both = [sorted((r["term"], r["q"], r["doc_id"], r["tf"]) for r in made.candidates(terms, few_terms=n).collect()) for n in (0, 10)]
    assert both[0] == both[1] == [("fox", 2, 1, 1), ("fox", 2, 4, 1), ("red", 1, 1, 3), ("red", 1, 2, 1)]


def test_hits_and_judgements_are_written_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a red fox runs far away"), (2, "a fox, red; runs"), (3, "far red fox runs a away")], "doc_id long, text string")
    made = R.Index.build(docs, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "red fox runs far"), (2, "a red fox runs far away"), (3, "a unicorn fox"), (4, "fox, red"), (5, "red fox runs")], "qid long, text string")
    hits, judged = R.top_k(made, asked, 2), R.containment_qrels(made, docs, asked)
    assert {tuple(r) for r in judged.collect()} == {(1, 1), (2, 1), (4, 2), (5, 1), (5, 3)}
    for df in (hits, judged):  # what reads them several times finds files, neither a search nor the documents
        assert len(df._jdf.queryExecution().executedPlan().toString().splitlines()) <= 4


def test_one_pass_deals_postings_by_document_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "PAIRS_A_TASK", 50)  # one partition wouldn't be dealt by a key
    docs = spark.createDataFrame([(i, f"red fox w{i % 7}") for i in range(100)], "doc_id long, text string")
    made = R.Index.build(docs, str(tmp_path / "i"))
    df = R.scored(made, spark.createDataFrame([(0, "red w3"), (1, "w3 fox")], "id long, text string"), 5, "okapi")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "hashpartitioning(id" not in plan
    assert df.count() == 200


def test_a_task_gives_on_the_best_of_each_text_only(spark, tmp_path):
    docs = spark.range(3000).select((3000 - F.col("id")).alias("doc_id"), F.concat_ws(" ", F.lit("common"), F.concat(F.lit("w"), F.col("id") % 3), F.when(F.col("id") % 500 == 0, "rare")).alias("text"))
    made = R.Index.build(docs, str(tmp_path / "i"))
    asked = [(0, "common w1"), (1, "rare"), (2, "common rare"), (3, "none")]
    df = R.scored(made, spark.createDataFrame(asked, "id long, text string"), 5, "lucene", cut=True)
    rows = df.collect()
    assert len(rows) <= 3 * 5 * df.rdd.getNumPartitions()  # not a row for each text and document
    best = {i: sorted((-round(r["score"], 6), r["doc_id"]) for r in rows if r["id"] == i)[:5] for i, _ in asked}
    assert [d for _, d in best[0]] == [2, 5, 8, 11, 14] and [d for _, d in best[1]] == [d for _, d in best[2]] == [500, 1000, 1500, 2000, 2500] and not best[3]


def test_best_of_task_equals_sorting():
    rnd = random.Random(7)
    for _ in range(200):
        k, docs, few = rnd.choice([1, 2, 5, 50]), rnd.choice([3, 20, 200]), rnd.choice([0.02, 0.9])
        names = [None, *[f"d{i:03}" for i in range(1, docs)]]
        rows = [(t, names[d], rnd.choice([0.5, 0.25, 1.0, 1 / 3])) for t in range(rnd.randint(1, 8)) for d in range(docs) if rnd.random() < few]
        rnd.shuffle(rows)
        asked = [(i, t, rnd.choice([1.0, 0.5, -0.3])) for i, t in sorted({(rnd.randint(0, 9), rnd.randint(0, 8)) for _ in range(12)})]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in x], t) for i, t in enumerate((pa.int64(), pa.string(), pa.float64()))], names=["number", "doc_id", "impact"]) for x in (rows[: len(rows) // 2], rows[len(rows) // 2 :])]
        got = [(r["id"], -round(r["score"], 6), r["doc_id"] or "") for b in R._best_of_task(*[np.array(x) for x in zip(*asked, strict=True)], k)(batches) for r in b.to_pylist()]
        sums = Counter()
        for i, t, w in asked:
            for term, d, x in rows:
                if term == t:
                    sums[i, d or ""] += w * x
        for i in {i for i, _, _ in asked}:
            assert sorted((s, d) for j, s, d in got if j == i)[:k] == sorted((-round(s, 6), d) for (j, d), s in sums.items() if j == i)[:k]


def test_a_build_deals_blocks_without_sampling_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "POSTINGS_A_TASK", 500)
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("all w"), F.col("id") % 90, F.lit(" v"), F.col("id") % 70).alias("text"))
    # Ranges of a sort are found by reading all that is dealt one more time.
    monkeypatch.setattr(type(docs), "repartitionByRange", lambda *a: pytest.fail("blocks are read for a sample"))
    made = R.Index.build(docs, str(tmp_path / "i"), parts=20)
    assert {(r["term"], r["df"]) for r in made.terms.collect()} == {("all", 1000), *((f"w{i}", 12 if i < 10 else 11) for i in range(90)), *((f"v{i}", 15 if i < 20 else 14) for i in range(70))}
    held = {r[0]: r[1] for r in made.blocks.select("part", "_metadata.file_path").distinct().groupBy("part").count().collect()}
    assert set(held) == {r[0] for r in made.terms.select(I.part_of(20)).distinct().collect()}
    assert max(held.values()) <= 2  # 6 tasks: a part's terms lie in one or two of the ranges
