"""The pipeline's stages against plain checks of what each must do."""

import math
import re

import corpus_pipeline as cp
from rankloom.llm import secrets, toxicity

DATA = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 1").collect()}
    clean = cp.toxicity_stage(spark, docs, DATA).cache()
    left = {r["doc_id"] for r in clean.select("doc_id").collect()}
    assert clean.columns == docs.columns and len(left & toxic) < 0.6 * len(toxic)
    one = cp.near_duplicate_stage(spark, clean, DATA).cache()
    assert one.columns == docs.columns and one.count() == one.select("text").distinct().count() < clean.count()
    masked = cp.secrets_stage(spark, one, DATA).cache()
    assert masked.columns == docs.columns and masked.count() == one.count()
    assert not any(secrets.unwrap(r["text"])[1] for r in masked.collect())
    mixed = cp.mixing_stage(spark, masked, DATA).cache()
    assert mixed.columns == docs.columns
    assert max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 3
    size = lambda df: {r["source"]: r["n"] for r in df.selectExpr("source", r"regexp_count(text, '[^\\x20\\x09-\\x0D]+') n").groupBy("source").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    before, after = size(masked), size(mixed)
    names = sorted(before)
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    for s in names:
        target = min(3 * before[s], sum(before.values()) * weights[s] / sum(weights.values()))
        assert abs(after.get(s, 0) - target) < 0.35 * target + 200
    packed = cp.packing_stage(spark, mixed, DATA)
    assert packed.selectExpr("max(length + offset) m").first()["m"] <= 2048
    assert re.fullmatch("[a-z_]+", cp.STAGES[0][0])


def test_toxicity_stage_drops_what_the_operator_predicts(spark, monkeypatch):
    """A model whose score is 0.4, or 0.2, for every text: the stage and the operator must judge alike."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet") for name in ("documents", "labels"))
    n = len(toxicity.FEATURES)
    for score, predicted in ((0.4, 1), (0.2, 0)):
        model = toxicity.Model({}, [0.0] * n, [1.0] * n, [0.0] * n, math.log(score / (1 - score)))
        monkeypatch.setattr(toxicity, "train", lambda *a, m=model, **k: m)
        assert {r["predicted"] for r in toxicity.score_toxicity(docs, labels).collect()} == {predicted}
        assert cp.toxicity_stage(spark, docs, "/root/testdata/sf0.001").count() == (0 if predicted else docs.count())
