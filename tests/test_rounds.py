"""Regeneration over rounds against a literal replay, very many reports, cut-offs from settings, epochs without buckets."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions import scores
from rankloom.operators import cohort, regenerate
from rankloom.operators import retrieval as R
from rankloom.sources import io

SAMPLES = "grp long, idx long, source string, query string, polluted boolean, fell_back boolean"
LATER = "grp long, idx long, round int, query string, polluted boolean, fell_back boolean"


def replayed(samples, later, least_unique, rounds):
    """One group: [(query, polluted, fell_back)] by place, source first; later: {(round, place): the same}."""
    source, group = samples
    group, came = list(group), [0] * len(group)
    if min(len(group), least_unique) <= 1:
        return [(*g, c) for g, c in zip(group, came, strict=True)]
    low = source.strip().lower()
    for r in range(1, rounds + 1):
        if len(set(g[0] for g in group)) >= min(len(group), least_unique):
            break
        places = [i for i, g in enumerate(group) if g[0] in [x[0] for x in group[:i]] or g[1] or g[0].strip().lower() == low]
        moved = False
        for i in places:
            if (r, i) not in later:
                continue
            old, new = group[i], later[r, i]
            others = [x[0] for j, x in enumerate(group) if j != i and x[0]]
            take = bool(new[0]) and new[0] not in others
            take = take or (old[1] and not new[1]) or (old[0].strip().lower() == low and new[0].strip().lower() != low) or (old[2] and not new[2])
            if take:
                group[i], came[i], moved = new, r, True
        if not moved:
            break
    return [(*g, c) for g, c in zip(group, came, strict=True)]


@pytest.mark.parametrize("least_unique, rounds", [(4, 2), (3, 3), (1, 2), (8, 0)])
def test_rounds_equal_a_literal_replay(spark, least_unique, rounds):
    rnd = random.Random(least_unique)
    word = lambda: rnd.choice(["a", "b", "c", "d", "e", " SRC ", "src", ""])
    one = lambda: (word(), rnd.random() < 0.3, rnd.random() < 0.3)
    groups = {g: ("src", [one() for _ in range(rnd.randint(1, 7))]) for g in range(120)}
    later = {g: {(r, i): one() for r in (1, 2, 3) for i in range(len(x[1])) if rnd.random() < 0.8} for g, x in groups.items()}
    first = spark.createDataFrame([(g, i, s, *x) for g, (s, xs) in groups.items() for i, x in enumerate(xs)], SAMPLES)
    second = spark.createDataFrame([(g, i, r, *x) for g, xs in later.items() for (r, i), x in xs.items()], LATER)
    got = regenerate.replay(first, second, "grp", "idx", "source", least_unique, rounds).select("grp", "idx", "query", "polluted", "fell_back", "round")
    want = [(g, i, *x) for g in groups for i, x in enumerate(replayed(groups[g], later[g], least_unique, rounds))]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_rounds_of_odd_rows(spark):
    first = spark.createDataFrame([(1, 0, None, None, None, None), (1, 1, None, None, None, True), (None, 0, "s", "s", False, False)], SAMPLES)
    second = spark.createDataFrame([(1, 1, 1, "x", None, None), (1, 1, 1, "y", None, None), (1, 7, 1, "z", False, False)], LATER)
    got = sorted(map(tuple, regenerate.replay(first, second, "grp", "idx", "source").collect()), key=str)
    assert got == sorted([(1, 0, "", False, False, 0), (1, 1, "x", False, False, 1), (None, 0, "s", False, False, 0)], key=str)
    assert regenerate.replay(first.limit(0), second.limit(0), "grp", "idx", "source").count() == 0


def test_very_many_reports(spark, tmp_path):
    n = 20_000
    os.makedirs(tmp_path / "r")
    for i in range(n):
        (tmp_path / "r" / f"{i}.json").write_text(json.dumps({"name": f"n{i}", "mrr": i / 7}, indent=2))
    manifest = spark.range(n).select(F.col("id").alias("odd.name"), F.concat(F.lit(f"{tmp_path}/r/"), F.col("id").cast("string"), F.lit(".json")).alias("report_path"))
    got = io.read_reports(spark, manifest, "name string, mrr double")
    assert got.count() == n and got.where("name = concat('n', `odd.name`) and abs(mrr - `odd.name` / 7) < 1e-9").count() == n
    more = manifest.unionByName(spark.createDataFrame([(n, f"{tmp_path}/r/none.json")], manifest.schema))
    with pytest.raises(Exception, match="none.json"):
        io.read_reports(spark, more, "name string, mrr double").collect()
    assert io.read_reports(spark, more, "name string, mrr double", missing="null").where("name is null").count() == 1
    (tmp_path / "r" / "0.json").write_text("{")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        io.read_reports(spark, manifest.limit(1), "name string, mrr double").collect()


def test_cut_offs_come_from_the_settings(spark, tmp_path):
    docs = spark.createDataFrame([(i, "fox " * (9 - i) + "den") for i in range(8)], "doc_id long, text string")
    made = R.Index.build(docs, str(tmp_path / "i"))
    qrels = spark.createDataFrame([(1, 3), (1, 6)], "qid long, doc_id long")
    asked = spark.createDataFrame([(1, 0, "den", "fox")], "qid long, idx int, source string, raw string")
    rank = {r["doc_id"]: r["rank"] for r in R.top_k(made, spark.createDataFrame([(1, "fox")], "qid long, text string"), 50).collect()}
    lo, hi = sorted((rank[3], rank[6]))
    got = lambda *k: R.score_rewrites(made, qrels, asked, cfg=scores.RewardConfig(mrr_k=k[0], recall_k=k[1], recall_aux_k=k[2])).first()
    a = got(lo - 1 or 1, lo, hi)
    assert (a["mrr"] > 0) == (lo == 1) and a["recall"] == 0.5 and a["recall_dense"] == 1.0
    b = got(lo, hi, lo)
    assert b["mrr"] == pytest.approx(1 / lo) and b["recall"] == 1.0 and b["recall_dense"] == 0.5
    assert got(0, 0, 0)["recall"] == (0.5 if lo == 1 else 0.0)


def test_an_epoch_without_weighted_items_is_all_in_order(spark):
    items = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), F.lit("DROP").alias("bucket")).repartition(5)
    got = cohort.epoch_sample(items, {"A": 1.0}, "k").orderBy("place").collect()
    assert [(r["place"], r["k"], r["bucket"]) for r in got] == [(i + 1, i, "DROP") for i in range(500)]
