"""Literal rows for text functions, scores, cohorts, groups and early stopping."""

import pytest
from pyspark.sql import functions as F

from rankloom.functions import scores
from rankloom.functions import text as T
from rankloom.operators import cohort, groups, logs
from rankloom.streaming.logs import decide


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_term_preserve(spark):
    v = {"s": "COPD home treatment without oxygen 2024", "r": "copd treatment oxygen"}
    s, r = F.col("s"), F.col("r")
    assert one(spark, T.keyword_preserve(s, r), **v) == pytest.approx(2 / 3)
    assert one(spark, T.locked_preserve(s, r), **v) == pytest.approx(1 / 3)
    assert one(spark, T.term_preserve(s, r), **v) == pytest.approx(0.5)
    v = {"s": "best budget gaming laptop", "r": "gaming laptop deals"}
    assert one(spark, T.term_preserve(s, r), **v) == pytest.approx(0.75)


@pytest.mark.parametrize("n,score", [(1, 0), (3, 2 / 3), (4, 1), (12, 1), (19, 0.125), (20, 0)])
def test_length_score(spark, n, score):
    assert one(spark, T.length_score(F.col("t")), t=" ".join(["w"] * n)) == pytest.approx(score)


@pytest.mark.parametrize("text,penalty", [("", 1.0), ("best laptop\nbudget laptop", 0.5), ("because this query is better", 0.5)])
def test_bad_format(spark, text, penalty):
    assert one(spark, T.bad_format_penalty(F.col("t")), t=text) == pytest.approx(penalty)


def test_bad_format_token_cap(spark):
    # five tokens over a cap of three, and digits don't count as letters
    assert one(spark, T.bad_format_penalty(F.col("t"), most_tokens=3), t="best budget gaming laptop 2024") == pytest.approx(0.06)


def test_unsafe_copy(spark):
    f = T.unsafe_copy_penalty(F.col("s"), F.col("s"))
    assert one(spark, f, s="what is the best laptop?") == 1.0
    assert one(spark, f, s="best budget laptop") == 0.0


@pytest.mark.parametrize("rank,bonus", [(1, 1), (3, 0.8), (5, 0.5), (10, 0.3), (20, 0.15), (50, 0.05), (80, 0), (None, 0)])
def test_rank_bonus(spark, rank, bonus):
    assert one(spark, scores.rank_bonus(F.col("r").cast("int")), r=rank) == pytest.approx(bonus)


def test_penalties(spark):
    assert one(spark, scores.overedit_penalty(F.col("k"), 0.45), k=0.10) == pytest.approx(0.35)
    assert one(spark, scores.recall_drop_penalty(F.lit(0.5), F.col("k"), 0.8), k=0.25) == pytest.approx(0.20)
    assert one(spark, scores.anchor_bonus(F.lit(0.5), F.lit(0.5), F.lit(0.5), F.col("k"), 0.05), k=0.5) == 0.0
    assert one(spark, scores.anchor_bonus(F.lit(0.6), F.lit(0.5), F.lit(0.5), F.col("k"), 0.05), k=0.5) == 0.05


@pytest.mark.parametrize(
    "raw,source,best",
    [
        ("Search Query:\n  best budget gaming laptop 2024\n\nExplanation: it is short", "best gaming laptop", "best budget gaming laptop 2024"),
        ("finderscope\n\nExample\nUser query: what is a finderscope", "what is finderscope", "finderscope"),
        ("1. androgen receptor", "androgen receptor", "androgen receptor"),
        ("", "x", ""),
    ],
)
def test_clean_query(spark, raw, source, best):
    assert one(spark, T.clean_query(F.col("r"), F.col("s")), r=raw, s=source) == best


def test_stabilized_falls_back(spark):
    x = one(spark, T.stabilized(F.col("r"), F.col("s")), r="", s="  best   laptop ")
    assert x["fallback_to_original"] and x["final_query"] == "best laptop" and x["fallback_reasons"] == ["empty_after_clean"]


def test_clipped_objective(spark):
    import math

    new, old = F.array(F.lit(math.log(0.75)), F.lit(math.log(0.25))), F.array(F.lit(math.log(0.5)), F.lit(math.log(0.5)))
    assert one(spark, scores.clipped_objective(new, old, F.col("a")), a=1.0) == pytest.approx([1.2, 0.5])


def test_quotas(spark):
    w = spark.createDataFrame([("A", 0.65), ("B", 0.25), ("C", 0.10)], "bucket string, weight double")
    assert {r["bucket"]: r["quota"] for r in cohort.quotas(w, 10).collect()} == {"A": 7, "B": 2, "C": 1}


def test_split_is_a_partition(spark):
    rows = cohort.split(spark.range(10).withColumnRenamed("id", "k"), "k", 0.8).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in rows} == {"train": 8, "validation": 2}
    with pytest.raises(ValueError):
        cohort.split(spark.range(3), "id", 1.5)


def test_buckets(spark):
    df = spark.createDataFrame([(0.10, 1.0, False), (0.40, 1.0, False), (0.0, 0.0, True), (0.0, 0.0, False)], "m double, r double, l boolean")
    assert [x["b"] for x in df.select(cohort.bucket(F.col("m"), F.col("r"), F.col("l")).alias("b")).collect()] == ["A", "C", "B", "DROP"]


def test_advantages(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 2.0), (2, 1.0), (2, 1.0)], "g int, r double")
    got = [round(x["advantage"], 4) for x in groups.advantages(df, "g", "r").orderBy("g", "r").collect()]
    assert got == [-1.2247, 0.0, 1.2247, 0.0, 0.0]


def test_gap_stop(spark):
    df = spark.createDataFrame([(1, "a", 0.1, 0), (1, "b", 0.1, 1), (1, "c", 0.1, 2), (1, "d", 0.5, 3)], "g int, q string, r double, i int")
    row = groups.gap_stop(df, "g", "q", "r", "i", 0.2, 2, 8).first()
    assert (row["generated"], row["gap_met"]) == (4, True)


def test_early_stop_batch_equals_stream_step(spark):
    values = [0.5, 0.488, 0.487, 0.49, 0.48]
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "run string, step long, m double")
    got = [(r["streak"], r["should_stop"], r["reason"]) for r in logs.early_stop(df, "run", "step", "m").orderBy("step").collect()]
    want, best, streak = [], None, 0
    for n, v in enumerate(values, 1):
        best, streak, stop, reason = decide(best, streak, n, v, 0.01, 2, 3)
        want.append((streak, stop, reason))
    assert got == want and got[-1] == (2, True, "significant_drop_stop")


def test_pearson_without_variance(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(logs.pearson("x", "y").alias("r")).first()["r"] is None
