"""Rollout groups: advantages, gaps, flags, nesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def advantages(df: DataFrame, group: str, reward: str, eps: float = 1e-8) -> DataFrame:
    w = Window.partitionBy(group)
    sd = F.stddev_pop(reward).over(w)
    return df.withColumn("advantage", F.when(sd < 1e-8, 0.0).otherwise((F.col(reward) - F.avg(reward).over(w)) / (sd + eps)))


def flags(df: DataFrame, group: str, query: str, reward: str, mrr: str, idx: str) -> DataFrame:
    """collapsed, flat_reward, flat_mrr, reward_gap (over distinct queries, 0 under two), best_reward_hits_best_mrr."""
    distinct = df.groupBy(group, query).agg(F.max(reward).alias("hi"), F.min(reward).alias("lo"))
    gap = distinct.groupBy(group).agg(F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(F.max("hi") - F.min("lo")).alias("reward_gap"), (F.count(F.lit(1)) == 1).alias("collapsed"))
    rest = df.groupBy(group).agg((F.max(reward) == F.min(reward)).alias("flat_reward"), (F.max(mrr) == F.min(mrr)).alias("flat_mrr"), F.max(mrr).alias("top"), F.max_by(mrr, F.struct(F.col(reward), -F.col(idx))).alias("own"))
    return gap.join(rest.select(group, "flat_reward", "flat_mrr", (F.col("own") == F.col("top")).alias("best_reward_hits_best_mrr")), group)


def best(df: DataFrame, group: str, reward: str, idx: str, keep: list[str]) -> DataFrame:
    return df.groupBy(group).agg(F.max_by(F.struct(*keep), F.struct(F.col(reward), -F.col(idx))).alias("x")).select(group, "x.*")


def gap_stop(df: DataFrame, group: str, query: str, reward: str, idx: str, threshold: float, initial: int, most: int) -> DataFrame:
    """How many samples a group takes until max - min of its queries' rewards reaches the threshold (from `initial`, at most
    `most`). A query counts once, with the reward of its first sample; under two different queries the gap is 0."""
    w = Window.partitionBy(group).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy(group, query).orderBy(idx)) == 1
    n = F.row_number().over(Window.partitionBy(group).orderBy(idx))
    own = F.when(F.col("first"), F.col(reward))
    gap = F.when(F.count_if("first").over(w) < 2, 0.0).otherwise(F.max(own).over(w) - F.min(own).over(w))
    run = df.withColumn("first", first).withColumn("n", n).withColumn("gap", gap).where(F.col("n") <= most)
    hit = run.groupBy(group).agg(F.min(F.when((F.col("n") >= initial) & (F.col("gap") >= threshold), F.col("n"))).alias("at"), F.max("n").alias("last"))
    return hit.select(group, F.coalesce("at", "last").alias("generated"), F.col("at").isNotNull().alias("gap_met"), F.when(F.col("at").isNotNull(), "threshold_reached").otherwise("max_group_size_reached").alias("stop_reason"))


def nest(df: DataFrame, group: str, idx: str, cols: list[str]) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(idx, *cols)))
    return df.groupBy(group).agg(rows.alias("r")).select(group, *[F.col(f"r.{c}").alias(f"group_{c}") for c in cols])


def unnest(df: DataFrame, group: str, cols: list[str]) -> DataFrame:
    return df.select(group, F.posexplode(F.arrays_zip(*[F.col(f"group_{c}") for c in cols])).alias("idx", "r")).select(group, "idx", *[F.col(f"r.group_{c}").alias(c) for c in cols])


def reward_gap(df: DataFrame, group: str, query: str, reward: str) -> DataFrame:
    """Highest less lowest reward over a group's different queries; 0 with fewer than two of them."""
    distinct = df.groupBy(group, query).agg(F.max(reward).alias("hi"), F.min(reward).alias("lo"))
    return distinct.groupBy(group).agg(F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(F.max("hi") - F.min("lo")).alias("reward_gap"))


def regenerate(df: DataFrame, group: str, query: str, source: str, polluted: str, idx: str) -> DataFrame:
    """Adds is_duplicate, is_copy and regenerate: rows that repeat an earlier query of the group, are polluted, or copy
    the source (in any case)."""
    again = F.row_number().over(Window.partitionBy(group, query).orderBy(idx)) > 1
    copy = F.lower(F.trim(query)) == F.lower(F.trim(source))
    return df.withColumn("is_duplicate", again).withColumn("is_copy", copy).withColumn("regenerate", F.col("is_duplicate") | F.col("is_copy") | F.col(polluted))


def accept_retry(final: Column, others: Column, polluted: tuple[Column, Column], copied: tuple[Column, Column], fell_back: tuple[Column, Column]) -> Column:
    """Whether a new sample takes the old one's place: a query that no other sample has, or freed of a fault the old one
    had. Pairs are (old, new)."""
    better = lambda p: p[0] & ~p[1]
    return ((final != "") & ~F.array_contains(others, final)) | better(polluted) | better(copied) | better(fell_back)


def skip_reason(collapsed: Column, flat_reward: Column, flat_main: Column, valid_samples: Column) -> Column:
    """Why a group takes no part in an update; null if it does."""
    return F.when(collapsed, "collapsed").when(flat_reward & flat_main, "flat_reward_and_main").when(flat_reward, "flat_reward").when(valid_samples == 0, "no_valid_samples")


def kl_dominance(df: DataFrame, pg: str, kl: str) -> DataFrame:
    """Share of the divergence term in the mean absolute losses; rows without a loss don't count."""
    return df.agg((F.avg(F.abs(kl)) / (F.avg(F.abs(pg)) + F.avg(F.abs(kl)) + 1e-12)).alias("kl_dominance"), F.count(pg).alias("n"))
