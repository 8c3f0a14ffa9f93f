"""Metrics of training steps: over samples and their groups, and over calls for samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Means of a step over its samples, and the samples' columns they are taken of (fixed names).
MEANS = {
    "reward_mean": "reward", "mrr_mean": "mrr", "recall_mean": "recall", "recall_dense_mean": "recall_dense", "rank_bonus_mean": "rank_bonus", "main_reward_mean": "main_reward",
    "orig_mrr20_mean": "orig_mrr", "rewrite_mrr20_mean": "mrr", "orig_recall20_mean": "orig_recall", "rewrite_recall20_mean": "recall", "rewrite_recall50_mean": "recall_dense",
    "delta_mrr20_mean": "delta_mrr", "delta_recall20_mean": "delta_recall", "delta_recall50_mean": "delta_recall_aux", "orig_rank_bonus_mean": "orig_rank_bonus",
    "delta_rank_bonus_mean": "delta_rank_bonus", "anchor_bonus_mean": "anchor_bonus", "keyword_preserve_mean": "keyword_preserve", "recall_drop_penalty_mean": "recall_drop_penalty",
    "overedit_penalty_mean": "overedit_penalty", "bad_format_penalty_mean": "bad_format_penalty", "unsafe_copy_penalty_mean": "unsafe_copy_penalty",
}
# Shares of samples above 0.
SHARES = {
    "nonzero_reward_ratio": "reward", "nonzero_mrr20_ratio": "mrr", "nonzero_recall20_ratio": "recall", "delta_mrr20_positive_ratio": "delta_mrr",
    "delta_recall20_positive_ratio": "delta_recall", "anchor_hit_ratio": "anchor_bonus", "recall_drop_ratio": "recall_drop_penalty",
}
# Shares of groups, and the flags they count.
GROUP_SHARES = {
    "reward_gap_met_ratio": "gap_met", "max_group_size_hit_ratio": "gap_missed", "collapsed_group_ratio": "collapsed", "all_same_final_query_ratio": "collapsed",
    "flat_reward_group_ratio": "flat_reward", "flat_mrr20_group_ratio": "flat_mrr", "flat_main_reward_group_ratio": "flat_main", "flat_reward_skipped_group_ratio": "flat_skipped",
    "flat_main_reward_skipped_group_ratio": "flat_main_skipped", "trainable_group_ratio": "trainable", "best_reward_hit_best_mrr20_ratio": "best_hits_best",
}
LOSSES = ("loss", "loss_pg", "loss_pg_abs_mean", "loss_kl", "kl_dominance_ratio", "updated")
GROUP_MEANS = ("unique_final_query_mean", "generated_sample_count_mean", "generated_sample_count_max", "extra_sample_ratio", "reward_gap_raw_mean", "adv_mean", "adv_std", "sampled", "valid_samples")


def step_metrics(samples: DataFrame, keys: tuple[str, ...], threshold: float, initial: int, group: str = "grp", query: str = "final_query", idx: str = "idx") -> DataFrame:
    """keys and the metrics MEANS, SHARES, GROUP_SHARES, GROUP_MEANS and LOSSES of the samples of each step.

    samples: one row each, with the columns MEANS names and loss, loss_pg, loss_kl (null: no finite loss). Groups with one
    query only, or one reward only, give no losses; without any loss these are 0 and updated is 0. A group's gap is that of
    its queries' first rewards, 0 under two queries. Advantages are standardised in a group: their mean is 0 and their
    squares follow from its variance. Two sums by group, then one by step; nothing is collected."""
    own = [*keys, group]
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    sums = {c: F.sum(value(c)).alias(f"s_{c}") for c in MEANS.values()}
    above = {c: F.count_if(F.col(c) > 0).alias(f"p_{c}") for c in SHARES.values()}
    flat = lambda c: (F.max(c) == F.min(c))
    valid = F.col("loss").isNotNull()
    g = samples.groupBy(*own).agg(
        F.count(F.lit(1)).alias("n"), *sums.values(), *above.values(), flat("reward").alias("flat_reward"), flat("mrr").alias("flat_mrr"), flat("main_reward").alias("flat_main"),
        F.var_pop("reward").alias("var"), (F.max_by("mrr", F.struct(F.col("reward"), -F.col(idx))) == F.max("mrr")).alias("best_hits_best"), F.count_if(valid).alias("valid"),
        *[F.sum(F.when(valid, F.col(c))).alias(f"s_{c}") for c in ("loss", "loss_pg", "loss_kl")], F.sum(F.when(valid, F.abs("loss_pg"))).alias("s_abs_pg"), F.sum(F.when(valid, F.abs("loss_kl"))).alias("s_abs_kl"))
    firsts = samples.groupBy(*own, query).agg(F.min_by("reward", idx).alias("r")).groupBy(*own).agg(F.count(F.lit(1)).alias("unique"), F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(F.max("r") - F.min("r")).alias("gap"))
    g = g.join(firsts, own).withColumn("collapsed", F.col("unique") == 1).withColumn("gap_met", F.col("gap") >= threshold).withColumn("gap_missed", ~F.col("gap_met"))
    g = g.withColumn("flat_skipped", ~F.col("collapsed") & F.col("flat_reward")).withColumn("flat_main_skipped", F.col("flat_skipped") & F.col("flat_main"))
    g = g.withColumn("trainable", ~F.col("collapsed") & ~F.col("flat_skipped"))
    sd = F.sqrt("var")
    g = g.withColumn("squares", F.when(sd < 1e-8, 0.0).otherwise(F.col("n") * F.col("var") / F.pow(sd + 1e-8, 2)))
    lost = lambda c: F.coalesce(F.sum(F.when(F.col("trainable"), F.col(c))), F.lit(0.0))
    n, groups, valid = F.sum("n"), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("trainable"), F.col("valid"))), F.lit(0))
    mean = lambda total: F.coalesce(F.try_divide(total, F.nullif(valid, F.lit(0))), F.lit(0.0))
    abs_pg, abs_kl = mean(lost("s_abs_pg")), mean(lost("s_abs_kl"))
    return g.groupBy(*keys).agg(
        *[(F.sum(f"s_{c}") / n).alias(m) for m, c in MEANS.items()], *[(F.sum(f"p_{c}") / n).alias(m) for m, c in SHARES.items()],
        *[(F.count_if(c) / groups).alias(m) for m, c in GROUP_SHARES.items()],
        F.avg("unique").alias("unique_final_query_mean"), F.avg("n").alias("generated_sample_count_mean"), F.max("n").cast("double").alias("generated_sample_count_max"),
        (F.sum(F.greatest(F.col("n") - initial, F.lit(0))) / n).alias("extra_sample_ratio"), F.avg("gap").alias("reward_gap_raw_mean"),
        F.lit(0.0).alias("adv_mean"), F.sqrt(F.sum("squares") / n).alias("adv_std"), n.cast("double").alias("sampled"), valid.cast("double").alias("valid_samples"),
        mean(lost("s_loss")).alias("loss"), mean(lost("s_loss_pg")).alias("loss_pg"), abs_pg.alias("loss_pg_abs_mean"), mean(lost("s_loss_kl")).alias("loss_kl"),
        F.when(valid > 0, abs_kl / (abs_pg + abs_kl + 1e-12)).otherwise(0.0).alias("kl_dominance_ratio"), (valid > 0).cast("double").alias("updated"))


def call_stats(calls: DataFrame, keys: tuple[str, ...], prompts: str, queries: Column, group_size: int) -> DataFrame:
    """Statistics of the calls for samples of each step: one row a call with its number of prompts; queries: the step's
    queries (an aggregate). Calls beyond one a member of a group are splits of calls that were too large."""
    n = F.count(F.lit(1))
    return calls.groupBy(*keys).agg(
        F.avg(prompts).alias("rollout_batch_prompt_count_mean"), F.min(prompts).cast("double").alias("rollout_batch_prompt_count_min"), F.max(prompts).cast("double").alias("rollout_batch_prompt_count_max"),
        n.cast("double").alias("rollout_batch_call_count"), F.sum(prompts).cast("double").alias("rollout_batch_total_prompts"),
        (queries * group_size).cast("double").alias("rollout_batch_expected_prompts"), F.greatest(n - group_size, F.lit(0)).cast("double").alias("rollout_batch_fallback_split_count"))
