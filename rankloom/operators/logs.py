"""Training-log analytics and early stopping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import maybe_float, mean_of, safe_ratio
from ..functions.text import unique_nonempty
from .ranks import placed


def with_step_index(steps: DataFrame) -> DataFrame:
    """Adds global_step_idx, 1 to n by (epoch, step): numbered within each epoch, after the counts of the epochs before."""
    epochs = steps.groupBy("epoch").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("epoch").orderBy("step"))
    return steps.withColumn("_i", inside).join(epochs.select("epoch", before.alias("_before")), "epoch").select(*steps.columns, (F.col("_i") + F.col("_before")).cast("int").alias("global_step_idx"))


# Metrics that older logs have under another name, and that name (fixed names).
FALLBACKS = {
    "rewrite_mrr20_mean": ("mrr_mean",), "rewrite_recall20_mean": ("recall_mean",), "rewrite_recall50_mean": ("recall_dense_mean",), "main_reward_mean": ("reward_mean",),
    "flat_main_reward_group_ratio": ("flat_reward_group_ratio",),
}


def first_present(df: DataFrame, *names: str) -> Column:
    """The first of the columns that df has and that isn't null."""
    return F.coalesce(*[F.col(n) for n in names if n in df.columns], F.lit(None))


def with_fallbacks(df: DataFrame, fallbacks: dict[str, tuple[str, ...]] = FALLBACKS) -> DataFrame:
    """df with each metric filled from its other names where it is null or missing; no column where df has none of them."""
    for name, others in fallbacks.items():
        if {name, *others} & set(df.columns):
            df = df.withColumn(name, first_present(df, name, *others))
    return df


def train_steps(rows: DataFrame) -> DataFrame:
    """Rows of a training log in order: missing epochs and steps count as 0, metrics have their fallbacks, and
    global_step_idx and valid_ratio are added."""
    for c in ("epoch", "step"):
        rows = rows.withColumn(c, F.coalesce(F.col(c).cast("int"), F.lit(0)) if c in rows.columns else F.lit(0))
    ratio = safe_ratio(F.col("valid_samples"), F.col("sampled")) if {"valid_samples", "sampled"} <= set(rows.columns) else F.lit(None).cast("double")
    return with_step_index(with_fallbacks(rows)).withColumn("valid_ratio", ratio)


# Arrays of a group trace and the name of their mean over all samples of a step (fixed values).
SAMPLE_MEANS = {
    "group_rewards": "trace_reward_mean", "group_mrr": "trace_mrr_mean", "group_recall": "trace_recall_mean", "group_recall_dense": "trace_recall_dense_mean",
    "group_orig_mrr": "trace_orig_mrr20_mean", "group_delta_mrr": "trace_delta_mrr20_mean", "group_main_rewards": "trace_main_reward_mean",
    "group_anchor_bonus": "trace_anchor_bonus_mean", "group_recall_drop_penalties": "trace_recall_drop_penalty_mean", "group_overedit_penalties": "trace_overedit_penalty_mean",
    "group_term_preserve": "trace_term_preserve_mean", "group_keyword_preserve": "trace_keyword_preserve_mean", "group_locked_term_preserve": "trace_locked_term_preserve_mean",
    "group_length_scores": "trace_length_score_mean", "group_clean_format_scores": "trace_clean_format_mean", "group_bad_format_penalties": "trace_bad_format_penalty_mean",
    "group_unsafe_copy_penalties": "trace_unsafe_copy_penalty_mean",
}


def group_steps(trace: DataFrame) -> DataFrame:
    """One row of each (epoch, step) of a group trace (a row for each query, an array element for each sample).

    Sample means are sums over sizes of the arrays, so nothing is exploded and sums are taken before the one shuffle.
    Means of nothing are null; missing flags count as false and missing numbers as 0. Older copy penalties stand in for
    unsafe-copy ones only where a step has none of these; a missing flat-main ratio takes the flat-reward one. Arrays
    that the trace lacks give no column."""
    has = set(trace.columns)
    none = F.array().cast("array<double>")
    arr = lambda c: F.coalesce(F.col(c).cast("array<double>"), none) if c in has else none
    total = lambda c: F.sum(F.aggregate(c, F.lit(0.0), lambda a, x: a + x))
    count = lambda c: F.sum(F.size(c))
    positive = lambda c: F.sum(F.size(F.filter(c, lambda x: x > 0)))
    flat = lambda c: (F.array_max(c) == F.array_min(c)).cast("double")
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)).cast("double") if c in has else F.lit(0.0)
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in has else F.lit(0.0)
    rewards, mrr, main = arr("group_rewards"), arr("group_mrr"), arr("group_main_rewards")
    some = F.size(rewards) > 0
    queries = F.coalesce(F.col("group_final_queries"), F.array().cast("array<string>")) if "group_final_queries" in has else F.array().cast("array<string>")
    unique = unique_nonempty(queries)
    fell_back = F.coalesce(F.col("group_fallback_to_original"), F.array().cast("array<boolean>")) if "group_fallback_to_original" in has else F.array().cast("array<boolean>")
    best = F.array_position(rewards, F.array_max(rewards)).cast("int") - 1
    means = [F.try_divide(total(arr(c)), count(arr(c))).alias(n) for c, n in SAMPLE_MEANS.items() if c in has and n != "trace_unsafe_copy_penalty_mean"]
    new, old = arr("group_unsafe_copy_penalties"), arr("group_copy_penalties")
    if has & {"group_unsafe_copy_penalties", "group_copy_penalties"}:
        means.append(F.when(count(new) > 0, F.try_divide(total(new), count(new))).otherwise(F.try_divide(total(old), count(old))).alias("trace_unsafe_copy_penalty_mean"))
    anchor, drop = arr("group_anchor_bonus"), arr("group_recall_drop_penalties")
    flat_reward = F.avg(F.when(some, flat(rewards)))
    out = trace.groupBy("epoch", "step").agg(
        F.count(F.lit(1)).alias("qid_rows"), *means,
        F.avg(F.when(some, mean_of(rewards))).alias("trace_row_reward_mean_avg"), F.avg(F.when(some, F.array_max(rewards))).alias("trace_row_reward_max_avg"),
        F.avg(unique).alias("trace_unique_final_query_mean"), F.avg((unique <= 1).cast("double")).alias("trace_all_same_final_query_ratio"),
        F.avg(F.when(F.size(fell_back) > 0, F.size(F.filter(fell_back, lambda x: x)) / F.greatest(F.size(fell_back), F.lit(1)))).alias("trace_fallback_ratio"),
        flat_reward.alias("trace_flat_reward_group_ratio"), F.avg(F.when(some & (F.size(mrr) > 0), flat(mrr))).alias("trace_flat_mrr20_group_ratio"),
        F.coalesce(F.avg(F.when(some & (F.size(main) > 0), flat(main))), flat_reward).alias("trace_flat_main_reward_group_ratio"),
        F.avg(F.when(some & (F.size(mrr) > 0), (F.get(mrr, best) == F.array_max(mrr)).cast("double"))).alias("trace_best_reward_hit_best_mrr20_ratio"),
        F.try_divide(positive(anchor), count(anchor)).alias("trace_anchor_hit_ratio"), F.try_divide(positive(drop), count(drop)).alias("trace_recall_drop_ratio"),
        F.avg(flag("collapsed_group")).alias("collapsed_group_ratio"), F.avg(flag("reward_gap_met")).alias("reward_gap_met_ratio"),
        F.avg(F.coalesce(F.col("reward_gap_stop_reason") == "max_group_size_reached", F.lit(False)).cast("double") if "reward_gap_stop_reason" in has else F.lit(0.0)).alias("max_group_size_hit_ratio"),
        F.avg(number("reward_gap_raw")).alias("reward_gap_raw_mean"), F.avg(number("reward_gap_threshold")).alias("reward_gap_threshold_mean"),
        F.avg(number("initial_group_size")).alias("initial_group_size_mean"), F.avg(number("generated_sample_count")).alias("generated_sample_count_mean"),
        F.avg(number("extra_sample_count")).alias("extra_sample_count_mean"), F.try_divide(F.sum(number("extra_sample_count")), F.sum(number("generated_sample_count"))).alias("extra_sample_ratio"))
    return with_step_index(out)


def merge_steps(left: DataFrame, right: DataFrame, order: str = "global_step_idx") -> DataFrame:
    """left with right's columns of the same (epoch, step). Where a row matches, right's values stand for left's, nulls
    too. Of right's rows with one key the last counts: that of the highest `order` if it has that column, else of the
    highest values; so left's rows never multiply."""
    rest = [c for c in right.columns if c not in ("epoch", "step")]
    last = F.struct(*[c for c in (order, *rest) if c in rest])
    r = right.groupBy("epoch", "step").agg(F.max_by(F.struct(*rest), last).alias("_r"), F.lit(True).alias("_hit"))
    out = left.join(r, ["epoch", "step"], "left")
    old = [F.when(F.col("_hit"), F.col(f"_r.{c}")).otherwise(F.col(c)).alias(c) if c in rest else F.col(c) for c in left.columns]
    return out.select(*old, *[F.col(f"_r.{c}").alias(c) for c in rest if c not in left.columns])


def pearson(x: str, y: str) -> Column:
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.when(F.count(a) >= 2, F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))))


def trend_thirds(df: DataFrame, metric: str, order: str) -> DataFrame:
    """Means of the first and the last third (at least one) of the values that aren't null, and their difference."""
    rows = placed(df.where(F.col(metric).isNotNull()).select(metric, order), [F.col(order)], "_i")
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    third = F.greatest(F.floor(F.col("_n") / 3), F.lit(1))
    out = rows.crossJoin(F.broadcast(n)).agg(F.avg(F.when(F.col("_i") <= third, F.col(metric))).alias("first_third"), F.avg(F.when(F.col("_i") > F.col("_n") - third, F.col(metric))).alias("last_third"))  # one row
    return out.withColumn("change", F.col("last_third") - F.col("first_third"))


def best_row(df: DataFrame, metric: str, order: str, keep: list[str], maximize: bool = True) -> DataFrame:
    value = F.col(metric) if maximize else -F.col(metric)
    return df.where(F.col(metric).isNotNull()).agg(F.max_by(F.struct(*keep), F.struct(value, -F.col(order))).alias("x")).select("x.*")


# What a summary of a log has of the merged steps (fixed names): means, pairs whose correlation tells whether both logs
# agree, rows of the highest and the lowest value, and first and last thirds.
SUMMARY_MEANS = (
    "mrr_mean", "trace_mrr_mean", "rewrite_mrr20_mean", "trace_orig_mrr20_mean", "delta_mrr20_positive_ratio", "flat_main_reward_group_ratio", "best_reward_hit_best_mrr20_ratio",
    "anchor_bonus_mean", "trace_anchor_bonus_mean", "recall_drop_penalty_mean", "trace_recall_drop_penalty_mean", "anchor_hit_ratio", "trace_anchor_hit_ratio", "recall_drop_ratio",
    "trace_recall_drop_ratio", "recall_mean", "trace_recall_mean", "recall_dense_mean", "trace_recall_dense_mean", "term_preserve_mean", "trace_term_preserve_mean", "length_score_mean",
    "trace_length_score_mean", "bad_format_penalty_mean", "trace_bad_format_penalty_mean", "unsafe_copy_penalty_mean", "trace_unsafe_copy_penalty_mean", "unique_final_query_mean",
    "trace_unique_final_query_mean", "collapsed_group_ratio", "reward_gap_met_ratio", "max_group_size_hit_ratio", "generated_sample_count_mean", "extra_sample_ratio", "valid_ratio",
    "loss", "loss_pg", "loss_kl",
)
SUMMARY_PAIRS = {
    "reward_alignment_corr": ("reward_mean", "trace_reward_mean"), "mrr_alignment_corr": ("mrr_mean", "trace_mrr_mean"), "recall_alignment_corr": ("recall_mean", "trace_recall_mean"),
    "recall_dense_alignment_corr": ("recall_dense_mean", "trace_recall_dense_mean"), "term_preserve_alignment_corr": ("term_preserve_mean", "trace_term_preserve_mean"),
}
SUMMARY_BEST = {
    "best_train_reward_mean": ("reward_mean", 1), "best_trace_reward_mean": ("trace_reward_mean", 1), "best_train_mrr_mean": ("mrr_mean", 1), "best_train_rewrite_mrr20_mean": ("rewrite_mrr20_mean", 1),
    "lowest_flat_main_reward_group_ratio": ("flat_main_reward_group_ratio", -1), "best_trace_unique_final_query_mean": ("trace_unique_final_query_mean", 1),
    "highest_gap_met_ratio": ("reward_gap_met_ratio", 1), "lowest_collapsed_group_ratio": ("collapsed_group_ratio", -1), "loss_min": ("loss", -1),
}
SUMMARY_TRENDS = ("reward_mean", "trace_reward_mean", "trace_unique_final_query_mean", "valid_ratio")


def log_summary(train: DataFrame, trace: DataFrame, merged: DataFrame) -> DataFrame:
    """One row on a run's logs: counts, sorted epochs, lowest and highest step, correlations, best rows (struct of epoch,
    step, global_step_idx, value; the first of equals), averages and trends, both as structs. Values that aren't numbers
    don't count; a metric that the steps lack, or without any number, is null.

    One aggregate over the merged steps, and one numbering for each trend."""
    number = lambda c: maybe_float(F.col(c)) if c in merged.columns else F.lit(None).cast("double")
    names = {*SUMMARY_MEANS, *SUMMARY_TRENDS, "reward_mean", "trace_reward_mean", *[c for p in SUMMARY_PAIRS.values() for c in p], *[c for c, _ in SUMMARY_BEST.values()]}
    m = merged.select("epoch", "step", "global_step_idx", *[number(c).alias(c) for c in sorted(names)])
    row = lambda c: F.struct("epoch", "step", "global_step_idx", F.col(c).alias("value"))
    best = {n: F.max_by(F.when(F.col(c).isNotNull(), row(c)), F.when(F.col(c).isNotNull(), F.struct(F.col(c) * way, -F.col("global_step_idx")))) for n, (c, way) in SUMMARY_BEST.items()}
    out = m.agg(
        F.count(F.lit(1)).alias("aligned_steps"), F.min("step").alias("step_min"), F.max("step").alias("step_max"), F.avg("reward_mean").alias("reward_mean_avg"), F.avg("trace_reward_mean").alias("trace_reward_mean_avg"),
        *[pearson(*p).alias(n) for n, p in SUMMARY_PAIRS.items()], *[x.alias(n) for n, x in best.items()], F.struct(*[F.avg(c).alias(c) for c in SUMMARY_MEANS]).alias("averages"))
    counted = lambda df, n: df.agg(F.count(F.lit(1)).alias(f"{n}_rows"), F.array_sort(F.collect_set(F.coalesce(F.col("epoch").cast("int"), F.lit(0)))).alias(f"{n}_epochs"))  # noqa: E731  (epochs are few)
    out = counted(train, "train").crossJoin(counted(trace, "group")).crossJoin(out)  # one row each
    for c in SUMMARY_TRENDS:
        out = out.crossJoin(trend_thirds(m, c, "global_step_idx").select(F.col("first_third").alias(f"_{c}_early"), F.col("last_third").alias(f"_{c}_late")))
    trends = [f"{c}_{x}" for c in SUMMARY_TRENDS for x in ("early", "late")]
    return out.withColumn("trend_first_last_third", F.struct(*[F.col(f"_{t}").alias(t) for t in trends])).drop(*[f"_{t}" for t in trends])


def early_stop(df: DataFrame, run: str, order: str, metric: str, threshold: float = 0.01, patience: int = 2, warmup: int = 3) -> DataFrame:
    """State after each evaluation of a run, in order (then by metric); evaluations without a metric don't count.

    new best, then equal to the best, then warm-up, then a drop of at least the threshold (streak + 1), else within
    tolerance; it stops once past warm-up the streak reaches patience. Rows after a stop are still reported. Running
    windows: a run's rows are sorted, but never held as one array."""
    rows = df.where(F.col(metric).isNotNull()).select(run, F.col(order).cast("long").alias(order), F.col(metric).cast("double").alias(metric))
    by = Window.partitionBy(run).orderBy(order, metric)
    m, before = F.col(metric), F.col("_before")
    rows = rows.withColumn("_n", F.row_number().over(by)).withColumn("_before", F.max(metric).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    fell = before.isNotNull() & (m < before) & (F.col("_n") > warmup) & (before - m >= threshold)
    rows = rows.withColumn("_fell", fell).withColumn("_calm", F.count_if(~F.col("_fell")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.when(F.col("_fell"), F.row_number().over(Window.partitionBy(run, "_calm", "_fell").orderBy(order, metric))).otherwise(0).cast("int")
    rows = rows.withColumn("streak", streak)
    stop = F.col("_fell") & (F.col("streak") >= patience)
    reason = F.when(before.isNull() | (m > before), "new_best").when(m == before, "matched_best").when(F.col("_n") <= warmup, "warmup_baseline").when(stop, "significant_drop_stop").when(F.col("_fell"), "significant_drop").otherwise("within_tolerance")
    best, drop = F.greatest(m, before), F.coalesce(F.greatest(F.lit(0.0), before - m), F.lit(0.0))
    return rows.select(run, order, metric, best.alias("best"), drop.alias("drop"), "streak", stop.alias("should_stop"), reason.alias("reason"))
