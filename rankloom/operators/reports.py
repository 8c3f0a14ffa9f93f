"""Reports on rewarded rewrites, and tables of prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Means of a breakdown summary and the scored columns they are taken of; shares of rows above 0 (fixed values).
MEANS = {
    "mrr_mean": "mrr", "recall_mean": "recall", "recall_dense_mean": "recall_aux", "reward_mean": "total", "orig_mrr20_mean": "o_mrr", "rewrite_mrr20_mean": "mrr",
    "orig_recall20_mean": "o_recall", "rewrite_recall20_mean": "recall", "rewrite_recall50_mean": "recall_aux", "delta_mrr20_mean": "delta_mrr", "delta_recall20_mean": "delta_recall",
    "delta_recall50_mean": "delta_recall_aux", "rank_bonus_mean": "rank_bonus", "orig_rank_bonus_mean": "o_rank_bonus", "delta_rank_bonus_mean": "delta_rank_bonus",
    "main_reward_mean": "main_reward", "anchor_bonus_mean": "anchor_bonus", "keyword_preserve_mean": "keyword_preserve", "bad_format_penalty_mean": "bad_format_penalty",
    "unsafe_copy_penalty_mean": "unsafe_copy_penalty", "recall_drop_penalty_mean": "recall_drop_penalty", "overedit_penalty_mean": "overedit_penalty",
}
SHARES = {
    "nonzero_mrr20_ratio": "mrr", "nonzero_recall20_ratio": "recall", "delta_mrr20_positive_ratio": "delta_mrr", "delta_recall20_positive_ratio": "delta_recall",
    "anchor_hit_ratio": "anchor_bonus", "recall_drop_ratio": "recall_drop_penalty",
}


def breakdown_summary(scored: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """22 means, 6 shares of rows above 0 and the count; of no rows at all (without keys) one row of zeros."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    cols = [zero(F.avg(c)).alias(n) for n, c in MEANS.items()] + [zero(F.avg((F.col(c) > 0).cast("int"))).alias(n) for n, c in SHARES.items()]
    cols.append(F.count(F.lit(1)).cast("double").alias("count"))
    return (scored.groupBy(*keys) if keys else scored).agg(*cols)


def grid(patterns: DataFrame) -> DataFrame:
    """Prompts of patterns (code, name, tags, profiles: array of structs with suffix, name, frame and temperature): one for
    each profile of each pattern."""
    p = patterns.withColumn("p", F.explode("profiles"))
    label = F.concat(F.upper("code"), F.lit(" "), F.col("name"), F.lit(" ["), F.col("p.name"), F.lit("]"))
    tags = F.concat(F.array("code"), F.col("tags"), F.array(F.concat(F.lit("frame-"), F.col("p.frame")), F.concat(F.lit("temp-"), F.format_string("%.2f", "p.temperature"))))
    return p.select(F.concat_ws("_", "code", "p.suffix").alias("prompt_id"), label.alias("prompt_name"), tags.alias("tags"), F.col("p.temperature").alias("temperature"))


def pick(specs: DataFrame, key: str, ids: list[str] | None = None, most: int | None = None) -> DataFrame:
    """The specs of the ids, in the order asked for, with their place; an unknown id is an error. Without ids: all, by key."""
    if most is not None and most < 1:
        raise ValueError("at least one")
    if ids is None:
        out = specs.orderBy(key)
        return out if most is None else out.limit(most)
    wanted = specs.sparkSession.createDataFrame(list(enumerate(ids)), f"place long, {key} string")
    unknown = [r[key] for r in wanted.join(specs, key, "left_anti").collect()]  # at most the ids asked for
    if unknown:
        raise ValueError(f"unknown: {', '.join(sorted(unknown))}")
    out = wanted.join(specs, key)
    return out if most is None else out.where(F.col("place") < most)


def rewrite_diagnostics(records: DataFrame) -> DataFrame:
    """Rates and means over stabilised rewrites (the fields of functions.text.stabilized, and source, normalised); zeros of
    none. reasons counts each fallback reason, sorted by name."""
    changed = F.col("final_query") != F.col("source")
    rates = {
        "changed_rate": changed, "effective_rewrite_rate": changed & ~F.col("fallback_to_original"), "fallback_rate": F.col("fallback_to_original"), "raw_format_fail_rate": F.col("raw_format_penalty") > 0,
        "raw_multiline_rate": F.col("raw_multiline"), "raw_think_rate": F.col("raw_contains_think"), "raw_label_rate": F.col("raw_contains_label"),
    }
    zero = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    empty = F.count_if(F.array_contains("fallback_reasons", "empty_after_clean"))  # the only reason there is
    reasons = F.when(empty > 0, F.create_map(F.lit("empty_after_clean"), empty)).otherwise(F.create_map().cast("map<string, bigint>"))
    return records.agg(F.count(F.lit(1)).alias("n"), *[zero(c.cast("int")).alias(n) for n, c in rates.items()], zero("final_overlap").alias("mean_final_overlap"), zero("final_term_count").alias("mean_final_terms"), reasons.alias("fallback_reason_counts"))


def three_way(original: DataFrame, zero: DataFrame, tuned: DataFrame, key: str = "qid") -> DataFrame:
    """The rows of original with zero's and tuned's columns (names must differ); a key that either lacks is an error."""
    for name, other in (("zero", zero), ("tuned", tuned)):
        lost = original.select(key).join(other, key, "left_anti").limit(1).collect()
        if lost:
            raise KeyError(f"{name} has no {key} {lost[0][0]}")
    return original.join(zero, key).join(tuned, key)


def leaderboard(rows: DataFrame, by: list[str], name: str, name_descending: bool = False) -> DataFrame:
    """Adds rank, from 1: by the columns (9 decimals), each from the highest on, then by name. One row a variant."""
    order = [F.desc(F.round(c, 9)) for c in by] + [F.desc(name) if name_descending else F.asc(name)]
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def numeric_first(key: Column) -> list[Column]:
    """Sort keys: whole numbers by value (of any length), then other texts."""
    digits = key.rlike("^[0-9]+$")
    bare = F.regexp_replace(key, "^0+(?=.)", "")
    return [F.when(digits, 0).otherwise(1), F.when(digits, F.length(bare)).otherwise(0), F.when(digits, bare).otherwise(key), key]
