"""Queries on training metrics, log summaries and run settings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import config, logs, training
from ..streaming import logs as stream
from .registry import drained, event_log, io, query, table
from .rollouts import traces

# ---- samples of a step: events by day and quarter, groups by user ------------------------------

# Columns of a sample, as SQL and as a Spark expression alike.
SAMPLE = {
    "reward": "round(value, 4)", "mrr": "round(value * 0.5 + event_id % 7, 4)", "recall": "(event_id % 5) / 8.0D", "recall_dense": "(event_id % 9) / 8.0D", "rank_bonus": "(event_id % 3) / 4.0D",
    "main_reward": "floor(value / 10)", "orig_mrr": "(user_id % 4) / 4.0D", "orig_recall": "(user_id % 3) / 4.0D", "delta_mrr": "(event_id % 5 - 2) / 4.0D", "delta_recall": "(event_id % 3 - 1) / 2.0D",
    "delta_recall_aux": "(event_id % 7 - 3) / 8.0D", "orig_rank_bonus": "(user_id % 2) / 2.0D", "delta_rank_bonus": "(event_id % 3 - user_id % 2) / 4.0D", "anchor_bonus": "greatest(0, event_id % 4 - 2) / 4.0D",
    "keyword_preserve": "(event_id % 6) / 8.0D", "recall_drop_penalty": "greatest(0, 2 - event_id % 4) / 8.0D", "overedit_penalty": "(event_id % 10) / 16.0D", "bad_format_penalty": "(event_id % 12) / 16.0D",
    "unsafe_copy_penalty": "(event_id % 2) / 1.0D",
}
LOSS = {"loss_pg": "(event_id % 11 - 5) / 8.0D", "loss_kl": "(event_id % 13 - 4) / 16.0D"}
in_sql = lambda x: x.replace(".0D", ".0::DOUBLE")
EPOCH, STEP = "datediff(to_date(ts), DATE '1970-01-01')", "hour(ts) div 6"


def samples(spark, d):
    e = table(spark, d, "events").where("value is not null")
    lossy = "event_id % 17 = 0"
    cols = [f"{x} as {c}" for c, x in SAMPLE.items()] + [f"case when {lossy} then null else {x} end as {c}" for c, x in LOSS.items()]
    e = e.selectExpr(f"{EPOCH} as epoch", f"cast({STEP} as int) as step", "user_id % 40 as grp", "event_id as idx", "event_type as final_query", *cols)
    return e.withColumn("loss", F.col("loss_pg") + F.col("loss_kl"))


S = f"""WITH s AS (SELECT date_diff('day', DATE '1970-01-01', ts::DATE)::INT AS epoch, (hour(ts) // 6)::INT AS step, user_id % 40 AS grp, event_id AS idx, event_type AS fq, {', '.join(f'{in_sql(x)} AS {c}' for c, x in SAMPLE.items())},
  {', '.join(f'CASE WHEN event_id % 17 > 0 THEN {in_sql(x)} END AS {c}' for c, x in LOSS.items())} FROM events WHERE value IS NOT NULL),
f AS (SELECT epoch, step, grp, fq, arg_min(reward, idx) AS r FROM s GROUP BY ALL), u AS (SELECT epoch, step, grp, count(*) AS uq, CASE WHEN count(*) < 2 THEN 0 ELSE max(r) - min(r) END AS gap FROM f GROUP BY ALL),
g AS (SELECT epoch, step, grp, count(*) AS n, max(reward) = min(reward) AS fr, max(mrr) = min(mrr) AS fm, max(main_reward) = min(main_reward) AS fa, first(mrr ORDER BY reward DESC, idx) = max(mrr) AS bh FROM s GROUP BY ALL),
w AS (SELECT *, uq = 1 AS co, gap >= 30 AS met FROM g JOIN u USING (epoch, step, grp)),
a AS (SELECT s.*, CASE WHEN stddev_pop(reward) OVER p < 1e-8 THEN 0 ELSE (reward - avg(reward) OVER p) / (stddev_pop(reward) OVER p + 1e-8) END AS adv, co, fr, NOT co AND NOT fr AND loss_pg IS NOT NULL AS used FROM s JOIN w USING (epoch, step, grp) WINDOW p AS (PARTITION BY epoch, step, grp)),
m AS (SELECT epoch, step, {', '.join(f'avg({c}) AS {m}' for m, c in training.MEANS.items())}, {', '.join(f'avg(({c} > 0)::INT) AS {m}' for m, c in training.SHARES.items())},
  avg(adv) AS adv_mean, stddev_pop(adv) AS adv_std, count(*)::DOUBLE AS sampled, count(*) FILTER (used)::DOUBLE AS valid_samples, coalesce(avg(loss_pg + loss_kl) FILTER (used), 0) AS loss, coalesce(avg(loss_pg) FILTER (used), 0) AS loss_pg,
  coalesce(avg(abs(loss_pg)) FILTER (used), 0) AS loss_pg_abs_mean, coalesce(avg(loss_kl) FILTER (used), 0) AS loss_kl, coalesce(avg(abs(loss_kl)) FILTER (used) / (avg(abs(loss_pg)) FILTER (used) + avg(abs(loss_kl)) FILTER (used) + 1e-12), 0) AS kl_dominance_ratio,
  (count(*) FILTER (used) > 0)::INT::DOUBLE AS updated FROM a GROUP BY epoch, step),
h AS (SELECT epoch, step, avg(met::INT) AS reward_gap_met_ratio, avg((NOT met)::INT) AS max_group_size_hit_ratio, avg(co::INT) AS collapsed_group_ratio, avg(co::INT) AS all_same_final_query_ratio, avg(fr::INT) AS flat_reward_group_ratio,
  avg(fm::INT) AS flat_mrr20_group_ratio, avg(fa::INT) AS flat_main_reward_group_ratio, avg((NOT co AND fr)::INT) AS flat_reward_skipped_group_ratio, avg((NOT co AND fr AND fa)::INT) AS flat_main_reward_skipped_group_ratio,
  avg((NOT co AND NOT fr)::INT) AS trainable_group_ratio, avg(bh::INT) AS best_reward_hit_best_mrr20_ratio, avg(uq) AS unique_final_query_mean, avg(n) AS generated_sample_count_mean, max(n)::DOUBLE AS generated_sample_count_max,
  sum(greatest(0, n - 2))::DOUBLE / sum(n) AS extra_sample_ratio, avg(gap) AS reward_gap_raw_mean FROM w GROUP BY epoch, step)"""
STEP_METRICS = [*training.MEANS, *training.SHARES, *training.GROUP_SHARES, *training.GROUP_MEANS, *training.LOSSES]
query(S + f" SELECT epoch, step, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in STEP_METRICS)} FROM m JOIN h USING (epoch, step)", "train_step_metrics")(
    lambda s, d: training.step_metrics(samples(s, d), ("epoch", "step"), 30.0, 2).select("epoch", "step", *[(F.round(c, 6) + 0.0).alias(c) for c in STEP_METRICS]))
CALLS = [f"rollout_batch_{x}" for x in ("prompt_count_mean", "prompt_count_min", "prompt_count_max", "call_count", "total_prompts", "expected_prompts", "fallback_split_count")]
query("""SELECT o_orderpriority AS step, round(avg(o_orderkey % 5 + 1), 6) AS rollout_batch_prompt_count_mean, min(o_orderkey % 5 + 1)::DOUBLE AS rollout_batch_prompt_count_min, max(o_orderkey % 5 + 1)::DOUBLE AS rollout_batch_prompt_count_max,
  count(*)::DOUBLE AS rollout_batch_call_count, sum(o_orderkey % 5 + 1)::DOUBLE AS rollout_batch_total_prompts, (count(DISTINCT o_custkey) * 4)::DOUBLE AS rollout_batch_expected_prompts, greatest(0, count(*) - 4)::DOUBLE AS rollout_batch_fallback_split_count
FROM orders GROUP BY 1""", "rollout_call_stats")(
    lambda s, d: training.call_stats(table(s, d, "orders").select(F.col("o_orderpriority").alias("step"), (F.col("o_orderkey") % 5 + 1).alias("n"), "o_custkey"), ("step",), "n", F.count_distinct("o_custkey"), 4).withColumn(CALLS[0], F.round(CALLS[0], 6)))

# ---- logs -------------------------------------------------------------------------------------

RAW = """WITH r AS (SELECT date_diff('day', DATE '1970-01-01', ts::DATE)::INT AS epoch, (hour(ts) // 6)::INT AS step, avg(value) AS reward_mean, avg(value * 0.5 + event_id % 7) AS mrr_mean, count(*)::DOUBLE AS sampled, count(*) FILTER (value > 40)::DOUBLE AS valid_samples, avg(abs(value - 50)) AS loss FROM events WHERE value IS NOT NULL GROUP BY ALL),
t AS (SELECT *, CASE WHEN step = 1 THEN reward_mean + 1 END AS old_main FROM r),
l AS (SELECT *, row_number() OVER (ORDER BY epoch, step)::INT AS global_step_idx, CASE WHEN step > 0 THEN mrr_mean END AS recall_mean, coalesce(old_main, reward_mean) AS main_reward_mean, valid_samples / nullif(sampled, 0) AS valid_ratio FROM t)"""


def train_log(spark, d):
    """A log of older and newer names: main_reward_mean only here and there, no names of the rewrites' metrics."""
    e = table(spark, d, "events").where("value is not null").selectExpr(f"{EPOCH} as epoch", f"cast({STEP} as int) as step", "value", "event_id")
    rows = e.groupBy("epoch", "step").agg(F.avg("value").alias("reward_mean"), F.avg(F.col("value") * 0.5 + F.col("event_id") % 7).alias("mrr_mean"), F.count(F.lit(1)).cast("double").alias("sampled"), F.count_if(F.col("value") > 40).cast("double").alias("valid_samples"), F.avg(F.abs(F.col("value") - 50)).alias("loss"))
    return rows.withColumn("main_reward_mean", F.when(F.col("step") == 1, F.col("reward_mean") + 1)).withColumn("recall_mean", F.when(F.col("step") > 0, F.col("mrr_mean").cast("string")).otherwise("n/a"))


ALIASED = ["rewrite_mrr20_mean", "main_reward_mean", "valid_ratio"]
query(RAW + " SELECT epoch, step, global_step_idx, round(mrr_mean, 6) AS rewrite_mrr20_mean, round(main_reward_mean, 6) AS main_reward_mean, round(valid_ratio, 6) AS valid_ratio FROM l", "train_steps_aliases")(
    lambda s, d: logs.train_steps(train_log(s, d)).select("epoch", "step", "global_step_idx", *[F.round(c, 6).alias(c) for c in ALIASED]))
TRACE = """, e AS (SELECT date_diff('day', DATE '1970-01-01', ts::DATE)::INT AS epoch, (hour(ts) // 6)::INT AS step, user_id % 3 AS kind, event_id, round(value, 4) AS r, round(value * 0.5 + event_id % 7, 4) AS m, event_type AS q, greatest(0, event_id % 5 - 2)::DOUBLE AS a FROM events WHERE value IS NOT NULL),
ts AS (SELECT epoch, step, avg(r) AS trace_reward_mean, avg(m) FILTER (kind > 0) AS trace_mrr_mean, avg(a) AS trace_anchor_bonus_mean, avg((a > 0)::INT) AS trace_anchor_hit_ratio FROM e GROUP BY ALL),
tk AS (SELECT epoch, step, kind, count(*) AS n, count(DISTINCT q) AS u FROM e GROUP BY ALL), tg AS (SELECT epoch, step, avg(u) AS trace_unique_final_query_mean, avg((kind = 1)::INT) AS collapsed_group_ratio, avg(n) AS generated_sample_count_mean FROM tk GROUP BY epoch, step),
x AS (SELECT * FROM l JOIN ts USING (epoch, step) JOIN tg USING (epoch, step)), c AS (SELECT *, count(*) OVER () AS n FROM x)"""
AVERAGES = ["mrr_mean", "trace_mrr_mean", "rewrite_mrr20_mean", "trace_anchor_bonus_mean", "trace_anchor_hit_ratio", "recall_mean", "trace_unique_final_query_mean", "collapsed_group_ratio", "generated_sample_count_mean", "valid_ratio", "loss"]
BEST = {"best_train_reward_mean": "reward_mean DESC", "best_trace_reward_mean": "trace_reward_mean DESC", "best_train_rewrite_mrr20_mean": "mrr_mean DESC", "lowest_collapsed_group_ratio": "collapsed_group_ratio", "loss_min": "loss"}
TRENDS = ["reward_mean", "trace_reward_mean", "trace_unique_final_query_mean", "valid_ratio"]
LOG_SQL = RAW + TRACE + f""" SELECT (SELECT count(*) FROM r) AS train_rows, (SELECT count(*) FROM tk) AS group_rows, (SELECT array_to_string(list_sort(list_distinct(list(epoch))), ',') FROM r) AS train_epochs, count(*) AS aligned_steps, min(step) AS step_min, max(step) AS step_max,
  round(corr(reward_mean, trace_reward_mean), 6) AS reward_alignment_corr, round(corr(mrr_mean, trace_mrr_mean), 6) AS mrr_alignment_corr, NULL::DOUBLE AS recall_alignment_corr,
  {', '.join(f"first(global_step_idx ORDER BY {o}, global_step_idx)::INT AS {n}" for n, o in BEST.items())},
  {', '.join(f"round(avg({'mrr_mean' if a == 'rewrite_mrr20_mean' else a}), 6) AS avg_{a}" for a in AVERAGES)}, NULL::DOUBLE AS avg_loss_kl,
  {', '.join(f"round(avg({t}) FILTER (global_step_idx <= greatest(n // 3, 1)), 6) AS {t}_early, round(avg({t}) FILTER (global_step_idx > n - greatest(n // 3, 1)), 6) AS {t}_late" for t in TRENDS)} FROM c"""


@query(LOG_SQL)
def log_summary_full(spark, d):
    trace, log = traces(spark, d), train_log(spark, d)
    out = logs.log_summary(log, trace, logs.merge_steps(logs.train_steps(log), logs.group_steps(trace)))
    rounded = lambda c, n: F.round(c, 6).alias(n)
    return out.select(
        "train_rows", "group_rows", F.array_join(F.col("train_epochs").cast("array<string>"), ",").alias("train_epochs"), "aligned_steps", "step_min", "step_max",
        *[rounded(c, c) for c in ("reward_alignment_corr", "mrr_alignment_corr", "recall_alignment_corr")], *[F.col(f"{n}.global_step_idx").alias(n) for n in BEST],
        *[rounded(f"averages.{a}", f"avg_{a}") for a in (*AVERAGES, "loss_kl")], *[rounded(f"trend_first_last_third.{t}_{x}", f"{t}_{x}") for t in TRENDS for x in ("early", "late")])


# ---- settings ---------------------------------------------------------------------------------

CONFIG = """WITH c AS (SELECT DISTINCT l_linenumber AS run FROM lineitem)
SELECT run::INT AS run, greatest(1, run - 3)::INT AS num_epochs, greatest(2, run - 1)::INT AS group_size, greatest(4, greatest(2, run - 1))::INT AS max_group_size, CASE WHEN run > 1 THEN greatest(1, run - 4) END::INT AS max_steps,
  greatest(0, (run - 3) / 4.0::DOUBLE) AS reward_gap_threshold, run / 8.0::DOUBLE AS train_ratio, 'phase' || (1 + run % 2)::VARCHAR AS curriculum_phase,
  array_to_string(list_filter([CASE WHEN run < 4 THEN 'num_epochs' END, CASE WHEN run < 3 THEN 'group_size' END, CASE WHEN run < 3 THEN 'reward_gap_threshold' END, CASE WHEN run > 1 AND run < 5 THEN 'max_steps' END, CASE WHEN run > 5 THEN 'max_group_size' END], lambda x: x IS NOT NULL), ',') AS repaired FROM c"""


@query(CONFIG)
def config_clamp(spark, d):
    n = F.col("run")
    runs = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("int").alias("run")).distinct()
    runs = runs.select("run", (n - 3).alias("num_epochs"), (n - 1).alias("group_size"), F.lit(4).alias("max_group_size"), F.when(n > 1, n - 4).alias("max_steps"), ((n - 3) / 4.0).alias("reward_gap_threshold"), (n / 8.0).alias("train_ratio"), F.concat(F.lit("phase"), (1 + n % 2).cast("string")).alias("curriculum_phase"))
    return config.clamp(runs).withColumn("repaired", F.array_join("repaired", ","))


query("SELECT o_orderkey, coalesce(CASE WHEN o_custkey % 3 = 0 THEN 0.1 END, CASE WHEN o_custkey % 3 = 1 THEN 0.2 END, 0.8)::DOUBLE AS temperature, CASE WHEN o_custkey % 2 = 0 THEN 'p06_strict' ELSE 'p' || (o_custkey % 10)::VARCHAR END AS prompt_id FROM orders", "decode_settings")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", config.first_given(F.when(F.col("o_custkey") % 3 == 0, 0.1), F.when(F.col("o_custkey") % 3 == 1, 0.2), F.lit(0.8)).alias("temperature"), config.upgraded(F.when(F.col("o_custkey") % 2 == 0, "p05_demo").otherwise(F.concat(F.lit("p"), (F.col("o_custkey") % 10).cast("string"))), "p05_demo", "p06_strict").alias("prompt_id")))


# ---- streams ----------------------------------------------------------------------------------

@query("WITH e AS (SELECT date_trunc('hour', ts) AS h, value FROM events), w AS (SELECT h - INTERVAL (k) HOUR AS began, value FROM e, range(0, 3) r(k)) SELECT began::TIMESTAMP AS began, round(avg(value), 6) AS metric_mean, count(*) AS n FROM w GROUP BY began")
def stream_sliding_windows(spark, d):
    path = io.scratch(spark)
    out = drained(stream.windows(event_log(spark, d, path), "3 hours", "1 hour"), path, "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("began"), F.round("metric_mean", 6).alias("metric_mean"), "n")
