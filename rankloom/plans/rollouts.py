"""Queries on rollout groups, losses, steps and streams beyond those of the registry, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import groups, logs
from ..sources import io
from ..streaming import logs as stream
from .registry import G, L, drained, event_log, query, rollouts, steps, table

# ---- groups and losses ------------------------------------------------------------------------

query(G + ", x AS (SELECT grp, query, max(reward) AS hi, min(reward) AS lo FROM g GROUP BY ALL) SELECT grp, round(CASE WHEN count(*) < 2 THEN 0 ELSE max(hi) - min(lo) END, 4)::DOUBLE AS reward_gap FROM x GROUP BY grp", "reward_gap")(
    lambda s, d: groups.reward_gap(rollouts(s, d), "grp", "query", "reward").withColumn("reward_gap", F.round("reward_gap", 4)))
query(G + " SELECT grp, idx, row_number() OVER (PARTITION BY grp, query ORDER BY idx) > 1 AS is_duplicate, query = 'error' AS is_copy, row_number() OVER (PARTITION BY grp, query ORDER BY idx) > 1 OR query = 'error' OR mrr > 60 AS regenerate FROM g", "regen_candidates")(
    lambda s, d: groups.regenerate(rollouts(s, d).withColumn("source", F.lit(" ERROR")).withColumn("polluted", F.col("mrr") > 60), "grp", "query", "source", "polluted", "idx").select("grp", "idx", "is_duplicate", "is_copy", "regenerate"))
query(G + ", a AS (SELECT grp, count(DISTINCT query) = 1 AS collapsed, max(reward) = min(reward) AS fr, max(mrr) = min(mrr) AS fm, count(*) FILTER (reward > 1) AS v FROM g GROUP BY grp) SELECT grp, CASE WHEN collapsed THEN 'collapsed' WHEN fr AND fm THEN 'flat_reward_and_main' WHEN fr THEN 'flat_reward' WHEN v = 0 THEN 'no_valid_samples' END AS reason FROM a", "group_skip")(
    lambda s, d: rollouts(s, d).groupBy("grp").agg((F.count_distinct("query") == 1).alias("c"), (F.max("reward") == F.min("reward")).alias("fr"), (F.max("mrr") == F.min("mrr")).alias("fm"), F.count_if(F.col("reward") > 1).alias("v")).select("grp", groups.skip_reason(F.col("c"), F.col("fr"), F.col("fm"), F.col("v")).alias("reason")))
LOSS = """WITH z AS (SELECT vec_id, list_zip(embedding[1:20], embedding[21:40], embedding[45:64]) AS z FROM embeddings), o AS (SELECT vec_id,
  -list_sum(list_transform(z, lambda x: least(exp(x[1]::DOUBLE - x[2]::DOUBLE) * 0.5::DOUBLE, least(greatest(exp(x[1]::DOUBLE - x[2]::DOUBLE), 0.8::DOUBLE), 1.2::DOUBLE) * 0.5::DOUBLE))) / 20 AS pg, 0.04::DOUBLE * list_sum(list_transform(z, lambda x: x[1]::DOUBLE - x[3]::DOUBLE)) / 20 AS kl FROM z)"""


def losses(spark, d):
    part = lambda a, n: F.slice("embedding", a, n).cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", scores.sample_loss(part(1, 20), part(21, 24), part(45, 20), F.lit(0.5), 0.04).alias("x")).select("vec_id", "x.*")


query(LOSS + " SELECT vec_id, round(pg + kl, 5) + 0.0::DOUBLE AS loss, round(pg, 5) + 0.0::DOUBLE AS loss_pg, round(kl, 5) + 0.0::DOUBLE AS loss_kl FROM o", "sample_losses")(lambda s, d: losses(s, d).select("vec_id", *[(F.round(c, 5) + 0.0).alias(c) for c in ("loss", "loss_pg", "loss_kl")]))
query(LOSS + " SELECT round(avg(abs(kl)) / (avg(abs(pg)) + avg(abs(kl)) + 1e-12), 6) AS kl_dominance, count(pg) AS n FROM o", "kl_dominance")(lambda s, d: groups.kl_dominance(losses(s, d), "loss_pg", "loss_kl").withColumn("kl_dominance", F.round("kl_dominance", 6)))
query("SELECT l_linenumber AS round, round(least(1.35::DOUBLE, 0.9::DOUBLE + 0.08::DOUBLE * l_linenumber), 6) AS temperature FROM (SELECT DISTINCT l_linenumber FROM lineitem)", "retry_temperature")(
    lambda s, d: table(s, d, "lineitem").select(F.col("l_linenumber").alias("round")).distinct().select("round", scores.retry_temperature(F.lit(0.9), 0.08, F.col("round")).alias("temperature")))
query("SELECT s_suppkey, CASE WHEN s_suppkey % 50 > 0 THEN greatest(2, ceil((s_suppkey % 50) / greatest(1, ceil((s_nationkey + 1) / 4.0)))) ELSE 2 END::BIGINT AS epochs FROM supplier", "epochs_for_steps")(
    lambda s, d: table(s, d, "supplier").select("s_suppkey", scores.epochs_for(F.col("s_suppkey") % 50, F.col("s_nationkey") + 1, F.lit(4), F.lit(2)).alias("epochs")))

# ---- steps ------------------------------------------------------------------------------------

query(L + " SELECT epoch, step, round(CASE WHEN epoch % 2 = 0 THEN coalesce(CASE WHEN step % 3 > 0 THEN reward_mean END, reward_max) ELSE coalesce(CASE WHEN step % 3 > 0 THEN reward_max END, reward_mean) END, 6) AS value FROM l", "phase_metric")(
    lambda s, d: steps(s, d).select("epoch", "step", F.round(scores.phase_metric(F.when(F.col("epoch") % 2 == 0, "phase1").otherwise("phase2"), F.when(F.col("step") % 3 > 0, F.col("reward_mean")), F.when(F.col("step") % 3 > 0, F.col("reward_max")), F.when(F.col("epoch") % 2 == 0, F.col("reward_max")).otherwise(F.col("reward_mean"))), 6).alias("value")))


def traces(spark, d):
    """A group trace: of each day and quarter of it, one row a kind of user."""
    e = table(spark, d, "events").where("value is not null").select(F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("epoch"), F.floor(F.hour("ts") / 6).cast("int").alias("step"), (F.col("user_id") % 3).alias("kind"), F.struct("event_id", F.round("value", 4).alias("r"), F.round(F.col("value") * 0.5 + F.col("event_id") % 7, 4).alias("m"), F.col("event_type").alias("q"), F.greatest(F.lit(0), F.col("event_id") % 5 - 2).cast("double").alias("a")).alias("x"))
    rows = e.groupBy("epoch", "step", "kind").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return rows.select("epoch", "step", F.col("x.r").alias("group_rewards"), F.when(F.col("kind") > 0, F.col("x.m")).alias("group_mrr"), F.col("x.q").alias("group_final_queries"), F.col("x.a").alias("group_anchor_bonus"), F.col("x.a").alias("group_copy_penalties"), F.transform("x.q", lambda v: v == "error").alias("group_fallback_to_original"), F.when(F.col("kind") == 1, True).alias("collapsed_group"), F.when(F.size("x") > 3, "max_group_size_reached").alias("reward_gap_stop_reason"), F.size("x").alias("generated_sample_count"), F.when(F.col("kind") == 2, F.size("x") - 1).alias("extra_sample_count"))


STEP_COLS = ["trace_reward_mean", "trace_mrr_mean", "trace_anchor_bonus_mean", "trace_unsafe_copy_penalty_mean", "trace_row_reward_mean_avg", "trace_row_reward_max_avg", "trace_unique_final_query_mean", "trace_all_same_final_query_ratio", "trace_fallback_ratio", "trace_flat_reward_group_ratio", "trace_flat_mrr20_group_ratio", "trace_flat_main_reward_group_ratio", "trace_best_reward_hit_best_mrr20_ratio", "trace_anchor_hit_ratio", "collapsed_group_ratio", "max_group_size_hit_ratio", "generated_sample_count_mean", "extra_sample_ratio"]
query("""WITH e AS (SELECT date_diff('day', DATE '1970-01-01', ts::DATE)::INT AS epoch, (hour(ts) // 6)::INT AS step, user_id % 3 AS kind, event_id, round(value, 4) AS r, round(value * 0.5 + event_id % 7, 4) AS m, event_type AS q, greatest(0, event_id % 5 - 2)::DOUBLE AS a FROM events WHERE value IS NOT NULL),
s AS (SELECT epoch, step, avg(r) AS trace_reward_mean, avg(m) FILTER (kind > 0) AS trace_mrr_mean, avg(a) AS trace_anchor_bonus_mean, avg(a) AS trace_unsafe_copy_penalty_mean, avg((a > 0)::INT) AS trace_anchor_hit_ratio FROM e GROUP BY ALL),
k AS (SELECT epoch, step, kind, count(*) AS n, avg(r) AS rm, max(r) AS rx, (max(r) = min(r))::INT AS fr, (max(m) = min(m))::INT AS fm, (first(m ORDER BY r DESC, event_id) = max(m))::INT AS bh, count(DISTINCT q) AS u, avg((q = 'error')::INT) AS fb FROM e GROUP BY ALL),
t AS (SELECT epoch, step, count(*) AS qid_rows, avg(rm) AS trace_row_reward_mean_avg, avg(rx) AS trace_row_reward_max_avg, avg(u) AS trace_unique_final_query_mean, avg((u <= 1)::INT) AS trace_all_same_final_query_ratio, avg(fb) AS trace_fallback_ratio, avg(fr) AS trace_flat_reward_group_ratio, avg(fm) FILTER (kind > 0) AS trace_flat_mrr20_group_ratio, avg(fr) AS trace_flat_main_reward_group_ratio, avg(bh) FILTER (kind > 0) AS trace_best_reward_hit_best_mrr20_ratio, avg((kind = 1)::INT) AS collapsed_group_ratio, avg((n > 3)::INT) AS max_group_size_hit_ratio, avg(n) AS generated_sample_count_mean, sum(CASE WHEN kind = 2 THEN n - 1 ELSE 0 END)::DOUBLE / sum(n) AS extra_sample_ratio FROM k GROUP BY epoch, step)
SELECT epoch, step, row_number() OVER (ORDER BY epoch, step)::INT AS global_step_idx, qid_rows, """ + ", ".join(f"round({c}, 6) AS {c}" for c in STEP_COLS) + " FROM s JOIN t USING (epoch, step)", "group_steps")(
    lambda s, d: logs.group_steps(traces(s, d)).select("epoch", "step", "global_step_idx", "qid_rows", *[F.round(c, 6).alias(c) for c in STEP_COLS]))


# ---- streams ----------------------------------------------------------------------------------

@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, round(avg(value), 6) AS metric_mean, count(*) AS n FROM events GROUP BY 1")
def stream_windows(spark, d):
    path = io.scratch(spark)
    out = drained(stream.windows(event_log(spark, d, path), "1 day"), path, "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), F.round("metric_mean", 6).alias("metric_mean"), "n")


@query("WITH e AS (SELECT event_type AS run, date_trunc('millisecond', ts) AS t, value FROM events), m AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w >= INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY run ORDER BY t)), s AS (SELECT *, sum(new) OVER (PARTITION BY run ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT run, min(t)::TIMESTAMP AS began, count(*) AS n, round(max(value), 6) AS metric_max FROM s GROUP BY run, k")
def stream_sessions(spark, d):
    path = io.scratch(spark)
    out = drained(stream.sessions(event_log(spark, d, path), "2 hours"), path, "complete")
    return out.select("run", F.col("session_window.start").cast("timestamp_ntz").alias("began"), "n", F.round("metric_max", 6).alias("metric_max"))


@query("SELECT event_type AS run, dayofyear(ts)::INT AS epoch, hour(ts)::INT AS step, round(value, 6) AS metric, CASE WHEN hour(ts) < 12 THEN hour(ts) * 10 END::INT AS target FROM events")
def stream_join_steps(spark, d):
    path = io.scratch(spark)
    known = table(spark, d, "events").select(F.dayofyear("ts").alias("epoch"), F.hour("ts").alias("step")).distinct().where("step < 12").withColumn("target", F.col("step") * 10)
    return drained(stream.join_steps(event_log(spark, d, path), known), path, "append").select("run", "epoch", "step", F.round("metric", 6).alias("metric"), "target")
