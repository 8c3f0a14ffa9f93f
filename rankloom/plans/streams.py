"""Queries of streams that keep results, over the events as logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import io
from ..streaming import stores
from ..streaming.logs import step_rollup
from .registry import drained, event_log, query, table


@query("SELECT dayofyear(ts)::INT AS epoch, hour(ts)::INT AS step, round(avg(value), 6) AS metric_mean, round(max(value), 6) AS metric_max, count(*) AS n FROM events GROUP BY 1, 2")
def stream_rollup_updates(spark, d):
    path = io.scratch(spark)
    rolled = step_rollup(event_log(spark, d, path))
    stores.upsert(rolled, f"{path}-store", f"{path}-c").awaitTermination()
    out = stores.stored(spark, f"{path}-store", ["epoch", "step"], rolled.schema)
    return out.select("epoch", "step", F.round("metric_mean", 6).alias("metric_mean"), F.round("metric_max", 6).alias("metric_max"), "n")


ORDERED = """WITH e AS (SELECT event_type AS run, floor(epoch(ts))::BIGINT AS step, value AS m FROM events WHERE value IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step, m) AS n, max(m) OVER (PARTITION BY run ORDER BY step, m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e),
f AS (SELECT *, b IS NOT NULL AND m < b AND n > 3 AND b - m >= 5 AS dropped FROM o), g AS (SELECT *, sum((NOT dropped)::INT) OVER (PARTITION BY run ORDER BY n) AS grp FROM f)
SELECT run, step, round(m, 6) AS metric, (CASE WHEN dropped THEN sum(dropped::INT) OVER (PARTITION BY run, grp ORDER BY n) ELSE 0 END)::INT AS streak FROM g"""


@query(ORDERED)
def stream_ordered_stop(spark, d):
    path = io.scratch(spark)
    e = table(spark, d, "events").select(F.col("event_type").alias("run"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("metric")).where("metric is not null")
    ends = e.groupBy("run").agg((F.max("ts") + F.expr("interval 2 days")).alias("ts")).select("run", "ts", F.lit(None).cast("double").alias("metric"))
    log = e.unionByName(ends).withColumn("step", F.unix_timestamp("ts"))
    io.write_jsonl(log, path)
    rows = spark.readStream.schema("run string, step long, ts timestamp, metric double").json(path)
    return drained(stores.ordered_early_stop(rows, threshold=5.0), path, "append").select("run", "step", F.round("metric", 6).alias("metric"), "streak")


@query("""WITH l AS (SELECT dayofyear(ts)::INT AS epoch, hour(ts)::INT AS step, avg(value) AS reward_mean, count(*)::BIGINT AS sampled, max(value) - min(value) AS spread FROM events GROUP BY 1, 2)
SELECT epoch, step, round(reward_mean, 6) AS reward_mean, CASE WHEN step % 2 = 1 THEN sampled WHEN step % 4 = 2 THEN sampled + 1 END AS sampled, CASE WHEN step % 2 = 0 THEN round(spread, 6) END AS spread FROM l""")
def stream_merged_logs(spark, d):
    path = io.scratch(spark)
    e = table(spark, d, "events").select(F.dayofyear("ts").alias("epoch"), F.hour("ts").alias("step"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("value"))
    by = e.groupBy("epoch", "step").agg(F.avg("value").alias("reward_mean"), F.count(F.lit(1)).alias("sampled"), (F.max("value") - F.min("value")).alias("spread"), F.min("ts").alias("ts"), F.max("ts").alias("last"))
    end = by.agg((F.max("last") + F.expr("interval 2 days")).alias("ts")).select(F.lit(-1).alias("epoch"), F.lit(0).alias("step"), "ts")  # a later time on both sides lets the last rows go
    io.write_jsonl(by.select("epoch", "step", "ts", "reward_mean", "sampled").unionByName(end, allowMissingColumns=True), f"{path}-l")
    right = by.where("step % 2 = 0").select("epoch", "step", F.col("last").alias("ts"), F.when(F.col("step") % 4 == 2, F.col("sampled") + 1).alias("sampled"), "spread")
    io.write_jsonl(right.unionByName(end, allowMissingColumns=True), f"{path}-r")
    left = spark.readStream.schema("epoch int, step int, ts timestamp, reward_mean double, sampled long").json(f"{path}-l")
    right = spark.readStream.schema("epoch int, step int, ts timestamp, sampled long, spread double").json(f"{path}-r")
    out = drained(stores.merge_logs(left, right), path, "append").where("epoch > 0")
    return out.select("epoch", "step", F.round("reward_mean", 6).alias("reward_mean"), "sampled", F.round("spread", 6).alias("spread"))
