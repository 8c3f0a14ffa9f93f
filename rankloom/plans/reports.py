"""Queries of settings, regeneration rounds, many reports and lenient files, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regenerate
from ..operators import retrieval as R
from ..sources import io
from .registry import KEYS, METRICS_ONLY, all_hits, hits_sql, judged, query, rollouts, rounded, rounded_sql, strategies, table

CUT = METRICS_ONLY.replace("rank <= 20 THEN rank", "rank <= 5 THEN rank").replace("(rank <= 20)", "(rank <= 10)").replace("(rank <= 50)", "(rank <= 30)")


@query(hits_sql("ok", 1.5, 0.75, 30) + CUT + rounded_sql("me", ["qid", "strategy", "hit_rank"], ["mrr", "recall", "recall_aux"]))
def metrics_cutoffs(spark, d):
    """Reciprocal rank at 5, recall at 10 and 30."""
    out = R.metrics(strategies(spark, d), all_hits(spark, d, k=30), judged(spark, d), KEYS, 5, 10, 30)
    return rounded(out, ["qid", "strategy", "hit_rank"], ["mrr", "recall", "recall_aux"])


@query(None)
def regen_rounds(spark, d):
    """Groups of users' events; a candidate of round r is the event type of another event of the table, with its round."""
    e = rollouts(spark, d).select("grp", "idx", F.lit("error").alias("source"), "query", (F.col("mrr") > 30).alias("polluted"), (F.col("idx") % 5 == 0).alias("fell_back"))
    r = e.withColumn("round", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    new = F.when((F.col("idx") * 7 + F.col("round")) % 3 == 0, F.concat("query", F.lit("-"), (F.col("idx") % 4).cast("string"))).otherwise(F.col("query"))
    later = r.select("grp", "idx", "round", new.alias("query"), (F.col("polluted") & ((F.col("idx") + F.col("round")) % 4 == 0)).alias("polluted"), F.lit(False).alias("fell_back"))
    return regenerate.replay(e, later, "grp", "idx", "source", least_unique=4, most_rounds=3)


@query("SELECT s_suppkey::BIGINT AS variant, s_name AS name, s_acctbal::DOUBLE AS metric FROM supplier")
def manifest_reports(spark, d):
    """A report for every supplier, each a file of its own, joined to their manifest."""
    path = io.scratch(spark)
    made = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long"), F.to_json(F.struct(F.col("s_name").alias("name"), F.col("s_acctbal").cast("double").alias("metric"))).alias("text")).repartition(4 * spark.sparkContext.defaultParallelism)

    def put(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            paths = [f"{path}/{i}.json" for i in batch.column(0).to_pylist()]
            for p, text in zip(paths, batch.column(1).to_pylist(), strict=True):
                store, at = fs.FileSystem.from_uri(p)
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(at) as f:
                    f.write(text.encode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths)], names=["variant", "report_path"])

    made.mapInArrow(put, "variant long, report_path string").write.json(f"{path}-manifest")
    manifest = io.read_jsonl(spark, f"{path}-manifest", "variant long, report_path string")
    return io.read_reports(spark, manifest, "name string, metric double").select("variant", "name", "metric")


@query("SELECT item_id::VARCHAR AS query_id, text FROM benchmark WHERE item_id % 3 > 0 AND trim(text) <> ''")
def queries_without_blanks(spark, d):
    """Two appends of JSON lines, among them blank ids and lines that don't parse."""
    path = io.scratch(spark)
    b = table(spark, d, "benchmark").select(F.when(F.col("item_id") % 3 == 0, "  ").otherwise(F.col("item_id").cast("string")).alias("query_id"), "text", "item_id")
    for k in range(2):
        io.write_jsonl(b.where(F.col("item_id") % 2 == k).drop("item_id"), path, append=True)
    b.select(F.concat(F.lit('{"query_id": "'), F.col("item_id").cast("string"), F.lit('", "text"')).alias("value")).write.mode("append").text(path)
    return io.read_queries(spark, path)
