"""Splits, samples, difficulty buckets, quotas and schedules of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import placed


def hash_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def hash_rank(df: DataFrame, by: list[str], order: Column, key: str, out: str) -> DataFrame:
    """Adds out: 1 to n in ascending order of a hex hash within groups `by` (no nulls there), ties by key.

    Rows are numbered inside the 4096 cells of the hash's first three digits and the counts of the cells before are
    added, so neither the whole table nor a group with a third of its rows is ever one task."""
    df = df.withColumn("_hash", order).withColumn("_cell", F.substring("_hash", 1, 3))
    cells = df.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by, F.lit(1)).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select(*by, "_cell", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, "_cell").orderBy("_hash", key))
    return df.withColumn(out, inside).join(cells, [*by, "_cell"]).withColumn(out, F.col(out) + F.col("_before")).drop("_hash", "_cell", "_before")


def split(df: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """Adds part: 'train' for the first int(n * ratio) rows (1 to n - 1) in hash order, else 'validation'."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must lie between 0 and 1")
    cut = df.agg(F.least(F.greatest(F.floor(F.count(F.lit(1)) * ratio), F.lit(1)), F.count(F.lit(1)) - 1).alias("_cut"))
    ranked = hash_rank(df, [], hash_order(F.col(key), seed), key, "_place").crossJoin(F.broadcast(cut))  # one row
    return ranked.withColumn("part", F.when(F.col("_place") <= F.col("_cut"), "train").otherwise("validation")).drop("_place", "_cut")


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(hash_order(F.col(key), seed), key).limit(max(n, 0))


def bucket(mrr: Column, recall_wide: Column, learnable: Column) -> Column:
    return F.when((recall_wide > 0) & (mrr < 0.35), "A").when(mrr >= 0.35, "C").when((recall_wide == 0) & learnable, "B").otherwise("DROP")


METADATA = "qid long, text string, orig_mrr20 double, orig_recall20 double, orig_recall100 double, orig_best_hit_rank int, bucket string"


def build_metadata(index, queries: DataFrame, qrels: DataFrame, variant: str = "okapi") -> DataFrame:
    """qid, text and the metrics (METADATA) of original queries, from one retrieval of 100 documents each."""
    from ..functions.text import is_learnable
    from . import retrieval as R

    m = R.metrics(queries, R.top_k(index, queries, 100, variant), qrels, ("qid",), 20, 20, 100)
    own = bucket(F.col("mrr"), F.col("recall_aux"), is_learnable(F.col("text")))
    return queries.select("qid", "text").join(m, "qid").select("qid", "text", F.col("mrr").alias("orig_mrr20"), F.col("recall").alias("orig_recall20"), F.col("recall_aux").alias("orig_recall100"), F.col("hit_rank").alias("orig_best_hit_rank"), own.alias("bucket"))


def ensure_metadata(queries: DataFrame, path: str, build) -> DataFrame:
    """The metadata below path for these queries where it covers them all; else that of build() for all of them, written
    there. build() is only called if there is something to build."""
    from pyspark.errors import AnalysisException

    spark = queries.sparkSession
    try:
        found = spark.read.parquet(path)
        if not queries.select("qid").join(found, "qid", "left_anti").limit(1).count():
            return found.join(queries.select("qid").distinct(), "qid", "left_semi")
    except AnalysisException:
        pass  # nothing written yet
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def with_buckets(queries: DataFrame, metadata: DataFrame) -> DataFrame:
    """queries with their bucket; one without metadata is DROP."""
    return queries.join(metadata.select("qid", "bucket"), "qid", "left").withColumn("bucket", F.coalesce("bucket", F.lit("DROP")))


def bucket_counts(df: DataFrame, domain=("A", "B", "C", "DROP")) -> DataFrame:
    """bucket, n with zeros for those absent; a null bucket counts as DROP."""
    all_ = df.sparkSession.createDataFrame([(b,) for b in domain], "bucket string")
    n = df.groupBy(F.coalesce("bucket", F.lit("DROP")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return all_.join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def quotas(weights: DataFrame, total: int) -> DataFrame:
    """bucket, weight -> quota by largest remainder; ties by weight, then bucket, descending."""
    exact = F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(1))) * total
    df = weights.withColumn("exact", exact).withColumn("base", F.floor(F.round("exact", 9)))
    left = F.lit(total) - F.sum("base").over(Window.partitionBy(F.lit(1)))
    place = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), F.desc("weight"), F.desc("bucket")))
    return df.select("bucket", "weight", (F.col("base") + F.when(place <= left, 1).otherwise(0)).cast("long").alias("quota"))


def cyclic_draw(items: DataFrame, quota: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """For each bucket its quota of items: reshuffled and repeated in rounds until enough are drawn."""
    sizes = items.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).join(quota.select("bucket", "quota"), "bucket").where("quota > 0")
    rounds = items.join(sizes, "bucket").withColumn("round", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("quota") / F.col("n")) - 1).cast("int"))))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("round").cast("string"), F.lit(":"), F.col(key).cast("string")).cast("binary"))
    ranked = hash_rank(rounds, ["bucket", "round"], order, key, "slot").withColumn("slot", F.col("slot") + F.col("round") * F.col("n"))
    return ranked.where("slot <= quota").select("bucket", "slot", "round", key)


def epoch_sample(items: DataFrame, weights: dict[str, float], key: str, seed: int = 42) -> DataFrame:
    """place, bucket, key: one epoch of as many rows as there are in the buckets with a weight.

    Weights of the buckets that have items are scaled to 1 and turned into quotas by largest remainder; each bucket is
    drawn cyclically; a schedule of buckets in hash order says which bucket's next item comes at which place. Without
    any item in a weighted bucket all items come, in order of key."""
    spark = items.sparkSession
    some = items.where(F.col("bucket").isin(*weights))
    counts = {r["bucket"]: r["n"] for r in some.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a bucket
    if not counts:
        return placed(items.select("bucket", key), [F.col(key)], "place").select(F.col("place").cast("long").alias("place"), "bucket", key)
    table = spark.createDataFrame([(b, float(w)) for b, w in weights.items() if b in counts], "bucket string, weight double")
    quota = quotas(table, sum(counts.values()))
    draws = cyclic_draw(some.select("bucket", key), quota, key, seed)
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("bucket"), F.lit(":"), F.col("slot").cast("string")).cast("binary"))
    # A schedule's slots in a bucket come in order, so the i-th place of a bucket takes its i-th draw.
    slots = [spark.range(1, r["quota"] + 1).select(F.lit(r["bucket"]).alias("bucket"), F.col("id").alias("slot")) for r in quota.where("quota > 0").collect()]  # a range for each bucket
    slots = reduce(DataFrame.unionByName, slots)
    places = hash_rank(hash_rank(slots, [], order, "bucket", "place"), ["bucket"], order, "bucket", "nth")
    return places.select("bucket", F.col("nth").alias("slot"), "place").join(draws, ["bucket", "slot"]).select(F.col("place").cast("long").alias("place"), "bucket", key)
