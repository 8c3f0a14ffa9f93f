"""Places of rows in a total order, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import scratch


def placed(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Adds out: 1 to n in the order given. Rows are dealt by ranges of the order, sorted and written with their place in
    the range; the counts of the ranges before are added. Equal rows of the order stand in any order."""
    path = scratch(df.sparkSession)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    df.orderBy(*order).select("*", F.spark_partition_id().alias("_range"), place.alias("_in")).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each task of the sort
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("_range", before.alias("_before")))
    return rows.join(offsets, "_range").withColumn(out, F.col("_in") + F.col("_before") + 1).drop("_range", "_in", "_before")
