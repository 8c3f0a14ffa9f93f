"""Hard negatives: exact windowed search over k-means inverted lists, pruned by Cauchy-Schwarz bounds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, materialize

# Vectors of a squared length from here on could have scores whose multiples by 100 don't fit a long.
LONGEST = 2.0**55
EXACT_IN_DOUBLE = 2.0**53


@dataclass(frozen=True)
class Lists:
    """Inverted lists: rows (cluster, vec_id, label, v: packed integers), and for each cluster its centroid, its radius
    (the greatest distance of a member to it) and its number of rows. Centroids, radii and sizes are bounded by the
    number of clusters."""

    rows: DataFrame
    centroids: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    dtype: str
    exact: bool


def quantised(x: Column, scale: float = 256.0) -> Column:
    """Of an array of numbers: floor(scale * component), the component as double; null if any is null or not finite."""
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.when(whole, F.transform(x, lambda c: F.floor(c.cast("double") * scale)))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (array of long, as long as the longest) of the rows that take part, one for each vec_id."""
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    some = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<long>").alias("v"))
    some = some.where("vec_id is not null and label is not null and v is not null").where(square < LONGEST)
    return some.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.*")


def fit(rows: DataFrame, n: int, dim: int, clusters: int, fit_rows: int, seed: int) -> np.ndarray:
    """Centroids of k-means over about fit_rows rows, taken by a hash of their ids. min(clusters, sqrt(n)) of them."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    cells = 1 << 20
    some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(cells)) < max(1, int(cells * fit_rows / n)))
    some = some.select(array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    k = max(2, min(clusters, int(n**0.5)))
    if dim == 0 or some.limit(2).count() < 2:
        return np.zeros((1, dim))
    return np.array(KMeans(k=k, seed=seed, maxIter=8, initSteps=1).fit(some).clusterCenters())


def build(vectors: DataFrame, clusters: int = 256, fit_rows: int = 20_000, seed: int = 7) -> Lists | None:
    """Lists over all rows of vectors (vec_id, label, v); None if no row takes part. Only the centroids come from a
    sample: every row is put in a list, and the radii are of all rows."""
    raw = materialize(usable(vectors), "hardneg-rows")
    n, dim, top, square = raw.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda c: F.abs(c)))), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))).first()
    if not n:
        return None
    rows = raw.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))))
    centroids = fit(rows, n, dim, clusters, fit_rows, seed)
    dtype = "<i4" if (top or 0) < 2**31 else "<i8"

    def assign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        half = (centroids * centroids).sum(axis=1) / 2
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
            own = np.zeros(batch.num_rows, np.int32) if dim == 0 else np.argmin(half - x @ centroids.T, axis=1).astype(np.int32)
            away = np.sqrt(((x - centroids[own]) ** 2).sum(axis=1))
            packed = [row.tobytes() for row in x.astype(dtype)]
            yield pa.RecordBatch.from_arrays([pa.array(own), batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(away)], names=["cluster", "vec_id", "label", "v", "away"])

    lists = materialize(rows.mapInArrow(assign, "cluster int, vec_id long, label long, v binary, away double"), "hardneg-lists")
    discard(raw)
    radii, sizes = np.full(len(centroids), -1.0), np.zeros(len(centroids), np.int64)
    for c, r, m in lists.groupBy("cluster").agg(F.max("away"), F.count(F.lit(1))).collect():  # a row for each cluster
        radii[c], sizes[c] = r, m
    out = lists.drop("away")
    out.written_to = lists.written_to
    return Lists(out, centroids, radii, sizes, dtype, (square or 0.0) < EXACT_IN_DOUBLE)


def _visits(lists: Lists, queries: DataFrame, start: int, stop: int) -> DataFrame:
    """The clusters that queries (anchor_id, label, v, low, high: arrays, one entry for each window) look into in this
    round: those at places start to stop in descending order of the bound q.c + |q| r, but none whose bound lies strictly
    below every window's floor, and none whose least possible score q.c - |q| r lies above every window. `low` holds the
    k-th best score of a window as soon as it has k rows, so this is where a search stops."""
    centroids, radii, sizes, dtype, dim = lists.centroids, lists.radii, lists.sizes, lists.dtype, lists.centroids.shape[1]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        filled = np.flatnonzero(sizes > 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            q = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype).reshape(batch.num_rows, dim).astype(np.float64)
            dots, reach = q @ centroids[filled].T, np.sqrt((q * q).sum(axis=1))[:, None] * radii[filled][None, :]
            slack = 1e-9 * (np.abs(dots) + reach) + 1e-6  # rounding must not prune
            upper, lower = dots + reach + slack, dots - reach - slack
            order = np.argsort(-upper, axis=1, kind="stable")[:, start:stop]
            at, into = [], []
            for i, (low, high) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                u, d = upper[i, order[i]][:, None], lower[i, order[i]][:, None]
                wanted = ((u >= np.array(low, float)) & (d <= np.array(high, float))).any(axis=1)
                hit = order[i][wanted]
                at.append(np.full(len(hit), i))
                into.append(filled[hit])
            at = np.concatenate(at)
            part = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(into).astype(np.int32)), *part.columns], names=["cluster", *batch.schema.names])

    return queries.select("anchor_id", "label", "v", "low", "high").mapInArrow(run, "cluster int, anchor_id long, label long, v binary, low array<long>, high array<long>")


def _judge(k: int, same: bool, dtype: str, exact: bool):
    """The function for one tile: visits against rows of one list; the k best of each (anchor, window) there."""

    def run(key, visits, rows):
        import pyarrow as pa

        names = ["anchor_id", "w", "vec_id", "score"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        if not visits.num_rows or not rows.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names=names)
        column = lambda t, c: t.column(c).to_numpy()
        packed = lambda t: np.frombuffer(b"".join(t.column("v").to_pylist()), dtype).reshape(t.num_rows, -1).astype(np.float64 if exact else np.int64)
        score = packed(visits) @ packed(rows).T
        anchor, ids = column(visits, "anchor_id"), column(rows, "vec_id")
        fits = (column(visits, "label")[:, None] == column(rows, "label")[None, :]) == same
        fits &= anchor[:, None] != ids[None, :]
        lows, highs = visits.column("low").to_pylist(), visits.column("high").to_pylist()
        out: list[list[np.ndarray]] = [[], [], [], []]
        least = np.iinfo(np.int64).min // 2
        for w in range(max(map(len, lows))):
            low = np.array([x[w] if len(x) > w else 1 for x in lows])[:, None]
            high = np.array([x[w] if len(x) > w else 0 for x in highs])[:, None]
            ok = fits & (score >= low) & (score <= high)
            if ok.shape[1] > k:
                ok &= score >= np.partition(np.where(ok, score, least), -k, axis=1)[:, -k][:, None]
            r, c = np.nonzero(ok)
            s = score[r, c].astype(np.int64)
            order = np.lexsort((ids[c], -s, r))
            r, c, s = r[order], c[order], s[order]
            first = np.searchsorted(r, r)  # r ascends: where its row begins
            keep = np.arange(len(r)) - first < k
            for x, v in zip(out, (anchor[r[keep]], np.full(int(keep.sum()), w), ids[c[keep]], s[keep]), strict=True):
                x.append(v)
        return pa.Table.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(out, kinds, strict=True)], names=names)

    return run


def search(lists: Lists, queries: DataFrame, k: int, same: bool, first_clusters: int = 4, growth: int = 8, block_rows: int = 1024, strip_rows: int = 2048) -> DataFrame:
    """anchor_id, w, vec_id, score, rank: the k best rows, by descending score and then vec_id, for each window
    [low[w], high[w]] of queries (anchor_id, label, v, low, high), among rows of the same label or of others.

    In each round a query looks into its next clusters in order of the bound: 4 of them, then 32, then 256, and so on to
    the last; the k-th score found so far goes along. A list meets its visitors in tiles of about block_rows by
    strip_rows, whatever the sizes of the list and of the crowd, so no hot list is one task. Exact: the bounds leave out
    only what can't be among the k best, equal scores included."""
    spark = lists.rows.sparkSession
    start, step, best = 0, first_clusters, None
    blocks = [max(1, -(-int(m) // block_rows)) for m in lists.sizes]
    pick = lambda values, c: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col(c) + 1)
    while start < len(lists.sizes):
        asked = queries
        if best is not None:
            floor = best.groupBy("anchor_id", "w").agg(F.count(F.lit(1)).alias("m"), F.min("score").alias("s")).where(F.col("m") >= k)
            floor = floor.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "s"))).alias("at"))  # as many as windows
            raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("at", i), x)))
            asked = queries.join(floor, "anchor_id", "left").withColumn("low", raised)
        visits = materialize(_visits(lists, asked, start, start + step), "hardneg-visits")
        crowd = [0] * len(lists.sizes)
        for c, m in visits.groupBy("cluster").agg(F.count(F.lit(1))).collect():  # a row for each cluster
            crowd[c] = m
        start, step = start + step, step * growth
        if not any(crowd):
            discard(visits)
            continue
        strips = [-(-m // strip_rows) for m in crowd]
        left = visits.withColumn("strip", F.pmod(F.xxhash64("anchor_id"), pick(strips, "cluster"))).withColumn("block", F.explode(F.sequence(F.lit(0), pick(blocks, "cluster") - 1)))
        right = lists.rows.where(pick(strips, "cluster") > 0).withColumn("block", F.pmod(F.xxhash64("vec_id"), pick(blocks, "cluster")).cast("int")).withColumn("strip", F.explode(F.sequence(F.lit(0), pick(strips, "cluster") - 1)))
        key = ["cluster", "block", "strip"]
        found = left.withColumn("strip", F.col("strip").cast("int")).groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_judge(k, same, lists.dtype, lists.exact), "anchor_id long, w int, vec_id long, score long")
        every = found if best is None else best.drop("rank").unionByName(found)
        rank = F.row_number().over(Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "vec_id"))
        before, best = best, materialize(every.withColumn("rank", rank).where(F.col("rank") <= k), "hardneg-best")
        discard(visits, *([before] if before is not None else []))
    return best if best is not None else spark.createDataFrame([], "anchor_id long, w int, vec_id long, score long, rank int")


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, clusters: int = 256, fit_rows: int = 20_000) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (rows of vectors where
    the condition `anchors` on vec_id holds) and each of its `positives` best rows of the same label, the `negatives` best
    rows of other labels whose score lies between low and high hundredths of the positive's.

    vectors: vec_id, label, v (array of integers). A score is the integer inner product, higher first, ties by smaller
    vec_id. Rows with a null id, label or vector take no part, nor do vectors of a squared length of 2**55 or more, whose
    scores needn't fit; shorter vectors count as filled up with zeros. Rows that repeat count once; of different rows of
    one id the least (label, vector) stands. An anchor without another row of its label, or without a row in the window (always so
    if the positive's score is below 0), has no rows; an empty table gives none. Other columns are dropped."""
    spark = vectors.sparkSession
    lists = build(vectors, clusters, fit_rows)
    if lists is None:
        return spark.createDataFrame([], RESULT)
    start = lists.rows.where(anchors).select(F.col("vec_id").alias("anchor_id"), "label", "v")
    least, most = F.lit(-(2**62)), F.lit(2**62)
    near = search(lists, start.select("*", F.array(least).alias("low"), F.array(most).alias("high")), positives, True)
    floor_div = lambda x: F.expr(f"({x} - pmod({x}, 100L)) div 100L")
    near = near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), floor_div(f"{high}L * score").alias("high"), (-floor_div(f"-{low}L * score")).alias("low"))
    near = materialize(near, "hardneg-positives")
    windows = near.where("low <= high").groupBy("anchor_id").agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("x"))  # as many as positives
    asked = materialize(start.join(windows, "anchor_id").select("anchor_id", "label", "v", F.col("x.low").alias("low"), F.col("x.high").alias("high")), "hardneg-windows")
    far = search(lists, asked, negatives, False)
    windows = asked.select("anchor_id", F.posexplode(F.arrays_zip("low", "high")).alias("w", "x")).select("anchor_id", "w", "x.*")
    out = near.join(windows, ["anchor_id", "low", "high"]).join(far, ["anchor_id", "w"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
