"""Exact top-k search in Hamming space by incremental multi-index hashing."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, materialize

SEGMENT = 16
NO_ID = np.iinfo(np.int64).min


def codes(vectors: DataFrame, width: int = 64) -> DataFrame:
    """vec_id and code: the signs (over 0 or not) of a vector's components, 8 to a byte. Rows with a null id, or with a
    vector that is null, of another width or with a null in it, have no code and are left out."""
    bits = F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(0))
    words = [F.aggregate(F.slice(bits, 1 + SEGMENT * k, SEGMENT), F.lit(0), lambda a, b: a * 2 + b) for k in range(width // SEGMENT)]
    whole = (F.size("embedding") == width) & ~F.exists("embedding", lambda x: x.isNull())
    return vectors.where(F.col("vec_id").isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.array(*words).alias("code"))


@functools.cache
def masks(width: int, radius: int) -> np.ndarray:
    """All values of `width` bits of which `radius` are set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], dtype=np.int64)


class Index:
    """The codes of one group (those that share a segment's prefix) by the rest of the segment's value."""

    def __init__(self, segment: int, width: int, code: np.ndarray, least: np.ndarray, next_id: np.ndarray):
        """least, next_id: each code's two lowest ids."""
        self.segment, self.width, self.code, self.least, self.next_id = segment, width, code, least, next_id
        self.value = code[:, segment] & ((1 << width) - 1)
        self.order = np.argsort(self.value, kind="stable")
        self.start = np.searchsorted(self.value[self.order], np.arange((1 << width) + 1))

    def within(self, value: int, low: int, high: int) -> np.ndarray:
        """Rows whose value is low to high bits away."""
        radii = range(max(0, low), min(high, self.width) + 1)
        if sum(comb(self.width, r) for r in radii) >= len(self.value):  # more values to try than there are
            away = np.bitwise_count(self.value ^ value)
            return np.flatnonzero((away >= low) & (away <= high))
        found = []
        for r in radii:
            tried = masks(self.width, r) ^ value
            a, b = self.start[tried], self.start[tried + 1]
            full = np.flatnonzero(b > a)
            n = b[full] - a[full]
            found.append(self.order[np.repeat(a[full] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def search(self, query: int, code: np.ndarray, away: int, low: int, high: int, k: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, distance) of the k nearest codes whose nearest segment, the first of equals, is this one and low to high
        bits away; `away` of these are in the prefix. Codes beyond the bound and ones of the query's own id alone don't count."""
        rows = self.within(int(code[self.segment]) & ((1 << self.width) - 1), low - away, high - away)
        apart = np.bitwise_count(self.code[rows] ^ code[None, :]).astype(np.int64)
        distance = apart.sum(1)
        least = np.where(self.least[rows] == query, self.next_id[rows], self.least[rows])
        keep = (apart.argmin(1) == self.segment) & (distance <= bound) & (least != NO_ID)
        rows, distance, least = rows[keep], distance[keep], least[keep]
        best = np.lexsort((least, distance))[:k]
        return rows[best], distance[best]


def rounds(codes_: int, segments: int, candidates: int = 2_000) -> list[tuple[int, int]]:
    """Radii (from, to) of each round: a further radius is taken along while the rows to expect of it are few."""
    out, low, expected = [], 0, 0.0
    for r in range(SEGMENT + 1):
        expected += codes_ * segments * comb(SEGMENT, r) / (1 << SEGMENT)
        if expected >= candidates or r == SEGMENT:
            out.append((low, r))
            low, expected = r + 1, 0.0
    return out


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, group_rows: int = 65_536, candidates: int = 2_000) -> DataFrame:
    """query_id, rank, vec_id, distance: for each row whose id is divisible by `every`, the k rows of the least Hamming
    distance (then the least id) among all others.

    Incremental multi-index hashing over written tables. Every different code goes, for each of its 16-bit segments, to
    the group of the segment's prefix; a query goes to the groups whose prefix is within the round's radius, and meets
    there the codes whose segment is that near. After radius r in each of m segments every code within m(r+1)-1 bits has
    been seen: queries whose k-th distance lies within that are done, the others go on with the next radius and bring
    their k-th distance along as a bound. A code is looked at once only, at its nearest segment.

    The prefix has as many bits as make groups of about `group_rows` codes; larger groups (skewed values) are dealt out
    over several tasks. Rows of one code are one entry with its k + 1 lowest ids, which is all a search can use, so
    copies of a vector don't add up in a task. Rows that repeat an id are found as often as they occur, but a query's
    own id never; equal rows ask once; if an id with different codes is a query, each code asks, under the same
    query_id, and the k best of all are kept. Ids below 0 are found as others are. See codes() for nulls.
    Other columns are dropped; an empty table gives no rows."""
    coded = materialize(codes(vectors), "ham-codes")
    segments = 64 // SEGMENT
    times = coded.groupBy("code", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("times"))
    # A window group limit: each task passes on k + 1 rows of a code at most.
    place = F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))
    ids = F.array_sort(F.collect_list(F.struct("vec_id", "times"))).alias("ids")
    base = materialize(times.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("code").agg(ids), "ham-base")
    asked = coded.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "code").distinct()
    asked = materialize(asked.withColumn("ask", F.monotonically_increasing_id()), "ham-asked")
    n = base.count()
    prefix_bits = min(SEGMENT, max(0, -(-n // group_rows) - 1).bit_length())
    rest = SEGMENT - prefix_bits
    prefix = lambda s: F.shiftright(F.get("code", s), rest)

    each = F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("segment")
    rows = base.select(each, "code", "ids").withColumn("prefix", prefix(F.col("segment")))
    # At most `segments` rows for each value of a prefix of up to 16 bits: a proven bound.
    groups = materialize(rows.groupBy("segment", "prefix").agg(F.ceil(F.count(F.lit(1)) / group_rows).cast("int").alias("pieces")), "ham-groups")
    pieces = F.broadcast(groups)
    rows = rows.join(pieces, ["segment", "prefix"]).withColumn("piece", F.pmod(F.xxhash64("code"), F.col("pieces")).cast("int"))
    rows = rows.select("segment", "prefix", "piece", F.lit(-1).cast("long").alias("ask"), F.lit(0).cast("long").alias("query_id"), "code", "ids", F.lit(0).alias("away"), F.lit(0).alias("bound"))

    def search(low: int, high: int):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            def matrix(column) -> np.ndarray:
                return np.asarray(column.flatten()).reshape(len(column), -1).astype(np.int64)

            key, held, index, entries = None, [], None, None
            for batch in batches:
                where = np.stack([np.asarray(batch.column(c)) for c in range(3)], 1)
                cuts = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]).any(1)])) if len(where) else []
                for a, b in zip(cuts, [*cuts[1:], len(where)], strict=True):
                    part = batch.slice(a, b - a)
                    if (now := tuple(where[a].tolist())) != key:
                        key, held, index = now, [], None
                    asks = np.asarray(part.column(3))
                    split = int(np.searchsorted(asks >= 0, True))
                    if split:
                        held.append(part.slice(0, split))
                    if split == len(asks) or not held:
                        continue
                    if index is None:
                        whole = pa.Table.from_batches(held).combine_chunks()
                        entries = whole.column("ids").chunk(0)
                        of, at = entries.flatten().field("vec_id"), np.asarray(entries.offsets) - entries.offsets[0].as_py()
                        number = np.asarray(of)
                        second = np.where(np.diff(at) > 1, number[np.minimum(at[:-1] + 1, len(number) - 1)], NO_ID)
                        index = Index(key[0], rest, matrix(whole.column("code").chunk(0)), number[at[:-1]], second)
                    queries = part.slice(split)
                    code, found = matrix(queries.column(5)), []
                    for i, (query, away, bound) in enumerate(zip(*(queries.column(c).to_pylist() for c in (4, 7, 8)), strict=True)):
                        r, d = index.search(query, code[i], away, low, high, k, bound)
                        found.append((np.full(len(r), i), r, d))
                    who, r, d = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([queries.column(3).take(pa.array(who)), queries.column(4).take(pa.array(who)), pa.array(d.astype(np.int32)), entries.take(pa.array(r))], names=["ask", "query_id", "distance", "ids"])

        return run

    best = Window.partitionBy("ask").orderBy("distance", "vec_id")
    found_as = "ask long, query_id long, distance int, ids array<struct<vec_id: long, times: long>>"
    top = None
    left = asked.withColumn("bound", F.lit(segments * SEGMENT))
    for low, high in rounds(n, segments, candidates):
        turned = ",".join(str(m) for r in range(min(high, prefix_bits) + 1) for m in masks(prefix_bits, r).tolist())
        visits = left.select("ask", "query_id", "code", "bound", each).withColumn("turn", F.explode(F.split(F.lit(turned), ",").cast("array<int>")))
        visits = visits.withColumn("prefix", prefix(F.col("segment")).bitwiseXOR(F.col("turn"))).join(pieces, ["segment", "prefix"])
        visits = visits.select("segment", "prefix", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "ask", "query_id", "code", F.lit(None).cast(rows.schema["ids"].dataType).alias("ids"), F.bit_count("turn").cast("int").alias("away"), "bound")
        both = rows.unionByName(visits).repartition("segment", "prefix", "piece").sortWithinPartitions("segment", "prefix", "piece", "ask")
        found = both.mapInArrow(search(low, high), found_as).select("ask", "query_id", "distance", F.explode("ids").alias("x")).where("x.vec_id <> query_id")
        found = found.select("ask", "query_id", "distance", F.col("x.vec_id").alias("vec_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("x.times"))).alias("copy")).drop("copy")
        found = found if top is None else top.unionByName(found)
        # Spark keeps k rows a query in each task before the shuffle, too, so a query's rows don't grow with the groups.
        last, top = top, materialize(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"), "ham-top")
        if last is not None:
            discard(last)
        state = top.groupBy("ask").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
        open_ = asked.join(state, "ask", "left").where((F.coalesce("n", F.lit(0)) < k) | (F.col("far") > segments * (high + 1) - 1))
        left = open_.withColumn("bound", F.when(F.col("n") >= k, F.col("far")).otherwise(segments * SEGMENT)).select("ask", "query_id", "code", "bound")
        if high == SEGMENT or not left.limit(1).count():
            break
    discard(coded, base, asked, groups)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    out = top.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.col("distance").cast("long").alias("distance"))
