"""Near-duplicate documents: a chosen-path join on word shingles, exact links and their classes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import connected, discard, fresh, materialize, mix, row_key, shingles, word_hashes

SKETCH = 64
SEEDS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def runs_for(recall: float, threshold: float, fan: float) -> int:
    """Independent runs after which a pair at the threshold shares a path with at least this probability. A pair shares
    the fewest where one set holds the other: in one run Poisson(fan * threshold) of the chosen tokens, as the larger
    set's rate fan / size decides (sets of equal size share more, fan * 2t/(1+t))."""
    return max(1, int(np.ceil(-np.log(1 - recall) / (fan * threshold))))


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The least 16 bits' worth of hash in each of 64 bins, 0 for an empty bin."""
    out = np.full(SKETCH, 1 << 16, dtype=np.int64)
    np.minimum.at(out, (tokens & np.uint64(SKETCH - 1)).astype(np.int64), (mix(tokens) >> np.uint64(48)).astype(np.int64))
    return np.where(out == 1 << 16, 0, np.maximum(out, 1)).astype(np.uint16)


def chosen(tokens: np.ndarray, runs: int, fan: float) -> tuple[np.ndarray, np.ndarray]:
    """First steps of a set's paths, of the first run and of the others: the tokens whose hash in a run falls below
    fan / size, marked by the run."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    least = np.uint64(min((1 << 64) - 1, int(fan / n * 2.0**64)))
    with_seed = mix(tokens[None, :] ^ SEEDS[:runs, None])
    return np.unique(mix(with_seed[0][with_seed[0] <= least])), np.unique(mix(with_seed[1:][with_seed[1:] <= least]))


def alike(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float, threshold: float) -> np.ndarray:
    """Which pairs of two blocks of sketches may reach the threshold; sizes must fit, too."""
    equal = np.zeros((len(a), len(b)), dtype=np.int16)
    either = np.zeros_like(equal)
    for k in range(SKETCH):
        x, y = a[:, k, None], b[None, :, k]
        equal += (x == y) & (x > 0)
        either += (x | y) > 0
    small, large = np.minimum(na[:, None], nb[None, :]), np.maximum(na[:, None], nb[None, :])
    return (equal >= least * either) & (small >= threshold * large)


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def stars(self, nodes: list) -> list[tuple]:
        roots = [self.root(i) for i in range(len(self.up))]
        least: dict[int, object] = {}
        for i, r in enumerate(roots):
            if r not in least or nodes[i] < least[r]:
                least[r] = nodes[i]
        return [(nodes[i], least[r]) for i, r in enumerate(roots) if nodes[i] != least[r]]


def grouped(batches: Iterator, key: int = 0) -> Iterator[list]:
    """Rows of each run of equal keys of a sorted partition, as lists of Arrow scalars' Python values."""
    held: list = []
    last = None
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for row in zip(*cols, strict=True):
            if held and row[key] != last:
                yield held
                held = []
            last = row[key]
            held.append(row)
    if held:
        yield held


def tiles(df: DataFrame, key: str, size: str, node: str, most: int) -> DataFrame:
    """Adds tile and side: a group of over `most` rows is laid into blocks by node, and each pair of blocks is a tile of
    its own; so no task gets more than about two blocks, and every pair of rows still meets once."""
    n = F.ceil(F.col(size) / F.lit(most)).cast("int")
    block = F.pmod(F.xxhash64(F.col(node)), n).cast("int")
    df = df.withColumn("_block", F.when(n > 1, block).otherwise(0)).withColumn("_other", F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)))
    return df.withColumn("tile", F.xxhash64(F.col(key), F.least("_block", "_other"), F.greatest("_block", "_other"))).withColumn("side", F.when(F.col("_block") == F.col("_other"), -1).otherwise((F.col("_block") > F.col("_other")).cast("int"))).drop("_block", "_other")


def candidate_edges(reps: DataFrame, paths: str, fan: float, threshold: float, most: int, levels: int, crowd: int, written: list[DataFrame]) -> DataFrame:
    """Edges (a, b) between the labels of sets that share a path and whose sketches are alike; a star for each group,
    never all pairs. Sets of one label are connected already: a bucket of one label only is left out, and only sets of
    different labels are compared.

    Paths of over `crowd` sets are told apart first, by counts; only these are split and laid into tiles. So no task that
    is dealt by path holds more than `crowd` rows of one. Tables that the edges read are added to `written`."""
    least = threshold - 0.25

    def deeper(batches: Iterator) -> Iterator:
        """The next step of each path: sampled tokens are the sketch's values, chosen by a hash of path and token."""
        import pyarrow as pa

        for batch in batches:
            paths, nodes = [], []
            for path, node, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                sk = np.frombuffer(raw, np.uint16)
                bins = np.flatnonzero(sk)
                token = mix(sk[bins].astype(np.uint64) * np.uint64(SKETCH) + bins.astype(np.uint64)) ^ np.uint64(path & (1 << 64) - 1)
                h = mix(token)
                for x in h[h <= np.uint64(min((1 << 64) - 1, int(2 * fan / max(len(bins), 1) * 2.0**64)))]:
                    paths.append(int(mix(x.reshape(1))[0].astype(np.int64)))
                    nodes.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.int64()), pa.array(nodes, pa.int64())], names=["path", "node"])

    def brute(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out: list[tuple] = []
        for rows in grouped(batches):
            if len(rows) < 2:
                continue
            sizes = np.array([r[2] for r in rows])
            sk = np.frombuffer(b"".join(r[3] for r in rows), np.uint16).reshape(-1, SKETCH)
            side = np.array([r[4] for r in rows])
            label = np.array([r[5] for r in rows])
            forest = Forest(len(rows))
            first: dict[int, int] = {}
            for i, x in enumerate(label.tolist()):
                forest.join(first.setdefault(x, i), i)
            for at in range(0, len(rows), 256):
                hit = alike(sk[at : at + 256], sk, sizes[at : at + 256], sizes, least, threshold)
                hit &= ((side[at : at + 256, None] != side[None, :]) | (side[None, :] == -1)) & (label[at : at + 256, None] != label[None, :])
                for i, j in zip(*np.nonzero(np.triu(hit, at + 1)), strict=True):
                    forest.join(at + int(i), int(j))
            out += set(forest.stars(label.tolist()))
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    light = reps.select("node", "n_tokens", "sketch", "label")
    front = reps.select(F.explode(paths).alias("path"), "node", "label")
    crowded = materialize(front.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("path"), "near-crowded")
    written.append(crowded)
    own = Window.partitionBy("path")
    few = front.join(crowded, "path", "left_anti").withColumn("low", F.min("label").over(own)).withColumn("high", F.max("label").over(own)).where("low < high")
    few = few.select(F.col("path").alias("tile"), "node").join(light, "node").select("tile", "node", "n_tokens", "sketch", F.lit(-1).alias("side"), "label")
    front = front.join(crowded, "path", "left_semi")
    ready = []
    for level in range(levels + 1):
        # Written first: the join below then knows their size, and can split a path's rows.
        sizes = materialize(front.groupBy("path", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("path").agg(F.sum("n").alias("n"), (F.pow(F.sum("n"), 2) - F.sum(F.col("n") * F.col("n"))).alias("cross")).where("cross > 0"), f"near-sizes{level}")
        front = materialize(front.join(sizes, "path"), f"near-front{level}")
        discard(sizes)
        written.append(front)
        large = F.col("cross") > most * most
        ready.append((front if level == levels else front.where(~large)).drop("cross"))
        if level == levels or not front.where(large).limit(1).count():
            break
        large = front.where(large).join(light.select("node", "sketch"), "node").select("path", "node", "sketch")
        front = large.mapInArrow(deeper, "path long, node long").join(light.select("node", "label"), "node")
    buckets = ready[0]
    for x in ready[1:]:
        buckets = buckets.unionByName(x)
    buckets = tiles(buckets.drop("label").join(light, "node"), "path", "n", "node", most).select("tile", "node", "n_tokens", "sketch", "side", "label")
    return few.unionByName(buckets).repartition("tile").sortWithinPartitions("tile").mapInArrow(brute, "a long, b long").distinct()


def _exact(rows: list[tuple], at_once: int = 1_000_000) -> tuple[np.ndarray, Forest]:
    """Number of linked texts of each row and the forest of the links, by exact intersections. rows: (tile, node,
    texts, tokens, side); whole numbers decide: a link holds if 9 |a and b| >= 4 (|a| + |b|), a likeness of 0.8.

    Shared tokens are counted range by range of hashes, about `at_once` tokens each, and pairs are judged 256 rows at a
    time: beside the sets, memory is one count for each pair of the tile."""
    tokens = [np.frombuffer(r[3], np.uint64) for r in rows]
    sizes = np.array([len(t) for t in tokens], dtype=np.int32)
    weight = np.array([r[2] for r in rows], dtype=np.int64)
    side = np.array([r[4] for r in rows])
    n = len(rows)
    both, more = np.zeros((n, n), dtype=np.float32), np.zeros((n, n), dtype=np.float32)
    step = max(64, (1 << 20) // n)
    ranges = max(1, -(-int(sizes.sum(dtype=np.int64)) // at_once))
    bounds = np.array([(i << 64) // ranges for i in range(1, ranges)], dtype=np.uint64)
    cuts = [np.concatenate([[0], np.searchsorted(t, bounds), [len(t)]]) for t in tokens]
    for k in range(ranges):
        parts = [t[c[k] : c[k + 1]] for t, c in zip(tokens, cuts, strict=True)]
        owner = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in parts])
        everything = np.concatenate(parts)
        order = np.argsort(everything, kind="stable")
        everything, owner = everything[order], owner[order]
        ids = np.cumsum(np.concatenate([[False], everything[1:] != everything[:-1]])[: len(everything)])
        shared = np.bincount(ids) > 1
        keep = shared[ids]
        owner, ids = owner[keep], np.cumsum(shared)[ids[keep]] - 1
        for lo in range(0, int(ids[-1]) + 1 if len(ids) else 0, step):
            a, b = np.searchsorted(ids, [lo, lo + step])
            block = np.zeros((n, step), dtype=np.float32)
            block[owner[a:b], ids[a:b] - lo] = 1
            both += np.dot(block, block.T, out=more)
    forest, linked = Forest(n), np.zeros(n, dtype=np.int64)
    for at in range(0, n, 256):
        hit = 9 * both[at : at + 256].astype(np.int32) >= 4 * (sizes[at : at + 256, None] + sizes[None, :])
        hit &= (side[at : at + 256, None] != side[None, :]) | (side[None, :] == -1)
        hit[np.arange(len(hit)), at + np.arange(len(hit))] = False
        linked[at : at + 256] = hit @ weight
        for i, j in zip(*np.nonzero(np.triu(hit, at + 1)), strict=True):
            forest.join(at + int(i), int(j))
    return linked, forest


def classes(docs: DataFrame, recall: float = 0.9999, fan: float = 1.5, most: int = 2048, levels: int = 3, tile: int = 1024, tokens_a_set: int = 4096, crowd: int = 256) -> DataFrame:
    """near_duplicates() with the least (no_id, row, same) of each row's class, which tells its first document."""
    runs = runs_for(recall, 0.8, fan)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.select("doc_id", row_key().alias("row"), F.xxhash64("text").alias("same"), "text")

    def first_steps(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["doc_id", "row", "same", "text_key", "set_key", "n_tokens", "first_paths", "more_paths", "sketch"]
        for batch in batches:
            keys, sets, sizes, paths, more, sketches = [], [], [], [], [], []
            column = batch.column(3)
            for k, words in word_hashes(column):
                tokens = shingles(words)
                keys.append(hashlib.blake2b(column[k].as_buffer(), digest_size=16).digest() if column[k].is_valid else b"")
                sets.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                sizes.append(len(tokens))
                one, rest = chosen(tokens, runs, fan)
                paths.append(one.view(np.int64))
                more.append(rest.view(np.int64))
                sketches.append(sketch(tokens).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(keys, pa.binary()), pa.array(sets, pa.binary()), pa.array(sizes, pa.int32()), pa.array(paths, pa.list_(pa.int64())), pa.array(more, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=names)

    rows = materialize(base.mapInArrow(first_steps, "doc_id long, row long, same long, text_key binary, set_key binary, n_tokens int, first_paths array<long>, more_paths array<long>, sketch binary"), "near-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "row", "same")).alias("first")
    texts = materialize(rows.groupBy("set_key", "text_key").agg(F.count(F.lit(1)).alias("n_copies"), first, F.first(F.struct("n_tokens", "first_paths", "more_paths", "sketch")).alias("x")), "near-texts")
    reps = texts.groupBy("set_key").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n_texts"), F.first("x").alias("x"))
    # Sets are numbered anew, as several may share an id; the numbers are those of the written table.
    reps = materialize(reps.select("set_key", F.monotonically_increasing_id().alias("node"), "first", "n_texts", "x.*"), "near-reps")
    sets = reps.where("n_tokens > 0")
    done: list[DataFrame] = []
    known = connected(candidate_edges(sets.withColumn("label", F.col("node")), "first_paths", fan, 0.8, most, levels, crowd, done), "near-a")
    sets = materialize(sets.join(known, "node", "left").withColumn("label", F.coalesce("label", "node")), "near-sets")
    edges = candidate_edges(sets, "more_paths", fan, 0.8, most, levels, crowd, done)
    comps = joined = connected(edges.union(known.select(F.col("node").alias("a"), F.col("label").alias("b"))), "near-b")
    comps = comps.join(reps.select("node", "first.row", "first.same", "n_texts", "n_tokens"), "node")
    # Long sets count as several, so that a block of a tile is bounded in tokens as in sets.
    weigh = F.greatest(F.count(F.lit(1)), F.ceil(F.sum("n_tokens") / tokens_a_set)).alias("n")
    comps = materialize(comps.join(comps.groupBy("label").agg(weigh), "label").drop("n_tokens"), "near-comps")
    discard(known, sets, joined, *done)

    def full_sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [shingles(w).tobytes() for _, w in word_hashes(batch.column(4))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.binary())], names=["label", "node", "n", "n_texts", "tokens"])

    def links(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out: list[tuple] = []
        make = lambda: pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["node", "to", "n"])
        for group in grouped(batches):
            if len(group) > 1:
                count, forest = _exact(group)
                nodes = [r[1] for r in group]
                out += [(node, node, int(c)) for node, c in zip(nodes, count, strict=True) if c]
                out += [(a, b, 0) for a, b in forest.stars(nodes)]
            if len(out) > 50_000:
                yield make()
                out = []
        yield make()

    # Always dealt by key: the sets to compare are a share of the documents, so they are no table to broadcast.
    bodies = base.select("row", "same", "text").join(comps.hint("merge"), ["row", "same"]).dropDuplicates(["node"]).select("label", "node", "n", "n_texts", "text")
    sets = bodies.mapInArrow(full_sets, "label long, node long, n long, n_texts long, tokens binary")
    sets = tiles(sets, "label", "n", "node", tile).select("tile", "node", "n_texts", "tokens", "side")
    found = materialize(sets.repartition("tile").sortWithinPartitions("tile").mapInArrow(links, "node long, to long, n long"), "near-links")
    counts = found.where("node = to").groupBy("node").agg(F.sum("n").alias("linked"))
    labels = connected(found.where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b")), "near-l")
    least = labels.join(reps.select("node", "first"), "node").groupBy("label").agg(F.min("first").alias("least"))
    by_set = reps.select("set_key", "node", "first", "n_texts").join(counts, "node", "left").join(labels, "node", "left").join(least, "label", "left")
    by_set = by_set.select("set_key", F.coalesce("least", "first").alias("least"), (F.coalesce("linked", F.lit(0)) + F.col("n_texts") - 1).alias("n_links"))
    by_text = texts.select("set_key", "text_key", "n_copies").join(by_set, "set_key").select("text_key", "least", "n_links", "n_copies")
    by_text = materialize(by_text, "near-by-text")
    discard(texts, reps, comps, found, labels)
    return rows.select("doc_id", "text_key").join(by_text, "text_key").select("doc_id", "least", "n_links", "n_copies")


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id, n_links, n_copies for every document.

    Two texts are linked if the Jaccard likeness of their sets of five-word shingles is 0.8 or more. class_id is the
    least doc_id connected by links or equal texts; n_links counts the other different texts linked to a text;
    n_copies the rows with the very same text.

    Chosen-path join: in each of enough independent runs for the target recall (see runs_for) a set goes to the buckets
    of its sampled tokens; buckets of over `crowd` sets with over `most` squared pairs that aren't connected yet are split
    by the next sampled shared token, `levels` deep; the others are compared by brute force. What the first run connects
    needn't be found again by the others. What stays large (families of near copies) is compared in tiles. Groups of
    equal sets go in once. A bucket reports a star of the sets that look alike, not their pairs; the sets a star
    connects are then compared with each other, every pair once, on their whole shingle sets; links are counted there.

    Null text counts as empty; texts without words are only linked to texts equal to them or without words. A text of
    fewer than five words has one shingle. Rows that repeat an id with the same text are copies; with another text they
    are documents of their own, so an id may be in several classes. class_id is a class's least id that isn't null; a
    class of null ids alone has a negative number made from its text. Empty input gives no rows; other columns are
    dropped. Settings: see classes()."""
    return classes(docs, **how).select("doc_id", F.col("least.row").alias("class_id"), "n_links", "n_copies")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """documents with one row of each class: the one of the least id (null ids last; of equal ids, that of the lowest hash
    of the text). Rows equal in id and text count once. A different text that shares an id stays, as it is of another
    class. Null and empty texts are one class; empty input gives no rows; all columns are kept, whatever their names."""
    row, same = own = fresh(docs, "_row", "_same")
    found = classes(docs, **how).select(F.col("least.row").alias(row), F.col("least.same").alias(same)).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumn(same, F.xxhash64(text)).withColumn(row, F.coalesce(F.col("doc_id").cast("long"), -F.abs(F.xxhash64(text) / 2).cast("long") - 1))
    return keyed.join(found, own, "left_semi").dropDuplicates(own).drop(*own)
