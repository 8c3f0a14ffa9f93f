"""Pieces the operators share: written tables, word hashing on Arrow buffers, connected classes."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

# Bytes that separate words (fixed values): space and the five ASCII controls 9..13.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local session (tests) gets a temporary one; on a cluster
    that is an error, as executors don't share the driver's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "rankloom-checkpoints")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more. Only for tables whose readers are written themselves:
    what a returned frame still reads must stay."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until none is a column of df in any case of letters."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def map_rows(df: DataFrame, run, extra: dict[str, str] | None = None) -> DataFrame:
    """df.mapInArrow(run) with df's columns, and `extra` ones (name: type) after them. Columns go to run as c0, c1, ...,
    so any names do, dotted ones too."""
    names = [f"c{i}" for i in range(len(df.columns) + len(extra or {}))]
    schema = StructType([StructField(n, f.dataType) for n, f in zip(names, df.schema.fields, strict=False)])
    for name, kind in zip(names[len(df.columns) :], (extra or {}).values(), strict=True):
        schema = schema.add(name, kind)
    return df.toDF(*names[: len(df.columns)]).mapInArrow(run, schema).toDF(*df.columns, *(extra or {}))


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """doc_id, or for a null id a negative hash of the text."""
    return F.coalesce(F.col(doc_id).cast("long"), -F.abs(F.xxhash64(F.col(text)) / 2).cast("long") - 1)


# ---- hashing whole words of many texts at once -------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_ODD), -1, 1 << 64))
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (finaliser of the published splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SEPARATORS)] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = powers(_ODD, CHUNK + 1), powers(_INV, CHUNK + 1)


def _words_of_chunk(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in data and their first bytes; a word also ends where a text starts."""
    n = len(data)
    inside = ~_SPACE[data]
    begin = inside.copy()
    begin[1:] &= _SPACE[data[:-1]]
    cut = starts[(starts > 0) & (starts < n)]
    begin[cut] = inside[cut]
    finish = inside.copy()
    finish[:-1] &= _SPACE[data[1:]]
    finish[cut - 1] = inside[cut - 1]
    b, e = np.flatnonzero(begin), np.flatnonzero(finish)
    up, down = (_UP, _DOWN) if n <= CHUNK else (powers(_ODD, n), powers(_INV, n))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:n], dtype=np.uint64)])
    return mix((total[e + 1] - total[b]) * down[b]), b


def _cuts(data: np.ndarray, at: int, end: int) -> Iterator[tuple[int, int]]:
    """Pieces of one long text, cut at separators, so that no word is split."""
    while end - at > CHUNK:
        gaps = np.flatnonzero(_SPACE[data[at + CHUNK // 2 : at + CHUNK]])
        to = at + CHUNK // 2 + int(gaps[-1]) + 1 if len(gaps) else None
        if to is None:
            more = np.flatnonzero(_SPACE[data[at + CHUNK : end]])
            to = at + CHUNK + int(more[0]) + 1 if len(more) else end
        yield at, to
        at = to
    if end > at:
        yield at, end


def word_hashes(column) -> Iterator[tuple[int, np.ndarray]]:
    """For each text of an Arrow string column: its row and a 64-bit hash of each word, in order."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1
        if stop <= row:
            parts = [_words_of_chunk(data[a:b], np.zeros(0, np.int64))[0] for a, b in _cuts(data, int(offsets[row]), int(offsets[row + 1]))]
            yield row, np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            row += 1
            continue
        stop = min(stop, n)
        base = int(offsets[row])
        piece = data[base : int(offsets[stop])]
        own = offsets[row : stop + 1] - base
        if len(piece):
            hashes, at = _words_of_chunk(piece, own[:-1])
        else:
            hashes, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        bounds = np.searchsorted(at, own)
        for k in range(stop - row):
            yield row + k, hashes[bounds[k] : bounds[k + 1]]
        row = stop


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Distinct hashes of runs of `width` words, sorted; a shorter text has one run of all its words."""
    n = len(words)
    if n == 0:
        return words
    k = min(width, n)
    m = n - k + 1
    out = np.zeros(m, dtype=np.uint64)
    for i in range(k):
        out = out * _ODD + words[i : i + m]
    return np.unique(mix(out + np.uint64(k)))


# ---- classes of linked nodes ------------------------------------------------------------------

def connected(edges: DataFrame, tag: str, most_rounds: int = 60) -> DataFrame:
    """(node, label): label is the least node reachable over edges (a, b). Nodes without an edge are absent.

    Every round takes the least label among neighbours and then jumps to that label's own label, so chains halve;
    each round is a written table, and nothing but one count reaches the driver. Tables of earlier rounds are deleted."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{tag}-edges")
    labels = step = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")).select("node", "label"), f"{tag}-labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("m"))
        low = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        before, step = step, materialize(low.join(up, "label", "left").select("node", "was", F.least("label", F.coalesce("up", "label")).alias("label")), f"{tag}-labels")
        discard(before)
        labels = step.select("node", "label")
        if not step.where("was <> label").limit(1).count():
            discard(both)
            labels.written_to = step.written_to
            return labels
    raise RuntimeError("labels did not settle")
