"""Cascading erasure: tables as sorted files, Bloom filters that shortlist files, exact joins that confirm victims, and
a streaming rewrite of the confirmed files only."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, fresh, materialize, shared_dir

FILES = 250
BATCH = 1 << 16
GROUP = 1 << 17
# A Bloom block is 8 words of 64 bits; a key sets one bit in each word of one block; a block is meant for 16 keys.
WORDS, KEYS_A_BLOCK = 8, 16


@dataclass(frozen=True)
class Layer:
    """A table of the cascade: its rows, their leading sort value (a column that isn't written), the link key by which
    victims are found, the layer whose victims give those keys in column `gives` (None: the first keys), and the column of
    amounts."""

    name: str
    frame: DataFrame
    lead: str
    key: str
    parent: str | None
    gives: str | None
    amount: str
    scratch: tuple[DataFrame, ...] = ()  # written tables that only frame reads

    @property
    def columns(self) -> list[str]:
        return [c for c in self.frame.columns if c != self.lead]


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Sink:
    """A Parquet file that is filled batch by batch beside its place; the file system's own name of it is `at`."""

    def __init__(self, uri: str, schema):
        import pyarrow.parquet as pq

        self.fs, self.at = _file_system(uri)
        self.fs.create_dir(self.at.rsplit("/", 1)[0], recursive=True)
        self.schema, self.held, self.rows, self.total = schema, [], 0, 0
        self.writer = pq.ParquetWriter(self.at, schema, filesystem=self.fs, compression="snappy")

    def add(self, batch) -> None:
        if batch.num_rows:
            self.held.append(batch)
            self.rows += batch.num_rows
            self.total += batch.num_rows
            if self.rows >= GROUP:
                self._write()

    def _write(self) -> None:
        import pyarrow as pa

        if self.held:
            self.writer.write_table(pa.Table.from_batches(self.held).cast(self.schema), row_group_size=GROUP)
            self.held, self.rows = [], 0

    def close(self) -> int:
        self._write()
        self.writer.close()
        return self.total


def _slice(uri: str, columns: list[str], start: int, stop: int) -> Iterator:
    """Batches of the rows start to stop of a Parquet file; row groups before and after aren't read."""
    import pyarrow.parquet as pq

    fs, at = _file_system(uri)
    with fs.open_input_file(at) as source:
        file = pq.ParquetFile(source)
        ahead = 0
        for g in range(file.metadata.num_row_groups):
            n = file.metadata.row_group(g).num_rows
            if ahead < stop and ahead + n > start:
                place = ahead
                for batch in file.iter_batches(BATCH, row_groups=[g], columns=columns, use_threads=False):
                    a, b = max(start - place, 0), min(stop - place, batch.num_rows)
                    if a < b:
                        yield batch.slice(a, b - a)
                    place += batch.num_rows
            ahead += n


def _dealt(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small frame whose rows go to tasks of their own, as far as there are cores."""
    return spark.createDataFrame(rows, schema).repartition(max(1, min(len(rows), 2 * spark.sparkContext.defaultParallelism)))


def lay_out(layer: Layer, folder: str, files: int = FILES) -> tuple[int, dict[int, str]]:
    """Write the layer's n rows, sorted by its lead and then all columns (ascending, nulls first), as Parquet files of
    1 + n // files consecutive rows: that number, and {file_no: path}.

    One sort deals the rows by ranges of the whole order, so a client with a third of the rows is many ranges. Each file
    is then read off the sorted ranges in order by one task, streaming, without another shuffle, written beside its place
    and moved there: a task that runs twice leaves the same file."""
    spark, columns = layer.frame.sparkSession, layer.columns
    (part,) = fresh(layer.frame, "range")
    order = [F.col(f"`{c}`").asc_nulls_first() for c in (layer.lead, *columns)]
    sorted_path = f"{folder}-sorted/{layer.name}"
    ranges = layer.frame.orderBy(*order).select(*[f"`{c}`" for c in columns], F.spark_partition_id().alias(part))
    ranges.write.option("parquet.block.size", 8 << 20).parquet(sorted_path)
    counts = spark.read.parquet(sorted_path).groupBy(F.col(part).alias("r"), F.col("_metadata.file_path").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    counts = sorted((r["r"], r["p"], r["n"]) for r in counts.collect())  # a row for each task of the sort
    n = sum(c[2] for c in counts)
    size = 1 + n // files
    plan: list[tuple[int, str, list[tuple[str, int, int]]]] = [(k, f"{folder}/{layer.name}/{k:05d}.parquet", []) for k in range(-(-n // size))]
    at = 0
    for _, path, m in counts:
        for k in range(at // size, -(-(at + m) // size)):
            plan[k][2].append((path, max(k * size - at, 0), min((k + 1) * size - at, m)))
        at += m
    if not plan:
        _delete(spark, sorted_path)
        return size, {}

    from pyspark.sql.pandas.types import to_arrow_schema

    schema, stage = to_arrow_schema(layer.frame.select(*[f"`{c}`" for c in columns]).schema), f"{folder}-stage"

    def write(batches: Iterator) -> Iterator:
        for batch in batches:
            for row in batch.to_pylist():
                sink = _Sink(f"{stage}/{uuid.uuid4().hex}.parquet", schema)
                for s in row["slices"]:
                    for piece in _slice(s["path"], columns, s["start"], s["stop"]):
                        sink.add(piece)
                sink.close()
                fs, to = _file_system(row["target"])
                fs.create_dir(to.rsplit("/", 1)[0], recursive=True)
                fs.move(sink.at, to)
            yield batch.select(["file_no"])

    _dealt(spark, plan, "file_no long, target string, slices array<struct<path: string, start: long, stop: long>>").mapInArrow(write, "file_no long").collect()
    _delete(spark, sorted_path)
    return size, {k: path for k, path, _ in plan}


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _numbered(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.parquet(*paths).withColumn("file_no_", F.regexp_extract("_metadata.file_name", r"(\d+)\.parquet$", 1).cast("long"))


def _bits() -> list:
    """The bit that a key sets in each word: six bits each of h_, its second xxhash."""
    return [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h_, {6 * i}) & 63 as int))") for i in range(WORDS)]


def bloom_filters(spark: SparkSession, files: dict[int, str], key: str, blocks: int) -> DataFrame:
    """file_no, block, w0..w7: the Bloom filter of each file over its keys, one row for each block with a bit set. Built
    by partial aggregation (bit_or), so a key with a third of the rows is one row for each task."""
    keys = _numbered(spark, list(files.values())).where(F.col(f"`{key}`").isNotNull()).select("file_no_", F.xxhash64(f"`{key}`").alias("b_"), F.xxhash64(f"`{key}`", F.lit(1)).alias("h_"))
    return keys.groupBy(F.col("file_no_").alias("file_no"), F.pmod("b_", F.lit(blocks)).alias("block")).agg(*[F.bit_or(w).alias(f"w{i}") for i, w in enumerate(_bits())])


def shortlist(filters: DataFrame, keys: DataFrame, blocks: int) -> list[int]:
    """The files whose filter holds a key of keys (one column, distinct): all that have one, and a few that don't. Keys
    meet filters by block, so neither has to fit a task. At most as many as there are files reach the driver."""
    (key,) = keys.columns
    asked = keys.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), F.xxhash64(key, F.lit(1)).alias("h_"))
    asked = asked.select("block", *[w.alias(f"m{i}") for i, w in enumerate(_bits())])
    inside = F.expr(" and ".join(f"(w{i} & m{i}) = m{i}" for i in range(WORDS)))
    hit = filters.alias("f").join(asked.alias("k"), (F.col("f.block") == F.col("k.block")) & inside, "left_semi")
    return sorted(r[0] for r in hit.select("file_no").distinct().collect())


def confirm(spark: SparkSession, paths: list[str], layer: Layer, keys: DataFrame, below: list[str]) -> DataFrame:
    """file_no, row (place in the file) and the columns of `below` (keys of the next layers) of the rows whose link key is
    one of keys, by an exact join over the shortlisted files."""
    (key,) = keys.columns
    rows = _numbered(spark, paths).select(F.col(f"`{layer.key}`").alias(key), F.col("file_no_").alias("file_no"), F.col("_metadata.row_index").alias("row"), *[F.col(f"`{c}`").alias(f"gives_{c}") for c in below])
    return rows.join(keys, key, "left_semi").drop(key)


class _Rewrite:
    """Streams one file, leaving out rows by place. Places come in ascending order and in pieces; no more of the file is
    read than the places known so far decide."""

    def __init__(self, source: str, target: str):
        import pyarrow.parquet as pq

        self.fs, at = _file_system(source)
        self.input = self.fs.open_input_file(at)
        self.file = pq.ParquetFile(self.input)
        self.batches = self.file.iter_batches(BATCH, use_threads=False)
        self.sink = _Sink(target, self.file.schema_arrow)
        self.known, self.read, self.erased = np.zeros(0, np.int64), 0, 0
        self.ahead = next(self.batches, None)

    def _pass(self) -> None:
        import pyarrow as pa

        end = self.read + self.ahead.num_rows
        cut = int(np.searchsorted(self.known, end))
        keep = np.ones(self.ahead.num_rows, bool)
        keep[self.known[:cut] - self.read] = False
        self.sink.add(self.ahead.filter(pa.array(keep)))
        self.erased += int((~keep).sum())
        self.known, self.read, self.ahead = self.known[cut:], end, next(self.batches, None)

    def drop(self, places: np.ndarray) -> None:
        self.known = np.concatenate([self.known, places])
        while self.ahead is not None and self.known[-1] >= self.read + self.ahead.num_rows:
            self._pass()
            if not len(self.known):
                break

    def close(self) -> tuple[int, int]:
        while self.ahead is not None:
            self._pass()
        self.input.close()
        return self.sink.close(), self.erased


def rewrite(victims: DataFrame, files: dict[str, dict[int, str]], stage: str) -> list[tuple[str, int, str, int, int]]:
    """(name, file_no, staged path, rows left, rows erased) of each file that holds a victim (victims: name, file_no,
    row). The originals aren't touched, so a task that runs twice reads what it read before. At most as many rows as there
    are files reach the driver."""
    spark = victims.sparkSession

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one = at = target = None

        def done():
            left, erased = one.close()
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, target, left, erased)], names=["name", "file_no", "path", "left", "erased"])

        for batch in batches:
            names, numbers, places = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            starts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1] or numbers[i] != numbers[i - 1]), len(names)]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if a == b:
                    continue
                if at != (names[a], int(numbers[a])):
                    if one:
                        yield done()
                    at = (names[a], int(numbers[a]))
                    target = f"{stage}/{at[0]}-{at[1]:05d}-{uuid.uuid4().hex}.parquet"
                    one = _Rewrite(files[at[0]][at[1]], target)
                one.drop(places[a:b])
        if one:
            yield done()

    tasks = max(1, min(sum(map(len, files.values())), 2 * spark.sparkContext.defaultParallelism))
    sorted_places = victims.select("name", "file_no", "row").repartition(tasks, "name", "file_no").sortWithinPartitions("name", "file_no", "row")
    return [tuple(r) for r in sorted_places.mapInArrow(run, "name string, file_no long, path string, left long, erased long").collect()]


def _described(batches: Iterator) -> Iterator:
    """Rows of the result for files (table_name, file_no, path, n_erased, rewritten, amount), read from the files."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            fs, at = _file_system(row["path"])
            with fs.open_input_file(at) as source:
                file = pq.ParquetFile(source)
                names = file.schema_arrow.names
                digest, n, cents = hashlib.sha256(), 0, 0
                for piece in file.iter_batches(BATCH, columns=list(dict.fromkeys([names[0], row["amount"]])), use_threads=False):
                    ids = ["" if x is None else str(x) for x in piece.column(names[0]).to_pylist()]
                    digest.update((("," if n else "") + ",".join(ids)).encode())
                    x = np.nan_to_num(piece.column(row["amount"]).cast(pa.float64()).fill_null(0.0).to_numpy(), nan=0.0, posinf=0.0, neginf=0.0)
                    cents += int(np.floor(100 * x + 0.5).astype(np.int64).sum())
                    n += piece.num_rows
            out.append((row["table_name"], row["file_no"], n, row["n_erased"], cents, row["rewritten"], digest.hexdigest(), ",".join(names), row["path"]))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string())
        columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])


RESULT = "table_name string, file_no long, n_rows long, n_erased long, cents long, rewritten boolean, ids_sha256 string, columns string, path string"


def erase(layers: list[Layer], keys: DataFrame, folder: str, files: int = FILES) -> DataFrame:
    """Lay the layers out as sorted files below folder, erase the rows that hang on `keys` (one column, keys of the first
    layer) and return a row for each file that is left (RESULT).

    From the first layer down, xxhash Bloom filters on the link keys shortlist files and exact joins confirm the rows;
    their own keys go on to the layers below. Files with confirmed rows stream through a filter and take the place of the
    old ones once all are written, so their footers know the survivors only; emptied files go, others stay as they are. A
    run that died is run again in a new folder.

    Null keys link nothing; rows that repeat are erased together; an empty table has no file; columns of any name are
    written as they are, in order; a file is held by no task as a whole. NaN and infinite amounts count as 0."""
    spark = keys.sparkSession
    sizes, at = {}, {}
    for x in layers:
        sizes[x.name], at[x.name] = lay_out(x, folder, files)
        discard(*x.scratch)
    found: dict[str, DataFrame] = {}
    victims, written = None, []
    for layer in layers:
        own = keys if layer.parent is None else found[layer.parent].select(f"gives_{layer.gives}")
        own = materialize(own.toDF("key").where("key is not null").distinct(), "erasure-keys")
        below = sorted({x.gives for x in layers if x.parent == layer.name and x.gives})
        blocks = -(-sizes[layer.name] // KEYS_A_BLOCK)
        short = []
        if at[layer.name]:
            filters = materialize(bloom_filters(spark, at[layer.name], layer.key, blocks), "erasure-bloom")
            short = shortlist(filters, own, blocks)
            discard(filters)
        if short:
            rows = confirm(spark, [at[layer.name][k] for k in short], layer, own, below)
        else:
            rows = layer.frame.limit(0).select(F.lit(0).cast("long").alias("file_no"), F.lit(0).cast("long").alias("row"), *[F.col(f"`{c}`").alias(f"gives_{c}") for c in below])
        found[layer.name] = materialize(rows, "erasure-victims")
        written += [own, found[layer.name]]
        part = found[layer.name].select(F.lit(layer.name).alias("name"), "file_no", "row")
        victims = part if victims is None else victims.unionByName(part)
    changed = {(name, k): (path, left, erased) for name, k, path, left, erased in rewrite(victims, at, f"{folder}-stage")}
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    final = []
    for layer in layers:
        for k, path in at[layer.name].items():
            staged, left, erased = changed.get((layer.name, k), (None, 1, 0))
            old = spark._jvm.org.apache.hadoop.fs.Path(path)
            if staged:
                fs.delete(old, False)
                if left and not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(staged), old):
                    raise OSError(f"can't move {staged} to {path}")
            if left:
                final.append((layer.name, k, path, erased, bool(staged), layer.amount))
    discard(*written)
    _delete(spark, f"{folder}-stage")
    _delete(spark, f"{folder}-sorted")
    if not final:
        return spark.createDataFrame([], RESULT)
    return _dealt(spark, final, "table_name string, file_no long, path string, n_erased long, rewritten boolean, amount string").mapInArrow(_described, RESULT)


def chosen_masters(clients: DataFrame, clicks: DataFrame, modulus: int = 200) -> DataFrame:
    """master_id of the masters to erase: those whose crc32 is divisible by modulus, and the one whose clients together
    have most clicks (ties, at 0 too: the smallest). Null masters are none; a client that repeats counts once."""
    pairs = clients.where("master_id is not null").select("master_id", "client_id").distinct()
    counts = clicks.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))
    most = pairs.join(counts, "client_id", "left").groupBy("master_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n")).orderBy(F.desc("n"), "master_id").limit(1)
    some = pairs.where(F.crc32(F.col("master_id").cast("string")) % modulus == 0).select("master_id")
    return some.unionByName(most.select("master_id")).distinct()


def shop_layers(clients: DataFrame, clicks: DataFrame, sales: DataFrame, lines: DataFrame) -> list[Layer]:
    """The shop's cascade: masters, their clients, these clients' clicks and sales, these sales' lines; sorted by crc32 of
    the client. A line whose sale is missing or has no client sorts as an empty client; a sale_id that repeats with several
    clients sorts its lines by the least."""
    mark = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")))
    out = []
    for name, frame, key, parent, gives, amount in (
        ("clients", clients, "master_id", None, None, "balance"),
        ("clicks", clicks, "client_id", "clients", "client_id", "value"),
        ("sales", sales, "client_id", "clients", "client_id", "total"),
        ("sale_lines", lines, "sale_id", "sales", "sale_id", "amount"),
    ):
        (lead,), scratch = fresh(frame, "lead"), ()
        if name == "sale_lines":
            # Written, so that the join is of two plain exchanges, of which Spark can split the key of a hot sale.
            owner = materialize(sales.where("sale_id is not null").groupBy("sale_id").agg(F.min("client_id").alias("c")).select("sale_id", mark("c").alias(lead)), "erasure-owners")
            scratch = (owner,)
            frame = frame.join(owner, "sale_id", "left").select(*[frame[f"`{c}`"] for c in frame.columns], F.coalesce(lead, F.lit(0).cast("long")).alias(lead))
        else:
            frame = frame.withColumn(lead, mark("client_id"))
        out.append(Layer(name, frame, lead, key, parent, gives, amount, scratch))
    return out


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/erasure-{uuid.uuid4().hex}"
