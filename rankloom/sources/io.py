"""Sources and sinks: JSON lines, JSON documents, CSV, topics, judgements, run history."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def work_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local session (tests) gets a temporary one; on a cluster
    that is an error, as executors don't share the driver's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or os.path.join(tempfile.gettempdir(), "rankloom-checkpoints")).rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new folder below work_dir."""
    return f"{work_dir(spark)}/io-{uuid.uuid4().hex}"


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of a JSON-lines folder or file; blank lines are skipped. strict: a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def scans_files(df: DataFrame) -> bool:
    """Whether df is a scan of files with nothing but selections and filters above it, so that its rows still stand in the
    order of their files."""
    nodes = [df._jdf.queryExecution().analyzed()]
    for node in nodes:
        below = node.children()
        nodes += [below.apply(i) for i in range(below.size())]
    names = [n.nodeName() for n in nodes]
    try:
        df.select("_metadata.file_path", "_metadata.file_block_start")
    except AnalysisException:  # not of files
        return False
    return names.count("LogicalRelation") == 1 and set(names) <= {"LogicalRelation", "Project", "Filter", "SubqueryAlias", "View"}


def numbered(df: DataFrame, out: str) -> DataFrame:
    """Adds out: 0 to n - 1, dense and unique, in the order of df. Of files that are only selected from and filtered: by
    file name, then by place in the file; of a sorted frame: as it is sorted; a frame without an order (after a join, a
    repartition) is numbered in the order in which it happens to be written.

    Rows are written once with their place in their task, so whatever made them is computed a single time; the counts of
    the file blocks or tasks before are added. One row for each block or task is what the offsets take; no row of df is
    moved."""
    names = [next(n for i in range(99) if (n := f"_{c}{i or ''}") not in df.columns) for c in ("at", "task", "in")]
    at, task, place = names
    where = F.struct("_metadata.file_path", "_metadata.file_block_start") if scans_files(df) else F.struct(F.lit("").alias("file_path"), F.lit(0).cast("long").alias("file_block_start"))
    path = scratch(df.sparkSession)
    df.select("*", where.alias(at), F.spark_partition_id().alias(task), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(place)).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    counts = rows.groupBy(at, task).agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first"))
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy(at, task).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(at, task, (ahead - F.col("_first")).alias("_shift"))
    return rows.join(offsets, [at, task]).select(*[F.col(f"`{c}`") for c in df.columns if c != out], (F.col(place) + F.col("_shift")).alias(out))


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(line, text) of the lines that don't parse, by number from 1. Lines are numbered within the whole folder, its files
    read one after another."""
    text = numbered(spark.read.text(path).withColumnRenamed("value", "text"), "line").withColumn("line", F.col("line") + 1)
    parsed = F.from_json("text", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    return text.where("trim(text) <> ''").withColumn("x", parsed).where("x._bad is not null").select("line", "text")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Fixed header if columns are given (absent ones are null), else the frame's own order."""
    cols = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns or df.columns]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def union_rows(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id, text of a JSON-lines folder, without the rows where either is blank."""
    rows = read_jsonl(spark, path, "query_id string, text string")
    return rows.where("trim(query_id) <> '' and trim(text) <> ''")


def write_backend(spark: SparkSession, path: str, backend: str) -> None:
    """Note which variant an index was built for."""
    if backend not in ("okapi", "lucene"):
        raise ValueError(f"unknown backend {backend}")
    write_report(spark.createDataFrame([(backend,)], "backend string"), path)


def read_backend(spark: SparkSession, path: str, default: str = "okapi") -> str:
    """The noted variant, or the default where nothing is noted."""
    try:
        row = spark.read.schema("backend string").option("multiLine", True).json(path).first()
    except AnalysisException:
        return default
    return row[0] if row and row[0] else default


def read_qrels_json(spark: SparkSession, path: str) -> DataFrame:
    """qid, docid of one JSON object {qid: [docid, ...]}. Such an object is one value, so it must fit a task; larger
    judgements go as JSON lines."""
    m = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<string>>").alias("m"))
    return m.select(F.explode("m").alias("qid", "docs")).select("qid", F.explode("docs").alias("docid")).distinct()


def positive_qrels(df: DataFrame) -> DataFrame:
    """qid, docid of a map column docid -> score: castable and above 0."""
    e = df.select("qid", F.explode("judgements").alias("docid", "score"))
    return e.where(F.expr("try_cast(score as double)") > 0).select("qid", "docid")


def topic_text(payload: Column) -> Column:
    """The first field of a topic that isn't blank: title, query, question, description, text, then any."""
    named = [F.nullif(F.trim(payload[k]), F.lit("")) for k in ("title", "query", "question", "description", "text")]
    return F.coalesce(*named, F.get(F.filter(F.map_values(payload), lambda x: F.trim(x) != ""), F.lit(0)))


def topics_qrels(topics: DataFrame, judgements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries: qid, text; judgements: qid, docid) of topics (qid, payload: map) and of judgements (qid, map of docid to
    score): positive judgements, and the topics with text that have one."""
    positive = positive_qrels(judgements).distinct()
    queries = topics.select("qid", topic_text(F.col("payload")).alias("text")).where("text <> ''")
    return queries.join(positive, "qid", "left_semi"), positive


def first_field(df: DataFrame, names: list[str], default=None) -> Column:
    return F.coalesce(*[F.col(n) for n in names if n in df.columns], F.lit(default))


def head_of(expression: str) -> tuple[str, int | None]:
    """'train[:500]' -> ('train', 500)."""
    m = re.fullmatch(r"\s*(\w+)\[:(\d+)\]\s*", expression)
    return (m[1], int(m[2])) if m else (expression.strip(), None)


def read_split(spark: SparkSession, folder: str, expression: str) -> DataFrame:
    name, n = head_of(expression)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df if n is None else df.limit(n)


def first_readable(spark: SparkSession, paths: list[str]) -> DataFrame:
    for p in paths:
        try:
            return spark.read.parquet(p)
        except AnalysisException:
            continue
    raise FileNotFoundError(f"none of {paths} can be read")


def ordinals(df: DataFrame, prefix: str = "Q", column: str = "qid") -> DataFrame:
    """Adds prefix + row index of the input's order."""
    return numbered(df, "_ordinal").withColumn(column, F.concat(F.lit(prefix), F.col("_ordinal").cast("string"))).drop("_ordinal")


def last_by_key(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row of each key: that of the highest ordinal."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), ordinal).alias("x")).select("x.*")


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def history(spark: SparkSession, path: str) -> DataFrame:
    """Runs with their rows, in order of time; one row of each (run, prompt), the latest."""
    rows = last_by_key(spark.read.parquet(path).withColumn("k", F.concat_ws("\x1f", "run_id", "prompt_id")), "k", "at").drop("k")
    return rows.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("at", "prompt_id", "metric"))).alias("results"))


def write_report(df: DataFrame, path: str) -> None:
    """One-row frame as an indented JSON document, in any store that Spark writes to."""
    row = df.limit(2).toJSON().collect()
    if len(row) != 1:
        raise ValueError("a report is one row")
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(json.dumps(json.loads(row[0]), indent=2, ensure_ascii=False).encode()))
    finally:
        out.close()


def read_reports(spark: SparkSession, manifest: DataFrame, schema: str, missing: str = "error") -> DataFrame:
    """The rows of a manifest (report_path and other columns) with the fields of their reports, JSON documents of a schema.

    Tasks open the files, so there is no list of them on the driver and no limit to their number; any store that Arrow
    opens will do. A file that isn't there is named in the error, or with missing="null" its row has nulls; a file that
    isn't such a document is an error."""
    if missing not in ("error", "null"):
        raise ValueError(f"unknown choice {missing}")
    names = [f"c{i}" for i in range(len(manifest.columns))]
    at = manifest.columns.index("report_path")

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            texts = []
            for path in batch.column(at).to_pylist():
                try:
                    store, place = fs.FileSystem.from_uri(path)
                    with store.open_input_stream(place) as f:
                        texts.append(f.read().decode())
                except FileNotFoundError as e:
                    if missing == "error":
                        raise FileNotFoundError(f"no report at {path}") from e
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "text"])

    plain = manifest.toDF(*names)
    tasks = 4 * spark.sparkContext.defaultParallelism
    rows = plain.where(F.col(names[at]).isNotNull()).repartition(tasks).mapInArrow(read, plain.schema.add("text", "string"))
    parsed = rows.withColumn("x", F.from_json("text", schema, {"mode": "FAILFAST"})).drop("text")
    fields = parsed.schema["x"].dataType.names
    return parsed.select(*[F.col(n).alias(c) for n, c in zip(names, manifest.columns, strict=True)], *[F.col(f"x.`{f}`").alias(f) for f in fields])


def rewrite_host(url: Column, host: str, endpoint: str) -> Column:
    return F.regexp_replace(url, "^https?://" + re.escape(host), endpoint.rstrip("/"))
