"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, fresh, materialize

CYCLE = (5.0, 2.0, 1.0)
CELLS = 4096


def quality_weight(text: Column) -> Column:
    """Weight of a document in the draw, in (0, 1]: falls with the share of mark-up and filler symbols."""
    text = F.coalesce(text, F.lit(""))
    symbols = F.length(text) - F.length(F.translate(text, "*#$%&|@{}<>\\^~_", ""))
    return 1.0 / (1.0 + 20.0 * symbols / F.greatest(F.length(text), F.lit(1)))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 of seed and id."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10)
    return (digits.cast("double") + 0.5) / float(16**13)


def source_targets(sizes: DataFrame, cycle: tuple[float, ...] = CYCLE, most_epochs: int = 3) -> DataFrame:
    """(source, source_size) -> adds target. Weights repeat over sources in code point order, null last. A target stops at
    most_epochs times the source's size; what is over is shared again by weight, which is the water level found here
    in one pass over sources sorted by cap / weight."""
    n = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(x) for x in cycle]), (n % len(cycle) + 1).cast("int"))
    at = Window.orderBy("ratio", F.col("source").isNull(), "source")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = sizes.withColumn("weight", weight).withColumn("cap", most_epochs * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    df = df.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    df = df.withColumn("before", F.coalesce(F.sum("cap").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    df = df.withColumn("rest", F.sum("weight").over(at.rowsBetween(0, Window.unboundedFollowing)))
    df = df.withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
    place = F.row_number().over(at)
    df = df.withColumn("place", place).withColumn("water", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(everything).getField("level"))
    return df.select("source", "source_size", F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, seed: int = 7, cycle: tuple[float, ...] = CYCLE, most_epochs: int = 3, boundary: str = "words") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, key for all documents.

    size counts the words of the whole text (null: 0). Complete epochs come first; what is left of the target is drawn
    without replacement by ascending key -ln(u)/weight and summed up to the budget. The document at the budget's edge
    gives just the words that are missing (boundary="words"), or is taken whole if at least half of it fits
    (boundary="documents"). Equal rows share a key and stand side by side; documents of size 0 are taken 0 times, as
    are all of a source whose words are none; null sources form one source. Empty input gives no rows; very long
    texts are documents of many words like any; other columns are dropped.

    A source may hold any share of the rows: its keys are laid into 4096 cells by 1-exp(-key), cells are summed before
    any shuffle by source, and rows are ranked one by one only inside the one cell where the budget ends."""
    u = uniform(F.col("doc_id"), seed)
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("tie"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), (-F.log(u) / quality_weight(F.col("text"))).alias("key"))
    sized = materialize(sized.withColumn("cell", F.least(F.floor((1 - F.exp(-F.col("key"))) * CELLS), F.lit(CELLS - 1)).cast("int")), "mix")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    cells = sized.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    targets = source_targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), cycle, most_epochs)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") + 1e-9), F.lit(most_epochs))).otherwise(0).cast("long"))
    targets = targets.withColumn("budget", F.greatest(F.lit(0), F.round(F.col("target") - F.col("epochs") * F.col("source_size"))).cast("long"))
    upto = F.sum("cell_size").over(Window.partitionBy("s2").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    edge = cells.withColumnRenamed("source", "s2").withColumn("upto", F.coalesce(upto, F.lit(0)))
    edge = edge.join(targets, same("s2", "source")).where("upto < budget and budget <= upto + cell_size").select("s2", F.col("cell").alias("edge"), "upto")
    plan = targets.join(edge, same("s2", "source"), "left").select(F.col("source").alias("s1"), "source_size", "target", "epochs", "budget", F.coalesce("edge", F.lit(-1)).alias("edge"), F.coalesce("upto", F.lit(0)).alias("upto"))
    rows = sized.join(materialize(plan, "mix-plan"), same("source", "s1")).drop("s1")
    part = F.when(F.col("cell") < F.col("edge"), F.col("size")).otherwise(F.lit(0))
    clear = rows.where("cell <> edge").withColumn("part", part)
    ranked = rows.where("cell = edge").withColumn("ahead", F.col("upto") + F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if boundary == "words":
        part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("ahead")))
    else:
        part = F.when(F.col("ahead") + F.col("size") / 2 <= F.col("budget"), F.col("size")).otherwise(F.lit(0))
    out = clear.unionByName(ranked.withColumn("part", part).drop("ahead"))
    taken = (F.col("epochs") * F.col("size") + F.col("part")).cast("long")
    copies = (F.col("epochs") + F.when(F.col("part") > 0, 1).otherwise(0)).cast("long")
    return out.select("doc_id", "source", "tie", "size", "source_size", F.round("target", 4).alias("target"), taken.alias("taken"), F.when(F.col("size") > 0, copies).otherwise(0).cast("long").alias("copies"), F.round("key", 9).alias("key"))


def take(docs: DataFrame, **how) -> DataFrame:
    """documents' rows, each as often as the mix takes it as a whole; columns as they were.

    Rows that share an id (or a null id) and text are told apart by nothing and so share a count: their copies are
    taken alike."""
    ident, tie, source, copies, text, n = own = fresh(docs, "_id", "_tie", "_source", "_copies", "_text", "_n")
    plan = mix(docs, boundary="documents", **how).where("copies > 0")
    keyed = plan.groupBy(F.col("doc_id").alias(ident), F.col("tie").alias(tie), F.col("source").alias(source)).agg(F.max("copies").alias(copies))
    rows = docs.withColumn(text, F.xxhash64("text"))
    out = rows.join(keyed, F.col("doc_id").cast("long").eqNullSafe(F.col(ident)) & (F.col(text) == F.col(tie)) & rows["source"].cast("string").eqNullSafe(F.col(source)))
    return out.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).drop(*own)
