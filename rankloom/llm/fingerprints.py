"""One-permutation MinHash fingerprints, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import GAP, WORD, materialize

BINS = 256
BITS = 4
PROBES = 8
EMPTY = ""


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def packed(text: Column, width: int = 5) -> Column:
    """The fingerprint of a text as 16 longs of 16 four-bit fields; an empty array for a text without words.

    Words are runs of other than ASCII white space. Every run of `width` words (all words, if fewer) is hashed once;
    its top 8 bits choose the bin and each bin keeps its least hash. An empty bin takes the value of a filled bin chosen
    by a hash of its own number and the try, the same for all texts (optimal densification); after 8 tries the filled
    bin with the least hash of both numbers is taken, so the search always ends."""

    def from_hashes(hashes):
        minima = F.filter(hashes, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(F.get(hashes, i - 1), 56)))
        return _let(minima, from_minima)

    def from_minima(minima):
        return _let(F.transform(minima, lambda x: F.shiftright(x, 56)), lambda bins: from_bins(minima, bins))

    def from_bins(minima, bins):
        dense = F.transform(F.sequence(F.lit(-128), F.lit(127)), lambda b: F.get(minima, (F.array_position(bins, b.cast("long")) - 1).cast("int")))
        return _let(dense, lambda d: from_dense(minima, d))

    def from_dense(minima, dense):
        def filled(v, i):
            tries = [F.get(dense, F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(PROBES)]
            last = F.array_min(F.transform(minima, lambda x: F.struct(F.xxhash64(i, F.shiftright(x, 56)).alias("o"), x.alias("x")))).getField("x")
            return F.coalesce(v, *tries, last)

        return _let(F.transform(dense, filled), pack)

    def pack(values):
        return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: F.aggregate(F.slice(values, j * 16 + 1, F.lit(16)), F.lit(0).cast("long"), lambda a, v: F.shiftleft(a, BITS).bitwiseOR(v.bitwiseAND(F.lit(15).cast("long")))))

    def from_words(words):
        run = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)])
        hashes = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - width, F.lit(0))), run)
        return _let(F.sort_array(hashes), from_hashes)

    words = F.filter(F.split(text, GAP), lambda w: w != "")
    return F.when(F.regexp_like(text, F.lit(WORD)), _let(words, from_words)).otherwise(F.array().cast("array<long>"))


def as_hex(longs: Column) -> Column:
    """One hex digit for each bin."""
    return F.array_join(F.transform(longs, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins, freed of the chance 2^-b that different values agree in b bits; 0 to 1. Two texts without
    words are alike (1); one without words is unlike any other (0)."""
    low = F.lit(int("1" * 16, 16)).cast("long")

    def apart(x, y):
        return _let(x.bitwiseXOR(y), lambda d: F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseOR(F.shiftrightunsigned(d, 3)).bitwiseAND(low)))

    unequal = F.aggregate(F.zip_with(a, b, apart), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << BITS)
    share = ((BINS - unequal) / float(BINS) - chance) / (1 - chance)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def with_next(df: DataFrame, key: str, cols: list[str], rows_a_cell: int = 500) -> DataFrame:
    """Adds next_<c>: c of the row that follows in descending key order (null keys last, ties by the hash of the first column);
    the first row follows the last. Rows equal in key and first column (128 bits of hash) are counted: one of them takes
    its place among the others, and the rest, each followed by its like, is made of it in pieces of rows_a_cell rows, so
    that a row that fills a third of the table is no task's own."""
    same = ["_tie", "_tie2"]
    marked = df.withColumn("_tie", F.xxhash64(cols[0])).withColumn("_tie2", F.xxhash64(F.lit(1), cols[0]))
    times = materialize(marked.groupBy(F.col(key).alias("_at"), *[F.col(c).alias(f"_at{c}") for c in same]).agg(F.count(F.lit(1)).alias("_times")).where("_times > 1"), "copies")
    if times.isEmpty():
        return _followed(df, key, cols, rows_a_cell)
    like = F.col(key).eqNullSafe(F.col("_at")) & (F.col("_tie") == F.col("_at_tie")) & (F.col("_tie2") == F.col("_at_tie2"))
    marked = marked.join(times, like, "left")
    many = materialize(marked.where("_times is not null").dropDuplicates([key, *same]).select(*df.columns, "_times"), "copied")
    each = _followed(marked.where("_times is null").select(*df.columns).unionByName(many.drop("_times")), key, cols, rows_a_cell)
    pieces = many.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 2) / rows_a_cell))))
    pieces = pieces.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
    rest = F.least(F.lit(rows_a_cell), F.col("_times") - 1 - F.col("_piece") * rows_a_cell)
    again = pieces.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), rest)))
    return each.unionByName(again.select(*df.columns, *[F.col(c).alias(f"next_{c}") for c in cols]))


def _followed(df: DataFrame, key: str, cols: list[str], rows_a_cell: int) -> DataFrame:
    """with_next of rows that differ in key or first column. Rows are laid into cells by a piecewise linear map through 64 quantiles, so that no
    task sorts more than about its share; the first row of each cell is also sent to the cell before it. A key that holds
    several quantiles, and null keys, are laid out by the tie hash."""
    n, some, knots = df.agg(F.count(F.lit(1)), F.count(key), F.percentile_approx(key, [i / 64 for i in range(65)], 2000)).first()
    knots = knots or []
    cells, empty = max(1, some // rows_a_cell), max(1, (n - some) // rows_a_cell)
    df = df.withColumn("_tie", F.xxhash64(cols[0]))
    after = F.col("_tie") / 2.0**64 + 0.5
    k, parts, width = F.col(key).cast("double"), F.lit(0.0), 0
    for a, b in zip(knots, knots[1:], strict=False):
        step = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (k - float(a)) / float(b - a))) if b > a else F.when(F.col(key) > a, 1.0).when(F.col(key) == a, 1 - after).otherwise(0.0)
        parts, width = parts + step, width + 1
    cell = cells - 1 - F.least(F.floor(parts / max(width, 1) * cells), F.lit(cells - 1))
    df = df.withColumn("_cell", F.when(F.col(key).isNull(), cells + F.least(F.floor(after * empty), F.lit(empty - 1))).otherwise(cell).cast("long"))
    first = df.groupBy("_cell").agg(F.min(F.struct(F.col(key).isNull().alias("n"), F.bitwise_not(F.col(key)).alias("k"), F.col("_tie").alias("t"))).alias("first"))
    # The cell before each: within stretches of 4096 cells, and for the first of a stretch the last of those before it.
    first = first.withColumn("_stretch", F.floor(F.col("_cell") / 4096))
    ends = first.groupBy("_stretch").agg(F.max("_cell").alias("_end"))
    over = Window.orderBy("_stretch")
    whole = F.max("_end").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = ends.select("_stretch", F.coalesce(F.lag("_end").over(over), whole).alias("_back"))
    ahead = F.coalesce(F.lag("_cell").over(Window.partitionBy("_stretch").orderBy("_cell")), F.col("_back"))
    first = materialize(first.join(ends, "_stretch").select("_cell", ahead.alias("_to"), F.col("first.t").alias("_first"), F.col("first.k").alias("_key")), "next")
    opens = (F.col("_tie") == F.col("_first")) & F.bitwise_not(F.col(key)).eqNullSafe(F.col("_key"))
    both = df.join(first, "_cell").withColumn("_copies", F.when(opens, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    both = both.select("*", F.explode("_copies").alias("_guest")).withColumn("_home", F.when(F.col("_guest"), F.col("_to")).otherwise(F.col("_cell")))
    w = Window.partitionBy("_home").orderBy(F.col("_guest"), F.col(key).desc_nulls_last(), F.col("_tie"))
    for c in cols:
        both = both.withColumn(f"next_{c}", F.lead(c).over(w))
    return both.where(~F.col("_guest")).drop("_cell", "_tie", "_to", "_first", "_key", "_copies", "_guest", "_home")


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Every text's fingerprint, that of its edited text, and their likenesses.

    The edited text puts as many first code points of the next document (descending doc_id; the first follows the last)
    as there are (or all) in place of the last floor(n/3). Null text counts as empty. Repeated rows follow one another;
    a single row follows itself; empty input gives no rows; other columns are dropped."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("packed", packed(F.col("text")))
    df = with_next(base, "doc_id", ["text", "packed"])
    n = F.length("text").cast("long")
    swap = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - swap).cast("int")), F.substring(F.col("next_text"), F.lit(1), swap))
    df = df.withColumn("n_chars", n).withColumn("edited", edited)
    df = df.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "packed", "next_packed", packed(F.col("edited")).alias("edited_packed"))
    return df.select("doc_id", "n_chars", "edited_sha256", as_hex(F.col("packed")).alias("fingerprint"), as_hex(F.col("edited_packed")).alias("edited_fingerprint"),
                     likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"), likeness(F.col("packed"), F.col("next_packed")).alias("near_next"))
