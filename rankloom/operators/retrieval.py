"""BM25 retrieval over a written index: pruned top-k, judgements, retrieval metrics and rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text as T
from ..functions.text import tokens_ascii
from ..sources.io import scratch
from .index import FEW_TERMS, LEVELS, POSTINGS_A_TASK, VARIANTS, Index, _remove, impact, raw_idf

__all__ = ["Index", "VARIANTS", "_remove", "raw_idf"]
# Scores are rounded to six decimals before ranks: bounds must leave that much room.
ROOM = 2e-6
# Pairs of text and posting of a batch of queries that are scored in one pass, and how many of them one task scores at most,
# as the documents are dealt evenly.
ONE_PASS = 4_000_000_000
PAIRS_A_TASK = 50_000_000
# Words of a text that a document must have before it is read, the rarest.
RAREST = 4
# Pairs of text and document (16 bytes each) up to this number are sent to all tasks, so that texts aren't shuffled for them.
FEW_PAIRS = 1_000_000

def query_terms(queries: DataFrame) -> DataFrame:
    """text, term, qtf of the different texts of queries."""
    return queries.select("text").distinct().select("text", F.explode(tokens_ascii(F.col("text"))).alias("term")).groupBy("text", "term").agg(F.count(F.lit(1)).alias("qtf"))


def bounds(index: Index, terms: DataFrame, k: int, variant: str, text: str = "text") -> DataFrame:
    """text, term, weight of query terms (text, term, qtf) that the index knows, and what the impacts of these terms tell of
    scores before any postings are summed: bound, the most that the term can add; rest, the most that the text's other terms can; floor, a score
    that k documents reach for sure (those of the text's best term at some level of impact); needed: whether a document
    can reach the floor only with this term or one of a higher bound; spare, the bounds of the terms not needed; drag, what
    terms of a negative weight can take away.

    Terms in ascending order of their bounds aren't needed as long as their bounds add up to less than the floor."""
    top = VARIANTS[variant][0] + 1
    known = terms.join(index.impacts(terms, variant), "term")
    level = F.size(F.filter("at", lambda x: x >= k)) - 1
    x = known.select(text, "term", (F.col("qtf") * index.idf(variant)).alias("weight"), "most", F.greatest(level, F.lit(0)).alias("level"))
    reach = F.col("weight") * F.col("most")
    x = x.select(text, "term", "weight", F.greatest(reach, F.lit(0.0)).alias("bound"), F.least(reach, F.lit(0.0)).alias("below"), (F.greatest("weight", F.lit(0.0)) * F.col("level") * (top / LEVELS)).alias("sure"))
    every = Window.partitionBy(text)
    upward = every.orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("drag", F.sum("below").over(every)).withColumn("floor", F.max("sure").over(every) + F.col("drag") - ROOM)
    x = x.withColumn("so_far", F.sum("bound").over(upward)).withColumn("all", F.sum("bound").over(every)).withColumn("needed", F.col("so_far") >= F.col("floor"))
    x = x.withColumn("spare", F.coalesce(F.max(F.when(~F.col("needed"), F.col("so_far"))).over(every), F.lit(0.0)))
    return x.select(text, "term", "weight", "bound", (F.col("all") - F.col("bound")).alias("rest"), "floor", "needed", "spare", "drag")


def _kept(df: DataFrame) -> DataFrame:
    """df as a written table: read several times, and of a known size when joins are chosen."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scored(index: Index, texts: DataFrame, k: int, variant: str, one_pass: int = ONE_PASS, cut: bool = False) -> DataFrame:
    """id, doc_id, score for texts (id, text): the k best documents of each are among them, with their whole scores.

    Documents come in by the postings of needed terms only, and only by postings that, with the most the other terms can
    add, reach the floor. What the k best of these have so far is a higher floor for all, and the other terms' postings are
    looked up only for documents that can still reach it. So the postings of a frequent word are dealt out for few
    documents, not for all. Texts whose terms have at most one_pass postings together, each text's counted, are scored in
    one pass, with the same best: postings of all their terms are dealt by document, each once for all texts, and meet the
    texts there; a task adds up each text's scores of its documents and, with cut, gives on only the text's k best of them."""
    terms = texts.select("id", F.explode(index.tokens(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    part = (F.col("weight") * impact(variant, index.avgdl)).alias("part")
    plain = _kept(terms.join(index.statistics.select("term", "df"), "term").select("id", "term", "df", (F.col("qtf") * index.idf(variant)).alias("weight")))
    asked, pairs = plain.agg(F.count(F.lit(1)), F.coalesce(F.sum("df"), F.lit(0))).first()
    if pairs <= one_pass and asked <= FEW_TERMS:
        return _in_one_pass(index, plain, k if cut else None, variant, pairs)
    known = _kept(bounds(index, terms, k, variant, "id"))
    blocks = index.blocks_of(known)
    first = index.candidates(known.where("needed").select("id", "term", "weight", "rest", "floor", "spare", "drag"), blocks)
    first = first.select("id", "doc_id", part, "rest", "floor", "spare", "drag").where("part + rest >= floor")
    first = first.groupBy("id", "doc_id").agg(F.sum("part").alias("score"), *[F.first(c).alias(c) for c in ("floor", "spare", "drag")])
    first = _kept(first.where("score + spare >= floor").drop("floor"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score")))
    best = first.withColumn("place", place).where(F.col("place") <= k).groupBy("id").agg(F.count(F.lit(1)).alias("n"), (F.min(F.col("score") + F.col("drag")) - ROOM).alias("reached")).where(F.col("n") == k)
    first = first.join(best.select("id", "reached"), "id", "left").where("reached is null or score + spare >= reached").select("id", "doc_id", "score")
    if known.where("not needed").isEmpty():
        return first
    more = index.candidates(known.where("not needed").select("id", "term", "weight"), blocks).select("id", "doc_id", part)
    more = more.join(first.select("id", "doc_id"), ["id", "doc_id"], "left_semi")
    return first.unionByName(more.withColumnRenamed("part", "score")).groupBy("id", "doc_id").agg(F.sum("score").alias("score"))


def _in_one_pass(index: Index, plain: DataFrame, k: int | None, variant: str, pairs: int) -> DataFrame:
    """id, doc_id, score of the terms of texts (id, term, df, weight): FEW_TERMS rows at most, which all tasks get."""
    terms = _kept(plain.select("term", "df").distinct().select("term", "df", F.monotonically_increasing_id().alias("number")))
    postings = terms.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    asked = plain.join(F.broadcast(terms.select("term", "number")), "term").select("id", "number", "weight").orderBy("id", "number").toArrow()
    best = _best_of_task(*[asked.column(c).to_numpy() for c in ("id", "number", "weight")], k)
    found = index.candidates(terms.select("term", "number")).select("number", "doc_id", impact(variant, index.avgdl).alias("impact"))
    found = found.repartition(max(1, -(-postings // POSTINGS_A_TASK), -(-pairs // PAIRS_A_TASK)), "doc_id")
    return found.mapInArrow(best, f"id bigint, doc_id {found.schema['doc_id'].dataType.simpleString()}, score double")


def _best_of_task(ids, numbers, weights, k: int | None):
    """Arrow batches (number of a term, doc_id, impact), all of a task's documents, as (id, doc_id, score): of each text the
    documents that can be among the task's k best once scores are rounded; of equal scores the k lowest doc_ids. Without k: all.

    ids, numbers, weights: the terms of all texts, in order of (id, number). A document's sum is in that order as well, so
    equal documents have equal scores. Work grows with the postings of each text, not with texts times documents."""
    import numpy as np

    def best(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        held = [b for b in batches if len(b)]
        if not held or not len(ids):
            return
        table = pa.Table.from_batches(held)
        coded = table.column(1).combine_chunks().dictionary_encode(null_encoding="encode")
        sort = pc.array_sort_indices(coded.dictionary, null_placement="at_start")
        docs, place = coded.dictionary.take(sort), np.empty(len(sort), np.int64)
        place[sort.to_numpy()] = np.arange(len(sort))
        term = table.column(0).to_numpy()
        order = np.argsort(term, kind="stable")
        term, doc, impacts = term[order], place[coded.indices.to_numpy()[order]], table.column(2).to_numpy()[order]
        opens, ends = np.searchsorted(term, numbers, "left"), np.searchsorted(term, numbers, "right")
        edges = np.append(np.flatnonzero(np.diff(ids, prepend=ids[0] - 1)), len(ids))
        texts, hits, sums, held = [], [], [], 0
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            spans = [(o, e, w) for o, e, w in zip(opens[a:b], ends[a:b], weights[a:b], strict=True) if e > o]
            if not spans:
                continue
            at, part = np.concatenate([doc[o:e] for o, e, _ in spans]), np.concatenate([w * impacts[o:e] for o, e, w in spans])
            if len(at) * 8 < len(docs):  # few documents have the text's terms
                found, inside = np.unique(at, return_inverse=True)
                score = np.bincount(inside, part)
            else:
                hit = np.zeros(len(docs), bool)
                hit[at] = True
                found = np.flatnonzero(hit)
                score = np.bincount(at, part, len(docs))[found]
            if k and len(found) > k:
                near = score >= np.partition(score, len(score) - k)[len(score) - k] - ROOM
                found, score = found[near], score[near]
            if k and len(found) > k:
                down = np.lexsort((found, -score))
                found, score = found[down], score[down]
                fresh = np.append(True, score[1:] != score[:-1])
                among = np.arange(len(score)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
                found, score = found[among < k], score[among < k]
            texts.append(np.full(len(found), ids[a]))
            hits.append(found)
            sums.append(score)
            held += len(found)
            if held >= 100_000:
                yield _batch(texts, docs, hits, sums)
                texts, hits, sums, held = [], [], [], 0
        if held:
            yield _batch(texts, docs, hits, sums)

    return best


def _batch(texts, docs, hits, sums):
    import numpy as np
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(texts)), docs.take(pa.array(np.concatenate(hits))), pa.array(np.concatenate(sums))], names=["id", "doc_id", "score"])


def top_k(index: Index, queries: DataFrame, k: int, variant: str = "okapi", keys: tuple[str, ...] = ("qid",), one_pass: int = ONE_PASS) -> DataFrame:
    """Ranked hits of queries (keys..., text): documents that share a term, by score (6 decimals), then doc_id. Equal query
    texts are searched once; blank ones find nothing. The k best of each query are kept before the final shuffle (by the scoring
    tasks, or by window group limit). The hits are written, so what reads them several times doesn't search again."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant}")
    texts = _kept(queries.select("text").distinct().select("text", F.monotonically_increasing_id().alias("id")))
    s = scored(index, texts, k, variant, one_pass, cut=True).withColumn("score", F.round("score", 6))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "doc_id"))
    s = s.withColumn("rank", rank).where(F.col("rank") <= k)
    return _kept(queries.join(texts.join(s, "id").drop("id"), "text").select(*keys, "doc_id", "score", F.col("rank").cast("int").alias("rank")))


def padded(hits: DataFrame, index: Index, queries: DataFrame, k: int, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """hits (keys..., doc_id, score, rank; scores above 0) of queries with fewer than k matches, filled up to k with
    documents that match nothing, at score 0 in corpus order (doc_id). Queries or documents without tokens take no part.

    Of n hits and k - n fillers no filler lies beyond the first k documents of the corpus: only those are looked at."""
    first = index.lengths.select("doc_id").orderBy("doc_id").limit(k)  # k rows: a bound
    found = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    short = queries.where(F.size(index.tokens(F.col("text"))) > 0).select(*keys).join(found, list(keys), "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < k)
    fill = short.crossJoin(F.broadcast(first)).join(hits.select(*keys, "doc_id"), [*keys, "doc_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id")) + F.col("n")
    fill = fill.withColumn("rank", place.cast("int")).where(F.col("rank") <= k)
    return hits.unionByName(fill.select(*keys, "doc_id", F.lit(0.0).alias("score"), "rank"))


def containment_qrels(index: Index, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, doc_id where the document contains the query's text: candidates by words, then the containment itself.

    Words between others in the text are whole words in the document: the RAREST rarest are looked up, and documents with
    all of them are read. The pairs are written, and so is the result, as it is read several times. A text of two words has
    none; its first word ends some word of the document. A single word lies somewhere in one. These are found by the
    endings, and by the stretches of the words' lengths, of the vocabulary. A text without an ASCII letter, digit or
    underscore has no word to look up and no judgements. The index must be of whole words, not of stems."""
    if index.stem:
        raise ValueError("words inside texts are looked up in an index of whole words")
    words = queries.select("qid", "text", tokens_ascii(F.col("text")).alias("w"))
    inner = words.where(F.size("w") > 2).select("qid", "text", F.explode(F.array_distinct(F.expr("slice(w, 2, size(w) - 2)"))).alias("term"))
    known = inner.join(index.terms, "term").groupBy("qid", "text").agg(F.slice(F.array_sort(F.collect_set(F.struct("df", "term"))), 1, RAREST).alias("best"))
    # A word that no document has is in no pair: a text with one has no candidates.
    whole = inner.groupBy("qid", "text").agg(F.count(F.lit(1)).alias("n")).join(inner.join(index.terms, "term").groupBy("qid", "text").agg(F.count(F.lit(1)).alias("n")), ["qid", "text", "n"], "left_semi")
    wanted = known.join(whole, ["qid", "text"], "left_semi").select("qid", "text", F.size("best").alias("all"), F.explode("best.term").alias("term"))
    short = words.where(F.size("w").isin(1, 2)).select("qid", "text", F.col("w")[0].alias("part"), (F.size("w") == 2).alias("ends"))
    sizes = [r["n"] for r in short.select(F.length("part").alias("n")).distinct().collect()]  # lengths of words: few
    if sizes:
        spans = F.flatten(F.transform(F.array(*[F.lit(n) for n in sorted(sizes)]), lambda n: F.when(F.length("term") >= n, F.transform(F.sequence(F.lit(1), F.length("term") - n + 1), lambda i: F.struct(F.substring(F.col("term"), i, n).alias("part"), (i + n - 1 == F.length("term")).alias("at_end")))).otherwise(F.array().cast("array<struct<part:string,at_end:boolean>>"))))
        known = index.terms.select("term", F.explode(F.array_distinct(spans)).alias("x")).select("term", "x.*")
        wanted = wanted.unionByName(short.join(known, "part").where("at_end or not ends").select("qid", "text", F.lit(1).alias("all"), "term").distinct())
    found = index.candidates(_kept(wanted.withColumn("number", F.xxhash64("qid", "text")).select("number", "all", "term").distinct()))
    pairs = _kept(found.groupBy("number", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("all").alias("all")).where("n >= all").select("number", "doc_id"))
    pairs = F.broadcast(pairs) if pairs.limit(FEW_PAIRS + 1).count() <= FEW_PAIRS else pairs
    bodies = docs.select("doc_id", F.col("text").alias("body")).join(pairs, "doc_id")
    asked = queries.select("qid", "text").distinct().withColumn("number", F.xxhash64("qid", "text"))
    return _kept(bodies.join(asked, "number").where(F.contains("body", "text")).select("qid", "doc_id").distinct())


def reciprocal_rank(hits: DataFrame, qrels: DataFrame, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """keys, hit_rank, reward: one over the rank of the first relevant hit, however deep; 0 where none is relevant."""
    marked = hits.join(qrels.select("qid", "doc_id").distinct().withColumn("rel", F.lit(1)), ["qid", "doc_id"], "left")
    first = F.min(F.when(F.col("rel") == 1, F.col("rank")))
    return marked.groupBy(*keys).agg(first.alias("hit_rank")).select(*keys, "hit_rank", F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0)).alias("reward"))


def metrics(queries: DataFrame, hits: DataFrame, qrels: DataFrame, keys: tuple[str, ...] = ("qid",), mrr_k: int = 20, recall_k: int = 20, aux_k: int = 50) -> DataFrame:
    """hit_rank, mrr, recall, recall_aux, counts and rank_bonus for each query; no relevant documents give zeros."""
    marked = hits.join(qrels.withColumn("rel", F.lit(1)), ["qid", "doc_id"])
    found = marked.groupBy(*keys).agg(F.min(F.when(F.col("rank") <= mrr_k, F.col("rank"))).alias("hit_rank"), F.count_if(F.col("rank") <= recall_k).alias("found"), F.count_if(F.col("rank") <= aux_k).alias("found_aux"))
    total = qrels.groupBy("qid").agg(F.count(F.lit(1)).alias("total"))
    out = queries.select(*keys).join(found, list(keys), "left").join(total, "qid", "left")
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("total")), F.lit(0.0))
    return out.select(*keys, "hit_rank", F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0)).alias("mrr"), share("found").alias("recall"), share("found_aux").alias("recall_aux"), F.coalesce("found", F.lit(0)).alias("retrieved_relevant"), F.coalesce("total", F.lit(0)).alias("relevant_total"), scores.rank_bonus(F.col("hit_rank")).alias("rank_bonus"))


def reward(scored: DataFrame, baseline: DataFrame | None, cfg: scores.RewardConfig = scores.RewardConfig()) -> DataFrame:
    """Adds the reward and its parts to scored rows (qid, mrr, recall, recall_aux, rank_bonus and text qualities) against
    the original query's metrics (o_mrr, o_recall, o_recall_aux; missing: 0; without a baseline they are scored's own columns)."""
    df = scored if baseline is None else scored.join(baseline, "qid", "left").fillna(0.0, ["o_mrr", "o_recall", "o_recall_aux"])
    df = df.withColumn("delta_mrr", F.col("mrr") - F.col("o_mrr")).withColumn("delta_recall", F.col("recall") - F.col("o_recall")).withColumn("delta_recall_aux", F.col("recall_aux") - F.col("o_recall_aux"))
    main = cfg.mrr_weight * F.col("delta_mrr") + cfg.recall_weight * F.col("delta_recall") + cfg.recall_aux_weight * F.col("delta_recall_aux") + cfg.rank_bonus_weight * F.col("rank_bonus")
    df = df.withColumn("main_reward", main).withColumn("anchor_bonus", scores.anchor_bonus(F.col("mrr"), F.col("recall"), F.col("o_mrr"), F.col("o_recall"), cfg.anchor))
    df = df.withColumn("recall_drop_penalty", scores.recall_drop_penalty(F.col("o_recall"), F.col("recall"), cfg.recall_drop)).withColumn("overedit_penalty", scores.overedit_penalty(F.col("keyword_preserve"), cfg.keyword_floor))
    total = F.col("main_reward") + F.col("anchor_bonus") - cfg.bad_format_weight * F.col("bad_format_penalty") - cfg.unsafe_copy_weight * F.col("unsafe_copy_penalty") - cfg.overedit_weight * F.col("overedit_penalty") - F.col("recall_drop_penalty")
    return df.withColumn("total", total)


# Fields of a scored rewrite (fixed names), beside the keys and the cleaned query.
BREAKDOWN = (
    "total", "mrr", "recall", "recall_dense", "rank_bonus", "overlap", "keyword_preserve", "locked_term_preserve", "number_preserve", "acronym_preserve", "negation_preserve",
    "main_reward", "orig_mrr", "orig_recall", "orig_recall_aux", "orig_rank_bonus", "delta_mrr", "delta_recall", "delta_recall_aux", "delta_rank_bonus", "anchor_bonus",
    "recall_drop_penalty", "overedit_penalty", "bad_format_penalty", "unsafe_copy_penalty", "hit_rank", "retrieved_relevant_count", "relevant_total",
)


def score_rewrites(index: Index, qrels: DataFrame, rewrites: DataFrame, key: str = "idx", variant: str = "okapi", cfg: scores.RewardConfig = scores.RewardConfig()) -> DataFrame:
    """rewrites (qid, key, source, raw) -> qid, key, rewritten_query and the fields of BREAKDOWN.

    An answer is cleaned against its source first and then retrieved. The source's own metrics are the baseline; a blank
    or null source has none (zeros) and its rewrite keeps everything. Equal texts, the source's too, are searched once. The
    settings' cut-offs (at least 1 each) say how deep ranks count; as many documents are retrieved as the deepest asks."""
    source = F.coalesce(T.normalize(F.col("source")), F.lit(""))
    asked = rewrites.select("qid", key, source.alias("source"), T.normalize(T.clean_query(F.coalesce(F.col("raw"), F.lit("")), source)).alias("text"))
    texts = asked.select("qid", "text").union(asked.select("qid", "source")).distinct()
    both, cuts = ("qid", "text"), [max(1, int(x)) for x in (cfg.mrr_k, cfg.recall_k, cfg.recall_aux_k)]
    measured = metrics(texts, top_k(index, texts.where("text <> ''"), max(cuts), variant, both), qrels, both, *cuts)
    own = measured.select("qid", F.col("text").alias("source"), F.col("mrr").alias("o_mrr"), F.col("recall").alias("o_recall"), F.col("recall_aux").alias("o_recall_aux"), F.col("rank_bonus").alias("o_rank_bonus")).where("source <> ''")
    x = asked.join(measured, ["qid", "text"]).join(own, ["qid", "source"], "left").fillna(0.0, ["o_mrr", "o_recall", "o_recall_aux", "o_rank_bonus"])
    has, s, t = F.col("source") != "", F.col("source"), F.col("text")
    parts = T.preserve_parts(s, t)
    x = x.select("*", T.overlap(s, t).alias("overlap"), F.when(has, T.keyword_preserve(s, t)).otherwise(1.0).alias("keyword_preserve"), parts.alias("parts"), T.bad_format_penalty(t).alias("bad_format_penalty"), T.unsafe_copy_penalty(s, t).alias("unsafe_copy_penalty"))
    x = reward(x, None, cfg)
    return x.select(
        "qid", key, F.col("text").alias("rewritten_query"), "total", "mrr", "recall", F.col("recall_aux").alias("recall_dense"), "rank_bonus", "overlap", "keyword_preserve",
        F.col("parts.locked").alias("locked_term_preserve"), F.col("parts.number").alias("number_preserve"), F.col("parts.acronym").alias("acronym_preserve"), F.col("parts.negation").alias("negation_preserve"),
        "main_reward", F.col("o_mrr").alias("orig_mrr"), F.col("o_recall").alias("orig_recall"), F.col("o_recall_aux").alias("orig_recall_aux"), F.col("o_rank_bonus").alias("orig_rank_bonus"),
        "delta_mrr", "delta_recall", "delta_recall_aux", (F.col("rank_bonus") - F.col("o_rank_bonus")).alias("delta_rank_bonus"), "anchor_bonus", "recall_drop_penalty", "overedit_penalty",
        "bad_format_penalty", "unsafe_copy_penalty", "hit_rank", F.col("retrieved_relevant").alias("retrieved_relevant_count"), "relevant_total")
