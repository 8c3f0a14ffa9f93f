"""Literal rows and small tables for the index, judgements, logs, corpora, settings and files."""

import math

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from rankloom.functions import scores
from rankloom.functions import text as T
from rankloom.operators import cohort, config, corpus, groups, logs, reports, training
from rankloom.operators import retrieval as R
from rankloom.operators.ranks import placed
from rankloom.sources import io
from rankloom.streaming import logs as stream


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


# ---- texts ------------------------------------------------------------------------------------

@pytest.mark.parametrize("text,flag", [("query: best laptop", True), ("Query : x", True), ("user query: x", True), ("better bm25 query: x", False), ("best laptop", False), ("note: best laptop", False), ("I think so", True)])
def test_explanation(spark, text, flag):
    assert one(spark, T.is_explanation(F.col("t")), t=text) is flag


@pytest.mark.parametrize("text,penalty", [("best laptop\rbudget laptop", 0.5), ("best laptop\r\n", 0.0), ("query: best laptop", 0.5), ("search query: a\nb", 1.0)])
def test_bad_format_breaks(spark, text, penalty):
    assert one(spark, T.bad_format_penalty(F.col("t")), t=text) == pytest.approx(penalty)


@pytest.mark.parametrize("source,rewrite,locked", [("2024 and 2024", "2024", 0.5), ("NASA or NASA", "nasa", 0.5), ("not this, not that", "not", 0.5), ("5 NASA", "5", 0.5), ("plain words", "x", 1.0)])
def test_locked_terms_count_as_often_as_they_occur(spark, source, rewrite, locked):
    assert one(spark, T.locked_preserve(F.col("s"), F.col("r")), s=source, r=rewrite) == pytest.approx(locked)


@pytest.mark.parametrize("text,candidate", [("1] androgen receptor", "androgen receptor"), ("- [x]", "[x]"), ("'\"best  laptop\"'", "best laptop"), ("٣. words", "words")])
def test_candidate_text(spark, text, candidate):
    assert one(spark, T.candidate_text(F.col("t")), t=text) == candidate


@pytest.mark.parametrize(
    "text,single,out",
    [
        ("best laptop\nUser query: next", False, "best laptop"), ("best laptop\nUSER QUERY: next", False, "best laptop"), ("best laptop\nsecond line", False, "best laptop\nsecond line"),
        ("best laptop\nsecond line", True, "best laptop"), ("best laptop\rsecond", True, "best laptop"), ("User query: x", False, ""), ("example\nx", False, ""), ("Example", False, "Example"),
        ("  best laptop </s> more", False, "best laptop"), ("best laptop\nExamples follow", False, "best laptop"), ("best laptop\nexamples follow", False, "best laptop\nexamples follow"), ("", True, ""), (None, True, ""),
    ],
)
def test_truncate_generation(spark, text, single, out):
    assert one(spark, T.truncate_generation(F.col("t").cast("string"), "</s>", single_line=single), t=text) == out


def test_stop_strings():
    assert T.stop_strings() == T.STOP_STRINGS
    assert T.stop_strings("\nExample", ("end", "", "end")) == ("\nExample", "end", "\nUser query:", "\nBetter BM25 query:", "\nSearch query:", "\nRewritten query:")


def test_unique_nonempty(spark):
    assert one(spark, T.unique_nonempty(F.array(*[F.lit(x) for x in ("a  b", " a b", "a b ", "", "  ")]))) == 2


@pytest.mark.parametrize("text,name", [("Run 1: Strict/Balanced!", "run_1_strict_balanced"), ("  ", "summary"), ("__A__", "a")])
def test_slug(spark, text, name):
    assert one(spark, T.slug(F.col("t")), t=text) == name


def test_no_break_space_is_readable(spark):
    assert one(spark, T.unreadable_ratio(F.col("t")), t="a b c") == 0.0


# ---- scores -----------------------------------------------------------------------------------

@pytest.mark.parametrize("n,temperature,got", [(0, 0.8, [(0.8, 0.9)]), (1, 0.8, [(0.8, 0.9)]), (3, 0.8, [(0.8, 0.9), (0.85, 0.91), (0.9, 0.92)]), (2, 0.0, [(0.0, 0.9), (0.0, 0.9)]), (2, -1.0, [(-1.0, 0.9), (-1.0, 0.9)])])
def test_sampling_schedule(spark, n, temperature, got):
    assert [tuple(x) for x in one(spark, scores.sampling_schedule(F.col("n"), temperature, 0.9), n=n)] == got


def test_safe_numbers(spark):
    ratio = lambda a, b: one(spark, scores.safe_ratio(F.col("a").cast("double"), F.col("b").cast("double")), a=a, b=b)
    assert (ratio(1, 4), ratio(1, 0), ratio(None, 2), ratio(2, None)) == (0.25, None, None, None)
    assert one(spark, scores.maybe_float(F.col("t")), t="1.5") == 1.5 and one(spark, scores.maybe_float(F.col("t")), t="n/a") is None


def test_gap_counts_a_query_once(spark):
    df = spark.createDataFrame([(1, "a", 0.1, 0), (1, "a", 0.9, 1), (1, "b", 0.2, 2), (1, "c", 0.4, 3)], "g int, q string, r double, i int")
    row = groups.gap_stop(df, "g", "q", "r", "i", 0.3, 2, 8).first()
    assert (row["generated"], row["gap_met"], row["stop_reason"]) == (4, True, "threshold_reached")
    assert groups.gap_stop(df.where("q = 'a'"), "g", "q", "r", "i", 0.3, 2, 8).first()["stop_reason"] == "max_group_size_reached"


def test_accept_retry(spark):
    no, yes = F.lit(False), F.lit(True)
    accept = lambda final, polluted=(no, no), copied=(no, no), fell=(no, no): one(spark, groups.accept_retry(F.lit(final), F.array(F.lit("a"), F.lit("b")), polluted, copied, fell))
    assert [accept("c"), accept("a"), accept(""), accept("a", (yes, no)), accept("a", (no, yes)), accept("a", (no, no), (yes, no)), accept("", (no, no), (no, no), (yes, no))] == [True, False, False, True, False, True, True]


# ---- index, judgements, rewrites ---------------------------------------------------------------

DOCS = [(1, "the red fox and a bored foxes den"), (2, "infrared foxtrot"), (3, "a whale, a whaler"), (4, ""), (5, None), (6, "red hen")]


@pytest.fixture
def made(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    return docs, R.Index.build(docs, str(tmp_path / "index"), shard_rows=1)


def test_index_is_kept_and_found(spark, tmp_path, made):
    docs, index = made
    path = str(tmp_path / "index")
    assert (index.n, index.lengths.count()) == (4, 4) and {tuple(r) for r in index.terms.where("term in ('a', 'red')").collect()} == {("a", 2, 3), ("red", 2, 2)}
    again = R.Index.ensure(docs.limit(0), path)  # what is there stands, the documents aren't read
    assert again.n == 4 and sorted(map(tuple, again.postings.collect())) == sorted(map(tuple, index.postings.collect()))
    with pytest.raises(FileNotFoundError):
        R.Index.open(spark, str(tmp_path / "none"))
    R._remove(spark, f"{path}/corpus")  # not written to its end
    other = str(tmp_path / "other")
    assert R.Index.ensure(docs, other).n == 4 and R.Index.open(spark, other).n == 4
    empty = R.Index.build(docs.limit(0), str(tmp_path / "empty"))
    assert R.top_k(empty, spark.createDataFrame([(1, "red")], "qid long, text string"), 3).count() == 0


def test_index_of_files_follows_them(spark, tmp_path):
    path, folder = str(tmp_path / "docs"), str(tmp_path / "kept")
    spark.createDataFrame(DOCS[:2], "doc_id long, text string").write.parquet(path)
    assert R.Index.of(spark.read.parquet(path), folder).n == 2 and R.Index.of(spark.read.parquet(path), folder).n == 2
    spark.createDataFrame(DOCS[2:], "doc_id long, text string").write.mode("append").parquet(path)
    assert R.Index.of(spark.read.parquet(path), folder).n == 4


def test_split_terms_score_alike(spark, tmp_path, made):
    docs, split = made
    plain = R.Index.build(docs, str(tmp_path / "plain"))
    assert split.shards > 1 and plain.shards == 1
    asked = spark.createDataFrame([(1, "a red whale"), (2, "fox the the"), (3, "")], "qid long, text string")
    for variant in ("okapi", "lucene"):
        assert sorted(map(tuple, R.top_k(split, asked, 3, variant).collect())) == sorted(map(tuple, R.top_k(plain, asked, 3, variant).collect())) != []
    with pytest.raises(ValueError):
        R.top_k(plain, asked, 3, "bm25+")


def test_containment(spark, made):
    docs, index = made
    texts = ["red fox", "whale", "red", "fox and", "bored foxes den", "hale, a wha", "x", "fox red", "the red fox and a bored foxes den", "Red"]
    asked = spark.createDataFrame(list(enumerate(texts)), "qid long, text string")
    got = {tuple(r) for r in R.containment_qrels(index, docs, asked).collect()}
    assert got == {(i, d) for i, t in enumerate(texts) for d, body in DOCS if body and t in body}


def test_reciprocal_rank_uncut(spark):
    hits = spark.createDataFrame([(1, 10 + i, i) for i in range(1, 90)] + [(2, 5, 1)], "qid long, doc_id long, rank int")
    got = {r["qid"]: (r["hit_rank"], r["reward"]) for r in R.reciprocal_rank(hits, spark.createDataFrame([(1, 97)], "qid long, doc_id long")).collect()}
    assert got == {1: (87, 1 / 87), 2: (None, 0.0)}


def test_score_rewrites(spark, made):
    docs, index = made
    qrels = spark.createDataFrame([(1, 1), (2, 3)], "qid long, doc_id long")
    raw = [(1, 0, "red fox", "Search query: red fox den\nExplanation: because"), (1, 1, "red fox", "red fox"), (2, 0, None, "whale"), (2, 1, "hen", ""), (3, 0, "hen", "red hen")]
    got = {(r["qid"], r["idx"]): r for r in R.score_rewrites(index, qrels, spark.createDataFrame(raw, "qid long, idx int, source string, raw string")).collect()}
    assert len(got) == 5 and got[1, 0]["rewritten_query"] == "red fox den" and got[1, 0]["hit_rank"] == 1
    assert got[1, 1]["delta_mrr"] == 0 and got[1, 1]["overlap"] == 1 and got[1, 1]["total"] == pytest.approx(0.1 * got[1, 1]["rank_bonus"])
    assert got[2, 0]["orig_mrr"] == 0 and got[2, 0]["keyword_preserve"] == 1 and got[2, 0]["mrr"] == 1
    assert got[2, 1]["rewritten_query"] == "" and got[2, 1]["mrr"] == 0 and got[2, 1]["bad_format_penalty"] == 1
    assert got[3, 0]["relevant_total"] == 0 and set(R.BREAKDOWN) <= set(got[3, 0].asDict())


# ---- logs and metrics ---------------------------------------------------------------------------

def test_merge_keeps_the_last_and_its_nulls(spark):
    left = spark.createDataFrame([(1, 1, 5.0, 1), (1, 2, 6.0, 2)], "epoch int, step int, loss double, global_step_idx int")
    right = spark.createDataFrame([(1, 1, 7.0, 0.1, 1), (1, 1, None, 0.2, 2), (9, 9, 1.0, 1.0, 3)], "epoch int, step int, loss double, gap double, global_step_idx int")
    got = [(r["step"], r["loss"], r["gap"], r["global_step_idx"]) for r in logs.merge_steps(left, right).orderBy("step").collect()]
    assert got == [(1, None, 0.2, 2), (2, 6.0, None, 2)]


def test_fallbacks(spark):
    rows = spark.createDataFrame([(2, 0.4, None, 4.0, 2.0), (1, 0.3, 0.9, 0.0, 1.0)], "step int, mrr_mean double, rewrite_mrr20_mean double, sampled double, valid_samples double")
    got = [(r["epoch"], r["step"], r["global_step_idx"], r["rewrite_mrr20_mean"], r["valid_ratio"]) for r in logs.train_steps(rows).orderBy("step").collect()]
    assert got == [(0, 1, 1, 0.9, None), (0, 2, 2, 0.4, 0.5)]
    assert "main_reward_mean" not in logs.train_steps(rows).columns


def test_log_summary_of_little(spark):
    log = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.7)], "epoch int, step int, reward_mean double")
    steps = logs.train_steps(log)
    row = logs.log_summary(log, log.limit(0).select("epoch"), steps).first()
    assert (row["train_rows"], row["group_rows"], row["train_epochs"], row["group_epochs"]) == (2, 0, [1], [])
    assert row["best_train_reward_mean"]["step"] == 2 and row["loss_min"] is None and row["averages"]["loss"] is None
    assert row["trend_first_last_third"]["reward_mean_late"] == 0.7 and row["mrr_alignment_corr"] is None
    assert logs.log_summary(log.limit(0), log.limit(0), steps.limit(0)).first()["aligned_steps"] == 0


def test_step_metrics_without_losses(spark):
    cols = sorted(set(training.MEANS.values()))
    rows = [(1, "g", "same", i, None, None, None, *[1.0] * len(cols)) for i in range(3)]
    df = spark.createDataFrame(rows, "step int, grp string, final_query string, idx int, loss double, loss_pg double, loss_kl double, " + ", ".join(f"{c} double" for c in cols))
    row = training.step_metrics(df, ("step",), 0.1, 2).first()
    assert (row["collapsed_group_ratio"], row["trainable_group_ratio"], row["updated"], row["kl_dominance_ratio"], row["sampled"], row["valid_samples"]) == (1.0, 0.0, 0.0, 0.0, 3.0, 0.0)
    assert row["adv_std"] == 0.0 and row["extra_sample_ratio"] == pytest.approx(1 / 3)


def test_early_stop_leaves_out_nulls(spark):
    df = spark.createDataFrame([("r", 1, 0.5), ("r", 2, None), ("r", 3, 0.4), ("r", 4, 0.3), ("r", 5, 0.2), ("r", 6, 0.1)], "run string, step long, m double")
    got = [(r["step"], r["streak"], r["should_stop"]) for r in logs.early_stop(df, "run", "step", "m").orderBy("step").collect()]
    assert got == [(1, 0, False), (3, 0, False), (4, 0, False), (5, 1, False), (6, 2, True)]


def test_placed(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = placed(df, [F.desc("k")], "at").collect()
    assert {r["k"]: r["at"] for r in got} == {k: 1000 - k for k in range(1000)}
    assert placed(df.limit(0), [F.asc("k")], "at").count() == 0


# ---- corpora, settings, reports ------------------------------------------------------------------

def test_corpus_from_nested(spark, tmp_path):
    rows = [("ask  one", ["a  b", "c", " ", "a b"], [1, 0, 1, 1]), ("  ", ["z"], [1]), ("two", ["c", "d"], [0]), ("three", None, None)]
    path = str(tmp_path / "n")
    spark.createDataFrame(rows, "query string, t array<string>, s array<int>").coalesce(1).select("query", F.struct(F.col("t").alias("passage_text"), F.col("s").alias("is_selected")).alias("passages")).write.json(path)
    c = corpus.from_nested(io.read_jsonl(spark, path, "query string, passages struct<passage_text: array<string>, is_selected: array<int>>"))
    assert {r["contents"] for r in c.documents.collect()} == {"a b", "c", "d"}
    assert {tuple(r) for r in c.queries.collect()} == {("Q0", "ask one"), ("Q2", "two"), ("Q3", "three")}
    assert [r["query_id"] for r in c.judgements.collect()] == ["Q0"] and len(c.judgements.first()["docs"]) == 1
    s = corpus.stats(c).first()
    assert (s["num_docs"], s["num_queries"], s["num_empty_qrels_queries"], s["avg_positive_docs"], s["qrels_coverage"]) == (3, 3, 2, 1.0, 1.0)


def test_corpus_from_tables(spark):
    docs = spark.createDataFrame([("d1", "T", "x"), ("d2", "T", " x "), ("d3", None, "")], "_id string, title string, text string")
    asked = spark.createDataFrame([("q1", "one"), ("q2", ""), ("q3", "three")], "_id string, text string").coalesce(1)
    j = spark.createDataFrame([("q1", "d1", "1"), ("q1", "d2", "2"), ("q3", "d1", "none"), ("q2", "d1", "1"), ("q3", "d3", "1"), ("q3", "d2", "0")], "`query-id` string, `corpus-id` string, score string")
    c = corpus.from_tables(docs, asked, j)
    assert [r["contents"] for r in c.documents.collect()] == ["T x"] and {r["text"] for r in c.queries.collect()} == {"one", "three"}
    assert [(r["query_id"], len(r["docs"])) for r in c.judgements.collect()] == [("Q0", 1)]
    assert corpus.from_tables(docs, asked, j.drop("score")).judgements.count() == 2


def test_clamp(spark):
    df = spark.createDataFrame([(0, 1, 0, None, 0.5, "phase1"), (3, 4, 9, 0, 0.8, "phase2")], "num_epochs int, group_size int, max_group_size int, max_steps int, train_ratio double, curriculum_phase string")
    got = [tuple(r) for r in config.clamp(df).collect()]
    assert got == [(1, 2, 2, None, 0.5, "phase1", ["num_epochs", "group_size", "max_group_size"]), (3, 4, 9, 1, 0.8, "phase2", ["max_steps"])]
    for bad in (df.withColumn("train_ratio", F.lit(1.0)), df.withColumn("curriculum_phase", F.lit("phase3"))):
        with pytest.raises(SparkRuntimeException):
            config.clamp(bad).collect()


def test_overrides_and_paths(spark, tmp_path):
    cfg = config.override(scores.RewardConfig(), {"anchor": 0.1, "recall_drop": None})
    assert (cfg.anchor, cfg.recall_drop) == (0.1, 0.8)
    assert config.report_paths(None, "r1") == ("artifacts/r1/report.json", "artifacts/r1/history") and config.report_paths("x/y.json", "r1") == ("x/y.json", "x/history")
    assert spark.range(1).select(config.utc_now().alias("t")).first()["t"].endswith("+00:00")
    folder = tmp_path / "adapter"
    with pytest.raises(FileNotFoundError):
        config.check_adapter(spark, str(folder))
    folder.mkdir()
    (folder / "adapter_config.json").write_text('{"r": 8}')
    assert config.check_adapter(spark, str(folder)) == {"r": 8}
    (folder / "adapter_config.json").write_text("[1]")
    with pytest.raises(ValueError):
        config.check_adapter(spark, str(folder))


def test_metadata_store(spark, tmp_path):
    asked, path, calls = spark.createDataFrame([(1,), (2,)], "qid long"), str(tmp_path / "meta"), []

    def build(ids):
        calls.append(ids)
        return spark.createDataFrame([(i, "A") for i in ids], "qid long, bucket string")

    assert cohort.ensure_metadata(asked.limit(0), path, lambda: build([1])).count() == 1
    for _ in range(2):
        assert cohort.ensure_metadata(asked, path, lambda: build([1, 2, 3])).count() in (2, 3)
    assert calls == [[1], [1, 2, 3]]
    got = cohort.with_buckets(spark.createDataFrame([(3,), (4,)], "qid long"), spark.read.parquet(path)).orderBy("qid").collect()
    assert [r["bucket"] for r in got] == ["A", "DROP"]


def test_three_way_needs_every_key(spark):
    a, b = (spark.createDataFrame([(1, 0.1), (2, 0.2)], f"qid int, {n} double") for n in "ab")
    c = spark.createDataFrame([(1, 0.1)], "qid int, c double")
    assert reports.three_way(a, b, c.union(c.selectExpr("2", "0.3"))).count() == 2
    with pytest.raises(KeyError):
        reports.three_way(a, b, c)


def test_leaderboards(spark):
    rows = spark.createDataFrame([("a", 0.5, 0.5, 0.1), ("b", 0.5, 0.5, 0.2), ("c", 0.5, 0.5, 0.2), ("d", 0.6, 0.0, 0.0)], "v string, mrr double, recall double, reward double")
    order = lambda **how: [r["v"] for r in reports.leaderboard(rows, ["mrr", "recall", "reward"], "v", **how).orderBy("rank").collect()]
    assert order() == ["d", "b", "c", "a"] and order(name_descending=True) == ["d", "c", "b", "a"]


def test_pick_names_what_is_unknown(spark):
    specs = spark.createDataFrame([("b",), ("a",)], "id string")
    assert [r["id"] for r in reports.pick(specs, "id").collect()] == ["a", "b"]
    with pytest.raises(ValueError, match="zz"):
        reports.pick(specs, "id", ["a", "zz"])
    with pytest.raises(ValueError):
        reports.pick(specs, "id", most=0)


# ---- files and streams ---------------------------------------------------------------------------

def test_json_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"query_id": "1", "text": "a"}\n\n{"query_id": "2", "text"\n{"query_id": " ", "text": "b"}\n')
    schema = "query_id string, text string"
    assert io.read_jsonl(spark, str(path), schema).count() == 2
    assert [tuple(r) for r in io.bad_lines(spark, str(path), schema).collect()] == [(3, '{"query_id": "2", "text"')]
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_jsonl(spark, str(path), schema, strict=True).collect()
    assert [r["query_id"] for r in io.read_queries(spark, str(path)).collect()] == ["1"]
    out = str(tmp_path / "out")
    for append in (False, True):
        io.write_jsonl(spark.createDataFrame([("1", "a")], schema), out, append=append)
    assert io.read_jsonl(spark, out, schema).count() == 2


def test_numbers_follow_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5000).repartitionByRange(9, "id").sortWithinPartitions("id").select(F.col("id").cast("string").alias("v"), F.repeat(F.lit("x"), (F.col("id") % 7 * (F.col("id") > 2500).cast("int") * 9).cast("int")).alias("w")).write.json(path)
    got = io.ordinals(spark.read.schema("v string").json(path)).collect()
    assert len(got) == 5000 and all(r["qid"] == f"Q{r['v']}" for r in got)
    assert sorted(r["qid"] for r in io.ordinals(spark.range(3).coalesce(1)).collect()) == ["Q0", "Q1", "Q2"]


def test_csv_columns(spark, tmp_path):
    path = str(tmp_path / "c")
    io.write_csv(spark.createDataFrame([(1, "x")], "a int, b string"), path, ["b", "zz", "a"])
    assert spark.read.option("header", True).csv(path).collect()[0].asDict() == {"b": "x", "zz": None, "a": "1"}


def test_reports_and_manifest(spark, tmp_path):
    manifest = str(tmp_path / "manifest")
    for i, v in enumerate("ab"):
        io.write_report(spark.createDataFrame([(v, i / 10)], "name string, mrr double"), str(tmp_path / f"{v}.json"))
        io.write_jsonl(spark.createDataFrame([(v, f"file://{tmp_path}/{v}.json")], "variant string, report_path string"), manifest, append=True)
    got = io.read_reports(spark, io.read_jsonl(spark, manifest, "variant string, report_path string"), "name string, mrr double").orderBy("variant").collect()
    assert [(r["variant"], r["name"], r["mrr"]) for r in got] == [("a", "a", 0.0), ("b", "b", 0.1)]
    with pytest.raises(ValueError):
        io.write_report(spark.range(2), str(tmp_path / "two.json"))


def test_backend(spark, tmp_path):
    path = str(tmp_path / "backend.json")
    assert io.read_backend(spark, path) == "okapi"
    io.write_backend(spark, path, "lucene")
    assert io.read_backend(spark, path) == "lucene"
    with pytest.raises(ValueError):
        io.write_backend(spark, path, "none")


def test_splits_and_fields(spark, tmp_path):
    spark.range(20).write.parquet(str(tmp_path / "train.parquet"))
    assert io.read_split(spark, str(tmp_path), "train[:5]").count() == 5 and io.read_split(spark, str(tmp_path), " train ").count() == 20
    assert io.first_readable(spark, [str(tmp_path / "none"), str(tmp_path / "train.parquet")]).count() == 20
    with pytest.raises(FileNotFoundError):
        io.first_readable(spark, [str(tmp_path / "none")])
    df = spark.createDataFrame([(None, "b")], "x string, y string")
    assert df.select(io.first_field(df, ["z", "x", "y"], "d").alias("v")).first()["v"] == "b" and df.select(io.first_field(df, ["z", "x"], "d").alias("v")).first()["v"] == "d"


def test_history_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "h")
    rows = spark.createDataFrame([("r", "p1", 0.1, "t1"), ("r", "p2", 0.2, "t1")], "run_id string, prompt_id string, metric double, at string")
    io.append_history(rows, path)
    io.append_history(rows.where("prompt_id = 'p1'").withColumn("metric", F.lit(0.9)).withColumn("at", F.lit("t2")), path)
    got = io.history(spark, path).first()["results"]
    assert [(r["prompt_id"], r["metric"]) for r in got] == [("p2", 0.2), ("p1", 0.9)]


def test_late_rows_are_dropped(spark, tmp_path):
    """The second file's row lies hours before the watermark of the first."""
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    for ts in ("2024-01-01 10:10:00", "2024-01-01 15:00:00", "2024-01-01 10:20:00", "2024-01-01 23:00:00"):
        spark.createDataFrame([("r", 1, 1, ts, 1.0)], "run string, epoch int, step int, ts string, metric double").coalesce(1).write.mode("append").json(log)
        stream.windows(stream.read_log(spark, log), "1 hour").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-c").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {r["window"]["start"].hour: r["n"] for r in spark.read.parquet(out).collect()}
    assert got[10] == 1 and 23 not in got


def test_breakdown_summary_of_nothing(spark):
    cols = sorted(set(reports.MEANS.values()) | set(reports.SHARES.values()))
    row = reports.breakdown_summary(spark.createDataFrame([], ", ".join(f"{c} double" for c in cols))).first()
    assert not any(row) and len(row) == len(reports.MEANS) + len(reports.SHARES) + 1


def test_epoch_sample_without_buckets(spark):
    items = spark.createDataFrame([(3, "X"), (1, "X")], "k int, bucket string")
    got = cohort.epoch_sample(items, {"A": 1.0}, "k").orderBy("place").collect()
    assert [(r["place"], r["k"]) for r in got] == [(1, 1), (2, 3)]


def test_step_index_and_thirds(spark):
    df = spark.createDataFrame([(1, 2, 4.0), (0, 9, 1.0), (1, 1, None), (2, 1, 9.0)], "epoch int, step int, m double")
    steps = logs.with_step_index(df)
    assert {(r["epoch"], r["step"]): r["global_step_idx"] for r in steps.collect()} == {(0, 9): 1, (1, 1): 2, (1, 2): 3, (2, 1): 4}
    row = logs.trend_thirds(steps, "m", "global_step_idx").first()
    assert (row["first_third"], row["last_third"], row["change"]) == (1.0, 9.0, 8.0) and math.isclose(logs.best_row(steps, "m", "global_step_idx", ["epoch"]).first()["epoch"], 2)


@pytest.fixture
def several_files(spark, tmp_path):
    path = str(tmp_path / "files")
    spark.range(1000).repartition(4, "id").select(F.col("id").alias("k"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).write.parquet(path)
    return spark.read.parquet(path)


def test_numbers_are_dense_and_unique_on_any_frame(spark, several_files):
    df = several_files
    frames = {
        "plain": df, "filtered": df.where("k % 3 = 0"), "sorted": df.orderBy(F.desc("k")), "repartitioned": df.repartition(7), "ranges": df.repartitionByRange(5, "k"),
        "joined": df.join(spark.range(500).withColumnRenamed("id", "k"), "k"), "union": df.union(df), "grouped": df.groupBy((F.col("k") % 10).alias("k")).count(), "rows": spark.range(17).toDF("k"),
        "limited": df.orderBy("k").limit(10), "cached": df.orderBy("k").cache(), "none": df.where("k < 0"),
    }
    for name, frame in frames.items():
        got = sorted(r["i"] for r in io.numbered(frame, "i").select("i").collect())
        assert got == list(range(frame.count())), name
    frames["cached"].unpersist()


def test_numbers_follow_the_order(spark, several_files):
    df = several_files
    assert [(r["k"], r["i"]) for r in io.numbered(df.orderBy(F.desc("k")), "i").orderBy("i").collect()] == [(999 - i, i) for i in range(1000)]
    assert [r["k"] for r in io.numbered(df.orderBy("k").limit(10).where("k > 4"), "i").orderBy("i").collect()] == [5, 6, 7, 8, 9]
    by_file = [r["k"] for r in df.select("k", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    assert [r["k"] for r in io.numbered(df, "i").orderBy("i").collect()] == by_file
    odd = df.where("k % 2 = 1").select("k", F.lit(1).alias("_at"), F.lit(2).alias("_in"), F.lit(3).alias("i"))
    assert [r["k"] for r in io.numbered(odd, "i").orderBy("i").collect()] == [k for k in by_file if k % 2]


def test_corpora_of_sorted_and_repartitioned_frames(spark, tmp_path):
    path = str(tmp_path / "q")
    spark.range(200).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("qid"), F.concat(F.lit("query "), F.col("id").cast("string")).alias("text")).repartition(4).write.parquet(path)
    queries = spark.read.parquet(path)
    docs = spark.range(200).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("doc_id"), F.concat(F.lit("about "), F.col("id").cast("string")).alias("text"))
    judged = spark.range(200).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("qid"), F.concat(F.lit("d"), F.col("id").cast("string")).alias("doc_id"))
    nested = queries.select(F.col("text").alias("query"), F.struct(F.array("text").alias("passage_text"), F.array(F.lit(1)).alias("is_selected")).alias("passages"))
    for change in (lambda f: f, lambda f: f.orderBy(F.desc(f.columns[0])), lambda f: f.repartition(9)):
        c = corpus.from_tables(docs, change(queries), judged)
        assert c.queries.select("query_id").distinct().count() == 200
        text_of = {r["id"]: r["contents"] for r in c.documents.collect()}
        pairs = {r["text"]: [text_of[x] for x in r["docs"]] for r in c.queries.join(c.judgements, "query_id").collect()}
        assert pairs == {f"query {i}": [f"about {i}"] for i in range(200)}
        n = corpus.from_nested(change(nested))
        assert {r["query_id"] for r in n.queries.collect()} == {f"Q{i}" for i in range(200)}
        assert n.queries.join(n.judgements, "query_id").join(n.documents, F.col("docs")[0] == F.col("id")).where("text = contents").count() == 200
