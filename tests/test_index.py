"""The written index: exact top-k under pruning, parts that are read, and what happens to damaged files."""

import glob
import hashlib
import math
import os
import random
import re
import shutil
import threading
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from rankloom.operators import index as I
from rankloom.operators import retrieval as R

WORDS = [f"w{i}" for i in range(40)]
VARIANTS = {"okapi": (1.5, 0.75), "lucene": (0.9, 0.4)}


def corpus(n, seed):
    rnd = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    texts = [" ".join(rnd.choices(WORDS, weights, k=rnd.choice([1, 2, 3, 8, 30]))) for _ in range(n)]
    return list(enumerate(texts + texts[: n // 4]))  # equal documents: ties


def brute(docs, queries, k, variant):
    k1, b = VARIANTS[variant]
    tf = {i: Counter(re.findall("[a-z0-9_]+", t.lower())) for i, t in docs}
    tf = {i: c for i, c in tf.items() if c}
    df = Counter(t for c in tf.values() for t in c)
    n, avg = len(tf), sum(sum(c.values()) for c in tf.values()) / len(tf)
    raw = {t: math.log(n - m + 0.5) - math.log(m + 0.5) for t, m in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: (x if x >= 0 else 0.25 * mean) if variant == "okapi" else math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t, x in raw.items()}
    out = []
    for q, text in queries:
        asked = Counter(re.findall("[a-z0-9_]+", text.lower()))
        hits = []
        for i, c in tf.items():
            if any(t in c for t in asked):
                dl = sum(c.values())
                hits.append((-round(sum(m * idf[t] * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * dl / avg)) for t, m in asked.items() if t in c), 6), i))
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(hits)[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_pruned_top_k_equals_brute_force(spark, tmp_path, seed):
    rnd = random.Random(seed)
    docs = corpus(400, seed)
    queries = list(enumerate([" ".join(rnd.choices(WORDS, k=m)) for m in (1, 2, 3, 5, 9) for _ in range(4)] + ["w0 w39", "w0 w0 w1 w38", "nothing", "", "W0 unknown"]))
    made = R.Index.build(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "i"), parts=20)
    asked = spark.createDataFrame(queries, "qid long, text string")
    for variant in VARIANTS:
        for k, one_pass in ((1, 0), (3, 0), (10, 0), (1000, 0), (10, 10**9)):
            got = sorted((r["qid"], r["doc_id"], round(r["score"], 6), r["rank"]) for r in R.top_k(made, asked, k, variant, one_pass=one_pass).collect())
            want = brute(docs, queries, k, variant)
            assert [(q, i, r) for q, i, _, r in got] == [(q, i, r) for q, i, _, r in want]
            assert all(a[2] == pytest.approx(b[2], abs=2e-6) for a, b in zip(got, want, strict=True))


def test_frequent_terms_are_not_scored_for_every_document(spark, tmp_path):
    docs = [(i, "common " * (1 + i % 3) + (f"rare{i % 50} " * 3 if i % 4 == 0 else "") + "filler " * (i % 5)) for i in range(4000)]
    made = R.Index.build(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "i"))
    asked = spark.createDataFrame([("common rare4 filler",)], "text string")
    known = {r["term"]: r for r in R.bounds(made, R.query_terms(asked), 10, "lucene").collect()}
    assert known["rare4"]["needed"] and not known["common"]["needed"] and not known["filler"]["needed"]
    every = made.candidates(R.query_terms(asked)).count()
    assert R.scored(made, asked.withColumn("id", F.lit(0)), 10, "lucene", 0).count() < every / 20
    assert [(r["doc_id"], r["score"]) for r in R.top_k(made, asked.withColumn("qid", F.lit(0)), 10, "lucene", one_pass=0).orderBy("rank").collect()] == [(i, pytest.approx(s, abs=2e-6)) for _, i, s, _ in sorted(brute(docs, [(0, "common rare4 filler")], 10, "lucene"), key=lambda x: x[3])]


def test_only_the_parts_of_the_terms_are_read(spark, tmp_path):
    made = R.Index.build(spark.createDataFrame(corpus(300, 3), "doc_id long, text string"), str(tmp_path / "i"), parts=32)
    terms = spark.createDataFrame([("w1",), ("w7",)], "term string")
    wanted = {r[0] for r in terms.select(I.part_of(32)).collect()}
    read = made.read(terms)
    files = {r[0] for r in read.select("_metadata.file_path").distinct().collect()}
    assert {int(re.search(r"part=(\d+)", f)[1]) for f in files} == wanted
    assert read.join(terms, "term").count() == made.postings.join(terms, "term").count() > 0
    text = read._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[part#\d+ (IN|INSET)", text)
    every = {p for p in glob.glob(f"{made.place}/postings/part=*")}
    assert len(every) > len(wanted)


@pytest.fixture
def stored(spark, tmp_path):
    source = str(tmp_path / "docs")
    spark.createDataFrame(corpus(100, 4), "doc_id long, text string").write.parquet(source)
    return spark.read.parquet(source), str(tmp_path / "index")


def digests(path):
    return {p: hashlib.sha256(open(p, "rb").read()).hexdigest() for p in glob.glob(f"{path}/**", recursive=True) if os.path.isfile(p)}


def some_file(folder):
    return sorted(glob.glob(f"{folder}/**/*.parquet", recursive=True))[0]


def cut_file(place):
    path = some_file(f"{place}/postings")
    size = os.path.getsize(path)
    with open(path, "rb+") as f:
        f.truncate(size // 2)


def cut_manifest(place):
    path = f"{place}/manifest.json"
    text = open(path).read()
    open(path, "w").write(text[: len(text) // 2])


@pytest.mark.parametrize("damage", [cut_file, cut_manifest, lambda p: shutil.rmtree(f"{p}/terms"), lambda p: os.remove(some_file(f"{p}/lengths")), lambda p: os.remove(some_file(f"{p}/postings"))])
def test_damaged_index_is_noticed_and_written_anew(spark, stored, damage):
    docs, path = stored
    first = R.Index.ensure(docs, path)
    asked = spark.createDataFrame([(1, "w0 w3")], "qid long, text string")
    want, before = R.top_k(first, asked, 5).collect(), digests(path.replace("/index", "/docs"))
    assert R.Index.ensure(docs, path).place == first.place
    damage(first.place)
    with pytest.raises(FileNotFoundError):
        R.Index.open(spark, path)
    second = R.Index.ensure(docs, path)
    assert second.place != first.place and R.top_k(second, asked, 5).collect() == want
    assert [os.path.basename(p) for p in glob.glob(f"{path}/*")] == [os.path.basename(second.place)]
    assert R.Index.ensure(docs, path).place == second.place
    assert digests(path.replace("/index", "/docs")) == before


def test_content_is_held_against_the_manifest(spark, stored):
    docs, path = stored
    first = R.Index.ensure(docs, path)
    assert R.Index.open(spark, path, content=True).place == first.place
    target = some_file(f"{first.place}/lengths")
    data = bytearray(open(target, "rb").read())
    middle = data.index(b"PAR1") + 40
    data[middle : middle + 8] = b"\xff" * 8
    open(target, "wb").write(data)
    for crc in glob.glob(f"{first.place}/lengths/.*.crc"):
        os.remove(crc)
    assert R.Index.open(spark, path).place == first.place  # sizes are as they were
    with pytest.raises(FileNotFoundError):
        R.Index.open(spark, path, content=True)
    assert R.Index.ensure(docs, path, content=True).place != first.place


def test_unfinished_generations_are_left_alone(spark, stored):
    docs, path = stored
    other = f"{path}/gen-0000"
    os.makedirs(f"{other}/raw")
    made = R.Index.ensure(docs, path)
    assert os.path.isdir(other) and made.place != other and R.Index.ensure(docs, path).place == made.place
    shutil.rmtree(made.place)
    os.utime(other, (0, 0))  # abandoned long ago
    R.Index.ensure(docs, path)
    assert not os.path.isdir(other)


def test_two_sessions_at_once(spark, stored):
    docs, path = stored
    found, errors = [], []

    def run(session):
        try:
            found.append(R.Index.ensure(session.read.parquet(path.replace("/index", "/docs")), path))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=run, args=(spark.newSession(),)) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and len(found) == 2
    assert sorted(found[0].postings.collect()) == sorted(found[1].postings.collect())
    assert R.Index.open(spark, path).n == found[0].n


def test_damaged_content_doesnt_stand_for_its_name(spark, stored, monkeypatch):
    names = iter(range(10**6))  # the damaged generation comes first by name
    monkeypatch.setattr(I, "uuid", SimpleNamespace(uuid4=lambda: SimpleNamespace(hex=f"{next(names):032x}")))
    docs, path = stored
    first = R.Index.ensure(docs, path)
    target = some_file(f"{first.place}/lengths")
    data = bytearray(open(target, "rb").read())
    middle = data.index(b"PAR1") + 40
    data[middle : middle + 8] = b"\xff" * 8
    open(target, "wb").write(data)
    for crc in glob.glob(f"{first.place}/lengths/.*.crc"):
        os.remove(crc)
    second = R.Index.ensure(docs, path, content=True)
    assert second.place > first.place and second.lengths.count() == first.n
    assert [os.path.basename(p) for p in glob.glob(f"{path}/*")] == [os.path.basename(second.place)]
