"""Token counts, hard negatives and cascading erasure against the library, brute force and literal cases."""

import glob
import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict
from datetime import datetime
from urllib.parse import urlparse

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rankloom.llm import erasure, fingerprints, hardneg, queries, repeats, tokencount

DATA = "/root/testdata/sf0.001"
TABLES = ("clients", "clicks", "sales", "sale_lines")


# ---- token counts


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def odd_texts():
    rnd = random.Random(3)
    out = ["", "<|endoftext|>", " <|endoftext|> a  <|endoftext|>b   ", "   \n\t  x", "it's 'S 'll'LL", " " * 1000 + "x", "a" * 5000, "\x00\x01", "word " * 400_000, "漢字" * 3000]
    for c in [*range(0, 0xD800, 41), *range(0xE000, 0x40000, 97), 0x1E5D0, 0x2EBF0, 0x323B0, 0x50000, 0xE0001, 0x10FFFF]:
        out.append(f"a{chr(c)}b {chr(c) * 2} 1{chr(c)} !{chr(c)}  {chr(c)}\n\n{chr(c)}'s")
    return out + ["".join(rnd.choice("ab 'stl1!\n\t 　é漢̀<|endoftext|>") for _ in range(rnd.randint(1, 60))) for _ in range(3000)]


def test_token_counts_equal_the_library(spark, tokenizer):
    got = {r["doc_id"]: r for r in queries.op11_token_counts(spark, DATA).collect()}
    texts = dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{DATA}/documents.parquet'").fetchall())
    assert set(got) == set(texts)
    for i, e in zip(texts, tokenizer.encode_batch(list(texts.values()), add_special_tokens=False), strict=True):
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (len(e.ids), len(texts[i].encode()), len(e.ids) > 512)
        assert 0 <= got[i]["n_direct"] <= got[i]["n_tokens"]


def test_token_counts_of_odd_texts(tokenizer):
    counter = tokencount.Counter(tokencount.prove(queries.tokenizer_path()))
    texts = odd_texts()
    want = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [counter.count(t)[0] for t in texts] == want


def test_whole_strings_are_proven(tokenizer):
    proof = tokencount.prove(queries.tokenizer_path())
    assert len(proof.whole) > 40_000
    assert all(len(e.ids) == 1 for e in tokenizer.encode_batch(sorted(proof.whole), add_special_tokens=False))
    assert "<|endoftext|>" not in proof.whole


def test_token_counts_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "a b", "y"), (2, "", None), (2, "", None), (3, "z " * 600, "")], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, tokencount.count_tokens(df, queries.tokenizer_path()).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (None, 3, 2, False), (2, 0, 0, False), (2, 0, 0, False), (3, 1200, 601, True)], key=str)
    assert tokencount.count_tokens(df.limit(0), queries.tokenizer_path()).count() == 0


def test_other_files_are_an_error():
    import public_tokenizers

    with pytest.raises(ValueError):
        tokencount.prove(public_tokenizers.path("word_bpe_49k.json"))


# ---- hard negatives


def brute_negatives(rows, is_anchor, positives=5, negatives=3):
    """rows: {vec_id: (label, ints)}."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for a, (label, v) in rows.items():
        if not is_anchor(a):
            continue
        scored = sorted(((-dot(v, w), i, lab) for i, (lab, w) in rows.items() if i != a))
        for p, i, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and 50 * -p <= 100 * -x[0] <= 95 * -p]
            out += [(a, i, r + 1, j, -p, -s) for r, (s, j, _) in enumerate(fits[:negatives])]
    return sorted(out)


def same_negatives(got, want):
    assert sorted(map(tuple, got.collect())) == want


def test_hard_negatives_of_the_table(spark):
    rows = {}
    for i, e, lab in duckdb.sql(f"select vec_id, embedding, label from '{DATA}/embeddings.parquet'").fetchall():
        if lab is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        rows[i] = ((lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * x) for x in e])
    same_negatives(queries.op12_hard_negatives(spark, DATA), brute_negatives(rows, lambda i: i % 50 == 0))


VECTORS = "vec_id long, label int, v array<long>"


@pytest.mark.parametrize("limits", [{"first_clusters": 1, "growth": 2, "block_rows": 16, "strip_rows": 4}, {}])
def test_windows_with_ties_and_a_hot_vector(spark, monkeypatch, limits):
    rnd = random.Random(5)
    rows = {i: (rnd.randint(0, 2), [rnd.randint(-3, 5) for _ in range(3)]) for i in range(300)} | {i: (i % 2, [2, 2, 2]) for i in range(300, 450)}
    real = hardneg.search
    monkeypatch.setattr(hardneg, "search", lambda *a, **b: real(*a, **{**b, **limits}))
    df = spark.createDataFrame([(i, lab, v) for i, (lab, v) in rows.items()], VECTORS)
    same_negatives(hardneg.hard_negatives(df, F.col("vec_id") % 20 == 0, clusters=12), brute_negatives(rows, lambda i: i % 20 == 0))


def test_large_components_are_exact(spark):
    big = 2**26 + 1
    rows = {0: (0, [big, 1]), 1: (0, [big, 3]), 2: (1, [big // 2, 7]), 3: (1, [big // 2, 8]), 4: (1, [1, 1])}
    df = spark.createDataFrame([(i, lab, v) for i, (lab, v) in rows.items()], VECTORS)
    same_negatives(hardneg.hard_negatives(df, F.col("vec_id") == 0), brute_negatives(rows, lambda i: i == 0))


def test_hard_negatives_of_odd_rows(spark):
    rows = [(0, 1, [4, 0]), (0, 1, [4, 0]), (1, 1, [4]), (2, 2, [3, 1]), (3, None, [3, 1]), (4, 2, None), (None, 2, [3, 1]), (5, 3, []), (6, 2, [2**40, 0]), (7, 2, [-4, 0])]
    df = spark.createDataFrame(rows, VECTORS).withColumn("rank", F.lit("x"))
    assert list(map(tuple, hardneg.hard_negatives(df, F.col("vec_id") == 0).collect())) == [(0, 1, 1, 2, 16, 12)]
    assert hardneg.hard_negatives(df.limit(0), F.col("vec_id") == 0).collect() == []
    assert hardneg.hard_negatives(df.where("vec_id = 0"), F.col("vec_id") == 0).collect() == []


def test_vectors_that_are_not_whole_take_no_part(spark):
    df = spark.createDataFrame([(1, [1.0, None]), (2, [float("nan")]), (3, [float("inf")]), (4, [0.5, -0.001]), (5, None), (6, [])], "i int, x array<float>")
    assert {r["i"]: r["v"] for r in df.select("i", hardneg.quantised(F.col("x")).alias("v")).collect()} == {1: None, 2: None, 3: None, 4: [128, -1], 5: None, 6: []}


# ---- cascading erasure


def crc(x):
    return zlib.crc32(b"" if x is None else str(x).encode())


def brute_erasure(data, modulus=200, files=250):
    """data: {table: (column names, rows)} -> {(table, file_no): (rows left, erased, columns)} of files that are left."""
    value = lambda t, row, c: row[data[t][0].index(c)]
    low = lambda x: (x is not None, x)
    owner = {}
    for r in data["sales"][1]:
        s, c = value("sales", r, "sale_id"), value("sales", r, "client_id")
        if s is not None and (owner.get(s) is None or (c is not None and c < owner[s])):
            owner[s] = c
    lead = {t: (lambda r, t=t: crc(value(t, r, "client_id"))) for t in TABLES[:3]} | {"sale_lines": lambda r: crc(owner.get(value("sale_lines", r, "sale_id")))}
    clicks = Counter(value("clicks", r, "client_id") for r in data["clicks"][1])
    of = defaultdict(set)
    for r in data["clients"][1]:
        if value("clients", r, "master_id") is not None:
            of[value("clients", r, "master_id")].add(value("clients", r, "client_id"))
    masters = {m for m in of if crc(m) % modulus == 0}
    if of:
        masters.add(min(of, key=lambda m: (-sum(clicks[c] for c in of[m] if c is not None), m)))
    gone = {value("clients", r, "client_id") for r in data["clients"][1] if value("clients", r, "master_id") in masters} - {None}
    sales = {value("sales", r, "sale_id") for r in data["sales"][1] if value("sales", r, "client_id") in gone} - {None}
    dead = {"clients": lambda r: value("clients", r, "master_id") in masters, "clicks": lambda r: value("clicks", r, "client_id") in gone, "sales": lambda r: value("sales", r, "client_id") in gone, "sale_lines": lambda r: value("sale_lines", r, "sale_id") in sales}
    out = {}
    for t, (names, rows) in data.items():
        rows = sorted(rows, key=lambda r, t=t: (lead[t](r), *map(low, r)))
        size = 1 + len(rows) // files
        for k in range(0, len(rows), size):
            part = rows[k : k + size]
            left = [r for r in part if not dead[t](r)]
            if left:
                out[t, k // size] = (left, len(part) - len(left), ",".join(names))
    return out


AMOUNT = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}


def check_erasure(got, data, **more):
    want = brute_erasure(data, **more)
    got = {(r["table_name"], r["file_no"]): r for r in got}
    assert set(got) == set(want)
    folders = set()
    for at, (rows, erased, columns) in want.items():
        r, names = got[at], columns.split(",")
        ids = ",".join("" if x[0] is None else str(x[0]) for x in rows)
        amounts = [x[names.index(AMOUNT[at[0]])] for x in rows]
        cents = sum(math.floor(100 * x + 0.5) for x in amounts if x is not None)
        assert (r["n_rows"], r["n_erased"], r["rewritten"], r["columns"], r["cents"], r["ids_sha256"]) == (len(rows), erased, erased > 0, columns, cents, hashlib.sha256(ids.encode()).hexdigest())
        path = urlparse(r["path"]).path
        file = pq.ParquetFile(path)
        stored = [tuple(x.values()) for x in file.read().to_pylist()]
        assert stored == rows
        for c, name in enumerate(names):
            some = [x[c] for x in rows if x[c] is not None]
            stats = [file.metadata.row_group(g).column(c).statistics for g in range(file.metadata.num_row_groups)]
            if some:
                assert min(s.min for s in stats if s.has_min_max) == min(some), name
                assert max(s.max for s in stats if s.has_min_max) == max(some), name
        folders.add(os.path.dirname(os.path.dirname(path)))
    if want:
        (folder,) = folders
        assert {p for p in glob.glob(f"{folder}/**", recursive=True) if os.path.isfile(p)} == {urlparse(r["path"]).path for r in got.values()}
        assert not glob.glob(f"{folder}-*")
    return want


def test_erasure_of_the_tables(spark):
    found = {t: duckdb.sql(f"select * from '{DATA}/{t}.parquet'") for t in TABLES}
    data = {t: (q.columns, q.fetchall()) for t, q in found.items()}
    got = queries.op13_erasure(spark, DATA)
    want = check_erasure(got.collect(), data)
    assert any(e for _, e, _ in want.values()) and any(not e for _, e, _ in want.values())
    again = {r["path"] for r in queries.op13_erasure(spark, DATA).collect()}
    assert not again & {r["path"] for r in got.collect()}


CLIENTS = "client_id long, master_id long, `odd.name` string, balance double"
CLICKS = "click_id long, client_id long, at timestamp_ntz, value double"
SALES = "sale_id long, client_id long, total double"
LINES = "sale_id long, lead string, amount double"


def erased(spark, clients, clicks, sales, lines, **more):
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((clients, CLIENTS), (clicks, CLICKS), (sales, SALES), (lines, LINES))]
    got = erasure.erase(erasure.shop_layers(*frames), erasure.chosen_masters(frames[0], frames[1], **{k: v for k, v in more.items() if k == "modulus"}), erasure.new_folder(spark), **{k: v for k, v in more.items() if k == "files"})
    data = {t: (f.columns, list(map(tuple, rows))) for t, f, rows in zip(TABLES, frames, (clients, clicks, sales, lines), strict=True)}
    return check_erasure(got.collect(), data, **more)


def test_erasure_of_odd_rows(spark):
    at = datetime(2024, 1, 1)
    clients = [(1, 1, "a,b", 1.005), (1, 1, "a,b", 1.005), (2, 1, None, None), (3, 2, "é", -0.5), (None, None, None, None), (4, None, "x", 2.0), (None, 5, "n", 1.0)]
    clicks = [(1, 1, at, 0.1), (1, 1, at, 0.1), (2, None, None, None), (3, 3, at, 5.0), (None, 9, at, 1.0)]
    sales = [(10, 1, 5.0), (10, 3, 6.0), (11, None, 1.0), (None, 1, 2.0), (12, 4, None)]
    lines = [(10, "k", 1.0), (10, "k", 1.0), (11, None, 3.0), (None, "z", 4.0), (99, "y", 5.0), (12, "w", None)]
    for files in (1, 2, 250):
        erased(spark, clients, clicks, sales, lines, files=files, modulus=10**9)


def test_erasure_of_empty_tables(spark):
    assert erased(spark, [], [], [], []) == {}
    assert len(erased(spark, [], [], [(1, 2, 3.0)], [])) == 1
    assert erased(spark, [(1, 7, "a", 1.0)], [], [], []) == {}  # the smallest master goes, even without a click


def test_a_client_with_a_third_of_the_rows(spark):
    rnd = random.Random(1)
    clients = [(i, i // 3, f"n{i}", float(i)) for i in range(90)]
    who = lambda: 5 if rnd.random() < 0.34 else rnd.randint(0, 95)
    clicks = [(i, who(), datetime(2024, 1, 1 + i % 28), rnd.random()) for i in range(2000)]
    sales = [(i, who(), rnd.random()) for i in range(800)]
    lines = [(rnd.choice([7, rnd.randint(0, 820)]), None, 1.5) for _ in range(1500)]
    erased(spark, clients, clicks, sales, lines, files=20, modulus=7)


def test_filters_have_no_false_negatives_and_leave_files_out(spark):
    rows = [(i, i // 10, "", 1.0) for i in range(20_000)]
    layers = erasure.shop_layers(spark.createDataFrame(rows, CLIENTS), *[spark.createDataFrame([], s) for s in (CLICKS, SALES, LINES)])
    size, files = erasure.lay_out(layers[0], erasure.new_folder(spark), 100)
    blocks = -(-size // erasure.KEYS_A_BLOCK)
    filters = erasure.bloom_filters(spark, files, "client_id", blocks)
    sure = {k: {x for x in pq.read_table(urlparse(p).path)["client_id"].to_pylist()} for k, p in files.items()}
    keys = [3, 77, 4711, 10**9]
    found = set(erasure.shortlist(filters, spark.createDataFrame([(k,) for k in keys], "key long"), blocks))
    holding = {k for k, ids in sure.items() if ids & set(keys)}
    assert holding <= found and len(found) <= len(holding) + 2


# ---- layers of secrets, ids of fingerprints


SECRET = "some words before it: password = hunter2hunter2, and some behind"


def packed(text, how):
    import bz2
    import gzip
    import lzma

    deflate = zlib.compressobj(9, zlib.DEFLATED, -15)
    raw = text.encode()
    return {
        "plain": raw, "utf-16": text.encode("utf-16"), "utf-16-le": text.encode("utf-16-le"), "utf-16-be": text.encode("utf-16-be"), "gzip": gzip.compress(raw), "zlib": zlib.compress(raw),
        "deflate": deflate.compress(raw) + deflate.flush(), "bz2": bz2.compress(raw), "xz": lzma.compress(raw), "xz of utf-16": lzma.compress(text.encode("utf-16")),
    }[how]


@pytest.mark.parametrize("how", ["plain", "utf-16", "utf-16-le", "utf-16-be", "gzip", "zlib", "deflate", "bz2", "xz", "xz of utf-16"])
@pytest.mark.parametrize("width", [0, 9, 20, 36, 64, 76])
def test_secrets_in_every_kind_of_layer(how, width):
    import base64
    import textwrap

    from rankloom.llm import secrets

    code = base64.b64encode(packed(SECRET, how)).decode()
    body = "\n".join(textwrap.wrap(code, width)) if width else code
    text = f"a note\n\n{body}\n\nthe end"
    base, spans = secrets.unwrap(text)
    added = [x for x in spans if x not in base and x[2] == "assign"]
    assert base == secrets.scan(text) and added
    assert any(text[s:e].strip("=\n").startswith(body[:4]) or body.startswith(text[s:e][:4]) or s >= text.index(body) for s, e, _ in added)
    assert all(text.index(body) <= s < e <= text.index(body) + len(body) for s, e, _ in added)
    twice = base64.b64encode(packed(code, "gzip")).decode()
    assert any(k == "assign" for *_, k in secrets.unwrap(twice)[1])


def test_a_secret_over_a_line_end_is_found():
    import base64

    from rankloom.llm import secrets

    code = base64.b64encode(b"x" * 20 + b" token: abcdefghijkl " + b"y" * 20).decode()
    for width in (7, 12, 30, 36, 40):
        body = "\n".join(code[i : i + width] for i in range(0, len(code), width))
        assert any(k == "assign" for *_, k in secrets.unwrap(f"key {body}\nend")[1]), width


def test_prose_in_short_lines_has_no_secrets():
    from rankloom.llm import secrets

    text = "\n".join(["several", "words", "stand", "in", "lines", "of", "their", "own"] * 50)
    assert secrets.unwrap(text) == ([], [])


def test_fingerprints_of_the_least_id(spark):
    rows = [(-(2**63), "the first of all ids stands here"), (2**63 - 1, "the last of all ids stands there"), (0, "nothing in between"), (None, "no id")]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = [rows[1], rows[2], rows[0], rows[3]]
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        n = len(text) // 3
        assert got[i]["edited_sha256"] == hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest()


def test_very_long_texts(spark):
    """Every scan reads a text of a million words to its end."""
    from rankloom.llm import licenses, quality, secrets, toxicity

    long = "plain words of no kind " * 200_000 + "token: abcdefghijkl"
    docs = spark.createDataFrame([(1, long), (2, "short"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.find_secrets(docs).collect()}
    assert got[1]["n_assign"] == 1 and got[1]["spans"] == f"assign:{len(long) - 19}:{len(long)}"
    counted = {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(docs, queries.tokenizer_path()).collect()}
    assert counted[1] > 1_000_000 and counted[3] == 0
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(docs, labels).count() == 3 and quality.score_quality(docs).count() == 3
    files = docs.select("doc_id", F.col("doc_id").cast("string").alias("path"), "text", F.lit(False).alias("is_license_file"))
    assert licenses.scan_licenses(files).count() == 3


def test_hard_negatives_equal_their_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    want = c.execute(queries.oracle_sql()["op12_hard_negatives"]).fetchall()
    assert sorted(map(tuple, queries.op12_hard_negatives(spark, DATA).collect())) == sorted(want) != []


def test_a_row_repeated_over_a_third_of_the_table(spark):
    """Copies of one row lie in many tasks, each followed by its like but the last."""
    rows = [(i, f"own {i}") for i in range(-1000, 1000)] + [(5, "same")] * 1000 + [(None, "none")] * 300
    df = spark.createDataFrame(rows, "k long, t string").repartition(6)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        got = fingerprints.with_next(df, "k", ["t"], 20).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)
    tie = {r["t"]: r["h"] for r in df.select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]]))
    want = Counter((k, t, order[(i + 1) % len(order)][1]) for i, (k, t) in enumerate(order))
    assert Counter((r["k"], r["t"], r["next_t"]) for r in got) == want
    assert max(Counter(r["task"] for r in got).values()) < len(rows) / 5
    assert max(Counter(r["task"] for r in got if r["t"] == "same").values()) <= 60


@pytest.mark.parametrize("limits", [{}, {"hot_runs": 20}])
def test_a_stretch_that_one_text_repeats(spark, limits):
    """One digit has hundreds of runs in a single text, between stretches that differ."""
    rnd = random.Random(1)
    noise = lambda n: "".join(rnd.choices("abcdefghij", k=n))
    fill = noise(390)
    texts = {1: "".join(fill + noise(200) for _ in range(60)), 2: fill + noise(50) + fill, 3: noise(900), 4: ""}
    texts[5] = noise(30) + texts[1][590:2400]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.strip_repeats(df, **limits).collect()}
    raw = {i: t.encode() for i, t in texts.items()}
    seen = Counter(b[s : s + 400] for b in raw.values() for s in range(len(b) - 399))
    for i, b in raw.items():
        cover = bytearray(len(b))
        for s in range(len(b) - 399):
            if seen[b[s : s + 400]] > 1:
                cover[s : s + 400] = b"\1" * 400
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        runs = sum(1 for j, c in enumerate(cover) if c and (j == 0 or not cover[j - 1]))
        assert got[i] == (len(b), sum(cover), runs, hashlib.sha256(kept).hexdigest())
