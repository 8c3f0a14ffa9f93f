"""The operators against brute force, round trips and held-out labels."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from urllib.parse import quote

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rankloom.llm import fingerprints, hamming, licenses, mixing, packing, quality, queries, repeats, secrets, similarity, toxicity

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def sets_of(texts):
    words = {i: WORD.findall(t) for i, t in texts.items()}
    return {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, w in words.items()}


def brute_removed(texts, depth=400):
    raw = {i: t.encode() for i, t in texts.items()}
    seen = Counter(b[s : s + depth] for b in raw.values() for s in range(len(b) - depth + 1))
    out = {}
    for i, b in raw.items():
        cover = bytearray(len(b))
        for s in range(len(b) - depth + 1):
            if seen[b[s : s + depth]] > 1:
                cover[s : s + depth] = b"\1" * depth
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out[i] = (len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("limits", [{}, {"hot_runs": 1}, {"hot_runs": 3}])
def test_repeats(docs, texts, limits):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.strip_repeats(docs, **limits).collect()}
    assert got == brute_removed(texts)


@pytest.mark.parametrize("limits", [{}, {"hot_runs": 1}])
def test_repeats_periodic(spark, limits):
    texts = {1: "ab" * 400, 2: "x" * 399, 3: "y" * 400, 4: "é" * 300, 5: "".join(f"{i} " for i in range(400)), 6: "q" + "".join(f"{i} " for i in range(300))}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.strip_repeats(df, **limits).collect()}
    assert got == brute_removed(texts)


@pytest.mark.parametrize("limits", [{}, {"hot_runs": 2}])
def test_repeats_of_planted_passages(spark, limits):
    """Passages of over 50 words in three documents each: whole from 400 bytes on, untouched below; clean documents stay."""
    rnd = random.Random(9)
    words = lambda n: " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyzé", k=rnd.randint(3, 9))) for _ in range(n))
    passages = [words(rnd.randint(51, 70)) for _ in range(40)]
    for n in range(396, 405):
        p = words(80).encode()[: n - 3].decode(errors="ignore").rstrip()
        passages.append(p + "x" * (n - len(p.encode())))
    texts = {1000 + i: words(120) for i in range(30)}
    for k, p in enumerate(passages):
        texts |= {10 * k + j: f"{words(60)}{gap}{p}{gap}{words(60)}" for j, gap in enumerate(" \n\t")}
    assert all(len(WORD.findall(p)) > 50 for p in passages) and {len(p.encode()) >= 400 for p in passages} == {True, False}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.strip_repeats(df, **limits).collect()}
    assert got == brute_removed(texts)
    for k, p in enumerate(passages):
        n = len(p.encode())
        assert [got[10 * k + j][1:3] for j in range(3)] == [(n, 1) if n >= 400 else (0, 0)] * 3
    assert all(got[i][1] == 0 for i in texts if i >= 1000)
    assert all(got[i][0] == len(t.encode()) for i, t in texts.items())  # n_bytes is the input's length, whatever is removed


def brute_shared(rows, width=51):
    """For each row the words in runs of `width` words that another row holds too."""
    words = [WORD.findall(t or "") for t in rows]
    holders = defaultdict(set)
    for i, w in enumerate(words):
        for k in range(len(w) - width + 1):
            holders[tuple(w[k : k + width])].add(i)
    return [len({j for k in range(len(w) - width + 1) if len(holders[tuple(w[k : k + width])]) > 1 for j in range(k, k + width)}) for w in words]


PASSAGE_LIMITS = [{}, {"hot_runs": 1}, {"hot_runs": 3, "group_windows": 50}, {"group_windows": 1}]


@pytest.mark.parametrize("limits", PASSAGE_LIMITS)
def test_shared_words(docs, texts, limits):
    got = {r["doc_id"]: r["n_shared_words"] for r in repeats.strip_repeats(docs, **limits).collect()}
    assert got == dict(zip(texts, brute_shared(texts.values()), strict=True)) and sum(map(bool, got.values())) > 30


@pytest.mark.parametrize("limits", PASSAGE_LIMITS)
def test_shared_words_of_planted_and_odd_texts(spark, limits):
    """Passages of 49 to 70 words in other documents, most under 400 bytes: counted from 51 words on, whatever is removed."""
    rnd = random.Random(5)
    words = lambda n: " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyzé", k=rnd.randint(1, 7))) for _ in range(n))
    texts = [words(120) for _ in range(20)]
    for n in range(49, 71):
        p = words(n)
        texts += [f"{words(30)} {p} {words(9)}", f"{p}\n{words(40)}", f"{words(5)}  " + p.replace(" ", "\t\n")]
    own = words(60)
    texts += [f"{own} {words(70)} {own}", "a " * 300, "a " * 50, "a " * 51 + "b", "b a " * 90, f"b a {words(3)} " * 40 + "a b " * 80, None, "", " ", "x" * 900, "x" * 900]
    texts += [words(50)] * 2 + [words(51)] * 3 + [" ".join("abcdefghij" * 6)] * 2 + [f"x{' '.join('abcdefghij' * 6)}", words(90) + "\x00\u2028 "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shared_words"], r["n_removed"]) for r in repeats.strip_repeats(df, **limits).collect()}
    wanted = brute_shared(texts)
    assert [got[i][0] for i in range(len(texts))] == wanted
    assert [wanted[20 + 3 * k + j] for k in range(22) for j in range(3)] == [n if n > 50 else 0 for n in range(49, 71) for _ in range(3)]
    assert sum(got[i][0] > 50 and not got[i][1] for i in range(20, 86)) > 30


@pytest.mark.parametrize("limits", [{}, {"most": 4, "levels": 2, "tile": 4, "crowd": 2}, {"tokens_a_set": 2, "tile": 16}, {"crowd": 1}])
def test_near_duplicates(spark, limits):
    base = " ".join(f"w{i}" for i in range(120))
    rows = {i: base.replace(f"w{i * 3} ", f"v{i} ") for i in range(30)} | {100 + i: base for i in range(4)} | {200: "", 201: "  ", 202: "one two", 203: "one two"}
    rows |= {300 + i: " ".join(f"w{j}" for j in range(60)) + " " + " ".join(f"u{i}_{j}" for j in range(60)) for i in range(20)}
    sets = sets_of(rows)
    want = {}
    for i, s in sets.items():
        want[i] = len({rows[j] for j, t in sets.items() if rows[j] != rows[i] and (s and t and 9 * len(s & t) >= 4 * (len(s) + len(t)))})
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in similarity.near_duplicates(df, **limits).collect()}
    assert {i: r["n_links"] for i, r in got.items() if i not in (200, 201)} == {i: n for i, n in want.items() if i not in (200, 201)}
    assert len({got[i]["class_id"] for i in range(30)} | {got[100]["class_id"]}) == 1
    assert got[202]["class_id"] == got[203]["class_id"] == 202 and got[100]["n_copies"] == 4
    assert len({got[300 + i]["class_id"] for i in range(20)}) == 20


def test_exact_links_by_ranges():
    import numpy as np

    draw = np.random.default_rng(3)
    pool = draw.integers(0, 1 << 64, 400, dtype=np.uint64, endpoint=False)
    sets = [np.unique(np.concatenate([pool[: 100 + draw.integers(0, 40)], draw.choice(pool, 12)])) for _ in range(300)]
    rows = [(0, i, 1 + i % 3, t.tobytes(), int(draw.integers(-1, 2))) for i, t in enumerate(sets)]
    links = [[9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b)) and i != j and (rows[j][4] == -1 or rows[i][4] != rows[j][4]) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    for at_once in (10_000_000, 5_000):
        got, _ = similarity._exact(rows, at_once)
        assert got.tolist() == [sum(r[2] for r, hit in zip(rows, x, strict=True) if hit) for x in links]


def test_packing(spark, docs, texts):
    import numpy as np
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    rows = packing.pack(docs, queries.tokenizer_path()).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, t in texts.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    used = sum(r["length"] for r in rows)
    padded = sum(s[0]["padded"] for s in by_seq.values())
    assert used >= 0.98 * padded


def test_packing_long_gaps():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    encode = packing.load_encoder(queries.tokenizer_path())
    for text in ("a" + " " * 2_000_000 + "b", "\n" * 1_500_000, "x\t" * 60_000, "y" * 300_000, "one <|endoftext|> two", "<|endoftext|><|endoftext|>", "<|endoftext", "a<|b|>", "<|"):
        assert encode(text) == tok.encode(text, add_special_tokens=False).ids


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.score_toxicity(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in got)
    assert hit / sum(r["toxic"] for r in got) > 0.85 and hit / sum(r["predicted"] for r in got) > 0.85


def test_automaton_matches_edit_distance():
    terms = {"idiot": 2.0, "worthless": 3.0, "scum": 1.0, "lowei*": 1.5}
    auto = toxicity.Automaton(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for word in "idiot idi0t idiott diot worthless wortless wrthles worthxxxx scum scvm scums loweischaft lowischaft xlowei zzz id".split():
        near = []
        for t in terms:
            stem, b = t.rstrip("*"), auto.budget(len(t.rstrip("*")))
            k = min(distance(word[:n], stem) for n in range(len(word) + 1)) if t.endswith("*") else distance(word, stem)
            if k <= b:
                near.append(k)
        got = auto.match(word)
        assert (got is None) == (not near), word
        if near:
            assert got[1] == min(near), word


def test_secrets_base_and_layers():
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    text = f'é password = "hunter22" and {key} and {"0123456789abcdef" * 2}; secret=abc'
    base, spans = secrets.unwrap(text)
    assert [k for *_, k in base] == ["assign", "access", "hex"] and base == spans
    for wrapped in (base64.b64encode(f"token={key}".encode()).decode(), base64.b64encode(gzip.compress(f"token={key}xx".encode())).decode(), quote(f"token={key}", safe=""), "".join(f"\\u{ord(c):04x}" for c in f"token={key}")):
        for text in (f"see {wrapped} here", f"see {base64.b64encode(wrapped.encode()).decode()} here"):
            base, spans = secrets.unwrap(text)
            assert {k for *_, k in spans} >= {"assign", "access"}, text
            assert all(4 <= s < e <= len(text) - 5 for s, e, _ in set(spans) - set(base))
    assert secrets.unwrap("secret = token: abcdefgh")[0] == []


def test_secrets_base64_alphabets_and_pieces():
    secret = "password=hunter22"
    plain = base64.b64encode(secret.encode()).decode()
    for i in range(200):
        packed = base64.urlsafe_b64encode(zlib.compress(f"{secret}{i} {hashlib.sha256(str(i).encode()).hexdigest().upper()}".encode())).decode()
        for text in (f"é {packed} x", f"é https://h.example/download/{packed} x"):
            found = secrets.unwrap(text)[1]
            assert any(k == "assign" and text.index(packed) in range(s, e) for s, e, k in found), text
    for left, right in (("https://h.example/download/", ""), ("key-", "-end"), ("a_", "/b"), ("word", ""), ("w", "word"), ("ab", ""), ("", "abc/defg")):
        text = f"é {left}{plain.rstrip('=')}{right} x"
        at = text.index(plain[:-1])
        assert any(k == "assign" and s <= at + 2 and at + len(plain) - 2 <= e <= len(text) - 2 for s, e, k in secrets.unwrap(text)[1]), text
    assert secrets.unwrap(f"https://h.example/download/{plain} x")[1] == [(27, 27 + len(plain), "assign")]


def test_secrets_odd_characters_and_long_archives():
    secret = "password=hunter22"
    for odd in ("\u00a0", "\u200b", "\ufeff", "\x1b", "\x0c", "\0" * 40, "\udce9"):
        raw = f"mot {odd} de passe {secret} fin".encode("utf-8", "surrogateescape")
        text = f"see {base64.b64encode(raw).decode()} x"
        assert any(k == "assign" for *_, k in secrets.unwrap(text)[1]), odd
    filler = b"some words, and more. " * 4_000_000
    for packed in (gzip.compress(filler + secret.encode(), 1), gzip.compress(b"first, ") + gzip.compress(secret.encode()), gzip.compress(b"pass") + gzip.compress(secret[4:].encode())):
        text = f"see {base64.b64encode(packed).decode()} x"
        assert (4, len(text) - 2, "assign") in secrets.unwrap(text)[1]
    cut = secrets._inflate(zlib.compress(b"," + secret.encode() * 9 + b", " + secret.encode()), 20)
    assert "".join(cut) == "," + secret * 9 + ", " + secret


def test_secrets_long_and_deep():
    """Time grows with a text's length, not its square; nesting may be deep; spans map through many substitutions."""
    assert secrets.unwrap("q" * 1_000_000 + " %41 %zz") == ([], [])
    deep = "%" + "25" * 1200 + "41"
    assert (2, 2 + len(deep) + 19, "access") in secrets.unwrap(f"é {deep}KIA{'Q' * 16} .")[1]
    many = "%41 \\u0042 " * 3000
    text = f"{many}password%3dabcdefgh {many}"
    assert (len(many), len(many) + 19, "assign") in secrets.unwrap(text)[1]


def test_hamming(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    want = sorted(con.execute(queries.TOP_K_SQL).fetchall())
    for blocks in ({}, {"group_rows": 30, "candidates": 1}, {"group_rows": 7}):
        assert sorted(tuple(r) for r in hamming.top_k(df, **blocks).select("query_id", "rank", "vec_id", "distance").collect()) == want


def test_mixing(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    cols = ("doc_id", "size", "source_size", "target", "taken")
    got = entry.queries()["op5_mixing"](spark, DATA).select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"select {', '.join(cols)} from ({queries.MIX_SQL})").fetchall())


def test_targets_cap_and_reshare(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 30 and sum(got.values()) == pytest.approx(2010) and got[None] == 0
    assert got["b"] / got["c"] == pytest.approx(2)


def test_fingerprints(spark, docs, texts):
    got = fingerprints.fingerprint_pairs(docs).collect()
    order = sorted(texts, reverse=True)
    sets = sets_of(texts)
    errors = []
    for r in got:
        i = r["doc_id"]
        n = texts[order[(order.index(i) + 1) % len(order)]]
        t = texts[i]
        edited = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(t)
        e = sets_of({0: edited})[0]
        errors.append(r["near_edited"] - len(sets[i] & e) / len(sets[i] | e))
    assert abs(sum(errors)) / len(errors) < 0.02 and sum(x * x for x in errors) / len(errors) < 0.004
    by_text = defaultdict(set)
    for r in got:
        by_text[texts[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


@pytest.mark.parametrize("cell", [2, 3, 500])
def test_next_rows_of_repeated_and_null_ids(spark, cell):
    """Every row's next one by a plain sort; rows equal in id and text may stand in any order."""
    rows = [(7, f"hot {i}") for i in range(60)] + [(None, f"none {i}") for i in range(40)] + [(i, f"own {i}") for i in range(0, 400, 9)] + [(5, "same")] * 5
    df = spark.createDataFrame(rows, "k long, t string").repartition(5)
    tie = {r["t"]: r["h"] for r in df.select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]]))
    want = sorted((str(k), t, order[(i + 1) % len(order)][1]) for i, (k, t) in enumerate(order))
    got = sorted((str(r["k"]), r["t"], r["next_t"]) for r in fingerprints.with_next(df, "k", ["t"], cell).collect())
    assert got == want


def test_quality(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality.score_quality(spark.read.parquet(f"{d}/documents.parquet")).join(labels, "doc_id").collect()
    mean = lambda q: sum(r["score"] for r in got if r["quality"] == q) / sum(r["quality"] == q for r in got)
    assert mean(1) > mean(0) + 0.3


def test_licenses(spark):
    rows = [(1, "p/LICENSE", "Licensed under the Apache License, Version 2.0.", True), (2, "p/x/a", "words\nmore", False), (3, "p/y/LICENSE", "Released under the MIT License.", True), (4, "p/y/z/b", None, False), (5, "other/c", "", False), (6, None, "Licensed under CC BY-NC 4.0.", False)]
    got = {r["doc_id"]: (r["license"], r["inherited_from"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string, is_license_file boolean")).collect()}
    assert got == {1: ("Apache-2.0", None), 2: ("Apache-2.0", "p"), 3: ("MIT", None), 4: ("MIT", "p/y"), 5: (None, None), 6: ("CC-BY-NC-4.0", None)}


def test_licenses_wrapped(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU {}General Public License as published by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version.\n"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n"
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction.\n"
    marked = lambda text, mark: "".join(f"{mark} {line}\n" for line in text.splitlines())
    own = [("BSD-3-Clause", bsd), ("GPL-3.0", gpl.format("", 3)), ("GPL-2.0", gpl.format("", 2)), ("AGPL-3.0", gpl.format("Affero ", 3)), ("MIT", mit), ("MIT", mit.replace("\n", " "))]
    texts = [(name, "é Copyright (c) 2020 A. Writer\n\n" + marked(x, mark) + "\nint main() { return 0; }\n") for name, x in own for mark in ("", " *", "#", "dnl")]
    rows = [(i, f"d{i}/LICENSE", x, True) for i, (_, x) in enumerate(texts)] + [(100 + i, f"d{i}/src/a", "words", False) for i in range(len(texts))] + [(200 + i, f"e{i}", f"plain text of file {i}", False) for i in range(60)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string, is_license_file boolean")).collect()}
    for i, (name, x) in enumerate(texts):
        assert (got[i]["own_license"], got[100 + i]["license"]) == (name, name), x
        assert x[got[i]["start"] : got[i]["end"]].strip() and got[i]["cosine"] >= 0.75
    assert all(got[200 + i]["license"] is None for i in range(60))


ODD = [(1, "same text here", "en", "s", 9, "t"), (1, "same text here", "en", "s", 9, "t"), (2, None, None, None, None, None), (3, "", "en", None, 0, "x"), (None, "no id at all, but words", "de", "s", 5, "y"), (4, "long " * 60_000, "en", "s", 300_000, "z")]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, packed string"


def test_licenses_in_every_file(spark):
    notice = "Licensed under the Apache License, Version 2.0"
    for n in (1, 3, 40):
        rows = [(i, f"d{i}/a", f"Some words of file {i}.\n{notice}", False) for i in range(n)] + [(n, "b/LICENSE", notice, True), (n + 1, "b/c", "plain", False)]
        got = {r["doc_id"]: (r["license"], r["inherited_from"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string, is_license_file boolean")).collect()}
        assert got == {**{i: ("Apache-2.0", None) for i in range(n + 1)}, n + 1: ("Apache-2.0", "b")}


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_odd_rows(spark, rows):
    df = spark.createDataFrame(rows, ODD_SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    n = len(rows)
    assert len(quality.score_quality(df).collect()) == n
    assert len(fingerprints.fingerprint_pairs(df).collect()) == n
    assert len({r["doc_id"] for r in packing.pack(df, queries.tokenizer_path()).collect()}) == len({r[0] for r in rows})
    assert [r["score"] for r in toxicity.score_toxicity(df, labels).collect()] == [0.5] * n
    assert len(mixing.mix(df).collect()) == n
    assert len(similarity.near_duplicates(df).collect()) == n
    assert len(secrets.find_secrets(df).collect()) == n
    assert len(licenses.scan_licenses(licenses.as_files(df)).collect()) == n
    assert len(repeats.strip_repeats(df).collect()) == n
    assert secrets.redact(df).columns == df.columns and similarity.keep_one(df).columns == df.columns
    assert mixing.take(df).columns == df.columns and toxicity.drop_toxic(df, labels).columns == df.columns


def test_clashing_names(spark):
    """Columns named like those the operators add stay as they were."""
    names = "score _row _n _text _id _tie _source _copies _cell key size taken label node path a.b Packed".split()
    df = spark.createDataFrame([(i, f"some words of text number {i} " * 9, "s", 99, *[f"{c}{i}" for c in names]) for i in range(8)], "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    steps = {"tox": toxicity.drop_toxic(df, labels, threshold=0.6), "near": similarity.keep_one(df), "sec": secrets.redact(df), "mix": mixing.take(df)}
    for name, out in steps.items():
        assert out.columns == df.columns, name
        assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in df.withColumn("n_chars", df.n_chars if name != "sec" else F.length("text").cast("long")).collect()}, name
    assert steps["tox"].count() == 8
    for f in (quality.score_quality, fingerprints.fingerprint_pairs, mixing.mix, similarity.near_duplicates, secrets.find_secrets, repeats.strip_repeats, lambda d: licenses.scan_licenses(licenses.as_files(d.withColumn("lang", F.lit("en")))), lambda d: packing.pack(d, queries.tokenizer_path())):
        assert len(f(df).collect()) >= 8


def test_odd_vectors(spark):
    v = [float(i % 3 - 1) for i in range(64)]
    df = spark.createDataFrame([(100, v), (100, v), (1, v), (2, None), (None, v), (3, v[:5]), (4, [None, *v[1:]])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in hamming.top_k(df).select("query_id", "vec_id", "distance").distinct().collect()]
    assert got == [(100, 1, 0)]
    assert hamming.top_k(df.limit(0)).count() == 0
