"""Quality classifier: heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, row_key, word_hashes

WORDS = re.compile(r"[^\W\d_]+")
SYMBOLS = re.compile(r"[*#$%&|@{}<>\\^~=+_!]")
BUCKETS = 2048
KINDS = 7


def votes(text: str) -> str:
    """One letter per labeller: g (good), b (bad) or - (no opinion)."""
    n = len(text)
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if x.strip()]
    if not words:
        return "b" * 8
    symbols = len(SYMBOLS.findall(text)) / n
    repeated = 1 - len(set(lines)) / max(1, len(lines))
    runs = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words) - 1)
    upper = sum(w.isupper() and len(w) > 1 for w in words) / len(words)
    top = Counter(words).most_common(1)[0][1] / len(words)
    mean = sum(map(len, words)) / len(words)
    short = sum(len(x) < 15 for x in lines) / max(1, len(lines))
    say = lambda bad, good: "b" if bad else "g" if good else "-"
    return "".join((
        say(symbols > 0.04, symbols < 0.01),
        say(repeated > 0.25 and len(lines) > 3, repeated < 0.05 and len(lines) > 3),
        say(runs > 0.10, runs < 0.03),
        say(upper > 0.30, upper < 0.05),
        say(top > 0.25 and len(words) > 20, top < 0.10 and len(words) > 20),
        say(mean > 14 or mean < 2, 3 <= mean <= 9),
        say(len(words) < 8, len(words) > 60),
        say(short > 0.6 and len(lines) > 5, short < 0.2),
    ))


_KIND = np.full(256, 6, dtype=np.int64)
_KIND[33:127] = 5
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[0x20, 0x09]] = 3
_KIND[[0x0A, 0x0D, 0x0B, 0x0C]] = 4
SIZE = BUCKETS + KINDS**3


def hashed(words: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed words, and of runs of three kinds of byte."""
    out = np.zeros(SIZE, dtype=np.float32)
    if len(words):
        out[:BUCKETS] = np.sqrt(np.bincount((words >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1), minlength=BUCKETS) / len(words))
    if len(raw) > 2:
        total = np.zeros(KINDS**3)
        for at in range(0, len(raw), 1 << 20):
            k = _KIND[raw[at : at + (1 << 20) + 2]]
            if len(k) > 2:
                total += np.bincount(k[:-2] * KINDS * KINDS + k[1:-1] * KINDS + k[2:], minlength=KINDS**3)
        out[BUCKETS:] = np.sqrt(total / total.sum())
    return out


def estimate(patterns: list[str], counts: list[int], rounds: int = 100, prior: float = 0.8) -> tuple[dict[str, float], list[dict[str, float]]]:
    """Posterior of "good" for each pattern of votes and each labeller's accuracies, by expectation-maximisation over
    how often each pattern occurs; labellers are taken as independent given the true class."""
    if not patterns:
        return {}, []
    n = len(patterns[0])
    x = np.array([["bg-".index(c) for c in p] for p in patterns]).reshape(-1, n)
    c = np.array(counts, dtype=float)
    q = np.array([(1 + p.count("g")) / (2 + p.count("g") + 2 * p.count("b")) for p in patterns])
    table = np.zeros((2, n, 3))
    for _ in range(rounds):
        for k, w in enumerate((c * (1 - q), c * q)):
            for j in range(n):
                table[k, j] = np.bincount(x[:, j], weights=w, minlength=3) + 1.0
                table[k, j] /= table[k, j].sum()
        prior = float((c * q).sum() + 1) / (c.sum() + 2)
        log = [np.log(table[k])[np.arange(n)[None, :], x].sum(1) for k in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1] + np.log((1 - prior) / prior), -30, 30)))
        if np.abs(new - q).max() < 1e-6:
            q = new
            break
        q = new
    stats = [{"good_given_good": float(table[1, j, 1]), "bad_given_bad": float(table[0, j, 0]), "silent": float((c[:, None] * (x == 2)).sum(0)[j] / max(1.0, c.sum()))} for j in range(n)]
    return {p: float(v) for p, v in zip(patterns, q, strict=True)}, stats


@dataclass
class Model:
    posterior: dict[str, float]
    accuracies: list[dict[str, float]]
    weights: np.ndarray
    bias: float


def fit_linear(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 4.0, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full gradient with momentum."""
    w, b = np.zeros(x.shape[1], dtype=np.float32), 0.0
    vw, vb = np.zeros_like(w), 0.0
    for _ in range(rounds):
        g = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) / max(1, len(y))
        vw = 0.9 * vw - rate * (x.T @ g + ridge * w)
        vb = 0.9 * vb - rate * float(g.sum())
        w, b = w + vw, b + vb
    return w.astype(np.float32), float(b)


def train(docs: DataFrame, fit_rows: int = 3_000) -> Model:
    """Accuracies from how often each pattern of votes occurs over all documents (at most 3^8 patterns); the linear
    scorer from a bounded sample: the `fit_rows` documents of the lowest MD5 of their id (each different text of an id
    is a document of its own)."""
    base = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))

    def vote(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            count = Counter(votes(t.as_py()) for t in batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["pattern", "n"])

    found = base.select("text").mapInArrow(vote, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    posterior, accuracies = estimate([r["pattern"] for r in found], [r["n"] for r in found])

    def features(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            column = batch.column(0)
            x = [hashed(w, np.frombuffer(column[k].as_buffer(), np.uint8)).tobytes() for k, w in word_hashes(column)]
            y = [posterior[votes(t.as_py())] for t in column]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.float64())], names=["x", "y"])

    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    own = base.select("doc_id", F.xxhash64("text").alias("same"), row_key().alias("row"), "text")
    ids = own.select("doc_id", "same", "row").distinct().orderBy(order, "row", "same").limit(fit_rows).select("row", "same")
    # at most fit_rows pairs of numbers: a proven bound
    sample = own.join(F.broadcast(ids), ["row", "same"]).dropDuplicates(["row", "same"]).select("text")
    rows = sorted((bytes(r["x"]), r["y"]) for r in sample.mapInArrow(features, "x binary, y double").collect())
    x = np.frombuffer(b"".join(r[0] for r in rows), np.float32).reshape(-1, SIZE)
    w, b = fit_linear(x, np.array([r[1] for r in rows], dtype=np.float32)) if len(rows) else (np.zeros(SIZE, np.float32), 0.0)
    return Model(posterior, accuracies, w, b)


SCHEMA = "doc_id long, votes string, weak_label double, score double, predicted int"


def score_quality(docs: DataFrame, fit_rows: int = 3_000) -> DataFrame:
    """doc_id, votes, weak_label (posterior of the label model), score (linear scorer), predicted (1: good).

    Every document's whole text is voted on and scored; training see train(). No quality labels are used. Texts without
    words (null, empty) get eight bad votes; equal texts get equal results, null ids stay null; empty input gives no
    rows; very long texts are voted on and scored as a whole; other columns are dropped. Two scans and a bounded sample;
    no shuffle but of vote counts and the sample's ids."""
    model = train(docs, fit_rows)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            column = batch.column(1)
            score = [float(1 / (1 + np.exp(-(float(hashed(w, np.frombuffer(column[k].as_buffer(), np.uint8)) @ model.weights) + model.bias)))) for k, w in word_hashes(column)]
            said = [votes(t.as_py()) for t in column]
            weak = [model.posterior.get(v, 0.5) for v in said]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), pa.array(weak, pa.float64()), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, SCHEMA)
