"""Toxicity: a learned lexicon, Levenshtein automata over its trie, context windows and a small linear model."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, map_rows, materialize

WORDS = re.compile(r"[^\W_]+(?:[0-9@$!*]+[^\W\d_]+)*")
# Quotation marks and reporting words that set a quoted word apart from abuse (fixed values).
QUOTES = "\"“”«»„‘’"
REPORTING = frozenset("said says wrote called quote quoted quotes term word slur dit écrit sagte schrieb dijo escribió".split())
WINDOW = 5
FEATURES = ("weight_sum", "weight_max", "hits", "density", "fuzzy_hits", "quoted_share", "kinds")


class Automaton:
    """A deterministic automaton, built as it is used: the Levenshtein automata of all lexicon terms, intersected with
    their trie. A state is a set of (trie node, edits so far); a term ending in * accepts whatever follows it."""

    def __init__(self, terms: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.deep: list[int] = [0]
        for term in sorted(terms):
            node = 0
            for c in term.rstrip("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                    self.stem.append(None)
                    self.deep.append(0)
                node = self.children[node][c]
            if term.endswith("*"):
                self.stem[node] = term
            else:
                self.word[node] = term
            at = 0
            for c in term.rstrip("*"):
                self.deep[at] = max(self.deep[at], len(term.rstrip("*")))
                at = self.children[at][c]
            self.deep[at] = max(self.deep[at], len(term.rstrip("*")))
        self.terms = terms
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple] = []
        self.start = self.add({(0, 0)}, ())

    def budget(self, n: int) -> int:
        """Edits allowed for a term of n characters."""
        return 0 if n < 5 else 1 if n < 9 else 2

    def add(self, pairs: set, passed: tuple) -> int:
        least: dict[int, int] = {}
        todo = list(pairs)
        while todo:  # a character of the term that is missing from the word
            node, k = todo.pop()
            if k > self.budget(self.deep[node]) or least.get(node, 99) <= k:
                continue
            least[node] = k
            todo += [(child, k + 1) for child in self.children[node].values()]
        key = frozenset(least.items()) | frozenset((("stem", *x) for x in passed))
        if key not in self.states:
            stems = dict(passed)
            for node, k in least.items():
                if (s := self.stem[node]) and k <= self.budget(len(s) - 1):
                    stems[s] = min(k, stems.get(s, 99))
            key2 = frozenset(least.items()) | frozenset(("stem", s, k) for s, k in stems.items())
            if key2 in self.states:
                self.states[key] = self.states[key2]
                return self.states[key2]
            i = len(self.sets)
            self.states[key] = self.states[key2] = i
            self.sets.append(frozenset(least.items()))
            self.moves.append({})
            done = {self.word[node]: k for node, k in least.items() if self.word[node] and k <= self.budget(len(self.word[node]))}
            self.accepts.append((tuple(sorted(stems.items())), {**stems, **done}))
        return self.states[key]

    def step(self, state: int, c: str) -> int:
        pairs = set()
        for node, k in self.sets[state]:
            pairs.add((node, k + 1))  # an extra character
            for x, child in self.children[node].items():
                pairs.add((child, k if x == c else k + 1))
        to = self.add(pairs, self.accepts[state][0])
        self.moves[state][c] = to
        return to

    def match(self, word: str) -> tuple[float, float, int] | None:
        """(weight, edits, 1 if exact) of the best term within reach of the word, or None."""
        state = self.start
        for c in word:
            to = self.moves[state].get(c)
            state = self.step(state, c) if to is None else to
            if not self.sets[state] and not self.accepts[state][0]:
                return None
        found = self.accepts[state][1]
        if not found:
            return None
        exact = max((self.terms[t] for t, k in found.items() if not k), default=None)
        if exact is not None:
            return exact, 0, 1
        return max(self.terms[t] / (1 + k) for t, k in found.items()), min(found.values()), 0


@dataclass
class Lexicon:
    terms: dict[str, float]
    most_words: int = 400_000
    automaton: Automaton | None = None
    memo: dict[str, tuple | None] = field(default_factory=dict)

    def match(self, word: str):
        try:
            return self.memo[word]
        except KeyError:
            if self.automaton is None or len(self.automaton.sets) > 50_000:
                self.automaton = Automaton(self.terms)
            if len(self.memo) >= self.most_words:  # only a store of results: nothing is lost
                self.memo.clear()
            out = self.memo[word] = self.automaton.match(word)
            return out

    def features(self, text: str) -> list[float]:
        low = text.lower()
        words = WORDS.findall(low)
        if not words:
            return [0.0] * len(FEATURES)
        hits = {w: m for w in set(words) if (m := self.match(w)) is not None}
        if not hits:
            return [0.0] * len(FEATURES)
        exact = {w: m for w, m in hits.items() if m[2]}
        n_exact = n_fuzzy = quoted = 0
        spans = [(m.group(), m.start(), m.end()) for m in WORDS.finditer(low)]
        for i, (w, a, b) in enumerate(spans):
            if w not in hits:
                continue
            if w in exact:
                n_exact += 1
                before, after = spans[max(0, i - WINDOW)][1], spans[min(len(spans) - 1, i + WINDOW)][2]
                left, right = low[before:a], low[b:after]
                marks = any(q in left for q in QUOTES) and any(q in right for q in QUOTES)
                quoted += marks or any(spans[j][0] in REPORTING for j in range(max(0, i - WINDOW), i))
            else:
                n_fuzzy += 1
        weights = [m[0] for m in exact.values()]
        return [math.log1p(sum(weights)), max(weights, default=0.0), math.log1p(n_exact), math.sqrt(n_exact / len(words)), math.log1p(n_fuzzy) * max((m[0] for m in hits.values() if not m[2]), default=0.0), quoted / n_exact if n_exact else 0.0, math.log1p(len(exact))]


def grams(text: str) -> set[str]:
    """The words of a text and their openings of 4 to 7 letters, marked *."""
    words = {w for w in WORDS.findall(text.lower()) if len(w) >= 3}
    return words | {w[:n] + "*" for w in words for n in range(4, 8) if len(w) > n}


@dataclass
class Model:
    terms: dict[str, float]
    mean: list[float]
    scale: list[float]
    weights: list[float]
    bias: float
    fitted: bool = True

    def score(self, features: list[float]) -> float:
        z = self.bias + sum(w * (x - m) / s for w, x, m, s in zip(self.weights, features, self.mean, self.scale, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def is_held_out(doc_id) -> object:
    """Remainder 2 of CRC32 of doc_id as text, mod 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    a = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(h, a.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = 12_000, most_terms: int = 1_000, least_docs: int = 4, least_g2: float = 24.0) -> Model:
    """Lexicon and linear model from labelled documents.

    The fit uses a bounded sample: the `fit_rows` labelled, not held out documents of the lowest MD5 of their id. Of
    these, the terms (words, openings of words) with the highest likelihood ratio statistic for toxic documents make
    the lexicon: at most `most_terms`, in at least `least_docs` different texts. Counts are added up on the executors;
    the driver gets the chosen terms and one feature row per sampled document. Every label counts once per different
    text; an id with labels of both kinds counts as toxic, and stands for all texts of that id. Without labels of both
    kinds nothing can be learnt: the model isn't fitted and scores 0.5 throughout."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~is_held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary"))).limit(fit_rows)
    # at most fit_rows rows of two numbers: a proven bound
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = materialize(sample.withColumn("same", F.xxhash64("text")), "tox-sample").dropDuplicates(["same", "toxic"])
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    p, n = totals.get(1, 0), totals.get(0, 0)
    if not p or not n:
        return Model({}, [0.0] * len(FEATURES), [1.0] * len(FEATURES), [0.0] * len(FEATURES), 0.0, fitted=False)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["gram", "pos", "neg"]
        counts: dict[str, list[int]] = {}

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([x[1] for x in counts.values()], pa.int64()), pa.array([x[0] for x in counts.values()], pa.int64())], names=names)

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for g in grams(text.as_py()):
                    counts.setdefault(g, [0, 0])[toxic] += 1
                if len(counts) > 500_000:
                    yield batch_of()
                    counts.clear()
        if counts:
            yield batch_of()

    sums = sample.select("text", "toxic").mapInArrow(count, "gram string, pos long, neg long").groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rate = (F.col("pos") / p) / ((F.col("neg") + 0.5) / n)
    share = p / (p + n)
    both = F.col("pos") + F.col("neg")
    g2 = 2 * (F.col("pos") * F.log(F.col("pos") / (both * share)) + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (both * (1 - share)))).otherwise(0.0))
    best = sums.where(F.col("pos") >= least_docs).withColumn("rate", rate).withColumn("g2", g2).where((F.col("rate") > 6) & (F.col("g2") > least_g2)).orderBy(F.desc("g2"), "gram").limit(most_terms)
    terms = {r["gram"]: math.log(r["rate"]) for r in best.collect()}

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lexicon = Lexicon(terms)
        for batch in batches:
            rows = [lexicon.features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = sample.select("text", "toxic").mapInArrow(measure, "toxic int, x array<double>").collect()
    order = sorted(rows, key=lambda r: (r["toxic"], r["x"]))
    mean, scale, w, b = fit_logistic(np.array([r["x"] for r in order]), np.array([float(r["toxic"]) for r in order]))
    return Model(terms, mean.tolist(), scale.tolist(), w.tolist(), b)


# Scores from here on are predicted toxic, by the operator and by the pipeline's stage alike.
DECISION = 0.3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def scored(docs: DataFrame, model: Model, keep: str | None = None, threshold: float = DECISION) -> DataFrame:
    """Scores of all documents, or the documents' own columns with the score added under the name `keep`."""

    def add(at: int, kept: list[int]):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            lexicon = Lexicon(model.terms)
            for batch in batches:
                score = pa.array([model.score(lexicon.features(t.as_py() or "")) for t in batch.column(at)], pa.float64())
                columns = [batch.column(k) for k in kept]
                yield pa.RecordBatch.from_arrays([*columns, score], names=[f"c{k}" for k in range(len(kept) + 1)])

        return run

    if keep:
        return map_rows(docs, add(docs.columns.index("text"), list(range(len(docs.columns)))), {keep: "double"})
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(add(1, [0]), "c0 long, c1 double").toDF("doc_id", "score")
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))


def score_toxicity(docs: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """doc_id, held_out, score, predicted for every document, from its whole text only.

    Null and empty texts have no hits and get the score of such texts; equal texts get equal scores; null ids are
    scored and count as not held out; very long texts are read to their end; other columns are ignored. Scoring is one
    scan without a shuffle."""
    return scored(docs, train(docs, labels, **fit))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = DECISION, **fit) -> DataFrame:
    """documents without those that score at least threshold; columns as they were.

    Without labels of both kinds there is no model to reject by, and every document stays. Null and empty texts are
    judged as texts without hits; repeated rows are judged alike and all kept or dropped; null ids are kept or dropped
    by their text; empty input gives no rows; a column named score stays as it was."""
    model = train(docs, labels, **fit)
    if not model.fitted:
        return docs
    (score,) = fresh(docs, "score")
    return scored(docs, model, keep=score).where(F.col(score) < threshold).drop(score)
