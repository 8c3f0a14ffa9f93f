"""Token counts: pre-tokens that are proven to be one token are counted as they stand, only the others are merged."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_direct long"
# Beyond these code points no published Unicode version has a letter, a number or a space.
ASSIGNED = 0x40000
PIECES = 1 << 16
KEPT, KEPT_LENGTH = 1 << 19, 32


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet, by its published rule: printable bytes stand for themselves, the rest follow from 256."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(kept)))}


@dataclass(frozen=True)
class Proof:
    """What is known of a tokenizer before any text is read: `whole`, the strings that it encodes as exactly one token;
    `strange`, a character class of the code points that its splitting rule and the pattern's put in different classes;
    the pattern, and the one to use for texts with strange code points; the strings of its added tokens."""

    path: str
    whole: frozenset[str]
    pattern: str
    strange: str
    exact: str
    added: tuple[str, ...]


def _ranges(points: Iterable[int]) -> str:
    spans: list[list[int]] = []
    for c in sorted(points):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


def _classes(split) -> tuple[dict[str, set[int]], dict[str, set[int]]]:
    """Code points below ASSIGNED by class (letter, number, space, other): by the pattern's rules, and by split's."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, ASSIGNED)]))
    own = {k: "".join(regex.findall(p, every)) for k, p in (("letter", r"\p{L}+"), ("number", r"\p{N}+"), ("space", r"\s+"), ("other", r"[^\s\p{L}\p{N}]+"))}
    shown = {"letter": "a", "number": "1", "other": "!"}
    theirs: dict[str, set[int]] = {k: set() for k in own}
    for kind, chars in own.items():
        # Letters in a row are one piece; where the tokenizer thinks otherwise, the row falls apart into runs of one class.
        for a, b in split(chars):
            run = chars[a:b]
            order = sorted(shown, key=lambda k: k != kind)
            theirs[next((k for k in order if len(split(shown[k] + run)) == 1), "space")].update(map(ord, run))
    return {k: set(map(ord, v)) for k, v in own.items()}, theirs


@lru_cache(maxsize=4)
def prove(path: str) -> Proof:
    """The proof for a byte-level BPE tokenizer file (JSON) without normalizer, prefix space, truncation or padding; other
    files are an error. Every vocabulary string is given to the tokenizer alone; it is whole if it comes back as its own
    id and nothing else. A merge never looks beyond its pre-token, so a whole string is one token wherever it is a
    pre-token of its own. Bounded by the vocabulary and the code points; it runs on the driver, once for each file."""
    import public_tokenizers
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    pre = file.get("pre_tokenizer") or {}
    plain = file["model"].get("type") == "BPE" and not any(file.get(k) for k in ("normalizer", "truncation", "padding", "post_processor"))
    if not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"not a plain byte-level BPE file: {path}")
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in file["added_tokens"]):
        raise ValueError(f"added tokens that take in what stands around them: {path}")
    tokenizer = Tokenizer.from_file(path)
    added = tuple(x["content"] for x in file["added_tokens"])
    letter_of = {v: k for k, v in byte_letters().items()}
    known: dict[str, int] = {}
    for token, i in file["model"]["vocab"].items():
        try:
            known[bytes(letter_of[c] for c in token).decode()] = i
        except UnicodeDecodeError:
            continue  # part of a character: never a pre-token
    strings = list(known)
    whole = frozenset(s for s, e in zip(strings, tokenizer.encode_batch(strings, add_special_tokens=False), strict=True) if e.ids == [known[s]])
    ours, theirs = _classes(lambda s: [at for _, at in tokenizer.pre_tokenizer.pre_tokenize_str(s)])
    odd = {c for k in ours for c in ours[k] ^ theirs[k]}
    parts = {k: f"[[{c}]--[{_ranges(ours[k] - theirs[k])}]]" if ours[k] - theirs[k] else f"[{c}]" for k, c in (("letter", r"\p{L}"), ("number", r"\p{N}"), ("space", r"\s"))}
    more = {k: f"[{parts[k]}||[{_ranges(theirs[k] - ours[k])}]]" if theirs[k] - ours[k] else parts[k] for k in parts}
    a, n, s = more["letter"], more["number"], more["space"]
    exact = rf"(?V1)'(?:[sdmt]|re|ve|ll)| ?{a}+| ?{n}+| ?[^{s}{a}{n}]+|{s}+(?![^{s}])|{s}+"
    return Proof(path, whole, public_tokenizers.PATTERN, f"[{_ranges(odd)}]" if odd else "", exact, added)


class Counter:
    """Counts the tokens of texts by a proof. Merges run in the tokenizer's own model; those of short pre-tokens are
    kept, up to a fixed number."""

    def __init__(self, proof: Proof):
        import regex
        from tokenizers import Tokenizer

        self.whole = proof.whole
        self.split, self.exact = regex.compile(proof.pattern), regex.compile(proof.exact)
        self.strange = re.compile(proof.strange) if proof.strange else None
        self.added = regex.compile("|".join(map(regex.escape, sorted(proof.added, key=len, reverse=True)))) if proof.added else None
        self.tokenizer = Tokenizer.from_file(proof.path)
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.kept: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        n = self.kept.get(piece)
        if n is None:
            n = len(self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))
            if len(piece) <= KEPT_LENGTH and len(self.kept) < KEPT:
                self.kept[piece] = n
        return n

    def count(self, text: str) -> tuple[int, int]:
        """(tokens, those counted directly) of a text. The strings of added tokens are a token each and part the text.
        Pre-tokens are taken PIECES at a time, so a very long text is never held as a list."""
        total = direct = 0
        sections = [text]
        if self.added and self.added.search(text):
            sections = self.added.split(text)
            total = len(sections) - 1
        for section in sections:
            rule = self.exact if self.strange and not section.isascii() and self.strange.search(section) else self.split
            found = (m[0] for m in rule.finditer(section)) if len(section) > PIECES * 4 else iter(rule.findall(section))
            while pieces := list(islice(found, PIECES)):
                rest = [p for p in pieces if p not in self.whole]
                direct += len(pieces) - len(rest)
                total += len(pieces) - len(rest) + sum(map(self.merged, rest))
        return total, direct


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) and n_direct (tokens counted without a merge) of
    every row of docs (doc_id, text), as Tokenizer.from_file(path).encode(text, add_special_tokens=False) counts them.

    A scan without a shuffle; the proof (some 50,000 strings, bounded by the vocabulary) is broadcast, and a lost task is
    simply run again. Null texts are empty: no bytes, no tokens. Equal rows are rows of their own; null ids stay null;
    very long texts are counted piece by piece; an empty table gives no rows; other columns are dropped."""
    proof = docs.sparkSession.sparkContext.broadcast(prove(tokenizer_path))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = Counter(proof.value)
        for batch in batches:
            texts = batch.column(2)
            counts = [counter.count(texts[k].as_py() or "") for k in range(batch.num_rows)]
            total = pa.array([n for n, _ in counts], pa.int64())
            over = pa.array([n > limit for n, _ in counts], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), total, over, pa.array([d for _, d in counts], pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_direct"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(run, SCHEMA)
