"""Cost-balanced packing of tokenised documents into fixed sequences."""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

END_ID = 1
LONG_GAP = 100_000
GAPS = re.compile(rf"(?<!\s)\s{{{LONG_GAP}}}")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded long, cost double"


def load_encoder(path: str):
    """An encoder for a byte-level BPE tokenizer file (JSON), as a function text -> ids, equal to
    Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids.

    The ranks and the splitting rule come from the file itself; the merges run in tiktoken, which gives the same ids
    about five times faster. Two kinds of text go to tokenizers itself: those with the string of one of the file's added
    tokens (<|endoftext|>), which stands for that token's id there, and those with a gap of over 100,000 white-space
    characters, where tiktoken's splitting rule runs out of stack."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, added = whole["model"], [x["content"] for x in whole["added_tokens"]]
    # Byte-level alphabet, by its published rule: printable bytes stand for themselves, the rest follow from 256.
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(kept))}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    fast = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    slow: list = []

    def encode(text: str) -> list[int]:
        if not any(x in text for x in added) and (len(text) <= LONG_GAP or not GAPS.search(text)):
            return fast(text)
        if not slow:
            slow.append(Tokenizer.from_file(path))
        return list(slow[0].encode(text, add_special_tokens=False).ids)

    return encode


def attention_cost(length, linear: float, quadratic: float):
    return linear * length + quadratic * length * length


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of whole-capacity pieces and one remainder."""
    return [(s, min(capacity, n - s)) for s in range(0, n, capacity)]


def assign(pieces: list[tuple[int, int, int]], capacity: int, linear: float, quadratic: float) -> list[list[tuple[int, int, int]]]:
    """Sequences of (doc, start, length). Full pieces stand alone. The others go, longest first, to the sequence of the
    lowest cost so far that still has room; the number of sequences is what the tokens need. A piece that fits nowhere
    whole is cut over the free room that is left, so all sequences but one fill up; that one is cut by powers of two."""
    full = [[p] for p in pieces if p[2] == capacity]
    rest = sorted((p for p in pieces if p[2] < capacity), key=lambda p: (-p[2], p[0], p[1]))
    total = sum(p[2] for p in rest)
    bins = [[] for _ in range(total // capacity)]
    room = [capacity] * len(bins)
    heap = [(0.0, i) for i in range(len(bins))]
    left = []
    for p in rest:
        passed = []
        while heap:
            cost, i = heapq.heappop(heap)
            if room[i] >= p[2]:
                bins[i].append(p)
                room[i] -= p[2]
                if room[i]:
                    heapq.heappush(heap, (cost + attention_cost(p[2], linear, quadratic), i))
                break
            passed.append((cost, i))
            if len(passed) > 64:
                heap_ok = next((j for j in range(len(heap)) if room[heap[j][1]] >= p[2]), None)
                if heap_ok is None:
                    left.append(p)
                    break
        else:
            left.append(p)
        for x in passed:
            heapq.heappush(heap, x)
    for i in sorted((i for i in range(len(bins)) if room[i]), key=lambda i: (-room[i], i)):
        while room[i] and left:
            d, s, n = left.pop()
            take = min(n, room[i])
            bins[i].append((d, s, take))
            room[i] -= take
            if n > take:
                left.append((d, s + take, n - take))
    spare = sum(p[2] for p in left)
    while spare:
        size = 1 << (spare.bit_length() - 1)
        if spare > capacity // 2 and spare - size > size // 2:
            size = capacity
        one, want = [], min(size, spare)
        while want:
            d, s, n = left.pop()
            take = min(n, want)
            one.append((d, s, take))
            want -= take
            spare -= take
            if n > take:
                left.append((d, s + take, n - take))
        bins.append(one)
    return full + [b for b in bins if b]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, linear: float = 1.0, quadratic: float = 1.0 / 2048, block_tokens: int = 1_000_000) -> DataFrame:
    """Pieces of all documents with the sequence and offset each lies at.

    A scan without a shuffle: every task tokenises its rows and packs them in blocks of about `block_tokens` (16-bit or
    32-bit ids are held for one block only), so memory doesn't grow with the input and a lost task is simply run again.
    Null text counts as empty and still has its end id; equal rows are packed as rows of their own; a null doc_id
    stays null; empty input gives no rows; very long texts are cut into pieces like any; other columns are dropped. Cost of a sequence: sum over pieces of linear*n + quadratic*n*n."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encode = load_encoder(tokenizer_path)
        held: list[tuple] = []
        tokens, made = 0, TaskContext.get().partitionId() << 36
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def flush():
            nonlocal held, tokens, made
            pieces = [(k, s, n) for k, (_, ids) in enumerate(held) for s, n in cut(len(ids), capacity)]
            cols: list[list] = [[] for _ in names]
            for one in assign(pieces, capacity, linear, quadratic):
                used = sum(p[2] for p in one)
                padded = used if used & (used - 1) == 0 else capacity
                cost = float(sum(attention_cost(p[2], linear, quadratic) for p in one))
                at = 0
                for k, s, n in one:
                    doc, ids = held[k]
                    for c, v in zip(cols, (doc, s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids), made, at, padded, cost), strict=True):
                        c.append(v)
                    at += n
                made += 1
            held, tokens = [], 0
            kinds = [pa.float64() if x == "cost" else pa.int64() for x in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            texts = batch.column(1)
            for k, doc in enumerate(batch.column(0).to_pylist()):
                ids = encode(texts[k].as_py() or "")
                ids.append(END_ID)
                held.append((doc, np.array(ids, dtype="<u4")))
                tokens += len(ids)
                if tokens >= block_tokens:
                    yield flush()
        if held:
            yield flush()

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, SCHEMA)
