"""Removal of long strings that repeat anywhere in a corpus, by depth-limited radix passes over suffixes; count of words in
passages that other texts hold as well, by the same passes over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, mix, powers, word_hashes, _BYTE, _INV, _ODD

GRAM, WORD_GRAM = 64, 12
BLOCK = 1 << 19


def _prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and inverse powers from which the hash of any stretch follows: (sum[b] - sum[a]) * down[a]."""
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _tables(n)[0][:n], out=total[1:])
    return total, _tables(n)[1]


_KEPT: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    if not _KEPT or len(_KEPT[0]) <= n:
        _KEPT[:] = [powers(_ODD, n + BLOCK), powers(_INV, n + BLOCK)]
    return _KEPT


def _anchors(grams: np.ndarray, wide: int, starts: int) -> np.ndarray:
    """For each of the first `starts` places the place of the least of `wide` grams from there on (leftmost if equal)."""
    packed = (grams & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(grams), dtype=np.uint64)
    grid = np.concatenate([packed, np.full(-len(packed) % wide, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, wide)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[:starts], ahead[wide - 1 : wide - 1 + starts]) & np.uint64(0xFFFFF)).astype(np.int64)


def runs(data: np.ndarray, depth: int) -> Iterator[tuple]:
    """For the windows of `depth` bytes that start in one block after the other: (start of the block, its sums and inverse
    powers), first start, last start, start and end of the digit, and the digit of each run of windows.

    The anchor of a window is its 64-byte stretch of least hash (leftmost if equal), so equal windows have it at the
    same offset. The windows of an anchor fall in two: those with more of their bytes behind the anchor share the
    digit of the bytes from it on, the others the digit of the bytes up to its end. Digits are even (see passages)."""
    n, wide = len(data), depth - GRAM + 1
    half = wide // 2
    for at in range(0, n - depth + 1, BLOCK):
        piece = data[at : at + BLOCK + depth - 1]
        m = len(piece)
        total, down = _prefix(piece)
        grams = mix((total[GRAM:] - total[:-GRAM]) * down[: m - GRAM + 1])
        starts = m - depth + 1
        anchor = _anchors(grams, wide, starts)
        near = (anchor - np.arange(starts)) <= half
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (near[1:] != near[:-1])]))
        last = np.concatenate([first[1:] - 1, [starts - 1]])
        a, right = anchor[first], near[first]
        lo = np.where(right, a, a - half)
        hi = np.where(right, a + depth - half, a + GRAM)
        digit = mix((total[hi] - total[lo]) * down[lo] + right.astype(np.uint64)) & ~np.uint64(1)
        yield (at, total, down), first + at, last + at, lo + at, hi + at, digit


def quarters(block: tuple, first: np.ndarray, last: np.ndarray, lo: np.ndarray, hi: np.ndarray, digit: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """The next digit of runs: (first start, last start, digit) of up to four parts of each run.

    A window has x bytes ahead of its run's digit and the rest behind it. The part with x from q k to q (k + 1) - 1 shares
    q k more bytes ahead and rest - q (k + 1) + 1 more behind; equal windows have the same x, so they fall in equal parts."""
    at, total, down = block
    rest = depth - (hi - lo)
    q = rest // 4 + 1
    out = []
    for k in range(4):
        s0, s1 = np.maximum(first, lo - q * (k + 1) + 1), np.minimum(last, lo - q * k)
        some = s0 <= s1
        a, b = (lo - q * k)[some] - at, (hi + np.maximum(0, rest - q * (k + 1) + 1))[some] - at
        out.append((s0[some], s1[some], mix(((total[b] - total[a]) * down[a]) ^ mix(digit[some] + np.uint64(k)))))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def windows(data: np.ndarray, depth: int) -> np.ndarray:
    """Two hashes of each window of data, as rows of (64 bits, 64 bits)."""
    total, down = _prefix(data)
    n = len(data) - depth + 1
    one = (total[depth:] - total[:-depth]) * down[:n]
    other = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(mix(_BYTE[data]) * down[: len(data)], out=other[1:])
    two = (other[depth:] - other[:-depth]) * _tables(n)[0][:n]
    return np.stack([mix(one), two], axis=1)


def passages(words: np.ndarray, width: int) -> Iterator[tuple]:
    """For the windows of `width` word hashes that start in one block after the other: (start of the block, its sums and inverse
    powers), and first start, last start, anchor (in the block) and digit of each run of windows. The digit is that of the
    anchor, a window's stretch of WORD_GRAM words of least hash, and odd, so that it can't be one of bytes."""
    gram = min(WORD_GRAM, width)
    for at in range(0, len(words) - width + 1, BLOCK):
        piece = words[at : at + BLOCK + width - 1]
        m = len(piece)
        up, down = _tables(m)
        total = np.zeros(m + 1, dtype=np.uint64)
        np.cumsum(piece * up[:m], out=total[1:])
        grams = mix((total[gram:] - total[:-gram]) * down[: m - gram + 1])
        starts = m - width + 1
        anchor = _anchors(grams, width - gram + 1, starts)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.concatenate([first[1:] - 1, [starts - 1]])
        yield (at, total, down), first, last, anchor[first], (mix(grams[anchor[first]]) | np.uint64(1)).view(np.int64)


def wanted_passages(words: np.ndarray, wanted: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Digit, hash, start and part of each window in runs of the wanted digits. The part is the next digit, of all that the
    windows share whose anchor is about as far in (see quarters)."""
    gram = min(WORD_GRAM, width)
    rest = width - gram
    q = rest // 4 + 1
    out = [(np.zeros(0, np.int64),) * 4]
    for (at, total, down), first, last, anchor, digit in passages(words, width):
        i = np.flatnonzero(np.isin(digit, wanted))
        n = last[i] - first[i] + 1
        s = np.repeat(first[i] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        a, d = np.repeat(anchor[i], n), np.repeat(digit[i], n)
        k = (a - s) // q
        lo, hi = a - q * k, a + gram + np.maximum(0, rest - q * (k + 1) + 1)
        part = mix(((total[hi] - total[lo]) * down[lo]) ^ mix((d + k).view(np.uint64)))
        out.append((d, mix((total[s + width] - total[s]) * down[s]).view(np.int64), s + at, part.view(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def passage_windows(digit: np.ndarray, h: np.ndarray, s: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Of windows: digit, hash, start, length and whether a row is its window's first, by digit and start. What a window that
    recurs in the text covers without a gap is one row."""
    order = np.lexsort((s, h, digit))
    digit, h, s = digit[order], h[order], s[order]
    other = np.ones(len(s), dtype=bool)
    other[1:] = (digit[1:] != digit[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(other | (np.diff(s, prepend=s[:1]) > width))
    last = np.concatenate([first[1:], [len(s)]])[: len(first)] - 1
    out = digit[first], h[first], s[first], s[last] - s[first] + width, other[first]
    order = np.lexsort((out[2], out[0]))
    return tuple(c[order] for c in out)


def _text(column):
    """The binary column as strings; bytes that aren't UTF-8 stay as they are."""
    import pyarrow as pa

    kind = pa.large_string() if pa.types.is_large_binary(column.type) else pa.string()
    return pa.Array.from_buffers(kind, len(column), column.buffers(), offset=column.offset)


def _flat(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values packed in a binary column, and how many each row has."""
    import pyarrow as pa

    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind), np.diff(offsets).astype(np.int64) // np.dtype(kind).itemsize


def _packed(values: np.ndarray, bounds: np.ndarray):
    import pyarrow as pa

    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def passage_spans(held: DataFrame, width: int, group_windows: int) -> DataFrame:
    """(uid, s, e) in words of what windows of `width` words that other texts hold too cover; held: (uid, body, passages,
    hot_passages) with a text's digits that occur more than once.

    A window is told by its digit and another 64-bit hash. Windows meet by digit. Of hot digits the parts that one text alone
    has drop out; windows of the others meet only in counts and in a semi-join that can be split, once a text."""

    def packed_windows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(batch, kept):
            digit, h, s, n = (np.concatenate(c) for c in zip(*(x[1:5] for x in kept), strict=True))
            text = np.repeat([x[0] for x in kept], [len(x[1]) for x in kept])
            first = np.flatnonzero(np.concatenate([[True], (digit[1:] != digit[:-1]) | (text[1:] != text[:-1])]))
            bounds = np.append(first, len(digit))
            cols = [pa.array(digit[first]), batch.column(0).take(pa.array(text[first])), _packed(h, bounds), _packed(s.astype(np.int32), bounds), _packed(n.astype(np.int32), bounds)]
            return pa.RecordBatch.from_arrays(cols, names=["digit", "uid", "h", "s", "n"])

        for batch in batches:
            kept, size = [], 0
            for k, words in word_hashes(_text(batch.column(1))):
                found = passage_windows(*wanted_passages(words, np.asarray(batch.column(2)[k].values, dtype=np.int64), width)[:3], width)
                if len(found[0]):
                    kept.append((k, *found))
                    size += len(found[0])
                if size >= group_windows:
                    yield rows(batch, kept)
                    kept, size = [], 0
            if kept:
                yield rows(batch, kept)

    def met(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def resolve(digit, uid, counts, h, s, n):
            row = np.repeat(np.arange(len(digit)), counts)
            order = np.lexsort((h, digit[row]))
            a, b, r = digit[row][order], h[order], row[order]
            start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            several = np.minimum.reduceat(r, start) != np.maximum.reduceat(r, start)
            hit = np.zeros(len(row), dtype=bool)
            hit[order] = np.repeat(several, np.diff(np.append(start, len(row))))
            k = np.flatnonzero(hit)
            r, s, e = row[k], s[k].astype(np.int64), s[k].astype(np.int64) + n[k]
            cut = np.ones(len(k), dtype=bool)
            cut[1:] = (r[1:] != r[:-1]) | (s[1:] > e[:-1])
            first = np.flatnonzero(cut)
            ends = np.maximum.reduceat(e, first) if len(first) else e
            return pa.RecordBatch.from_arrays([uid.take(pa.array(r[first])), pa.array(s[first]), pa.array(ends)], names=["uid", "s", "e"])

        pool: list[tuple] = []
        size = 0

        def pooled():
            uid = pa.concat_arrays([x[1] for x in pool])
            digit, counts, h, s, n = (np.concatenate([x[i] for x in pool]) for i in (0, 2, 3, 4, 5))
            return digit, uid, counts, h, s, n

        for batch in batches:
            if not batch.num_rows:
                continue
            h, counts = _flat(batch.column(2), np.int64)
            pool.append((np.asarray(batch.column(0)), batch.column(1), counts, h, _flat(batch.column(3), np.int32)[0], _flat(batch.column(4), np.int32)[0]))
            size += len(h)
            if size >= group_windows:
                digit, uid, counts, h, s, n = pooled()
                k = int(np.flatnonzero(digit != digit[-1])[-1]) + 1 if digit[0] != digit[-1] else 0
                at = int(counts[:k].sum())
                if k:
                    yield resolve(digit[:k], uid[:k], counts[:k], h[:at], s[:at], n[:at])
                pool = [(digit[k:], uid[k:], counts[k:], h[at:], s[at:], n[at:])]
                size = len(h) - at
        if pool:
            yield resolve(*pooled())

    def parts_of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k, words in word_hashes(_text(batch.column(1))):
                part = np.unique(wanted_passages(words, np.asarray(batch.column(2)[k].values, dtype=np.int64), width)[3])
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[k], len(part)), pa.array(part)], names=["uid", "part"])

    def single_windows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k, words in word_hashes(_text(batch.column(1))):
                *found, part = wanted_passages(words, np.asarray(batch.column(2)[k].values, dtype=np.int64), width)
                keep = np.isin(part, np.asarray(batch.column(3)[k].values, dtype=np.int64))
                digit, h, s, n, lead = passage_windows(*(c[keep] for c in found), width)
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[k], len(digit)), *map(pa.array, (digit, h, s, s + n, lead))], names=["uid", "digit", "h", "s", "e", "lead"])

    common = held.where(F.size("passages") > 0).select("uid", "body", "passages").mapInArrow(packed_windows, "digit long, uid binary, h binary, s binary, n binary")
    spans = common.repartition("digit").sortWithinPartitions("digit").mapInArrow(met, "uid binary, s long, e long")
    hot = held.where(F.size("hot_passages") > 0).select("uid", "body", "hot_passages")
    if hot.limit(1).count():
        parts = materialize(hot.mapInArrow(parts_of, "uid binary, part long"), "rep-passage-parts")
        again = parts.groupBy("part").count().where("count > 1").select("part")
        left = parts.join(again, "part", "left_semi").groupBy("uid").agg(F.collect_list("part").alias("parts"))
        found = materialize(hot.join(left, "uid").select("uid", "body", "hot_passages", "parts").mapInArrow(single_windows, "uid binary, digit long, h long, s long, e long, lead boolean"), "rep-passages")
        several = found.where("lead").groupBy("digit", "h").count().where("count > 1").select("digit", "h")
        spans = spans.unionByName(found.join(several, ["digit", "h"], "left_semi").select("uid", "s", "e"))
    return spans


def _bytes(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=np.uint8) if value.is_valid else np.zeros(0, np.uint8)


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def hot_windows(hot: DataFrame, depth: int) -> DataFrame:
    """(uid, s, e) of the windows that repeat among the runs of hot digits; hot: (uid, body, hot) with a text's hot digits.

    The runs are told apart by their next digit, counted before any shuffle, so parts that occur once drop out; of the
    parts left every window is counted by all its bytes (128-bit hashes), once a text. Rows of one window meet only in
    counts and in a semi-join that can be split, never as one task's group."""

    def wanted(body, digits) -> Iterator[tuple]:
        data, digits = _bytes(body), np.asarray(digits.values, dtype=np.int64)
        for block, first, last, lo, hi, digit in runs(data, depth):
            i = np.flatnonzero(np.isin(digit.view(np.int64), digits))
            if len(i):
                yield data, block, *quarters(block, first[i], last[i], lo[i], hi[i], digit[i], depth)

    def next_digits(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for uid, body, digits in zip(*batch.columns, strict=True):
                found = [d for *_, d in wanted(body, digits)]
                values, times = np.unique(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.repeat(uid, len(values)), pa.array(values), pa.array(np.minimum(times, 2))], names=["uid", "part", "times"])

    def part_windows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for uid, body, digits, parts in zip(*batch.columns, strict=True):
                keep = np.asarray(parts.values, dtype=np.int64)
                for data, (at, *_), s0, s1, part in wanted(body, digits):
                    i = np.flatnonzero(np.isin(part.view(np.int64), keep))
                    if not len(i):
                        continue
                    n = s1[i] - s0[i] + 1
                    starts = np.repeat(s0[i] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    h = np.ascontiguousarray(windows(data[at : at + BLOCK + depth - 1], depth)[starts - at])
                    _, one, which, times = np.unique(h.view("V16").ravel(), return_index=True, return_inverse=True, return_counts=True)
                    known = _merged([(int(x), int(x) + depth) for x in starts[times[which] > 1]])
                    ends = np.concatenate([starts[one] + depth, [e for _, e in known]]).astype(np.int64)
                    begins = np.concatenate([starts[one], [b for b, _ in known]]).astype(np.int64)
                    count = np.concatenate([times, np.zeros(len(known))]).astype(np.int64)
                    pad = np.zeros((len(known), 2), np.uint64)
                    both = np.concatenate([h[one], pad]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.repeat(uid, len(count)), *map(pa.array, (begins, ends, count, both[:, 0].copy(), both[:, 1].copy()))], names=["uid", "s", "e", "times", "h1", "h2"])

    parts = materialize(hot.mapInArrow(next_digits, "uid binary, part long, times long"), "rep-parts")
    again = parts.groupBy("part").agg(F.sum("times").alias("n")).where("n > 1").select("part")
    left = parts.join(again, "part", "left_semi").groupBy("uid").agg(F.collect_list("part").alias("parts"))
    found = materialize(hot.join(left, "uid").select("uid", "body", "hot", "parts").mapInArrow(part_windows, "uid binary, s long, e long, times long, h1 long, h2 long"), "rep-windows")
    single = found.where("times > 0")
    twice = single.groupBy("h1", "h2").agg(F.sum("times").alias("n")).where("n > 1").select("h1", "h2")
    # What repeats inside its own text is known already (times = 0).
    return single.where("times = 1").join(twice, ["h1", "h2"], "left_semi").select("uid", "s", "e").unionByName(found.where("times = 0").select("uid", "s", "e"))


def strip_repeats(docs: DataFrame, depth: int = 400, group_windows: int = 400_000, hot_runs: int = 1_000, passage: int = 51) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_words for every document.

    Suffixes are told apart by most significant digits and only `depth` bytes deep. The first pass takes suffixes at
    anchors alone (content-chosen, every window has exactly one) with a digit of 232 bytes; groups of one drop out.
    The second pass orders the windows of the groups that are left by all their bytes; equal windows are the repeats.
    Every window takes part in exactly one group and equal windows in the same, so this is the full radix order's
    result. Windows are compared by 128-bit hashes. The groups of digits with over `hot_runs` runs, in many texts or
    in one, which could each fill a task, are ordered by their next digit and then by counts (see hot_windows), with the same result.

    Copies of a whole text are counted first and one of them goes on; all of a copied text of `depth` bytes or more is
    removed.

    n_shared_words counts the words that lie in a run of `passage` words or more (over 50) which another row holds as well,
    in whatever white space and however few bytes. Nothing is removed for it: a passage of under `depth` bytes stays.
    Its windows of words go through the same first pass as those of bytes, then see passage_spans.

    Null text counts as empty (0 bytes, SHA-256 of nothing); equal rows are copies; null ids stay null; texts
    shorter than depth keep every byte; empty input gives no rows; other columns are dropped."""
    least = min(depth, 2 * passage - 1)  # bytes of the shortest text that can count
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body"))

    def first_digits(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for doc, value, (_, words) in zip(batch.column(0).to_pylist(), batch.column(1), word_hashes(_text(batch.column(1))), strict=True):
                data = _bytes(value)
                parts = [d.view(np.int64) for *_, d in runs(data, depth)] + [d for *_, d in passages(words, passage)]
                digits, times = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)
                row = (doc, hashlib.sha256(data).hexdigest(), hashlib.blake2b(data, digest_size=16).digest(), len(data), digits[times == 1], digits[times > 1], times[times > 1], len(words))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "sha256", "uid", "n_bytes", "once", "often", "counts", "n_words"])

    rows = materialize(base.mapInArrow(first_digits, "doc_id long, sha256 string, uid binary, n_bytes long, once array<long>, often array<long>, counts array<long>, n_words long"), "rep-digits")
    texts = rows.groupBy("uid").agg(F.count(F.lit(1)).alias("copies"), F.max("n_bytes").alias("n_bytes"), F.max("n_words").alias("n_words"))
    single = rows.where(F.col("n_bytes") >= least).select("uid", "once", "often", "counts").dropDuplicates(["uid"])
    once = F.transform("once", lambda x: F.struct(x.alias("digit"), F.lit(1).cast("long").alias("times")))
    often = F.zip_with("often", "counts", lambda x, n: F.struct(x.alias("digit"), n.alias("times")))
    single = single.select("uid", F.explode(F.concat(once, often)).alias("x")).select("uid", "x.*")
    single = materialize(single, "rep-single")
    again = single.groupBy("digit").agg(F.sum("times").alias("n")).where("n > 1").select("digit", (F.col("n") > hot_runs).alias("is_hot"))
    of = lambda hot, odd: F.collect_list(F.when((F.col("is_hot") == hot) & (F.col("digit").bitwiseAND(1) == odd), F.col("digit")))
    picked = single.join(again, "digit").groupBy("uid").agg(of(False, 0).alias("digits"), of(True, 0).alias("hot"), of(False, 1).alias("passages"), of(True, 1).alias("hot_passages"))

    def identify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            uid = pa.array([hashlib.blake2b(_bytes(v), digest_size=16).digest() for v in batch.column(0)], pa.binary())
            yield pa.RecordBatch.from_arrays([uid, batch.column(0)], names=["uid", "body"])

    bodies = base.where(F.octet_length("body") >= least).select("body").mapInArrow(identify, "uid binary, body binary").groupBy("uid").agg(F.first("body").alias("body"))
    held = materialize(bodies.join(picked, "uid"), "rep-bodies")

    def second_digits(batches: Iterator) -> Iterator:
        """Stretches of bytes by digit. Of equal stretches of a text one goes on; all of them repeat, so they are spans
        already (body null), as many rows as there are gaps between them."""
        import pyarrow as pa

        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for k in range(batch.num_rows):
                data = _bytes(batch.column(1)[k])
                uid, wanted = batch.column(0)[k].as_py(), np.asarray(batch.column(2)[k].values, dtype=np.int64)
                seen: dict[bytes, tuple[int, int]] = {}
                known: list[tuple[int, int]] = []
                rows = []
                for _, lo, hi, _, _, digit in runs(data, depth):
                    digit = digit.view(np.int64)
                    for i in np.flatnonzero(np.isin(digit, wanted)):
                        s, e = int(lo[i]), int(hi[i]) + depth
                        body = data[s:e].tobytes()
                        mine = hashlib.blake2b(body, digest_size=16).digest()
                        if mine in seen:
                            known += [(s, e), seen[mine]]
                            continue
                        seen[mine] = (s, e)
                        rows.append((int(digit[i]), uid, s, e, body))
                home = int.from_bytes(uid[:8], "little", signed=True)
                for row in rows + [(home, uid, s, e, None) for s, e in _merged(known)]:
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["digit", "uid", "lo", "hi", "body"])

    def equal_windows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held_rows: list[tuple] = []
        size, last = 0, None

        def resolve():
            hashes = np.concatenate([windows(np.frombuffer(b, np.uint8), depth) for *_, b in held_rows])
            counts = [len(b) - depth + 1 for *_, b in held_rows]
            order = np.lexsort((hashes[:, 1], hashes[:, 0]))
            same = (hashes[order[1:]] == hashes[order[:-1]]).all(axis=1)
            dup = np.zeros(len(hashes), dtype=bool)
            dup[order[1:][same]] = True
            dup[order[:-1][same]] = True
            cols: list[list] = [[], [], []]
            at = 0
            for (uid, lo, _), n in zip(held_rows, counts, strict=True):
                d = np.concatenate([[False], dup[at : at + n], [False]])
                at += n
                for s, e in zip(np.flatnonzero(d[1:] & ~d[:-1]), np.flatnonzero(d[:-1] & ~d[1:]), strict=True):
                    for c, v in zip(cols, (uid, lo + int(s), lo + int(e) - 1 + depth), strict=True):
                        c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.binary(), pa.int64(), pa.int64()], strict=True)], names=["uid", "s", "e"])

        for batch in batches:
            digits = batch.column(0).to_pylist()
            known = batch.filter(batch.column(4).is_null())
            yield pa.RecordBatch.from_arrays([known.column(1), known.column(2), known.column(3)], names=["uid", "s", "e"])
            for k, digit in enumerate(digits):
                if not batch.column(4)[k].is_valid:
                    continue
                if digit != last and size >= group_windows:
                    yield resolve()
                    held_rows, size = [], 0
                last = digit
                body = batch.column(4)[k].as_py()
                held_rows.append((batch.column(1)[k].as_py(), batch.column(2)[k].as_py(), body))
                size += len(body) - depth + 1
        if held_rows:
            yield resolve()

    stretches = held.where(F.size("digits") > 0).select("uid", "body", "digits").mapInArrow(second_digits, "digit long, uid binary, lo long, hi long, body binary")
    spans = stretches.repartition("digit").sortWithinPartitions("digit").mapInArrow(equal_windows, "uid binary, s long, e long")
    hot = held.where(F.size("hot") > 0).select("uid", "body", "hot")
    if hot.limit(1).count():
        spans = spans.unionByName(hot_windows(hot, depth))
    spans = spans.groupBy("uid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cols: list[list] = [[] for _ in range(4)]
            for k in range(batch.num_rows):
                data = _bytes(batch.column(1)[k])
                merged = _merged([(x["s"], x["e"]) for x in batch.column(2)[k].as_py()])
                digest, at = hashlib.sha256(), 0
                for s, e in [*merged, [len(data), len(data)]]:
                    digest.update(data[at:s])
                    at = e
                for c, v in zip(cols, (batch.column(0)[k].as_py(), sum(e - s for s, e in merged), len(merged), digest.hexdigest()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.binary(), pa.int64(), pa.int64(), pa.string()], strict=True)], names=["uid", "removed", "runs", "kept"])

    done = held.select("uid", "body").join(spans, "uid").mapInArrow(cut, "uid binary, removed long, runs long, kept string")
    words = passage_spans(held, passage, group_windows).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))
    none = F.lit(0).cast("long")
    grown = lambda a, x: F.struct((a["n"] + F.greatest(x["e"] - F.greatest(x["s"], a["end"]), none)).alias("n"), F.greatest(x["e"], a["end"]).alias("end"))
    words = words.select("uid", F.aggregate("spans", F.struct(none.alias("n"), none.alias("end")), grown, lambda a: a["n"]).alias("shared"))
    done = texts.join(done, "uid", "left").join(words, "uid", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= depth)
    shared = F.when((F.col("copies") > 1) & (F.col("n_words") >= passage), F.col("n_words")).otherwise(F.col("shared")).alias("shared")
    done = done.where(whole | F.col("removed").isNotNull() | shared.isNotNull()).select("uid", shared, F.when(whole, F.col("n_bytes")).otherwise(F.col("removed")).alias("removed"), F.when(whole, F.lit(1)).otherwise(F.col("runs")).cast("long").alias("runs"), F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept")).alias("kept"))
    out = rows.select("doc_id", "sha256", "uid", "n_bytes").join(materialize(done, "rep-done"), "uid", "left")
    return out.select("doc_id", "n_bytes", F.coalesce("removed", F.lit(0)).alias("n_removed"), F.coalesce("runs", F.lit(0)).alias("n_spans"), F.coalesce("kept", "sha256").alias("kept_sha256"), F.coalesce("shared", F.lit(0)).alias("n_shared_words"))
