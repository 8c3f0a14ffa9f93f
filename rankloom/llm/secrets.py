"""Secret scans that unwrap nested encodings until nothing new appears."""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import html
import lzma
import re
import unicodedata
import zlib
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import DataFrame

from .shared import map_rows

# Patterns of the base scan (fixed values); letters of the first stand for either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
LEAST_VALUE, LEAST_ACCESS = 6, 20

KEYWORD = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
# Possessive runs that begin at a run's first character: a long run is read once, not once from each of its characters.
PERCENT = re.compile(r"(?<![A-Za-z0-9._~+/=:&?-])(?:[A-Za-z0-9._~+/=:&?-]*+%[0-9A-Fa-f]{2})+[A-Za-z0-9._~+/=:&?-]*")
ESCAPES = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#\d{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
ONE_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|(&#[xX]?[0-9A-Fa-f]{1,7};)")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}+={0,2}")
# Lines of any width; what is joined must have 16 characters or more, as above.
SPACED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,}+(?:\r?\n(?!--)[A-Za-z0-9+/_-]{2,}+)+={0,2}")
# In no secret and no encoding: texts may be parted behind them.
APART = re.compile(r"""[^A-Za-z0-9_.=:&?~%\\#;"'\x20\r\n+/-]""")
STEP, LONGEST = 1 << 18, 1 << 26
PIECES = (re.compile(r"[^/]{16,}"), re.compile(r"[^/+_-]{16,}"))
# Secrets and encodings are all of these characters, and none is shorter.
LEGIBLE = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")
# The same in UTF-16 of either byte order.
WIDE = re.compile(rb"\x00?(?:[\t\n\r\x20-\x7e]\x00){11,}[\t\n\r\x20-\x7e]\x00?")
STANDARD = str.maketrans("-_", "+/", "\r\n=")
MAGIC = (b"\x1f\x8b", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda")
BZIP, XZ = re.compile(rb"BZh[1-9]1AY&SY"), b"\xfd7zXZ\x00"
ARCHIVE = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
XZ_MEMORY = 1 << 28
BROKEN = (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError)


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind; leftmost and non-overlapping within a kind."""
    out = []
    if KEYWORD.search(text):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted((s, e, KINDS[k]) for s, e, k in out) if len({k for *_, k in out}) < 2 else [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2], x[1]))]


def _plain(raw: bytes) -> str | None:
    """UTF-8 or UTF-16 that is mostly text; the legible parts of anything else are read apart."""
    kinds = ["utf-8"]
    if raw[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE):
        kinds = ["utf-16"]
    elif len(raw) % 2 == 0 and 2 * raw[1::2].count(0) > len(raw) // 2:
        kinds = ["utf-16-le"]
    elif len(raw) % 2 == 0 and 2 * raw[::2].count(0) > len(raw) // 2:
        kinds = ["utf-16-be"]
    for kind in kinds:
        try:
            text = raw.decode(kind)
        except UnicodeDecodeError:
            continue
        if 5 * sum(c.isprintable() or c.isspace() or unicodedata.category(c) == "Cf" for c in text) >= 4 * max(len(text), 1):
            return text
    return None


def _after_last(text: str) -> int:
    """The end of the last character at which a text may be parted; 0 if there is none."""
    for i in range(len(text), 0, -4096):
        found = [m.end() for m in APART.finditer(text, max(0, i - 4096), i)]
        if found:
            return found[-1]
    return 0


def _opened(raw: bytes):
    """A decompressor for what raw begins with (gzip, zlib, bzip2 or xz); None for anything else."""
    if raw.startswith(MAGIC):
        return zlib.decompressobj(47)
    if BZIP.match(raw):
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor(lzma.FORMAT_XZ, memlimit=XZ_MEMORY) if raw.startswith(XZ) else None


def _bare(raw: bytes) -> bool:
    """Whether raw is a deflate stream without a header. Nothing marks one, so it must begin with text, and if it is
    short, end where raw ends."""
    d = zlib.decompressobj(-15)
    try:
        head = d.decompress(raw, 4096)
    except zlib.error:
        return False
    ended = d.eof and not d.unused_data
    return len(head) >= 12 and (ended or len(head) == 4096) and _plain(head[: len(head) // 4 * 4] if not ended else head) is not None


def _inflate(raw: bytes, most: int, bare: bool = False) -> Iterator[str]:
    """Text of gzip, zlib, bzip2 or xz streams, one after another (or of one bare deflate stream), in pieces of about `most`
    bytes. A piece ends at a character that is in no secret and no encoding; where there is none in `most` characters, the
    next piece begins with its last half. What comes before a damaged place counts. UTF-16 in an archive is read as such."""
    decode, held, rest, cut = None, "", raw, 0
    while d := (zlib.decompressobj(-15) if bare and rest is raw else None if bare else _opened(rest)):
        try:
            while not d.eof:
                out = d.decompress(rest, STEP)
                rest = getattr(d, "unconsumed_tail", b"")
                if not out and not rest:
                    break
                if decode is None and out:
                    wide = out[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE) or 3 * out.count(0) > len(out)
                    order = "utf-16" if out[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE) else "utf-16-be" if out[:1] == b"\0" else "utf-16-le"
                    decode = codecs.getincrementaldecoder(order if wide else "utf-8")("replace").decode
                new = decode(out) if decode else ""
                last = _after_last(new)
                cut = len(held) + last if last else cut
                held += new
                if len(held) >= most:
                    if cut:
                        yield held[:cut]
                        held, cut = held[cut:], 0
                    elif len(held) >= LONGEST:
                        yield held
                        held = held[len(held) // 2 :]
        except BROKEN:
            break
        if bare:
            break
        rest = d.unused_data.lstrip(b"\0")
    held += decode(b"", True) if decode else ""
    if held:
        yield held


def _percent(s: str) -> str:
    return re.sub(r"(?:%[0-9A-Fa-f]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), s)


def _escape(s: str) -> str:
    def one(m):
        code = m[1] or m[2] or m[3]
        if code is None:
            return html.unescape(m[4])
        n = int(code, 16)
        return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else "�"

    return ONE_ESCAPE.sub(one, s)


def _bytes(s: str) -> bytes:
    """The whole groups of a stretch without padding, of either alphabet, and the rest of two or three characters."""
    s = s[:-1] if len(s) % 4 == 1 else s
    return base64.b64decode(s + "=" * (-len(s) % 4))


def _readings(s: str, most: int) -> Iterator[tuple[int, int, str | Iterator[str]]]:
    """(start, end, decoded) of what a base64 stretch holds: all of it as one text or archive, or else its pieces
    between separators that are one, and in every case the legible parts and archives at all four alignments."""
    body = s.translate(STANDARD)
    flat = len(body) == len(s.rstrip("="))
    at = (lambda i, j: (i, len(s) if j >= len(body) else j)) if flat else (lambda i, j: (0, len(s)))
    taken: list[tuple[int, int]] = []

    def whole(i: int, j: int) -> str | Iterator[str] | None:
        if (j - i) % 4 == 1:
            return None
        raw = _bytes(body[i:j])
        pieces = _inflate(raw, most)
        first = next(pieces, "")
        if first:
            return chain([first], pieces)
        text = _plain(raw)
        return _inflate(raw, most, True) if text is None and _bare(raw) else text

    found = whole(0, len(body))
    if found is not None:
        yield 0, len(s), found
        taken.append((0, len(body)))
    elif flat:
        for pattern in PIECES:
            for m in pattern.finditer(s, 0, len(body)):
                i, j = m.span()
                if (i, j) != (0, len(body)) and not any(x <= i and j <= y for x, y in taken) and (inner := whole(i, j)) is not None:
                    yield *at(i, j), inner
                    taken.append((i, j))
    for k in range(4):
        if len(body) - k < 16:
            break
        raw = _bytes(body[k:])
        done = [(x, y) for x, y in taken if x % 4 == k]
        parts = [(m.start(), m.end(), m[0].replace(b"\0", b"").decode("ascii")) for p in (LEGIBLE, WIDE) for m in p.finditer(raw)]
        for m in ARCHIVE.finditer(raw):
            if any(b <= k + m.start() * 4 // 3 < e for b, e in done):
                continue
            pieces = _inflate(raw[m.start() :], most)
            if first := next(pieces, ""):
                parts.append((m.start(), len(raw), chain([first], pieces)))
        for x, y, inner in parts:
            i, j = k + x // 3 * 4 + x % 3, min(k + -(-y * 4 // 3), len(body))
            if not any(b <= i and j <= e for b, e in done):
                yield *at(i, j), inner


def layers(text: str, most: int) -> Iterator[tuple[int, int, str | Iterator[str]]]:
    """(start, end, decoded) of the encoded stretches of one layer; archives as pieces, inflated when they are asked for."""
    if "%" in text:
        for m in PERCENT.finditer(text):
            yield m.start(), m.end(), _percent(m[0])
    if "\\" in text or "&#" in text:
        for m in ESCAPES.finditer(text):
            yield m.start(), m.end(), _escape(m[0])
    for pattern in (BASE64, SPACED):
        for m in pattern.finditer(text):
            for a, b, found in _readings(m[0], most):
                yield m.start() + a, m.start() + b, found


def _substitute(text: str) -> tuple[str, list[tuple[int, int, int, int]]] | None:
    """The layer with its percent and Unicode escapes undone in place, and (new start, new end, start, end) of each."""
    spans = [(m.start(), m.end(), _percent(m[0])) for m in PERCENT.finditer(text)] if "%" in text else []
    if "\\" in text or "&#" in text:
        ends = [b for _, b, _ in spans]
        at = lambda m: bisect_right(ends, m.start())  # noqa: E731  (the first percent stretch that could overlap)
        free = [m for m in ESCAPES.finditer(text) if at(m) == len(spans) or spans[at(m)][0] >= m.end()]
        spans = sorted(spans + [(m.start(), m.end(), _escape(m[0])) for m in free])
    if not spans:
        return None
    out, at, marks, size = [], 0, [], 0
    for a, b, new in spans:
        out.append(text[at:a])
        size += a - at
        marks.append((size, size + len(new), a, b))
        out.append(new)
        size += len(new)
        at = b
    out.append(text[at:])
    return "".join(out), marks


@dataclass(frozen=True)
class Way:
    """The way from a layer back to the text: through the marks of one substitution to the layer below, or, without
    marks, to one span of the text. Ways are followed in a loop, so nesting may be of any depth."""

    marks: list[tuple[int, int, int, int]] | None
    ends: list[int]
    below: Way | None
    span: tuple[int, int]

    def back(self, s: int, e: int) -> tuple[int, int]:
        way: Way | None = self
        while way is not None:
            if way.marks is None:
                return way.span
            marks, i, j = way.marks, bisect_right(way.ends, s), bisect_left(way.ends, e)
            shift = [marks[k - 1][3] - marks[k - 1][1] if k else 0 for k in (i, j)]
            inside = i < len(marks) and s >= marks[i][0], j < len(marks) and e > marks[j][0]
            s, e = marks[i][2] if inside[0] else s + shift[0], marks[j][3] if inside[1] else e + shift[1]
            way = way.below
        return s, e


def unwrap(text: str, most: int = 1 << 24) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans): the base scan of the text, and with it what every decoded layer holds.

    Work list of (layer, way back to the text). Each layer is scanned, its escapes are undone in place, and its base64
    or compressed stretches become layers of their own, until no layer is new; a layer seen before in this text with
    the same origin isn't taken again, which ends cycles. A span in a base64 or compressed layer maps to the whole
    stretch; in an escaped one to the characters it came from. Found spans that equal one already there add nothing."""
    base = scan(text)
    found = set(base)
    work: deque[tuple[str | Iterator[str], Way | None]] = deque()
    seen: set[tuple[bytes, int, int]] = set()

    def put(layer: str, way: Way | None, origin: tuple[int, int]):
        key = (hashlib.blake2b(layer.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *origin)
        if key not in seen:
            seen.add(key)
            work.append((layer, way))

    put(text, None, (0, len(text)))
    while work:
        layer, way = work.popleft()
        if not isinstance(layer, str):
            # One piece of an archive; the next one comes after what this one holds.
            piece = next(layer, None)
            if piece is not None:
                put(piece, way, way.span)
                work.append((layer, way))
            continue
        back = way.back if way else lambda s, e: (s, e)
        if way:
            found |= {(*back(s, e), kind) for s, e, kind in scan(layer)}
        changed = _substitute(layer)
        if changed and changed[0] != layer:
            put(changed[0], Way(changed[1], [b for _, b, *_ in changed[1]], way, (0, 0)), back(0, len(layer)))
        for a, b, inner in layers(layer, most):
            origin = back(a, b)
            if not isinstance(inner, str):
                work.append((inner, Way(None, [], None, origin)))
            elif inner and inner != layer[a:b]:
                put(inner, Way(None, [], None, origin), origin)
    rank = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(found, key=lambda x: (x[0], rank[x[2]], x[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long"


def find_secrets(docs: DataFrame) -> DataFrame:
    """Spans of secrets in every whole text, in code points; one row per document, in one scan without a shuffle.

    n_* and base_sha256 hold the base scan alone; spans has these and the ones that decoding adds. Null and empty texts
    have no spans (the SHA-256 of nothing); equal rows give equal results; a null doc_id stays null; other columns
    are dropped."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                base, spans = unwrap(text.as_py() or "")
                count = [sum(k == kind for *_, k in base) for kind in KINDS]
                for c, v in zip(cols, (doc, *count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)), strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """documents with each found span replaced by mask (overlapping spans count as one); all columns and rows are kept,
    n_chars (where there is one) is counted anew. Null texts stay null."""
    at, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                if text:
                    merged: list[list[int]] = []
                    for s, e, _ in unwrap(text)[1]:
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e])
                    ends = [0, *(e for _, e in merged)]
                    text = mask.join(text[a:b] for a, b in zip(ends, [*(s for s, _ in merged), len(text)], strict=True))
                out.append(text)
            batch = batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))
            if size is not None:
                batch = batch.set_column(size, batch.schema.field(size), pa.array([None if x is None else len(x) for x in out], batch.schema.field(size).type))
            yield batch

    return map_rows(docs, run)
