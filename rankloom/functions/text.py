"""Text functions of query rewriting, as Column expressions (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that results depend on.
QUESTION_WORDS = ("what", "when", "where", "which", "who", "whom", "whose", "why", "how", "can", "could", "would", "should", "please")
NEGATIONS = ("no", "not", "without", "except", "excluding", "exclude")
FUNCTION_WORDS = ("a", "an", "and", "are", "as", "at", "be", "been", "being", "between", "but", "by", "for", "from", "if", "in", "into", "is", "it", "its", "of", "on", "or", "that", "the", "their", "them", "then", "there", "these", "those", "to", "was", "were", "will", "with")
STOPWORDS = QUESTION_WORDS + FUNCTION_WORDS
PARTIAL_TAILS = ("a", "an", "and", "by", "for", "in", "of", "on", "or", "the", "to", "with")
SPACE = r"[\s\x1C-\x1F\x85\p{Z}]+"
EXPLANATION = r"(?i)\b(because|therefore|explanation|reasoning|step[- ]?by[- ]?step|user query|search query|rewritten query|i (?:think|believe)|let(?:'s| us))\b"
LABELS_BEFORE_COLON = ("query", "search query", "rewritten query", "explanation", "reasoning")
POLLUTION = r"(?i)(<think|thinking process|analysis:|assistant:|search query:|rewritten query:)"
NUMERIC = r"(?i)\b\d+(?:\.\d+)?(?:%|[a-z]+)?\b"
ACRONYM = r"\b[A-Z]{2,}\b"
UNREADABLE = r"""[^\s\x1C-\x1F\x85\p{Z}\p{L}\p{N}\-_.,:;!?()/\[\]'"]"""
MARKER_LINE = r"(?i)^(?:rewritten\s+query|search\s+query|better\s+bm25\s+query)\s*:\s*(.*)$"
MARKER_INLINE = r"(?i)(?:rewritten\s+query|search\s+query|better\s+bm25\s+query)\s*:\s*([^\n\r]+)"
LABEL_LINES = ("assistant:", "search query:", "rewritten query:", "better bm25 query:", "better bm25 query", "better bm25", "better bm2")
NOISE = r"(?i)(user query|better bm25|example|bm25 rules)"
# Strings at which a generated answer ends: as they stand, in lower case anywhere, and in lower case at its beginning.
STOP_STRINGS = ("\nUser query:", "\nBetter BM25 query:", "\nSearch query:", "\nRewritten query:", "\nExample")
STOP_MARKERS = ("\nuser query:", "\nbetter bm25 query:", "\nsearch query:", "\nrewritten query:", "\nexample\n")
STOP_PREFIXES = ("user query:", "better bm25 query:", "search query:", "rewritten query:", "example\n")
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip(t: Column) -> Column:
    """t without white space (Unicode's) at its ends."""
    return F.regexp_replace(t, rf"^{SPACE}|{SPACE}$", "")


def normalize(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, SPACE, " "))


def tokens_ascii(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9_]+"), F.lit(0))


def tokens(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def overlap(a: Column, b: Column) -> Column:
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1)))


def copy_penalty(o: Column, tau: float) -> Column:
    return F.greatest(F.lit(0.0), o - tau)


def exact_copy_penalty(a: Column, b: Column, value: float = 1.0) -> Column:
    x, y = F.lower(normalize(a)), F.lower(normalize(b))
    return F.when((x == y) & (x != ""), value).otherwise(0.0)


def unreadable_ratio(t: Column) -> Column:
    return F.when(F.length(t) == 0, 1.0).otherwise((F.length(t) - F.length(F.regexp_replace(t, UNREADABLE, ""))) / F.greatest(F.length(t), F.lit(1)))


def english_ratio(t: Column) -> Column:
    low = F.lower(t)
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(low, "[^a-z]", "")), F.length(F.regexp_replace(low, r"[^\p{L}]", ""))), F.lit(0.0))


def is_explanation(t: Column) -> Column:
    return t.rlike(EXPLANATION) | (F.contains(t, F.lit(":")) & F.lower(strip(F.substring_index(t, ":", 1))).isin(*LABELS_BEFORE_COLON))


def is_polluted(t: Column) -> Column:
    return t.rlike(POLLUTION)


def all_numbers(t: Column) -> Column:
    """Numeric tokens as often as they occur."""
    return F.transform(F.regexp_extract_all(t, F.lit(NUMERIC), F.lit(0)), F.lower)


def all_acronyms(t: Column) -> Column:
    return F.transform(F.regexp_extract_all(t, F.lit(ACRONYM), F.lit(0)), F.lower)


def numeric_tokens(t: Column) -> Column:
    return F.array_distinct(all_numbers(t))


def acronyms(t: Column) -> Column:
    return F.array_distinct(all_acronyms(t))


def let(value: Column, body) -> Column:
    """body(value), with value worked out once per row even where body uses it in a loop over an array."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def keywords(t: Column) -> Column:
    locked = F.array_union(numeric_tokens(t), acronyms(t))
    return let(locked, lambda drop: F.filter(tokens(t), lambda w: ~w.isin(*STOPWORDS, *NEGATIONS) & ~F.array_contains(drop, w) & (F.length(w) > 1)))


def negations(t: Column) -> Column:
    return F.filter(tokens(t), lambda w: w.isin(*NEGATIONS))


def preserve_ratio(source: Column, rewrite: Column) -> Column:
    def ratio(p):
        s, r = p.getField("s"), p.getField("r")
        kept = F.aggregate(F.array_distinct(s), F.lit(0), lambda n, t: n + F.least(F.size(F.filter(s, lambda x: x == t)), F.size(F.filter(r, lambda x: x == t))))
        return F.when(F.size(s) == 0, 1.0).otherwise(kept / F.greatest(F.size(s), F.lit(1)))

    return let(F.struct(source.alias("s"), rewrite.alias("r")), ratio)


def keyword_preserve(source: Column, rewrite: Column) -> Column:
    return preserve_ratio(keywords(source), tokens(rewrite))


def preserve_parts(source: Column, rewrite: Column) -> Column:
    """struct(locked, number, acronym, negation): shares of the source's numbers, acronyms and negations, counted as often
    as they occur, that the rewrite keeps (1 where the source has none), and the mean of those that apply."""
    words = tokens(rewrite)
    pairs = {"number": (all_numbers(source), all_numbers(rewrite)), "acronym": (all_acronyms(source), words), "negation": (negations(source), words)}
    shares = F.struct(*[preserve_ratio(own, other).alias(k) for k, (own, other) in pairs.items()], *[(F.size(own) > 0).alias(f"has_{k}") for k, (own, _) in pairs.items()])

    def mean(p):
        has = [p.getField(f"has_{k}") for k in pairs]
        total = sum((F.when(h, p.getField(k)).otherwise(0.0) for k, h in zip(pairs, has, strict=True)), F.lit(0.0))
        n = sum((h.cast("int") for h in has), F.lit(0))
        return F.struct(F.coalesce(F.try_divide(total, n), F.lit(1.0)).alias("locked"), *[p.getField(k).alias(k) for k in pairs])

    return let(shares, mean)


def locked_preserve(source: Column, rewrite: Column) -> Column:
    return preserve_parts(source, rewrite).getField("locked")


def term_preserve(source: Column, rewrite: Column) -> Column:
    return 0.5 * keyword_preserve(source, rewrite) + 0.5 * locked_preserve(source, rewrite)


def length_score(t: Column, low: int = 1, best_low: int = 4, best_high: int = 12, high: int = 20) -> Column:
    n = F.size(tokens(t))
    return F.when((n <= low) | (n >= high), 0.0).when(n < best_low, (n - low) / (best_low - low)).when(n <= best_high, 1.0).otherwise((high - n) / (high - best_high))


def bad_format_penalty(t: Column, cap: float = 1.5, most_tokens: int = 12, least_english: float = 0.85, most_unreadable: float = 0.20) -> Column:
    x = strip(t)
    n, english, unreadable = F.size(tokens(x)), english_ratio(x), unreadable_ratio(x)
    total = (
        F.when(x.rlike("[\n\r]"), 0.5).otherwise(0.0)
        + F.when(is_explanation(x) | is_polluted(x), 0.5).otherwise(0.0)
        + F.when(n > most_tokens, F.least(F.lit(0.5), (n - most_tokens) * 0.03)).otherwise(0.0)
        + F.when(english < least_english, F.least(F.lit(0.5), 0.5 * (least_english - english) / least_english)).otherwise(0.0)
        + F.when(unreadable > most_unreadable, F.least(F.lit(0.5), 0.5 * (unreadable - most_unreadable) / (1 - most_unreadable))).otherwise(0.0)
    )
    return F.when(x == "", min(cap, 1.0)).otherwise(F.least(F.lit(cap), total))


def is_retrieval_ready(t: Column) -> Column:
    w = tokens(t)
    return F.size(w).between(2, 8) & ~F.contains(t, F.lit("?")) & ~F.arrays_overlap(w, strings(QUESTION_WORDS))


def unsafe_copy_penalty(source: Column, rewrite: Column) -> Column:
    return F.when((F.lower(normalize(source)) == F.lower(normalize(rewrite))) & (normalize(source) != "") & ~is_retrieval_ready(source), 1.0).otherwise(0.0)


# ---- cleaning a generated answer ---------------------------------------------------------------

def candidate_text(t: Column, strip_list_prefix: bool = True) -> Column:
    """A candidate without quotes around it, bullets or numbers before it, and with single spaces."""
    x = strip(t)
    for q in ("'", '"', "`"):
        x = F.regexp_replace(x, f"^{q}+|{q}+$", "")
    if strip_list_prefix:
        x = F.regexp_replace(x, r"^[\-\*\p{Nd}\.\)\]\s\x1C-\x1F\x85\p{Z}]+", "")
    return normalize(x)


def candidates(t: Column) -> Column:
    """Possible queries in an answer, in order: the text behind a marker (or the line after an empty one), other lines
    that aren't labels, bullets or examples, then all marked texts again."""
    lines = F.filter(F.transform(F.split(t, LINE_BREAK), normalize), lambda x: x != "")

    def one(line, i):
        low = F.lower(line)
        tail = normalize(F.regexp_extract(line, MARKER_LINE, 1))
        skip = low.startswith("user query") & line.rlike(r"(?i)^user\s+query\s*:") | low.startswith("example") | low.startswith("bm25 rules") | F.substring(line, 1, 1).isin("-", "*") | low.isin(*LABEL_LINES) | (line.endswith(":") & (F.size(F.split(line, " ")) <= 4))
        return F.when(line.rlike(MARKER_LINE), F.when(tail != "", tail).otherwise(F.get(lines, i + 1))).when(line.rlike(MARKER_INLINE), F.regexp_extract(line, MARKER_INLINE, 1)).when(skip, F.lit(None)).otherwise(line)

    found = F.concat(F.transform(lines, one), F.regexp_extract_all(t, F.lit(MARKER_INLINE), F.lit(1)))
    return F.array_distinct(F.filter(F.transform(F.filter(found, lambda x: x.isNotNull()), lambda x: candidate_text(x)), lambda x: x != ""))


def candidate_keys(found: Column, source: Column) -> Column:
    """Each candidate with its rank key: clean, overlap with the source, not ending in a dangling word, earlier first."""

    def key(c, i):
        w = tokens(c)
        return F.struct(F.when(c.rlike(NOISE) | is_explanation(c), 0).otherwise(1).alias("clean"), overlap(source, c).alias("overlap"), F.when(F.coalesce(F.get(w, F.size(w) - 1), F.lit("")).isin(*PARTIAL_TAILS), 0).otherwise(1).alias("whole"), (-i).alias("order"), c.alias("c"))

    return F.transform(found, key)


def best_candidate(found: Column, source: Column) -> Column:
    """The first of the cleanest candidates with the highest overlap that don't end in a dangling word."""
    return F.array_max(candidate_keys(found, source)).getField("c")


def ranked_candidates(found: Column, source: Column) -> Column:
    """All candidates, best first."""
    return F.transform(F.sort_array(candidate_keys(found, source), asc=False), lambda x: x.getField("c"))


def clean_query(raw: Column, source: Column) -> Column:
    return F.when(normalize(raw) == "", "").otherwise(F.coalesce(best_candidate(candidates(raw), source), candidate_text(raw)))


def stabilized(raw: Column, source: Column, stop: str | None = None) -> Column:
    """A cleaned rewrite that falls back to the source when cleaning leaves nothing, with its diagnostics. The raw text
    is trimmed first, and cut at the stop marker where one other than a line break is given."""
    raw = strip(raw)
    if stop and stop != "\n":
        raw = strip(F.substring_index(raw, stop, 1))
    clean, own = normalize(clean_query(raw, normalize(source))), normalize(source)
    final = F.when(clean == "", own).otherwise(clean)
    return F.struct(
        clean.alias("cleaned_query"), final.alias("final_query"), (clean == "").alias("fallback_to_original"),
        F.when(clean == "", strings(["empty_after_clean"])).otherwise(F.array().cast("array<string>")).alias("fallback_reasons"),
        F.lower(raw).rlike("<think|thinking process").alias("raw_contains_think"), is_polluted(raw).alias("raw_contains_label"),
        raw.rlike("[\n\r]").alias("raw_multiline"), bad_format_penalty(raw).alias("raw_format_penalty"), overlap(own, final).alias("final_overlap"), F.size(tokens(final)).alias("final_term_count"))


def stop_strings(stop_on: str | None = None, configured=()) -> tuple[str, ...]:
    """What ends an answer: the marker, the configured strings and the fixed ones, each once, in this order."""
    return tuple(dict.fromkeys(x for x in (stop_on, *configured, *STOP_STRINGS) if x))


def truncate_generation(t: Column, stop_on: str | None = None, configured=(), single_line: bool = False) -> Column:
    """The trimmed text up to the first line break (single_line), stop string (as it stands) or fixed marker (in any
    case); empty if it begins with a label. Null counts as empty."""
    t = F.coalesce(t, F.lit(""))
    breaks = ("\n", "\r") if single_line else ()
    at = [F.nullif(F.instr(t, x), F.lit(0)) for x in (*breaks, *stop_strings(stop_on, configured))] + [F.nullif(F.instr(F.lower(t), x), F.lit(0)) for x in STOP_MARKERS]
    label = F.lower(t).rlike("^(?:" + "|".join(STOP_PREFIXES) + ")")
    return F.when(label, "").otherwise(strip(F.coalesce(F.substring(t, F.lit(1), F.least(*at) - 1), t)))


def first_line(t: Column, marker: str = "\n\n") -> Column:
    cut = F.substring_index(t, marker, 1)
    return F.coalesce(F.get(F.filter(F.transform(F.split(cut, LINE_BREAK), normalize), lambda x: x != ""), F.lit(0)), F.lit(""))


def slug(t: Column) -> Column:
    """Lower case, with an underscore for each run of other than ASCII letters and digits; "summary" if nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.lower(strip(t)), "[^a-z0-9]+", "_"), F.lit("_")), F.lit("")), F.lit("summary"))


# ---- cohorts, prompts, names --------------------------------------------------------------------

def is_learnable(t: Column) -> Column:
    """Whether a query that finds nothing may still be improved: one clean line, mostly English, 3 to 12 tokens of which
    at least 40% aren't stopwords, with two keywords or one number, acronym or negation."""
    x = normalize(t)
    w = tokens(x)
    content = F.size(F.filter(w, lambda v: ~v.isin(*STOPWORDS)))
    locked = F.size(numeric_tokens(x)) + F.size(acronyms(x)) + F.size(negations(x))
    return (
        ~t.rlike("[\n\r]") & (x != "") & ~is_polluted(x) & (english_ratio(x) >= 0.70) & (unreadable_ratio(x) <= 0.25)
        & F.size(w).between(3, 12) & (content >= 0.40 * F.size(w)) & ((F.size(keywords(x)) >= 2) | (locked >= 1))
    )


def unique_nonempty(values: Column) -> Column:
    """Number of different texts that aren't blank, trimmed at their ends; a null counts as the text None."""
    return F.size(F.array_distinct(F.filter(F.transform(values, lambda x: strip(F.coalesce(x, F.lit("None")))), lambda x: x != "")))


def prompt(system: str, template: str, query: Column) -> Column:
    """System text, an empty line, and the template with {query} filled in."""
    before, _, after = template.partition("{query}")
    return F.concat(F.lit(f"{system}\n\n{before}"), normalize(query), F.lit(after))


def retry_prompt(base: Column, previous: Column, constraint: str, heading: str, suffix: str, most: int = 8) -> Column:
    """base with a list of up to `most` previous rewrites to avoid (different in any case, in order) ahead of the suffix;
    base itself if there is none."""
    texts = F.filter(F.transform(previous, normalize), lambda x: x != "")
    first = F.filter(F.transform(texts, lambda x, i: F.struct(x.alias("x"), i.alias("i"), F.lower(x).alias("k"))), lambda s: F.array_position(F.transform(texts, lambda y: F.lower(y)), s.getField("k")) == s.getField("i") + 1)
    head = F.regexp_replace(base, rf"{SPACE}$", "")
    head = F.when(head.endswith(suffix), F.regexp_replace(F.left(head, F.length(head) - len(suffix)), rf"{SPACE}$", "")).otherwise(head)
    items = F.array_join(F.transform(F.slice(first, 1, most), lambda s: F.concat(F.lit("- "), s.getField("x"))), "\n")
    return F.when(F.size(first) == 0, base).otherwise(F.concat(head, F.lit(f"\n{constraint}\n{heading}\n"), items, F.lit(f"\n{suffix}")))


def model_key(name: Column) -> Column:
    return F.lower(F.rtrim(F.replace(F.trim(name), F.lit("\\"), F.lit("/")), F.lit("/")))


def same_model(a: Column, b: Column) -> Column:
    """Whether two model names or paths mean the same: equal, one the tail of the other, or the same last part."""
    x, y = model_key(a), model_key(b)
    last = lambda v: F.substring_index(v, "/", -1)
    return (x != "") & (y != "") & ((x == y) | x.endswith(F.concat(F.lit("/"), y)) | y.endswith(F.concat(F.lit("/"), x)) | (last(x) == last(y)))
