"""Porter's stems as Column expressions (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffixes of the published algorithm (with its author's later bli and logi) and what takes their place.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "(?<=[st])ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

# A run of consonants and one of vowels. y is a vowel after a consonant and else a consonant; runs never give back.
CONSONANTS = "[^aeiou][^aeiouy]*+"
VOWELS = "[aeiouy][aeiou]*+"
START = f"^(?:{CONSONANTS})?+"
# By the measure m, the number of vowel runs followed by consonants: m > 0, m > 1, m = 1; then a vowel anywhere.
OVER_0 = f"{START}{VOWELS}{CONSONANTS}"
OVER_1 = f"{OVER_0}{VOWELS}{CONSONANTS}"
JUST_1 = f"{OVER_0}(?:{VOWELS})?+$"
VOICED = f"{START}[aeiouy]"
# m = 1, ending consonant, vowel, consonant, the last none of w, x, y.
SHORT = "^[^aeiou][^aeiouy]*+[aeiouy][^aeiouwxy]$"
# Ends in twice the same consonant; a doubled y is one only where its second is no vowel.
DOUBLE = r"([^aeiouylsz])\1$|(?:^|[aeiou])y(?:yy)+$|[^aeiouy](?:yy)+$"


def _replaced(w: Column, suffixes: dict[str, str], measure: str) -> Column:
    """w with its longest suffix replaced, if what stands before that has the measure."""
    pattern = f"^(.*?)({'|'.join(suffixes)})$"
    stem, suffix = F.regexp_extract(w, pattern, 1), F.regexp_extract(w, pattern, 2)
    new = F.create_map(*[F.lit(x) for pair in suffixes.items() for x in pair])
    return F.when((suffix != "") & stem.rlike(measure), F.concat(stem, F.element_at(new, suffix))).otherwise(w)


def _plural(w: Column) -> Column:
    return F.regexp_replace(w, "(?<=ss|i)es$|(?<=[^s])s$", "")


def _past(w: Column) -> Column:
    """Without -ed or -ing; a stem that is left bare is marked by a capital E where its ending may need mending."""
    cut = F.regexp_extract(w, "^(.*?)(?:ed|ing)$", 1)
    eed = F.when(F.regexp_extract(w, "^(.*)eed$", 1).rlike(OVER_0), F.regexp_replace(w, "d$", "")).otherwise(w)
    return F.when(w.endswith("eed"), eed).when(cut.rlike(VOICED), F.concat(cut, F.lit("E"))).otherwise(w)


def _mended(w: Column) -> Column:
    stem = F.regexp_replace(w, "E$", "")
    fixed = F.when(stem.rlike("(at|bl|iz)$") | stem.rlike(SHORT), F.concat(stem, F.lit("e"))).when(stem.rlike(DOUBLE), F.regexp_replace(stem, ".$", "")).otherwise(stem)
    return F.when(w.endswith("E"), fixed).otherwise(w)


def _last_y(w: Column) -> Column:
    return F.when(w.rlike(f"{VOICED}.*y$"), F.regexp_replace(w, "y$", "i")).otherwise(w)


def _bare(w: Column) -> Column:
    pattern = f"^(.*?)(?:{'|'.join(STEP_4)})$"
    stem = F.regexp_extract(w, pattern, 1)
    return F.when(stem.rlike(OVER_1), stem).otherwise(w)


def _last_e(w: Column) -> Column:
    stem = F.regexp_replace(w, "e$", "")
    return F.when(w.endswith("e") & (stem.rlike(OVER_1) | (stem.rlike(JUST_1) & ~stem.rlike(SHORT))), stem).otherwise(w)


def _last_l(w: Column) -> Column:
    return F.when(w.endswith("ll") & w.rlike(OVER_1), F.regexp_replace(w, "l$", "")).otherwise(w)


def porter(words: Column) -> Column:
    """The stems of an array of lower-case words, in order. Words of one or two characters stay; digits, underscores and
    letters beyond a to z count as consonants. Each step is one pass over the array, so that a word's steps don't nest."""
    steps = (_plural, _past, _mended, _last_y, lambda w: _replaced(w, STEP_2, OVER_0), lambda w: _replaced(w, STEP_3, OVER_0), _bare, _last_e, _last_l)
    stems = words
    for step in steps:
        stems = F.transform(stems, step)
    return F.zip_with(words, stems, lambda w, s: F.when(F.length(w) > 2, s).otherwise(w))
