"""Porter's stems: the published rules' examples, and a plain letter-by-letter version on random words."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions.stem import porter
from rankloom.operators import retrieval as R
from rankloom.operators.index import Index

# What the whole algorithm makes of the words that its publication gives for each rule.
EXAMPLES = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit
digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis
hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope
goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend
adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll
generalizations gener oscillators oscil as as is is y y by by say sai 2024 2024 a_b a_b""".split()

TWO = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
THREE = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
FOUR = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def letters(w):
    """v or c for each letter."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def measure(w):
    return letters(w).count("vc")


def cvc(w):
    return letters(w).endswith("cvc") and w[-1] not in "wxy"


def plain(w):
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for s in ("ed", "ing"):
            if w.endswith(s) and "v" in letters(w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and letters(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in letters(w[:-1]):
        w = w[:-1] + "i"
    for rules in (TWO, THREE):
        fit = max((r for r in rules if w.endswith(r[0])), key=lambda r: len(r[0]), default=None)
        if fit and measure(w[: -len(fit[0])]) > 0:
            w = w[: -len(fit[0])] + fit[1]
    fit = max((s for s in FOUR if w.endswith(s)), key=len, default=None)
    if fit and measure(w[: -len(fit)]) > 1 and (fit != "ion" or w[: -len(fit)].endswith(("s", "t"))):
        w = w[: -len(fit)]
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w


def stems(spark, words):
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", porter(F.array("w")).alias("s"))
    return {r["w"]: r["s"][0] for r in rows.collect()}


def test_published_examples(spark):
    got = stems(spark, EXAMPLES[::2])
    assert {w: got[w] for w in EXAMPLES[::2]} == dict(zip(EXAMPLES[::2], EXAMPLES[1::2], strict=True))


def test_random_words_letter_by_letter(spark):
    rnd = random.Random(3)
    ends = ["", "s", "es", "ed", "eed", "ing", "y", "e", "ll", "sses", "ies", *FOUR, *[a for a, _ in TWO], *[a for a, _ in THREE]]
    words = {"".join(rnd.choices("abeiylstzxw0_", k=rnd.randint(1, 7))) + rnd.choice(ends) + rnd.choice(["", "", "s", "ed", "ing", "ly"]) for _ in range(20_000)}
    words |= {"".join(rnd.choices("yab", k=rnd.randint(1, 7))) + rnd.choice(["ed", "ing", "y", ""]) for _ in range(3_000)}
    got = stems(spark, sorted(words))
    assert {w: (s, plain(w)) for w, s in got.items() if s != plain(w)} == {}


def test_empty_and_null(spark):
    rows = spark.sql("select array() as w union all select cast(null as array<string>)").select(porter(F.col("w").cast("array<string>")).alias("s")).collect()
    assert sorted((r["s"] for r in rows), key=str) == [None, []] or sorted((r["s"] for r in rows), key=str) == [[], None]


def test_index_of_stems(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Connected connections"), (2, "connecting the dots"), (3, "dotted lines"), (4, None), (5, "")], "doc_id long, text string")
    found = Index.build(docs, str(tmp_path / "i"), stem=True)
    assert {r["term"]: (r["df"], r["cf"]) for r in found.terms.collect()} == {"connect": (2, 3), "the": (1, 1), "dot": (2, 2), "line": (1, 1)}
    asked = spark.createDataFrame([(1, "connects"), (2, "DOTS dotting"), (3, "lined")], "qid long, text string")
    for one_pass in (0, 10**9):
        hits = R.top_k(found, asked, 5, "lucene", one_pass=one_pass).collect()
        assert sorted((r["qid"], r["rank"], r["doc_id"]) for r in hits) == [(1, 1, 1), (1, 2, 2), (2, 1, 3), (2, 2, 2), (3, 1, 3)]
    opened = Index.open(spark, str(tmp_path / "i"), content=True)
    assert opened.stem and opened.place == found.place
    with pytest.raises(ValueError, match="of stems"):
        Index.ensure(docs, str(tmp_path / "i"))
    with pytest.raises(ValueError, match="whole words"):
        R.containment_qrels(found, docs, asked)
