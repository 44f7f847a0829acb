"""Many phrases at once, word families, places of both."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quern.functions import morphology as mo
from quern.functions.text import is_verbatim
from quern.operators import phrases as ph


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


TEXTS = ["Heat pumps and heat-pump parts; HEAT PUMP.", "a a a a", "ÉCOLE primaire, école\nPRIMAIRE", "x_heat pump heat pumpx", "", None, "😀 heat pump😀", "c++ and c+++ or (c++)", "heat  pump", "the of the of the"]
PHRASES = ["heat pump", "a a", "école", "école primaire", "c++", "the of the", "of the", "absent words", "pump", "++", "", None]


def plain_hits(text, phrase):
    """All occurrences between characters that are no part of a word, overlaps included."""
    pattern = re.compile(rf"(?<!\w)(?={re.escape(phrase)}(?!\w))", re.IGNORECASE)
    return [(m.start(), m.start() + len(phrase)) for m in pattern.finditer(text or "")]


@pytest.mark.parametrize("near", [300_000, 0])
def test_hits_against_regular_expressions(spark, near):
    r = random.Random(2)
    words = ["heat", "pump", "a", "the", "of", "é", "c++", "x_1", "PUMP"]
    texts = TEXTS + ["".join(r.choice(words) + r.choice([" ", " ", ", ", "-", "\n", ""]) for _ in range(r.randrange(40))) for _ in range(60)]
    listed = PHRASES + [" ".join(r.choice(words) for _ in range(r.randrange(1, 4))) for _ in range(25)]
    listed = [p for p in dict.fromkeys(listed)]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(None, "heat pump", "k")], "doc_id long, text string, phrase string")
    table = spark.createDataFrame([(i, p) for i, p in enumerate(listed)], "phrase_id long, phrase string")
    want = [(i, n, s, e, t[s:e]) for i, t in enumerate(texts) for n, p in enumerate(listed) if p and re.search(r"\w", p) for s, e in plain_hits(t, p)]
    assert len(want) > 300
    got = ph.phrase_hits(df, "doc_id", "text", table, near_rows=near)
    assert rows_of(got) == sorted(want, key=repr)
    assert ph.phrase_hits(df.limit(0), "doc_id", "text", table).count() == ph.phrase_hits(df, "doc_id", "text", table.limit(0)).count() == 0


def test_hits_from_the_left(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    table = spark.createDataFrame([(p, p) for p in ("a a", "the of the", "heat pump")], "phrase_id string, phrase string")
    want = [(i, p, m.start(), m.end()) for i, t in enumerate(TEXTS) for p in ("a a", "the of the", "heat pump") for m in re.finditer(rf"(?<!\w){p}(?!\w)", t or "", re.IGNORECASE)]
    got = ph.without_overlaps(ph.phrase_hits(df, "doc_id", "text", table).drop("span"), "doc_id")
    assert rows_of(got) == sorted(want, key=repr) and (1, "a a", 2, 5) not in want


def test_long_text_of_frequent_words(spark):
    """Rows of one word don't carry the whole text: 40,000 of them would fill the memory."""
    text = "the of " * 20_000 + "the"
    df = spark.createDataFrame([(1, text, ["d"])], "doc_id long, text string, gate array<string>")
    rules = spark.createDataFrame([("t", "the", "d"), ("tot", "the of the", "d")], "phrase_id string, phrase string, domain string")
    got = ph.phrase_hits(df, "doc_id", "text", rules)
    assert [r[1:] for r in rows_of(got.groupBy("phrase_id").agg(F.count("*"), F.min("start"), F.max("end")))] == [(20_001, 0, len(text)), (20_000, 0, len(text))]
    assert got.where("span <> phrase_id").where("not (span = 'the' and start % 7 = 0 and end = start + 3 or span = 'the of the' and start % 7 = 0 and end = start + 10)").count() == 0


@pytest.mark.parametrize("near", [300_000, 0])
def test_hits_across_stretches(spark, near):
    """Phrases longer than a stretch, at every place of its edges, and columns that are kept."""
    words = [f"w{i % 7}" for i in range(400)]
    text = "".join(w + (" " if i % 5 else ", ") for i, w in enumerate(words))
    listed = [("short", "w1 w2"), ("edge", "w0"), ("long", " ".join(words[101:105])), ("longer", "".join(w + (" " if i % 5 else ", ") for i, w in enumerate(words) if 61 <= i < 190).strip(" ,"))]
    df = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "..", "z"), (4, "w0", "v")], "doc_id long, text string, other string")
    want = [(i, o, n, s, e, t[s:e]) for i, t, o in ((1, text, "x"), (4, "w0", "v")) for n, p in listed for s, e in plain_hits(t, p)]
    got = ph.phrase_hits(df, "doc_id", "text", spark.createDataFrame(listed, "phrase_id string, phrase string"), keep=["other"], near_rows=near)
    assert {w[2] for w in want} == {"short", "edge", "long", "longer"} and rows_of(got) == sorted(want, key=repr)


@pytest.mark.parametrize("near", [300_000, 0])
def test_words_are_folded_once_and_where_a_phrase_may_stand(spark, near):
    """20,000 words, 43 of them different: folding every word of every text took most of the time."""
    folded = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<string>")
    def fold(words):
        folded.add(sum(map(len, words)))
        return words.map(lambda row: [w.casefold() for w in row])

    r = random.Random(5)
    texts = [" ".join(["Rare THING" if i % 10 == 0 and k == 70 else f"W{r.randrange(40)}" for k in range(400)]) for i in range(50)] + ["rare things", "THING"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    table = spark.createDataFrame([("rare thing", "RARE thing"), ("thing", "Thing")], "phrase_id string, phrase string")
    got = rows_of(ph.phrase_hits(df, "doc_id", "text", table, norm=lambda w: w, fold=fold, literal=False, near_rows=near))
    want = [(i, p, *m.span(), m[0]) for i, t in enumerate(texts) for p in ("rare thing", "thing") for m in re.finditer(rf"\b{p}\b", t, re.IGNORECASE)]
    assert got == sorted(want, key=repr) and len(got) == 11 and 0 < folded.value < 500


def test_gate_opens_domains(spark):
    df = spark.createDataFrame([(1, "heat pump and solar roof", ["heating"]), (2, "heat pump and solar roof", ["heating", "power"]), (3, "heat pump", []), (4, "heat pump", None)], "doc_id long, text string, gate array<string>")
    rules = spark.createDataFrame([("h", "heat pump", "heating"), ("s", "solar roof", "power")], "phrase_id string, phrase string, domain string")
    assert rows_of(ph.gated_hits(df, "doc_id", "text", "gate", rules)) == [(1, "h", "heating", 0, 9, "heat pump"), (2, "h", "heating", 0, 9, "heat pump"), (2, "s", "power", 14, 24, "solar roof")]


# word families


def plain_family(word):
    """The rules one after another."""
    w = "".join(c for c in unicodedata.normalize("NFKD", word.casefold()) if not unicodedata.combining(c)).replace("’", "'").split("'")[-1]
    for stem, endings, name in mo.FAMILIES:
        if w in [stem + e for e in endings.split()]:
            return name
    for suffix in [*mo.VERB_SUFFIXES.split(), *mo.NOUN_SUFFIXES.split()]:
        if w.endswith(suffix) and len(w) >= len(suffix) + 4:
            return w[: -len(suffix)]
    return w[:-1] if len(w) >= 6 and w[-1] in "aeio" else w


def test_no_suffix_ends_in_another():
    for listed in (mo.VERB_SUFFIXES.split(), mo.NOUN_SUFFIXES.split()):
        assert not [(a, b) for a in listed for b in listed if a != b and a.endswith(b)]


def test_families(spark):
    told = {"Riqualificazione": "riqualific", "riqualificante": "riqualific", "EFFICIENTAMENTI": "efficient", "energetiche": "energet", "energetica": "energet", "dell'Energetico": "energet", "scuola": "scuol", "città": "citta", "lavorando": "lavor", "Impianti": "impiant", "sede": "sede", "reti": "reti"}
    r = random.Random(1)
    stems = ["lavor", "impi", "ret", "cit", "Éner", "straß", "ﬁn", "qual", "a'b", "ℌ", "한국", "İst", "Ⅷ", "x", "à", "ΟΔΟΣ"]
    words = [*told, *(r.choice(stems) + r.choice(["", *mo.VERB_SUFFIXES.split(), *mo.NOUN_SUFFIXES.split(), "a", "e", "i", "o", "u"]) for _ in range(600))]
    got = {r.w: r.f for r in spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "w string").select("w", mo.family(F.col("w")).alias("f")).collect()}
    assert {w: got[w] for w in told} == told
    assert got == {w: plain_family(w) for w in got}


def test_folding_equals_unicode(spark):
    chars = [chr(n) for n in range(1, 0x30000) if not 0xD800 <= n < 0xE000 and (n % 7 == 0 or n < 0x600 or 0x1D400 <= n < 0x1D800 or 0xFB00 <= n < 0xFB50)]
    texts = ["a" + c + "B" for c in chars] + ["".join(chars[i : i + 5]) for i in range(0, len(chars), 5)] + [None, ""]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("t", mo.folded(F.col("t")).alias("f")).collect()
    assert not [(r.t, r.f) for r in got if r.f != (None if r.t is None else mo.fold(r.t))]


def test_places_of_families(spark):
    texts = ["La riqualificazione energetica e le riqualificazioni\nENERGETICHE; l'energetico", "Impianto, impianti di dépuration", "riqualificato", "", None, "dell'impianto 12 impianti"]
    listed = ["riqualificare energetico", "impianto", "impianti di", "nothing here"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    table = spark.createDataFrame([(p, p) for p in listed], "phrase_id string, phrase string")
    token = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
    want = []
    for i, t in enumerate(texts):
        found = list(token.finditer(t or ""))
        words = [plain_family(m[0]) for m in found]
        for p in listed:
            rule = [plain_family(w) for w in token.findall(p)]
            want += [(i, p, found[k].start(), found[k + len(rule) - 1].end(), t[found[k].start() : found[k + len(rule) - 1].end()]) for k in range(len(words) - len(rule) + 1) if words[k : k + len(rule)] == rule]
    assert len(want) == 7
    for near in (300_000, 0):
        hits = ph.phrase_hits(df, "doc_id", "text", table, keep=["text"], norm=mo.family_of_folded, fold=mo.folded_words, word=mo.WORD, gap=mo.GAP, literal=False, near_rows=near)
        assert rows_of(hits.drop("text")) == sorted(want, key=repr)
        assert hits.where(~is_verbatim(F.col("text"), F.col("start"), F.col("end"), F.col("span"))).count() == 0
