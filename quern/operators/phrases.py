"""Many phrases in many texts: an index of phrases by their rarest word.

The words of the texts are counted once, as they are written, and each of them
is normalised once. A phrase is then looked for only where a form of its rarest
word stands, so the work follows the occurrences of rare words and not the
number of phrases, and only the words of such places are normalised again. A
place is verified inside the row of its stretch of the text: a few dozen words,
and as many words more at either end as the longest phrase has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import starts_of
from ..session import broadcast_if_small, kept

#: A word and what lies between words.
WORD, GAP = r"[\p{L}\p{N}_]+", r"[^\p{L}\p{N}_]+"

#: Words of a text that are looked up together.
STRETCH = 64


def _normalised(words: Column, norm: Callable[[Column], Column]) -> Column:
    return F.transform(words, norm)


def _stretches(df: DataFrame, key: str, text: str, word: str, gap: str, reach: int) -> tuple[DataFrame, Column]:
    """Texts in stretches of words, each with `reach` words more at either end: key, __no, __base (code points before it),
    __pieces (words and what lies between them, in turn), __lead (the index of the first word) and __skip (words before the stretch's own);
    and a stretch's own words.

    A row of one word then never carries the whole text.
    """
    own = max(STRETCH, 2 * reach)
    first = F.when(F.col(text).rlike(rf"\A(?:{word})"), 0).otherwise(1)
    cut = df.select(key, F.regexp_extract_all(text, F.lit(f"{word}|{gap}"), F.lit(0)).alias("__pieces"), first.alias("__first"))
    n = F.floor((F.size("__pieces") - F.col("__first") + 1) / 2)
    at = lambda c: F.when(c * own <= reach, 0).otherwise(2 * (c * own - reach) + F.col("__first")).cast("int")
    joined = lambda c: F.length(F.array_join(F.slice("__pieces", at(c) + 1, at(c + 1) - at(c)), ""))
    starts = F.when(n > 0, starts_of(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / own).cast("int")), joined)))
    one = lambda s, c: F.struct(
        c.alias("__no"), s.alias("__base"), F.slice("__pieces", at(c) + 1, F.lit(2 * (own + 2 * reach) + 2)).alias("__pieces"),
        F.when(at(c) == 0, F.col("__first")).otherwise(0).alias("__lead"), F.least(c * own, F.lit(reach)).alias("__skip"),
    )
    each = cut.select(key, "__first", F.explode_outer(F.transform(starts, one)).alias("s")).select(key, "s.*")
    return each, _every_second(F.slice("__pieces", F.col("__lead") + 2 * F.col("__skip") + 1, F.lit(2 * own - 1)))


def _every_second(pieces: Column) -> Column:
    """The words of pieces that begin with one."""
    return F.filter(pieces, lambda _, i: i % 2 == 0)


def _length_of(pieces: Column) -> Column:
    return F.length(F.array_join(pieces, ""))


def phrase_hits(
    df: DataFrame, key: str, text: str, phrases: DataFrame, keep: Sequence[str] = (), norm: Callable[[Column], Column] = F.lower, fold: Callable[[Column], Column] = lambda words: words,
    word: str = WORD, gap: str = GAP, literal: bool = True, near_rows: int = 300_000,
) -> DataFrame:
    """Every occurrence of every phrase: key, the columns to keep, phrase_id, start, end (code points, end exclusive) and span.

    phrases: phrase_id and phrase. A phrase occurs where the words of a text,
    normalised, are the phrase's; it stands between characters that are no part
    of a word. fold takes an array of words, norm each word of it after. If literal, what lies between and around its words has to be the
    same too, in any case. Occurrences may overlap. Keys have to be unique and
    not null; a null text has no occurrences, and neither has a phrase without
    a word.

    The index is broadcast if it was counted and found small; else words meet
    it by a shuffle, and the places found are brought back to their stretch of the text.
    Columns to keep are joined to the occurrences by the key.
    """
    texts = df.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    split = phrases.select("phrase_id", "phrase", fold(F.regexp_extract_all("phrase", F.lit(word), F.lit(0))).alias("words"), F.regexp_instr("phrase", F.lit(word)).alias("lead"))
    split = kept(split.withColumn("words", _normalised(F.col("words"), norm)).where((F.size("words") > 0) & F.col("phrase_id").isNotNull()), "phrases")
    reach = split.agg(F.max(F.size("words"))).first()[0] or 1
    of_phrases = split.select("phrase_id", F.posexplode("words").alias("place", "word"))
    vocabulary, _ = broadcast_if_small(of_phrases.select("word").distinct(), near_rows)
    seen = texts.select(F.explode_outer(F.regexp_extract_all(text, F.lit(word), F.lit(0))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("w is not null")
    forms = kept(seen.select("w", "n", F.explode_outer(_normalised(fold(F.array("w")), norm)).alias("word")).join(vocabulary, "word"), "forms")
    counts = forms.groupBy("word").agg(F.sum("n").alias("n"))
    rarest = of_phrases.join(counts, "word", "left").groupBy("phrase_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "word")).alias("r"))
    index = split.join(rarest.where("r.n > 0"), "phrase_id").select("phrase_id", "phrase", "words", "lead", F.col("r.place").alias("before"), F.col("r.word").alias("word"))
    index, small = broadcast_if_small(kept(index.join(forms.select("w", "word"), "word").drop("word"), "phrase-index"), near_rows)

    cut, own = _stretches(texts, key, text, word, gap, reach)
    # outer explodes: else the optimiser finds the words once more in a filter below; words that are null meet nothing
    if small:
        met = cut.select("*", F.posexplode_outer(own).alias("at", "w")).join(index, "w")
    else:
        met = cut.select(key, "__no", F.posexplode_outer(own).alias("at", "w")).join(index, "w").join(cut, [key, "__no"])
    # what decides stands between the word before the place and the word after it
    n, from_word = F.size("words"), F.col("__skip") + F.col("at") - F.col("before")
    first = 2 * F.greatest(from_word, F.lit(0)) + F.col("__lead")
    low = F.greatest(first - 2, F.lit(0))
    near, before = F.array_join(F.slice("__pieces", low + 1, first - low + 2 * n + 1), ""), _length_of(F.slice("__pieces", F.lit(1), low))
    there = F.slice("__pieces", first + 1, 2 * n - 1)
    start = _length_of(F.slice("__pieces", low + 1, first - low))
    end = start + _length_of(there)
    # one filter, the cheapest first
    same = from_word >= 0
    if literal:
        start = start - (F.col("lead") - 1)
        end = start + F.length("phrase")
        apart = ~F.substring(near, end + 1, F.lit(1)).rlike(word) & ~((start > 0) & F.substring(near, F.greatest(start, F.lit(1)), F.lit(1)).rlike(word))
        same = same & (start >= 0) & (F.lower(F.substring(near, start + 1, end - start)) == F.lower("phrase")) & apart
    same = same & ((n == 1) | (_normalised(fold(_every_second(there)), norm) == F.col("words")))  # a phrase of one word has met it
    found = met.where(same).select(key, "phrase_id", (F.col("__base") + before).alias("base"), start.alias("start"), end.alias("end"), F.substring(near, start + 1, end - start).alias("span"))
    place = lambda c: (F.col("base") + F.col(c)).cast("long").alias(c)
    hits = found.select(key, "phrase_id", place("start"), place("end"), "span")
    return hits.join(texts.select(key, *keep), key).select(key, *keep, "phrase_id", "start", "end", "span") if keep else hits


def without_overlaps(hits: DataFrame, key: str) -> DataFrame:
    """Hits of each phrase taken from the left, none overlapping the one before it; only phrases that overlap themselves lose any."""
    over = Window.partitionBy(key, "phrase_id").orderBy("start")
    apart = hits.withColumn("__run", F.sum(F.when(F.col("start") >= F.lag("end", 1, -1).over(over), 1).otherwise(0)).over(over))
    kept_start = lambda taken, h: F.when(h["start"] >= F.try_element_at(taken, F.lit(-1))["end"], F.concat(taken, F.array(h))).otherwise(taken)
    row = F.struct("start", "end", *[c for c in hits.columns if c not in ("start", "end", key, "phrase_id")])
    runs = apart.groupBy(key, "phrase_id", "__run").agg(F.array_sort(F.collect_list(row)).alias("h"))
    taken = F.aggregate(F.slice("h", F.lit(2), F.size("h")), F.slice("h", 1, 1), kept_start)
    return runs.select(key, "phrase_id", F.explode(taken).alias("h")).select(key, "phrase_id", "h.*").select(*hits.columns)


def gated_hits(df: DataFrame, key: str, text: str, gate: str, rules: DataFrame, **how: object) -> DataFrame:
    """Occurrences of the phrases of rules (phrase_id, phrase, domain) in texts whose gate, an array of domains, names the rule's domain.

    Returns key, phrase_id, domain, start, end and span, of each phrase those that finding from the left gives.
    """
    hits = phrase_hits(df, key, text, rules.select("phrase_id", "phrase"), keep=[gate], **how)
    domains, _ = broadcast_if_small(rules.select("phrase_id", "domain"))
    allowed = hits.join(domains, "phrase_id").where(F.array_contains(gate, F.col("domain"))).select(key, "phrase_id", "domain", "start", "end", "span")
    return without_overlaps(allowed, key)
