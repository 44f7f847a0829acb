"""Text expressions: segments with offsets, whole phrases, tokens, n-grams, spans."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A segment ends after each of these.
SEGMENT_END = ".;!?\n"


#: White space of any script: what Unicode gives the property White_Space (fixed values).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(c: Column) -> Column:
    """Without white space (of any script) at either end."""
    return F.btrim(c, F.lit(SPACE))


def lead(c: Column) -> Column:
    """Characters of white space at the start."""
    return F.length(c) - F.length(F.ltrim(c, F.lit(SPACE)))


def squeezed(c: Column) -> Column:
    """Runs of white space as single blanks, none at either end."""
    return trimmed(F.regexp_replace(c, r"(?U)\s+", " "))


def not_blank(c: Column) -> Column:
    """The trimmed text, null if nothing is left."""
    return F.nullif(trimmed(c), F.lit(""))


def first_text(*choices: Column) -> Column:
    """The first choice that isn't blank."""
    return F.coalesce(*[not_blank(c) for c in choices])


def phrase_pattern(*phrases: str) -> str:
    """A Java pattern for any of the phrases as whole words, in any case and script."""
    return r"(?iU)(?<!\w)(?:" + "|".join(rf"\Q{p}\E" for p in phrases) + r")(?!\w)"


def has_phrase(text: Column, *phrases: str) -> Column:
    """Whether the text holds one of the phrases as whole words; false for null."""
    return F.coalesce(text.rlike(phrase_pattern(*phrases)), F.lit(False))


#: Pieces of a text whose lengths are added up at once.
BLOCK = 32


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda s, x: s + x)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def starts_of(lengths: Column) -> Column:
    """For each of an array of lengths, the sum of those before it: those of the blocks before, and what is before it in its block."""

    def places(lengths: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: _sum(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
        before = _let(blocks, lambda sums: F.transform(sums, lambda _, b: _sum(F.slice(sums, F.lit(1), b))))
        return _let(before, lambda sums: F.transform(lengths, lambda _, i: F.get(sums, F.floor(i / BLOCK).cast("int")) + _sum(F.slice(lengths, i - i % BLOCK + 1, i % BLOCK))))

    return _let(lengths, places)


def segments(df: DataFrame, key: str, text: str, ends: str = SEGMENT_END) -> DataFrame:
    """key, segment_no, segment, start and end: the trimmed, non-blank segments of each text.

    A terminator stays with the segment before it; offsets are code points, the
    end exclusive. Offsets are worked out inside the row, so nothing is shuffled.
    """
    cut = f"(?<=[{re.escape(ends)}])" if "\n" not in ends else "(?<=[" + re.escape(ends.replace("\n", "")) + r"\n])"
    split = df.select(key, F.split(F.col(text), cut).alias("pieces"))
    placed = split.select(key, F.arrays_zip("pieces", starts_of(F.transform("pieces", F.length)).alias("starts")).alias("p"))
    # the outer explode keeps the optimiser from evaluating the array once more in a filter below it
    each = placed.select(key, F.posexplode_outer("p").alias("segment_no", "p"))
    out = each.select(key, "segment_no", trimmed(F.col("p.pieces")).alias("segment"), (F.col("p.starts") + lead(F.col("p.pieces"))).alias("start")).where("segment <> ''")
    return out.select(key, F.col("segment_no").cast("long").alias("segment_no"), "segment", "start", (F.col("start") + F.length("segment")).alias("end"))


def is_verbatim(text: Column, start: Column, end: Column, span: Column) -> Column:
    """Whether a span is what the text holds between two code-point offsets."""
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int")) == span


def tokens(text: Column, pattern: str = r"[a-zà-ÿ0-9]+", least: int = 1, stop: tuple[str, ...] = ()) -> Column:
    """Matches of a pattern in the lower-cased text, short and stop words left out; repeats stay."""
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= least) & ~t.isin(*stop) if stop else F.length(t) >= least)


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by blanks; an empty array if there are fewer."""
    return F.when(
        F.size(words) >= n,
        F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")),
    ).otherwise(F.array().cast("array<string>"))


def keyword_score(text: Column, weights: dict[str, int]) -> tuple[Column, Column]:
    """Sum of the weights of the keywords that a text holds (in any case), and their number."""
    lower, score, hits = F.lower(text), F.lit(0), F.lit(0)
    for word, weight in weights.items():
        here = F.contains(lower, F.lit(word.lower()))
        score = score + F.when(here, F.lit(weight)).otherwise(F.lit(0))
        hits = hits + here.cast("int")
    return score, hits


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags, white space squeezed."""
    bare = F.regexp_replace(html, r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " ")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))


#: Accented Latin letters and the letters they fold to: fixed values, one for one.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def folded(c: Column) -> Column:
    """Lower case without Latin accents."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


#: A stem of four letters or more and a suffix of three or more.
_SUFFIX = r"^(.{4,}?)(?:azioni|azione|amento|amenti|izione|izioni|are|ere|ire|ing|tion|ment)$"


def normalised_token(token: Column) -> Column:
    """A word family key: folded, what precedes an apostrophe dropped, a verb or noun suffix and then a final vowel dropped.

    A suffix is only dropped from a stem of four letters or more, the longest
    first; a final vowel only from a word of six letters or more.
    """
    bare = F.regexp_replace(folded(token), r"^[^'’]*['’]", "")
    stem = F.regexp_replace(bare, _SUFFIX, "$1")
    return F.when(F.length(stem) >= 6, F.regexp_replace(stem, r"[aeio]$", "")).otherwise(stem)


def normalised_tokens(tokens: Column) -> Column:
    """normalised_token of each of an array of words: every step once a word, a pattern only where a word is long enough or has an apostrophe."""
    bare = F.transform(F.transform(tokens, folded), lambda w: F.when(F.contains(w, F.lit("'")) | F.contains(w, F.lit("’")), F.regexp_replace(w, r"^[^'’]*['’]", "")).otherwise(w))
    stems = F.transform(bare, lambda w: F.when(F.length(w) >= 7, F.regexp_replace(w, _SUFFIX, "$1")).otherwise(w))
    return F.transform(stems, lambda w: F.when(F.length(w) >= 6, F.regexp_replace(w, r"[aeio]$", "")).otherwise(w))
