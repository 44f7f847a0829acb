"""Word families: Unicode folding, derivational families, ordered suffixes.

Folding maps each character for itself (case folding, compatibility
decomposition, combining marks dropped), so one table of characters does it.
Characters that fold to one other are translated in the JVM; texts with
characters that fold to several (ligatures, sharp s, Hangul) pass through one
Arrow function, which gets nulls for all other rows.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Letters of a word: letters of any script and number signs that aren't decimal digits.
LETTER = r"\p{L}\p{Nl}\p{No}"
WORD, GAP = rf"[{LETTER}]+(?:'[{LETTER}]+)?", rf"[^{LETTER}]+"

# Families of words (stem, endings, family), verb suffixes, and suffixes of nouns and adjectives, in this order.
FAMILIES = (
    ("riqualific", "azione azioni are ato ata ati ate ando ante anti", "riqualific"),
    ("efficientament", "o i", "efficient"),
    ("energetic", "o a i e", "energet"),
)
VERB_SUFFIXES = "erebbero irebbero arebbero assero essero issero avano evano ivano ando endo ato ata ati ate uto uta uti ute ito ita iti ite are ere ire"
NOUN_SUFFIXES = "zioni zione ici iche ico ica osi ose oso osa ali ale"


def fold(text: str) -> str:
    """Case folded, compatibility decomposed, without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str, str]:
    """Characters that fold to one other, what they fold to, and a character class of those that fold to none or several."""
    single, ranges = {}, []
    for n in range(128, sys.maxunicode + 1):
        if 0xD800 <= n < 0xE000:
            continue
        c = chr(n)
        f = fold(c)
        if len(f) == 1:
            if f != c:
                single[c] = f
        elif ranges and ranges[-1][1] == n - 1:
            ranges[-1][1] = n
        else:
            ranges.append([n, n])
    return "".join(single), "".join(single.values()), "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]"


@F.pandas_udf(StringType())
def _fold_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fold(t))


def folded(text: Column) -> Column:
    """fold() of a column: as a JVM translation but for characters that fold to none or several."""
    source, target, several = _tables()
    needs = text.rlike(rf"(?![\x00-\x7F]){several}")  # hundreds of ranges, tried one after another
    return F.when(text.rlike(r"\A[\x00-\x7F]*\z"), F.lower(text)).when(needs, _fold_all(F.when(needs, text))).otherwise(F.translate(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), source, target))


def _without_suffix(word: Column, suffixes: str, stem: int) -> Column:
    """The word without the suffix it ends in, null if none leaves a stem of so many letters. No suffix of a list ends in another."""
    return F.nullif(F.regexp_extract(word, rf"\A(.{{{stem},}})(?:{'|'.join(suffixes.split())})\z", 1), F.lit(""))


def family_of_folded(word: Column) -> Column:
    """The family of a folded word: what follows its last apostrophe, by derivational family, else without verb suffix,
    else without noun suffix, else (six letters or more) without a final vowel."""
    bare = F.element_at(F.split(F.replace(word, F.lit("’"), F.lit("'")), "'"), -1)
    out = F.lit(None).cast("string")
    for stem, endings, family in reversed(FAMILIES):
        out = F.when(bare.rlike(rf"\A{stem}(?:{'|'.join(endings.split())})\z"), family).otherwise(out)
    shorter = F.when((F.length(bare) >= 6) & F.substring(bare, -1, 1).isin(*"aeio"), F.substring(bare, F.lit(1), F.length(bare) - 1))
    return F.coalesce(out, _without_suffix(bare, VERB_SUFFIXES, 4), _without_suffix(bare, NOUN_SUFFIXES, 4), shorter, bare)


def family(word: Column) -> Column:
    return family_of_folded(folded(word))


def folded_words(words: Column) -> Column:
    """Each word of an array folded. The words are folded as one text, as an Arrow function can't stand inside a lambda."""
    return F.when(F.size(words) > 0, F.split(folded(F.array_join(words, "\n")), "\n")).otherwise(words)
