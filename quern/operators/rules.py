"""Rule tables as data, and matching of texts and codes against them.

A rule has a domain, a category, phrases and code prefixes. Texts meet phrases
as one literal pattern per rule inside a single scan, so a text is read once
however many rules there are; no row is multiplied before it has matched.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import code_has_prefix
from ..functions.text import phrase_pattern, segments


@dataclass(frozen=True)
class Rule:
    domain: str
    category: str
    phrases: tuple[str, ...]
    prefixes: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.domain}:{self.category}"


def _plain(text: Column) -> Column:
    """One spelling for all that a pattern takes as equal in case."""
    return F.lower(F.upper(text))


def matched_rules(text: Column, rules: Sequence[Rule]) -> Column:
    """Array of struct(category, phrases) of the rules with a phrase in the text, phrases sorted.

    Phrases of a single word can't overlap, so one pattern finds all of them;
    others may hold one another and are looked for one by one.
    """
    phrases = sorted({p for r in rules for p in r.phrases})
    single = [p for p in phrases if re.fullmatch(r"\w+", p)]
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(phrase_pattern(*single)), F.lit(0)), _plain)) if single else F.array().cast("array<string>")
    longer = F.array_compact(F.array(*[F.when(text.rlike(phrase_pattern(p)), F.lit(p.upper().lower())) for p in phrases if p not in single]).cast("array<string>"))

    def rows(words: Column) -> Column:
        of = [F.struct(F.lit(r.key).alias("category"), F.filter(F.array(*[F.lit(p) for p in sorted(r.phrases)]), lambda p: F.array_contains(words, _plain(p))).alias("phrases")) for r in rules]
        return F.filter(F.array(*of), lambda m: F.size(m["phrases"]) > 0)

    return F.coalesce(F.element_at(F.transform(F.array(F.concat(found, longer)), rows), 1), F.array().cast("array<struct<category:string,phrases:array<string>>>"))


def rule_segments(df: DataFrame, key: str, text: str, rules: Sequence[Rule]) -> DataFrame:
    """Segments of each text with the rules they match: key, segment_no, segment, start, end, matches."""
    return segments(df, key, text).withColumn("matches", matched_rules(F.col("segment"), rules))


def extracted(found: DataFrame, key: str) -> DataFrame:
    """One row per key, category and supporting segment, from rule_segments."""
    each = found.select(key, "segment_no", "segment", "start", "end", F.explode_outer("matches").alias("m")).where("m is not null")
    return each.select(key, F.col("m.category").alias("category"), "segment_no", "start", "end", "segment", F.col("m.phrases").alias("phrases"))


def extraction_summary(found: DataFrame, key: str) -> DataFrame:
    """Per key: components (distinct categories), unmatched segments, and whether a model has to look at the text.

    That is so if any segment matches no rule, or nothing matches at all.
    """
    per = found.select(F.col(key).alias(key), F.size("matches").alias("__hits"), F.transform("matches", lambda m: m["category"]).alias("categories"))
    out = per.groupBy(key).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("categories")))).cast("long").alias("components"),
        F.count_if(F.col("__hits") == 0).alias("unmatched_segments"),
    )
    return out.withColumn("needs_model", (F.col("unmatched_segments") > 0) | (F.col("components") == 0))


def candidate_rules(text: Column, codes: Column, rules: Sequence[Rule]) -> Column:
    """Categories of the rules that a notice is a candidate for: a phrase in its text, or a code prefix."""
    hits = []
    for r in rules:
        by_code = code_has_prefix(codes, F.array(*[F.lit(p) for p in r.prefixes])) if r.prefixes else F.lit(False)
        by_text = F.coalesce(text.rlike(phrase_pattern(*r.phrases)), F.lit(False)) if r.phrases else F.lit(False)
        hits.append(F.when(by_text | by_code, F.lit(r.key)))
    return F.filter(F.array(*hits), lambda c: c.isNotNull())


def suggested_codes(codes: DataFrame, key: str, mapping: DataFrame) -> DataFrame:
    """Distinct (key, code, category) of the rows of codes (key, code) that a mapping (code, category) knows."""
    return codes.join(mapping, "code").select(key, "code", "category").distinct()


def supporting_segment(found: DataFrame, key: str) -> DataFrame:
    """Per key and category the first supporting segment and all phrases found: the component's evidence span."""
    rows = extracted(found, key)
    return rows.groupBy(key, "category").agg(
        F.min_by(F.struct("start", "end", "segment"), "start").alias("first"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("phrases")))).alias("phrases"), F.count(F.lit(1)).alias("segments")
    ).select(key, "category", "first.start", "first.end", "first.segment", "phrases", "segments")


def boundary_unclear(text: Column, identifiers: str, counts: str) -> Column:
    """Whether a text speaks of more than one thing: several identifiers (group 1 of a pattern, case ignored), or a count above 1."""
    names = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(identifiers), F.lit(1)), lambda x: F.lower(x)))
    many = F.exists(F.regexp_extract_all(text, F.lit(counts), F.lit(1)), lambda x: x.try_cast("int") > 1)
    return F.coalesce((F.size(names) > 1) | many, F.lit(False))


def normalised_hits(words: Column, phrases: Sequence[str]) -> Column:
    """How many runs of normalised words equal one of the phrases, whose words are normalised likewise; words: an array column."""
    choice = "|".join(rf"\Q{p}\E" for p in phrases)
    return F.regexp_count(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(f"(?<= )(?:{choice})(?= )")).cast("long")


def gated_occurrences(df: DataFrame, text: str, gate: Column, rules: Sequence[Rule]) -> DataFrame:
    """Rows of df with rule and hits: occurrences of the phrases of the rules whose domain the row's gate names."""
    counts = F.array(*[F.struct(F.lit(r.key).alias("rule"), F.when(gate == r.domain, F.regexp_count(text, F.lit(phrase_pattern(*r.phrases)))).alias("hits")) for r in rules])
    return df.withColumn("found", F.explode(F.filter(counts, lambda c: c["hits"] > 0))).select(*df.columns, "found.rule", F.col("found.hits").cast("long").alias("hits"))
