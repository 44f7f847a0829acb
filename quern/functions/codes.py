"""Code and identifier predicates: prefixes, hierarchies, references, shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(code: Column) -> Column:
    return F.regexp_replace(code, r"\D", "")


def code_has_prefix(codes: Column, prefixes: Column) -> Column:
    """Whether the digits of any code start with any prefix; false if either array is empty or null."""
    hit = F.exists(F.transform(codes, digits), lambda c: F.exists(prefixes, lambda p: F.startswith(c, p)))
    return F.coalesce(hit, F.lit(False))


def same_reference(code: Column, reference: Column, aliases: Column | None = None) -> Column:
    """Whether a reference is a code or one of its aliases (an array), ends trimmed and case ignored; false for null and blank."""
    plain = lambda c: F.lower(F.trim(c))
    hit = F.coalesce(plain(code) == plain(reference), F.lit(False))
    if aliases is not None:
        hit = hit | F.coalesce(F.exists(aliases, lambda a: F.coalesce(plain(a) == plain(reference), F.lit(False))), F.lit(False))
    return hit & F.coalesce(plain(reference) != "", F.lit(False))


def reference_keys(code: Column, aliases: Column) -> Column:
    """Distinct keys of a code and its aliases to look references up by: trimmed, lower case, none blank."""
    every = F.transform(F.concat(F.array(code), F.coalesce(aliases, F.array().cast("array<string>"))), lambda c: F.lower(F.trim(c)))
    return F.array_distinct(F.filter(every, lambda c: c.isNotNull() & (c != "")))


def in_hierarchy(code: Column, others: Column) -> Column:
    """Whether a code equals, or is above or below, one of the codes in a pipe-separated list."""
    own = F.lower(F.trim(code))
    parts = F.transform(F.split(others, r"\|"), lambda c: F.lower(F.trim(c)))
    hit = F.exists(parts, lambda c: (c != "") & (F.startswith(c, own) | F.startswith(own, c)))
    return F.coalesce(hit & (own != ""), F.lit(False))


def has_shape(c: Column, pattern: str) -> Column:
    """Whether all of the text has a shape; false for null, and a newline at the end doesn't pass."""
    return F.coalesce(c.rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def whole_euros(amount: Column, currency: Column) -> Column:
    """An amount as whole euros: null, never rounded, if it is fractional, negative or in another currency."""
    return F.when((F.upper(currency) == "EUR") & (amount >= 0) & (amount == F.floor(amount)), amount.cast("long"))


def plain_decimal(text: Column, scale: int = 2) -> Column:
    """A decimal written with blanks and at most one comma or dot; null if blank, ambiguous or negative."""
    bare = F.regexp_replace(text, r"\s", "")
    return F.when(bare.rlike(r"^\d+([.,]\d+)?$"), F.replace(bare, F.lit(","), F.lit(".")).try_cast(f"decimal(38,{scale})"))


def calendar_date(text: Column) -> Column:
    """The date of an ISO date with an optional zone, which is ignored; null for anything else."""
    return F.try_to_date(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})(?:Z|[+-]\d{2}:\d{2})?$", 1), "yyyy-MM-dd")


def title_or_location(title: Column, geography: Column, *texts: Column) -> Column:
    """Whether the place agrees, or one of the texts holds the whole title (ends trimmed, case ignored); a blank title is held by none."""
    needle = F.lower(F.trim(title))
    held = F.lit(False)
    for text in texts:
        held = held | F.coalesce(F.contains(F.lower(text), needle), F.lit(False))
    return F.coalesce(geography, F.lit(False)) | (F.coalesce(needle != "", F.lit(False)) & held)
