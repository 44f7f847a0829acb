"""Search, relevance and publication of opportunities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_SIZES = (10, 25, 50)


def opportunities(projects: DataFrame, components: DataFrame, key: str) -> DataFrame:
    """One row per project and component; a project without a component keeps one row with nulls."""
    return projects.join(components, key, "left")


def relevance_score(in_domain: Column, has_code: Column, in_place: Column, large_enough: Column) -> Column:
    """How many of four checks hold; null counts as not."""
    score = F.lit(0)
    for check in (in_domain, has_code, in_place, large_enough):
        score = score + F.coalesce(check, F.lit(False)).cast("int")
    return score.cast("long")


def relevance_label(score: Column, has_profile: Column | None = None) -> Column:
    """All four checks: HIGH; three: MEDIUM; two: LOW; else NOT_RELEVANT. Without a profile to check against: LOW."""
    label = F.when(score == 4, "HIGH").when(score == 3, "MEDIUM").when(score == 2, "LOW").otherwise("NOT_RELEVANT")
    return label if has_profile is None else F.when(F.coalesce(has_profile, F.lit(False)), label).otherwise("LOW")


def criterion(values: Column, wanted: Column) -> Column:
    """Whether an array of values meets an array of wanted ones; an empty criterion is met."""
    return (F.size(wanted) == 0) | F.coalesce(F.arrays_overlap(values, wanted), F.lit(False))


def prefix_criterion(codes: Column, prefixes: Column) -> Column:
    """Whether any code starts with any prefix; an empty criterion is met, no codes meet only that."""
    return (F.size(prefixes) == 0) | F.coalesce(F.exists(codes, lambda c: F.exists(prefixes, lambda p: F.startswith(c, p))), F.lit(False))


def searched(df: DataFrame, words: str | None, fields: list[str], **equal) -> DataFrame:
    """Rows whose fields together hold the words (in any case) and whose other columns equal what is given."""
    if words:
        df = df.where(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(words.lower())))
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` of a total order, from 1 and no further than the last one; size falls back to the least permitted one.

    For a page that is not the first, rows are counted up to its first one: as
    many as that, and the page is there; fewer, and they are all.
    """
    size = size if size in PAGE_SIZES else PAGE_SIZES[0]
    if number > 1:
        before = (number - 1) * size
        found = df.limit(before + 1).count()
        number = number if found > before else max(1, -(-found // size))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def status_text(state: Column) -> Column:
    """What a state says to a reader."""
    return (
        F.when(state == "OPEN", "No procurement match found up to the cutoff")
        .when(state == "CLOSED", "Procurement found")
        .when(state == "PARTIAL", "Procurement found for some components")
        .otherwise("Evidence does not decide")
    )


def source_kind(title: Column, scope: Column) -> Column:
    return F.when(F.trim(title) == F.trim(scope), "Project title").otherwise("Project description")
