"""Procurement notices: pages of JSON from the landing zone, canonical rows, complete collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checks import CheckFailed, require_empty
from ..functions.codes import calendar_date, whole_euros
from ..functions.text import not_blank

#: A page as it is stored: fixed field names of this library. Texts come by language.
PAGE = """notices array<struct<notice_id: array<string>, publication_date: string, title: map<string, string>, description: map<string, string>,
codes: array<string>, nuts: array<string>, reference: array<string>, amount: decimal(38, 4), currency: string, award_date: string, contract_date: string, url: string>>,
total bigint, next_token string, timed_out boolean"""
LANGUAGES = ("eng", "por", "ita")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages at a path; one that isn't such JSON fails whatever reads it."""
    return spark.read.schema(PAGE).option("mode", "FAILFAST").json(path)


def first_language(texts: Column, languages: tuple[str, ...] = LANGUAGES) -> Column:
    """The first non-blank text in the preferred languages, else any."""
    choices = [not_blank(F.try_element_at(texts, F.lit(x))) for x in languages]
    return F.coalesce(*choices, F.try_element_at(F.filter(F.map_values(texts), lambda t: not_blank(t).isNotNull()), F.lit(1)))


def clean_list(values: Column) -> Column:
    """Trimmed values, blanks left out; null counts as none."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != "")


def canonical_notices(pages: DataFrame) -> DataFrame:
    """One row per notice of each page."""
    n = pages.select(F.explode("notices").alias("n"))
    first = lambda c: F.try_element_at(clean_list(F.col(c)), F.lit(1))
    return n.select(
        first("n.notice_id").alias("notice_id"), calendar_date(F.col("n.publication_date")).alias("publication_date"), calendar_date(F.col("n.award_date")).alias("award_date"),
        calendar_date(F.col("n.contract_date")).alias("contract_date"), first_language(F.col("n.title")).alias("title"), first_language(F.col("n.description")).alias("description"),
        clean_list(F.col("n.codes")).alias("codes"), first("n.nuts").alias("nuts"), first("n.reference").alias("reference"), whole_euros(F.col("n.amount"), F.col("n.currency")).alias("value_eur"), "n.url",
    )


def deduplicated(notices: DataFrame, keys: tuple[str, ...] = ("notice_id", "publication_date")) -> DataFrame:
    """Each notice once; notices without a key are an error."""
    require_empty(notices.where(" or ".join(f"{k} is null" for k in keys)).limit(5), "notices without identity")
    return notices.dropDuplicates(list(keys))


def completeness(pages: DataFrame) -> DataFrame:
    """One row for the pages of a run: notices (distinct ids), the highest total told, and why the run stopped.

    timed_out: a page did. complete: the total was reached, or none was told,
    and the last page is there. count_mismatch: an empty page came before the
    total was reached. missing_iteration_token: the last page names no next one,
    too early. max_pages: every page names a next one.
    """
    ids = pages.select(F.explode("notices").alias("n")).agg(F.count_distinct("n.notice_id", "n.publication_date").alias("found"))
    any_page = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    told = pages.agg(
        F.max("total").alias("total"), any_page(F.col("timed_out")).alias("timed_out"), any_page(F.size("notices") == 0).alias("empty"), any_page(not_blank(F.col("next_token")).isNull()).alias("last")
    )
    enough = F.col("total").isNull() | (F.col("found") == F.col("total"))
    reason = (
        F.when(F.col("timed_out"), "timed_out")
        .when(F.col("empty"), F.when(enough, "complete").otherwise("count_mismatch"))
        .when(F.col("last"), F.when(enough, "complete").otherwise("missing_iteration_token"))
        .otherwise("max_pages")
    )
    return ids.crossJoin(told).select("found", "total", reason.alias("stop_reason"))  # one row each


def disjoint(df: DataFrame, key: str, segment: str) -> DataFrame:
    """df, after a check in one pass that no key is null, in two segments, or twice in one."""
    bad = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col(key).isNull() | (F.col("n") > 1))
    require_empty(bad, f"keys without identity, or in more than one {segment}")
    return df


def merged_segments(segments: list[DataFrame], key: str) -> DataFrame:
    """The union of disjoint segments; a key in two of them, or without a value, is an error."""
    if not segments:
        raise CheckFailed("no segment")
    union = segments[0]
    for s in segments[1:]:
        union = union.unionByName(s)
    return disjoint(union, key, "segment")
