"""The public view of projects: nested rows made in one aggregation, with what must not be shown told as violations.

A row of the view holds a project's wording with its offsets, its components
with the span each rests on, and the procurement matches of each. Whatever is
not exactly supported is a violation of the row, and safe_view leaves out, or
refuses, rows that have any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_value
from ..functions.text import is_verbatim, trimmed
from .matching import CLOSED, OPEN, rolled_up_state

ACCEPTED = "HIGH_CONFIDENCE"


def wording(title: Column, scope: Column) -> Column:
    """struct(type, text, start, end): the scope text without white space around it, its code-point offsets, and whether it is but the title."""
    text = trimmed(scope)
    start = F.length(scope) - F.length(F.regexp_replace(scope, r"(?U)\A\s+", ""))
    kind = F.when(F.coalesce(trimmed(title) == text, F.lit(False)), "Project title").otherwise("Project description")
    return F.struct(kind.alias("type"), text.alias("text"), start.cast("long").alias("start"), (start + F.length(text)).cast("long").alias("end"))


def match_violations(found: Column) -> Column:
    """Violations of an accepted candidate (field, title, scope, text, start, end): no exact evidence, or not verbatim."""
    source = F.when(found["field"] == "TITLE", found["title"]).when(found["field"] == "SCOPE_DESCRIPTION", found["scope"])
    lacks = found["field"].isNull() | found["text"].isNull() | found["start"].isNull() | found["end"].isNull()
    verbatim = F.coalesce((found["start"] >= 0) & (found["end"] >= found["start"]) & is_verbatim(source, found["start"], found["end"], found["text"]), F.lit(False))
    return F.when(lacks, F.lit("match_without_evidence")).when(~verbatim, F.lit("match_not_verbatim"))


def component_views(components: DataFrame, candidates: DataFrame) -> DataFrame:
    """key, and component: struct(component_id, category, state, span, matches, violations), for components
    (key, component_id, category, state, scope_evidence, spans, evidence_ids) and their candidates
    (component_id, evidence_id, disposition, notice_id, published, title, scope, field, text, start, end).

    spans: array of struct(text, start, end), the first being the primary one.
    Candidates meet their component by its id, and are gathered per component:
    as many as were judged for it.
    """
    accepted = candidates.where(F.col("disposition") == ACCEPTED).groupBy("component_id").agg(
        F.array_sort(F.collect_list(F.struct("evidence_id", "notice_id", "published", "title", "scope", "field", "text", "start", "end"))).alias("accepted")
    )
    joined = components.join(accepted, "component_id", "left").withColumn("accepted", F.coalesce("accepted", F.array().cast(accepted.schema["accepted"].dataType)))
    ids = F.transform("accepted", lambda a: a["evidence_id"])
    told = F.coalesce("evidence_ids", F.array().cast("array<string>"))
    primary, state = F.get("spans", F.lit(0)), F.col("state")
    flags = F.array_compact(F.concat(
        F.array(
            F.when(primary.isNull(), F.lit("no_span")),
            F.when(primary.isNotNull() & ~F.coalesce((primary["end"] > primary["start"]) & (primary["text"] == F.col("scope_evidence")), F.lit(False)), F.lit("span_differs")),
            F.when((state == CLOSED) & ~F.array_sort(told).eqNullSafe(F.array_sort(F.array_distinct(ids))), F.lit("closed_ids_differ")),
            F.when((state == CLOSED) & (F.size(ids) == 0), F.lit("closed_without_evidence")),
            F.when((state == OPEN) & (F.size(told) > 0), F.lit("open_with_evidence")),
            F.when(F.size(ids) != F.size(F.array_distinct(ids)), F.lit("evidence_repeated")),
        ),
        F.transform("accepted", match_violations),
    ))
    shown = F.transform("accepted", lambda a: F.struct(a["evidence_id"].alias("evidence_id"), a["notice_id"].alias("notice_id"), a["published"].cast("string").alias("published"), a["title"].alias("title"), F.struct(a["field"].alias("field"), a["text"].alias("text"), a["start"].alias("start"), a["end"].alias("end")).alias("evidence")))
    view = F.struct("component_id", "category", "state", primary.alias("span"), shown.alias("matches"), F.array_distinct(flags).alias("violations"))
    return joined.select("key", view.alias("component"))


def public_view(projects: DataFrame, components: DataFrame, candidates: DataFrame) -> DataFrame:
    """key, wording, state, components, violations and digest of projects (key, title, scope, url and more, which are left out).

    A project without a component is UNRESOLVED. violations: the project's own
    (`no_wording`, `span_not_in_wording`) and its components', sorted. The
    digest is the SHA-256 of the canonical JSON of all that is shown.
    """
    gathered = component_views(components, candidates).groupBy("key").agg(F.array_sort(F.collect_list("component")).alias("components"))
    joined = projects.select("key", "title", "scope", "url").join(gathered, "key", "left").withColumn("components", F.coalesce("components", F.array().cast(gathered.schema["components"].dataType)))
    outside = F.exists("components", lambda c: c["span"].isNotNull() & ~F.coalesce((c["span"]["start"] >= 0) & is_verbatim(F.col("scope"), c["span"]["start"], c["span"]["end"], c["span"]["text"]), F.lit(False)))
    own = F.array(F.when(~F.coalesce(trimmed(F.col("scope")) != "", F.lit(False)), F.lit("no_wording")), F.when(outside, F.lit("span_not_in_wording")))
    every = F.array_sort(F.array_distinct(F.array_compact(F.concat(own, F.flatten(F.transform("components", lambda c: c["violations"]))))))
    rows = joined.select("key", "url", wording(F.col("title"), F.col("scope")).alias("wording"), rolled_up_state(F.transform("components", lambda c: c["state"])).alias("state"), "components", every.alias("violations"))
    rows = rows.withColumn("components", F.transform("components", lambda c: c.dropFields("violations")))
    shown = ["key", "url", "wording", "state", "components"]
    digest = F.sha2(canonical_value(F.struct(*shown), rows.select(*shown).schema), 256)
    return rows.withColumn("digest", digest)


def safe_view(view: DataFrame) -> DataFrame:
    """The rows that may be shown: those without a violation."""
    return view.where(F.size("violations") == 0).drop("violations")
