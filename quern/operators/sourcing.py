"""Source packages: documents, the requirements taken from them, and what may be reused of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import has_shape
from ..functions.text import not_blank

# Kinds of requirements with a boundary, and the inputs that a boundary in euros or months may bind to.
EURO_KINDS, MONTH_KINDS = ("MINIMUM_EUR", "MAXIMUM_EUR"), ("MINIMUM_MONTHS", "MAXIMUM_MONTHS")
EURO_INPUTS, MONTH_INPUT = ("proposed_project_cost_eur", "proposed_funding_eur"), "proposed_duration_months"
BLOCKED, FACTS_ONLY = "BLOCKED", "FACT_EXTRACTION_ONLY"


def package_violations(documents: DataFrame, requirements: DataFrame) -> DataFrame:
    """package_id, item (document or requirement id) and violation.

    Of documents (package_id, document_id, reuse_mode, reuse_url, reuse_note,
    sha256): `repeated`, `digest` (not 64 hex digits), `reuse_basis` (no address
    or no note), `blocked`. Of requirements (package_id, requirement_id,
    document_id, kind, boundary, input, source_text): `repeated`,
    `no_document` (none of that id in the package), `boundary` (a mechanical
    kind without one, another with one, or a negative one), `input` (not one
    that the kind binds to), `text_not_reusable` (text from a document of which
    only facts may be taken).

    Requirements meet their document by package and id; a null id meets none.
    """
    same_document, same_requirement = ["package_id", "document_id"], ["package_id", "requirement_id"]
    said = lambda c: not_blank(F.col(c)).isNotNull()
    docs = documents.groupBy(*same_document).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(~has_shape(F.col("sha256"), "[0-9a-fA-F]{64}")).alias("digest"), F.bool_or(~(said("reuse_url") & said("reuse_note"))).alias("basis"),
        F.coalesce(F.bool_or(F.col("reuse_mode") == BLOCKED), F.lit(False)).alias("blocked"), F.coalesce(F.bool_or(F.col("reuse_mode") == FACTS_ONLY), F.lit(False)).alias("facts_only"),
    )
    of_docs = F.array_compact(F.array(F.when(F.col("n") > 1, F.lit("repeated")), F.when(F.col("digest"), F.lit("digest")), F.when(F.col("basis"), F.lit("reuse_basis")), F.when(F.col("blocked"), F.lit("blocked"))))
    first = docs.select("package_id", F.col("document_id").alias("item"), F.explode(of_docs).alias("violation"))

    kind, bound = F.col("kind"), F.col("input")
    euros, months = F.coalesce(kind.isin(*EURO_KINDS), F.lit(False)), F.coalesce(kind.isin(*MONTH_KINDS), F.lit(False))
    fits = F.when(euros, bound.isin(*EURO_INPUTS)).when(months, bound == MONTH_INPUT).otherwise(bound.isNull())
    joined = requirements.join(docs.select(*same_document, "facts_only", F.lit(True).alias("known")), same_document, "left")
    wrong = F.array_compact(F.array(
        F.when(F.col("known").isNull(), F.lit("no_document")), F.when(((euros | months) != F.col("boundary").isNotNull()) | F.coalesce(F.col("boundary") < 0, F.lit(False)), F.lit("boundary")),
        F.when(~F.coalesce(fits, F.lit(False)), F.lit("input")), F.when(F.coalesce(F.col("facts_only"), F.lit(False)) & said("source_text"), F.lit("text_not_reusable")),
    ))
    second = joined.select("package_id", F.col("requirement_id").alias("item"), F.explode(wrong).alias("violation"))
    again = requirements.groupBy(*same_requirement).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("package_id", F.col("requirement_id").alias("item"), F.lit("repeated").alias("violation"))
    return first.unionByName(second).unionByName(again)
