"""Files as their publishers name things: lists of funded operations, pages of a notice search, project records, JSON lines.

Values of a notice may be a text, a list, or texts by language; whatever a page
holds beyond the allowlists is told as a violation, never passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checks import CheckFailed, require_columns, require_empty
from ..functions.codes import calendar_date, whole_euros
from ..functions.text import not_blank
from .notices import LANGUAGES, first_language
from .operations import HEADER, read_operation_lists

# The published header of an operation list, in order.
LIST_HEADER = (
    "CodiceProgramma_ProgrammeID", "Programma_Programme", "CodiceLocaleProgetto_OperationLocalIdentifier", "CodiceUnicoProgetto_UniqueProjectCode",
    "TitoloProgetto_OperationName", "SintesiProgetto_OperationSummary", "DataAggiornamento_LastUpdate", "CodiceFiscaleBeneficiario_BeneficiaryTaxCode",
    "NomeBeneficiario_BeneficiaryName", "CostoTotale_TotalCost", "CostoAmmesso_TotalEligibleExpenditure", "Fondo_Fund", "Ciclo_Period",
    "CategoriaOperazione_CategoryIntervention", "ObiettivoSpecifico_SpecificObjective", "DataInizioOperazione_OperationStartDate", "DataFineOperazione_OperationEndDate",
    "TassoCofinanziamentoUE_EUCofinancingRate", "Paese_Country", "CodicePostale_Postcode",
)
#: The names of this library for the same columns, in the same order.
LIST_NAMES = (
    "programme_id", "programme", "local_id", "cup", "title", "summary", "updated_on", "beneficiary_id", "beneficiary", "total_cost", "eligible_cost", "fund", "period",
    "category", "objective", "start", "end", "eu_rate", "country", "postcode",
)
# Fields of a notice and of the page it comes in.
NOTICE_FIELDS = (
    "publication-number", "publication-date", "notice-title", "description-proc", "classification-cpv", "contract-nature", "procedure-type", "estimated-value-proc",
    "estimated-value-cur-proc", "place-of-performance-subdiv-proc", "eu-funds-identifier", "links",
)
PAGE_FIELDS = ("notices", "totalNoticeCount", "iterationNextToken", "timedOut")
# Fields of a project record.
PROJECT_FIELDS = (
    "operation_code", "first_seen_at", "project_title", "project_start", "project_end", "approved_funding_eur", "executed_funding_eur", "project_scope_text", "fund", "programme",
    "objective", "theme", "region", "municipality", "nuts_code", "source_url",
)


def read_published_lists(spark: SparkSession, path: str) -> DataFrame:
    """Rows of zipped lists under the published header, in the columns that operations() takes."""
    assert set(LIST_NAMES) == set(HEADER)
    return read_operation_lists(spark, path, LIST_HEADER, dict(zip(LIST_HEADER, LIST_NAMES)))


def listed(value: Column) -> Column:
    """The trimmed, non-blank texts of a value that is a text or a JSON list of texts; null has none."""
    items = F.when(value.startswith("["), F.from_json(value, "array<string>")).otherwise(F.array(value))
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), not_blank), lambda x: x.isNotNull())


def first_of(value: Column) -> Column:
    return F.get(listed(value), F.lit(0))


def by_language(value: Column, languages: tuple[str, ...] = LANGUAGES) -> Column:
    """The first text of a value that may be a text, a list, or a JSON object of those by language."""
    texts = F.when(value.startswith("{"), F.from_json(value, "map<string,string>")).otherwise(F.create_map(F.lit(""), value))
    return first_language(F.transform_values(texts, lambda _, v: first_of(v)), languages)


def read_search_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row for each page, a JSON object in a file of its own: page (a map of its fields, nested values as JSON text) and file."""
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return parsed_pages(text, "value")


def parsed_pages(df: DataFrame, text: str) -> DataFrame:
    """df with page, and notices (an array of maps of their fields), parsed from JSON text; both null where it isn't such an object."""
    pages = df.withColumn("page", F.when(F.trim(text).startswith("{"), F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"})))
    notices = F.try_element_at("page", F.lit("notices"))
    return pages.withColumn("notices", F.when(notices.startswith("["), F.from_json(notices, "array<map<string,string>>"))).drop(text)


def page_violations(pages: DataFrame, key: str) -> DataFrame:
    """key and violation of pages: `not_json`, `field <name>` (of a page or notice, outside the allowlist), `no_notices`,
    `no_timed_out`, `not_a_list`, and `identity` for notices without number, date or title."""
    outside = lambda keys, allowed: F.array_except(keys, F.array(*[F.lit(f) for f in allowed]))
    notice = F.coalesce("notices", F.array().cast("array<map<string,string>>"))
    unknown = F.concat(outside(F.map_keys("page"), PAGE_FIELDS), outside(F.flatten(F.transform(notice, F.map_keys)), NOTICE_FIELDS))
    lacks = lambda n: first_of(F.try_element_at(n, F.lit("publication-number"))).isNull() | first_of(F.try_element_at(n, F.lit("publication-date"))).isNull() | by_language(F.try_element_at(n, F.lit("notice-title"))).isNull()
    of_page = F.array_compact(F.concat(
        F.transform(F.array_distinct(unknown), lambda f: F.concat(F.lit("field "), f)),
        F.array(
            F.when(~F.map_contains_key("page", "notices"), F.lit("no_notices")), F.when(~F.map_contains_key("page", "timedOut"), F.lit("no_timed_out")),
            F.when(F.map_contains_key("page", "notices") & F.col("notices").isNull(), F.lit("not_a_list")), F.when(F.exists(notice, lacks), F.lit("identity")),
        ),
    ))
    return pages.select(key, F.explode(F.when(F.col("page").isNull(), F.array(F.lit("not_json"))).otherwise(of_page)).alias("violation"))


def published_notices(pages: DataFrame, key: str, url: str = "https://ted.europa.eu/en/notice/-/detail/") -> DataFrame:
    """Canonical rows of the notices of pages: as canonical_notices gives them, with nature, procedure and all places.

    Only whole amounts in euros count. A notice whose links hold no https
    address gets the published form of one, url and its number.
    """
    n = pages.select(key, F.explode("notices").alias("__notice"))
    field = lambda name: F.try_element_at("__notice", F.lit(name))
    number = first_of(field("publication-number"))
    links = F.from_json(field("links"), "map<string,string>")
    https = [F.when(F.try_element_at(links, F.lit(k)).startswith("https://"), F.try_element_at(links, F.lit(k))) for k in ("html", "xml", "pdf")]
    return n.select(
        key, number.alias("notice_id"), calendar_date(first_of(field("publication-date"))).alias("publication_date"), by_language(field("notice-title")).alias("title"), by_language(field("description-proc")).alias("description"),
        listed(field("classification-cpv")).alias("codes"), first_of(field("contract-nature")).alias("nature"), first_of(field("procedure-type")).alias("procedure"),
        whole_euros(field("estimated-value-proc").try_cast("decimal(38,6)"), field("estimated-value-cur-proc")).alias("value_eur"),
        first_of(field("place-of-performance-subdiv-proc")).alias("nuts"), first_of(field("eu-funds-identifier")).alias("reference"), F.coalesce(*https, F.concat(F.lit(url), number)).alias("url"),
    )


def project_records(records: DataFrame, provenance: str = "UNRESOLVED") -> DataFrame:
    """Projects from records of another source, whose columns are texts: blanks as nulls, dates and amounts typed.

    A column outside the allowlist is an error; so is a record without code,
    scope or address, and one with a date or an amount that can't be read.
    Columns of the allowlist that the source lacks are null.
    """
    require_columns(records, PROJECT_FIELDS)
    text = {c: (not_blank(F.col(c).cast("string")) if c in records.columns else F.lit(None).cast("string")) for c in PROJECT_FIELDS}
    typed = {c: F.try_to_date(text[c], "yyyy-MM-dd") for c in ("project_start", "project_end")}
    typed |= {c: F.when(text[c].rlike(r"^\d+$"), text[c].try_cast("long")) for c in ("approved_funding_eur", "executed_funding_eur")}
    typed["first_seen_at"] = F.try_to_timestamp(text["first_seen_at"])
    bad = F.array_compact(F.array(*[F.when(text[c].isNotNull() & t.isNull(), F.lit(c)) for c, t in typed.items()], *[F.when(text[c].isNull(), F.lit(c)) for c in ("operation_code", "project_scope_text", "source_url")]))
    rows = records.select(*[typed.get(c, text[c]).alias(c) for c in PROJECT_FIELDS], F.lit(provenance).alias("temporal_provenance"), bad.alias("__bad"))
    require_empty(rows.where(F.size("__bad") > 0).select("operation_code", "__bad"), "records can't be read")
    return rows.drop("__bad")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines under a schema; blank lines are passed over.

    A line that isn't such an object, or holds a field beyond the schema, is an
    error that tells the file and the start of the line; so is a table without
    a row.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(not_blank(F.col("value")).isNotNull())
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    row = F.from_json("value", f"{schema}, __corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"})
    parsed = lines.select("file", "value", row.alias("row"), F.from_json("value", "map<string,string>").alias("fields"))
    extra = F.size(F.array_except(F.map_keys("fields"), F.array(*[F.lit(n) for n in names]))) > 0
    bad = parsed.where(F.col("row").isNull() | F.col("row.__corrupt").isNotNull() | F.col("fields").isNull() | extra)
    require_empty(bad.select("file", F.substring("value", 1, 80).alias("line")), "lines can't be read")
    rows = parsed.select(*[F.col(f"row.{n}").alias(n) for n in names])
    if rows.limit(1).count() == 0:
        raise CheckFailed(f"{path} holds no rows")
    return rows
