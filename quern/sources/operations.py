"""Operation lists: zipped, semicolon-separated CSV files with a fixed header."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checks import CheckFailed, require_empty
from ..functions.codes import plain_decimal
from ..functions.text import first_text, not_blank

#: The columns of an operation list, in order: a fixed format of this library.
HEADER = (
    "programme_id", "programme", "local_id", "cup", "title", "summary", "updated_on", "total_cost", "eligible_cost", "fund",
    "period", "category", "objective", "start", "end", "eu_rate", "country", "postcode", "beneficiary_id", "beneficiary",
)
#: Columns that identify persons and are never read further.
DROPPED = ("beneficiary_id", "beneficiary")


def unzipped(content: bytes) -> str:
    """Text of the only CSV file in a ZIP archive."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [n for n in z.namelist() if n.lower().endswith(".csv")]
        if len(names) != 1:
            raise CheckFailed(f"expected one CSV file, found {names}")
        return z.read(names[0]).decode("utf-8-sig")


def read_operation_lists(spark: SparkSession, path: str, header: Sequence[str] = HEADER, names: Mapping[str, str] | None = None) -> DataFrame:
    """Rows of all zipped lists at a path, parsed where they lie; a different header, a malformed row or a list without rows rejects all.

    Returns the columns of the list but DROPPED, as text, under the names of
    this library (names: which one each column of the header has), and source_file.
    """
    own = [(names or {}).get(h, h) for h in header]
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(batches):
        import csv

        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                lines = csv.reader(io.StringIO(unzipped(content)), delimiter=";", strict=True)
                found = next(lines, None)
                if [h.strip() for h in found or []] != list(header):
                    raise CheckFailed(f"unexpected header in {name}: {found}")
                table = list(lines)
                if any(len(r) != len(header) for r in table):
                    raise CheckFailed(f"a row of {name} has another number of fields")
                if not table:
                    raise CheckFailed(f"{name} has no rows")
                yield pd.DataFrame(table, columns=own, dtype=str).drop(columns=[c for c in DROPPED if c in own]).assign(source_file=name)

    columns = [c for c in own if c not in DROPPED]
    return files.mapInPandas(rows, ", ".join(f"`{c}` string" for c in [*columns, "source_file"]))


def operations(lists: DataFrame) -> DataFrame:
    """Typed operations; any row with a bad date or amount, no text at all, or another update date rejects the batch."""
    day = lambda c: F.try_to_date(not_blank(F.col(c)), "yyyy-MM-dd")
    text = first_text(F.col("summary"), F.col("title"))
    typed = lists.select(
        "local_id", not_blank(F.col("cup")).alias("cup"), first_text(F.col("title"), F.col("summary")).alias("title"), text.alias("scope"),
        day("updated_on").alias("updated_on"), plain_decimal(F.col("total_cost")).alias("total_cost"), plain_decimal(F.col("eligible_cost")).alias("eligible_cost"),
        "fund", "period", "category", "objective", day("start").alias("start"), day("end").alias("end"), plain_decimal(F.col("eu_rate"), 10).alias("eu_rate"), "country", "postcode",
        F.array(*[F.when(not_blank(F.col(c)).isNotNull() & bad.isNull(), F.lit(c)) for c, bad in (
            ("updated_on", day("updated_on")), ("start", day("start")), ("end", day("end")), ("total_cost", plain_decimal(F.col("total_cost"))),
            ("eligible_cost", plain_decimal(F.col("eligible_cost"))), ("eu_rate", plain_decimal(F.col("eu_rate"), 10)))]).alias("bad"),
    ).withColumn("bad", F.filter("bad", lambda c: c.isNotNull()))
    require_empty(typed.where(F.expr("size(bad) > 0 or scope is null or updated_on is null") | not_blank(F.col("local_id")).isNull()).select("local_id", "bad"), "rows can't be read")
    require_empty(typed.select("updated_on").distinct().agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "more than one update date")
    return typed.drop("bad")


def funding_projects(ops: DataFrame) -> DataFrame:
    """Projects: code (CUP or local id), alias codes, whole euros (truncated), dates and scope; one row per local id."""
    euros: Column = F.col("total_cost").cast("decimal(38,2)").cast("long")
    rows = ops.select(F.coalesce("cup", "local_id").alias("code"), F.array_distinct(F.filter(F.array("cup", "local_id"), lambda c: c.isNotNull())).alias("aliases"), "local_id", "title", "scope", "start", "end", euros.alias("approved_eur"), "fund", "objective")
    require_empty(rows.groupBy("local_id").agg(F.count_distinct(F.to_json(F.struct("*"))).alias("n")).where("n > 1"), "conflicting rows of one operation")
    return rows.dropDuplicates(["local_id"])
