"""Sinks: JSON lines and CSV for readers, with a content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import canonical_json, set_digest


def json_lines(df: DataFrame) -> DataFrame:
    """One column `value`: each row as compact JSON with its keys in order, nulls included."""
    return df.select(canonical_json(*df.columns).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> str:
    """Write rows as JSON lines and return the digest of their set; the commit protocol keeps readers from half a table."""
    lines = json_lines(df)
    lines.write.mode("overwrite").text(path)
    return set_digest(df.sparkSession.read.text(path), "value").first()["digest"]


def csv_cells(df: DataFrame) -> DataFrame:
    """All columns as text, arrays joined by ' | '."""
    return df.select(*[(F.array_join(F.col(f.name).cast("array<string>"), " | ") if f.dataType.typeName() == "array" else F.col(f.name).cast("string")).alias(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    """Every cell quoted, quotes doubled, nulls empty."""
    csv_cells(df).fillna("").write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
