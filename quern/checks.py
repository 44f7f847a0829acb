"""Fail-closed checks: each is a query for violations, and no row means it passed."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CheckFailed(ValueError):
    """A check found violations."""


def require_empty(violations: DataFrame, message: str) -> None:
    """Raise if there is any violation; the message shows the first few."""
    found = violations.limit(5).collect()
    if found:
        raise CheckFailed(f"{message}: {[r.asDict() for r in found]}")


def column_paths(schema: T.StructType, prefix: str = "") -> set[str]:
    """Dotted names of all columns, nested ones too; no data is read."""
    out = set()
    for f in schema.fields:
        kind = f.dataType
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        out.add(prefix + f.name)
        if isinstance(kind, T.StructType):
            out |= column_paths(kind, f"{prefix}{f.name}.")
    return out


def require_columns(df: DataFrame, allowed: Iterable[str]) -> DataFrame:
    """df itself, if it has no column outside the allowlist."""
    extra = sorted(column_paths(df.schema) - set(allowed))
    if extra:
        raise CheckFailed(f"columns outside the allowlist: {extra}")
    return df


def forbidden_columns(df: DataFrame, fragments: Iterable[str]) -> list[str]:
    """Names of columns, nested ones too, that hold one of the fragments."""
    fragments = [f.lower() for f in fragments]
    return sorted(p for p in column_paths(df.schema) if any(f in p.lower() for f in fragments))


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def conflicting_keys(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Keys whose rows disagree on the columns, and the number of variants."""
    return df.groupBy(key).agg(F.count_distinct(F.struct(*columns)).alias("variants")).where("variants > 1")


def dangling(child: DataFrame, parent: DataFrame, on: str) -> DataFrame:
    """Child rows without a parent."""
    return child.join(parent.select(on), on, "left_anti")


def unmatched(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Keys that only one side has, and which side."""
    both = left.select(on, F.lit(True).alias("l")).distinct().join(right.select(on, F.lit(True).alias("r")).distinct(), on, "full_outer")
    return both.where("l is null or r is null").select(on, F.when(F.col("l").isNull(), "right").otherwise("left").alias("side"))


def not_in(part: DataFrame, whole: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys of part that whole lacks: none if part is a subset, and null is a key like any other."""
    return part.select(*keys).subtract(whole.select(*keys))


def labelled_rows(rows: DataFrame, labels: DataFrame, key: str, wanted: Column, required: str) -> DataFrame:
    """Rows whose key has a wanted label, by a semi-join. A wanted key without a row, or whose required text is blank, is an error."""
    chosen = labels.where(wanted).select(key).distinct()
    require_empty(chosen.join(rows.select(key), key, "left_anti"), f"labelled, but without a row: {key}")
    found = rows.join(chosen, key, "left_semi")
    require_empty(found.where(~F.coalesce(F.trim(required) != "", F.lit(False))).select(key), f"{required} is blank")
    return found


def broken_rules(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every row and rule (name: condition that must hold) that is false or null."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda r: r.isNotNull())
    return df.select(key, F.explode(failed).alias("rule"))
