"""Content hashes, deterministic identifiers, and hash order."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(*columns: str) -> Column:
    """Compact JSON of the columns in alphabetical order, nulls included."""
    return F.to_json(F.struct(*[F.col(c).alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def content_digest(*columns: str) -> Column:
    return F.sha2(canonical_json(*columns), 256)


def short_id(prefix: str, *parts: Column, length: int = 20) -> Column:
    """prefix and the first digits of the SHA-256 of the parts joined by '|'."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length))


def hash_rank(seed: str, key: Column, separator: str = "\0") -> Column:
    """SHA-256 of seed, separator and key: a fixed random order."""
    return F.sha2(F.concat(F.lit(seed), F.lit(separator), key.cast("string")), 256)


def uuid5(namespace: str, name: Column) -> Column:
    """Version 5 UUID of a name, as lower-case text."""
    space = F.unhex(F.lit(uuid.UUID(namespace).hex))
    h = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    part = lambda start, n: F.substring(h, start, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def set_digest(df: DataFrame, column: str) -> DataFrame:
    """SHA-256 over all rows of a column, whatever their order and repeats: one row (n, digest).

    Row digests are summed as numbers of 4 x 16 hex digits, so nothing is gathered in one place.
    """
    h = df.select(F.sha2(F.col(column).cast("string"), 256).alias("h")).distinct()
    parts = [F.sum(F.conv(F.substring("h", 16 * i + 1, 16), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)]
    total = h.agg(F.count(F.lit(1)).alias("n"), *parts)
    return total.select("n", F.sha2(F.concat_ws("|", "n", *[F.col(f"p{i}").cast("string") for i in range(4)]), 256).alias("digest"))
