"""Dossiers: composed from a source package, a snapshot and a validation release, and verifiable later.

A dossier is only composed where the release binds exactly this package and
this snapshot, the package is fresh and the references have their shapes. What
stands against it is told by name. Its payload is written as canonical JSON,
whose SHA-256 is the dossier's digest.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_value
from ..functions.codes import has_shape
from .ledger import package_state

TENANT, PURCHASE, DIGEST = r"org_[0-9a-f]{32}", r"[A-Za-z0-9_.:-]{1,128}", r"[0-9a-f]{64}"


def canonical(df: DataFrame, column: str) -> Column:
    """Canonical JSON of a nested column of df."""
    return canonical_value(F.col(column), df.schema[column].dataType)


def with_digest(df: DataFrame, column: str, digest: str) -> DataFrame:
    """df with the SHA-256 of a column's canonical JSON."""
    return df.withColumn(digest, F.sha2(canonical(df, column), 256))


def release_blocks(bindings: Mapping[str, tuple[Column, Column]]) -> list[tuple[str, Column]]:
    """A block for each field (bound value, actual value) that a release doesn't bind, or binds to something else."""
    out = []
    for field, (bound, actual) in bindings.items():
        out += [(f"release_lacks_{field}", bound.isNull()), (f"release_differs_{field}", bound.isNotNull() & ~bound.eqNullSafe(actual))]
    return out


def request_blocks(tenant: Column, purchase: Column, complete: Column, invalidated_at: Column, fresh_until: Column, created_at: Column, digests: Mapping[str, Column]) -> list[tuple[str, Column]]:
    """Blocks of a request itself: references without their shape, a package that isn't fresh when the dossier is made, digests that are none."""
    state = package_state(complete, invalidated_at, fresh_until, created_at)
    return [
        ("tenant", ~has_shape(tenant, TENANT)), ("purchase", ~has_shape(purchase, PURCHASE)), ("created_at", created_at.isNull()),
        *[(f"package_{s.lower()}", state == s) for s in ("INCOMPLETE", "INVALIDATED", "REFRESH_REQUIRED")],
        *[(f"digest_{name}", ~has_shape(c, DIGEST)) for name, c in digests.items()],
    ]


def forbidden_words(texts: Sequence[Column], phrases: Sequence[str]) -> list[tuple[str, Column]]:
    """A block if a generated text holds a phrase that no dossier may use, in any case."""
    every = F.lower(F.concat_ws("\n", *texts))
    return [(f"phrase_{p.replace(' ', '_')}", F.contains(every, F.lit(p.lower()))) for p in phrases]


def composed(df: DataFrame, key: str, payload: Column, blocks: Sequence[tuple[str, Column]]) -> DataFrame:
    """key, blocks (names, in order), payload, canonical and digest: the latter three null where something blocks."""
    named = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in blocks]))
    rows = df.select(key, named.alias("blocks"), payload.alias("payload"))
    text = F.when(F.size("blocks") == 0, canonical(rows, "payload"))
    out = rows.withColumn("canonical", text).withColumn("digest", F.sha2("canonical", 256))
    return out.withColumn("payload", F.when(F.size("blocks") == 0, F.col("payload")))


def dossier_violations(dossiers: DataFrame, key: str) -> DataFrame:
    """key and violation of kept dossiers (payload, canonical, digest): `digest` if the bytes are not what it tells, `payload`
    if the payload's canonical form is not the bytes. Blocked ones, which have neither, pass."""
    again = canonical(dossiers, "payload")
    whole = F.col("canonical").isNotNull() | F.col("digest").isNotNull()
    found = F.array_compact(F.array(
        F.when(whole & ~F.col("digest").eqNullSafe(F.sha2("canonical", 256)), F.lit("digest")),
        F.when(whole & ~F.col("canonical").eqNullSafe(F.when(F.col("payload").isNotNull(), again)), F.lit("payload")),
    ))
    return dossiers.select(key, F.explode(found).alias("violation"))
