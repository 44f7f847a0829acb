"""Append-only versions: current rows, idempotent appends, states as of a time, lead days.

A version has version_id, logical_id, digest and supersedes (the version before
it, or null). Nothing is updated: writers append, readers look for the row that
no other supersedes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checks import require_empty
from ..functions.canonical import canonical_value
from ..functions.hashing import uuid5

#: Namespace of version ids, a fixed value of this library.
NAMESPACE = "5b4a7c1e-2f0d-5c3a-9e61-7d8f0a2b4c6d"


def version_id(kind: str, logical_id: Column, digest: Column, supersedes: Column) -> Column:
    return uuid5(NAMESPACE, F.concat_ws(":", F.lit(kind), logical_id.cast("string"), digest, F.coalesce(supersedes, F.lit("first"))))


def current_versions(versions: DataFrame) -> DataFrame:
    """The versions that none supersedes."""
    newer = versions.where("supersedes is not null").select(F.col("supersedes").alias("version_id"))
    return versions.join(newer, "version_id", "left_anti")


def append_plan(versions: DataFrame, incoming: DataFrame, kind: str) -> DataFrame:
    """Versions to append for incoming (logical_id, digest, ...): those whose digest isn't the current one's.

    An unchanged row needs no write; a change back to an earlier digest is a new
    version, as what it supersedes is part of its id.
    """
    now = current_versions(versions).select("logical_id", F.col("version_id").alias("supersedes"), F.col("digest").alias("now"))
    changed = incoming.join(now, "logical_id", "left").where(~F.col("digest").eqNullSafe(F.col("now"))).drop("now")
    return changed.withColumn("version_id", version_id(kind, F.col("logical_id"), F.col("digest"), F.col("supersedes")))


def versions_of(changes: DataFrame, logical_id: str, order: list[str], digest: str, kind: str) -> DataFrame:
    """All versions that a series of states gives: one for each state that differs from the one before it."""
    w = Window.partitionBy(logical_id).orderBy(*order)
    changed = changes.withColumn("before", F.lag(digest).over(w)).where(~F.col(digest).eqNullSafe(F.col("before"))).drop("before")
    return changed.withColumn("version_no", F.row_number().over(w).cast("long"))


def append(versions: DataFrame, path: str) -> None:
    """Write versions; a version_id that is there already is an error."""
    spark = versions.sparkSession
    try:
        there = spark.read.parquet(path).select("version_id")
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        require_empty(versions.select("version_id").join(there, "version_id", "left_semi"), "versions exist already")
    versions.write.mode("append").parquet(path)


def new_observations(observed: DataFrame, known: DataFrame) -> DataFrame:
    """Observations (version_id, run_id) that aren't known, each once."""
    return observed.dropDuplicates(["version_id", "run_id"]).join(known.select("version_id", "run_id"), ["version_id", "run_id"], "left_anti")


def as_of(versions: DataFrame, logical_id: str, at: str, moment: Column) -> DataFrame:
    """The latest row of each id up to a moment."""
    rows = F.struct(*[F.col(c) for c in versions.columns if c not in (logical_id, at)])
    latest = versions.where(F.col(at) <= moment).groupBy(logical_id).agg(F.max_by(F.struct(F.col(at), rows.alias("row")), F.col(at)).alias("x"))
    return latest.select(logical_id, F.col(f"x.{at}").alias(at), "x.row.*")


def package_state(complete: Column, invalidated_at: Column, fresh_until: Column, moment: Column) -> Column:
    """INCOMPLETE, INVALIDATED, REFRESH_REQUIRED or FRESH at a moment, the first that holds."""
    return (
        F.when(~F.coalesce(complete, F.lit(False)), "INCOMPLETE")
        .when(invalidated_at.isNotNull() & (invalidated_at <= moment), "INVALIDATED")
        .when(fresh_until.isNull() | (fresh_until < moment), "REFRESH_REQUIRED")
        .otherwise("FRESH")
    )


def leads_backwards(signal: Column, outcome: Column) -> Column:
    """Whether an outcome is before its signal; such a row is to be refused."""
    return F.coalesce(F.datediff(outcome, signal) < 0, F.lit(False))


def lead_days(signal: Column, outcome: Column) -> Column:
    """Days from a signal to its outcome. An outcome before its signal is an error that stops the query."""
    stop = F.raise_error(F.lit("an outcome cannot be before its signal"))
    return F.when(leads_backwards(signal, outcome), stop.cast("long")).otherwise(F.datediff(outcome, signal).cast("long"))


def latest_wins(log: DataFrame, key: str, order: str, deleted: str) -> DataFrame:
    """A mutable table as a log: the last row of each key, unless it marks a deletion."""
    row = F.struct(*[F.col(c) for c in log.columns if c != key])
    return log.groupBy(key).agg(F.max_by(row, F.col(order)).alias("row")).select(key, "row.*").where(~F.col(deleted))


def run_manifest(counts: DataFrame, run_id: str, input_digest: str, output_digest: str) -> DataFrame:
    """One row for a run: a map of counts (name, n), which must not be negative, and the content digest without times."""
    require_empty(counts.where("n < 0 or n is null"), "counts must not be negative")
    one = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.col("n").cast("long"))))).alias("counts"))
    text = F.concat_ws("|", F.lit(run_id), F.lit(input_digest), F.lit(output_digest), F.to_json("counts"))
    return one.select(F.lit(run_id).alias("run_id"), "counts", F.lit(input_digest).alias("input_digest"), F.lit(output_digest).alias("output_digest"), F.sha2(text, 256).alias("digest"))


def snapshot(memberships: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of each snapshot (snapshot_id, keys: an array), with status: member, repeated (from its second mention on) or unknown."""
    listed = memberships.select("snapshot_id", F.posexplode("keys").alias("place", key))
    mention = F.row_number().over(Window.partitionBy("snapshot_id", key).orderBy("place"))
    known = rows.select(key, F.lit(True).alias("known"))
    joined = listed.withColumn("mention", mention).join(known, key, "left")
    status = F.when(F.col("known").isNull(), "unknown").when(F.col("mention") > 1, "repeated").otherwise("member")
    return joined.select("snapshot_id", key, F.col("place").cast("long").alias("place"), status.alias("status"))


def snapshot_digests(members: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """snapshot_id, members and digest: what a snapshot holds, told by its members' canonical JSON in the order of its list.

    members: of snapshot(), whose status has to be `member` throughout; others
    have no digest, and `faults` counts them. A snapshot is one list, which is
    gathered; the digest of each row is made before.
    """
    shown = [c for c in rows.columns]
    of_row = rows.select(key, F.sha2(canonical_value(F.struct(*[F.col(c) for c in shown]), rows.schema), 256).alias("__digest"))
    listed = members.join(of_row, key, "left").groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("members"), F.count_if(F.col("status") != "member").alias("faults"), F.array_sort(F.collect_list(F.struct("place", "__digest"))).alias("d")
    )
    text = F.array_join(F.transform("d", lambda d: d["__digest"]), ",")
    return listed.select("snapshot_id", "members", "faults", F.when(F.col("faults") == 0, F.sha2(text, 256)).alias("digest"))


def source_gate(contracts: DataFrame, as_of: Column) -> DataFrame:
    """Contracts (source_id, status, gates: an array of booleans, review_due) with open: live, all gates passed, and not past review."""
    passed = F.forall("gates", lambda g: F.coalesce(g, F.lit(False)))
    return contracts.withColumn("open", F.coalesce((F.col("status") == "LIVE") & passed & (F.col("review_due") >= as_of), F.lit(False)))
