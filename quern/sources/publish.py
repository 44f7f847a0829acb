"""Publishing several tables at once: staged first, made visible by one manifest.

    root/data/<run>/<attempt>/<table>/   parquet, staged; nobody reads it by name
    root/manifests/<number>.json         one for each published run, created last

A manifest tells each table's folder, schema, rows and digest. It is created
under the next free number, and creation fails if the number is taken, so two
writers cannot commit side by side: one of them sees the other's manifest and,
if that is of the same run, stops. A run that dies before its manifest leaves
staged files that no reader resolves; a manifest cut short is not whole and is
passed over. Rows and digests are observed while a table is written, so no
table is read twice.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.hashing import content_digest


class PublishError(RuntimeError):
    """A run can't be published, or what was published can't be read."""


@dataclass(frozen=True)
class Manifest:
    number: int
    run: str
    attempt: str
    completed_at: str
    tables: dict[str, dict]
    counts: dict[str, int]
    input_digest: str | None
    output_digest: str


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _read(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8", "replace")
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with a text; false if it exists."""
    fs, p = _fs(spark, path)
    try:
        stream = fs.create(p, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception) or fs.exists(p):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def manifests(spark: SparkSession, root: str) -> list[Manifest]:
    """All whole manifests, oldest first. There is one for a run, so this is small beside the tables."""
    fs, p = _fs(spark, f"{root}/manifests")
    if not fs.exists(p):
        return []
    out = []
    for name in sorted(s.getPath().getName() for s in fs.listStatus(p)):
        if name.endswith(".json"):
            try:
                told = json.loads(_read(spark, f"{root}/manifests/{name}"))
                out.append(Manifest(number=int(name[:-5]), **{k: told[k] for k in ("run", "attempt", "completed_at", "tables", "counts", "input_digest", "output_digest")}))
            except (ValueError, KeyError):  # cut short
                continue
    return out


def _next_number(spark: SparkSession, root: str) -> int:
    fs, p = _fs(spark, f"{root}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return 1 + max([int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()], default=0)


def _row_digest(columns: list[str]) -> list[Column]:
    """Sums over rows of the parts of each row's digest: they tell a bag of rows whatever its order."""
    digest = content_digest(*columns)
    return [F.sum(F.conv(F.substring(digest, 16 * i + 1, 16), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)]


def _digest(found: dict) -> str:
    return hashlib.sha256("|".join(str(found[k] or 0) for k in ("rows", "p0", "p1", "p2", "p3")).encode()).hexdigest()


def stage(tables: dict[str, DataFrame], root: str, run: str) -> tuple[str, dict[str, dict]]:
    """Write tables under a new attempt of a run. Returns the attempt and what a manifest tells of each table."""
    attempt, told = uuid.uuid4().hex, {}
    for name, df in tables.items():
        seen = Observation()
        path = f"data/{run}/{attempt}/{name}"
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *_row_digest(df.columns)).write.parquet(f"{root}/{path}")
        found = seen.get
        told[name] = {"path": path, "schema": df.schema.json(), "rows": found["rows"], "digest": _digest(found)}
    return attempt, told


def commit(spark: SparkSession, root: str, run: str, attempt: str, told: dict[str, dict], counts: dict[str, int] | None = None, input_digest: str | None = None) -> Manifest:
    """Make a staged attempt visible. A run that is published already, or a negative count, is an error."""
    counts = {**{name: t["rows"] for name, t in told.items()}, **(counts or {})}
    if any(n < 0 for n in counts.values()):
        raise PublishError(f"counts must not be negative: {counts}")
    output = hashlib.sha256(json.dumps({name: t["digest"] for name, t in told.items()}, sort_keys=True).encode()).hexdigest()
    text = json.dumps({
        "run": run, "attempt": attempt, "completed_at": datetime.now(timezone.utc).isoformat(), "tables": told, "counts": counts, "input_digest": input_digest, "output_digest": output,
    }, sort_keys=True)
    while True:
        number = _next_number(spark, root)
        if any(m.run == run for m in manifests(spark, root)):
            raise PublishError(f"run {run} is published already")
        path = f"{root}/manifests/{number:012d}.json"
        if _create(spark, path, text):
            if json.loads(_read(spark, path))["attempt"] != attempt:  # a store whose creation is not exclusive
                raise PublishError(f"another writer took manifest {number}")
            return next(m for m in manifests(spark, root) if m.attempt == attempt)


def publish(tables: dict[str, DataFrame], root: str, run: str, counts: dict[str, int] | None = None, input_digest: str | None = None) -> Manifest:
    """Stage all tables of a run and make them visible together."""
    spark = next(iter(tables.values())).sparkSession
    if any(m.run == run for m in manifests(spark, root)):
        raise PublishError(f"run {run} is published already")
    return commit(spark, root, run, *stage(tables, root, run), counts, input_digest)


def published(spark: SparkSession, root: str, run: str | None = None) -> dict[str, DataFrame]:
    """The tables of the newest whole manifest, or of a run, with the schemas they were written with."""
    known = [m for m in manifests(spark, root) if run in (None, m.run)]
    if not known:
        raise PublishError(f"nothing is published in {root}" + (f" for run {run}" if run else ""))
    return {name: spark.read.schema(StructType.fromJson(json.loads(t["schema"]))).parquet(f"{root}/{t['path']}") for name, t in known[-1].tables.items()}


def changed_tables(spark: SparkSession, root: str, run: str | None = None) -> DataFrame:
    """Published tables whose files no longer hold what the manifest tells: name, told_rows, rows. None: all is as written."""
    tables = published(spark, root, run)
    told = [m for m in manifests(spark, root) if run in (None, m.run)][-1].tables
    rows = []
    for name, df in tables.items():
        found = df.agg(F.count(F.lit(1)).alias("rows"), *_row_digest(df.columns)).first().asDict()
        if _digest(found) != told[name]["digest"]:
            rows.append((name, told[name]["rows"], found["rows"]))
    return spark.createDataFrame(rows, "name string, told_rows long, rows long")


def forget_unpublished(spark: SparkSession, root: str, run: str) -> int:
    """Remove a run's staged attempts that no manifest names, once no writer is at work on it. Returns their number."""
    fs, p = _fs(spark, f"{root}/data/{run}")
    kept = {m.attempt for m in manifests(spark, root)}
    stale = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName() not in kept] if fs.exists(p) else []
    for path in stale:
        fs.delete(path, True)
    return len(stale)
