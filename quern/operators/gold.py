"""Gold packages: checked against their manifest, frozen with a tree of digests, compared without reading all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import canonical_value
from ..functions.text import is_verbatim
from .matching import rolled_up_state

#: Fields of a case's component: component_id, start, end, text, state, and evidence with published and accepted.
COMPONENT = "array<struct<component_id:string,start:bigint,end:bigint,text:string,state:string,evidence:array<struct<published:date,accepted:boolean>>>>"


def gold_violations(manifest: DataFrame, cases: DataFrame, key: str, text: str, cutoff: Column) -> DataFrame:
    """key, component_id (null for a whole case) and violation of cases (key, cutoff, components, state) against a manifest (key, text).

    `missing`: no case for a project; `unknown`: a case without project;
    `repeated`: more than one case or project of a key; `cutoff`: another
    cutoff; `state`: not the roll-up of its components; of components `span`:
    not within the text; `verbatim`: the text holds something else there
    (offsets are code points); `late`: accepted evidence published after the
    cutoff. A null key is `unknown` or `missing`.
    """
    projects = manifest.groupBy(key).agg(F.count(F.lit(1)).alias("__projects"), F.first(text).alias("__text"))
    counted = cases.groupBy(key).agg(F.count(F.lit(1)).alias("__cases"))
    pairs = projects.join(counted, key, "full")
    one = F.lit(None).cast("string")
    of_keys = F.array_compact(F.array(
        F.when(F.col("__cases").isNull(), F.lit("missing")), F.when(F.col("__projects").isNull(), F.lit("unknown")), F.when((F.col("__cases") > 1) | (F.col("__projects") > 1), F.lit("repeated")),
    ))
    keys = pairs.select(key, one.alias("component_id"), F.explode(of_keys).alias("violation"))

    known = cases.join(projects, key)
    states = F.transform("components", lambda c: c["state"])
    of_cases = F.array_compact(F.array(F.when(~F.col("cutoff").eqNullSafe(cutoff), F.lit("cutoff")), F.when(~F.col("state").eqNullSafe(rolled_up_state(states)), F.lit("state"))))
    whole = known.select(key, one.alias("component_id"), F.explode(of_cases).alias("violation"))

    each = known.select(key, "__text", F.explode("components").alias("c"))
    inside = F.coalesce((F.col("c.start") >= 0) & (F.col("c.end") > F.col("c.start")) & (F.col("c.end") <= F.length("__text")), F.lit(False))
    late = F.exists("c.evidence", lambda e: F.coalesce(e["accepted"] & (e["published"] > cutoff), F.lit(False)))
    of_components = F.array_compact(F.array(
        F.when(~inside, F.lit("span")), F.when(inside & ~F.coalesce(is_verbatim(F.col("__text"), F.col("c.start"), F.col("c.end"), F.col("c.text")), F.lit(False)), F.lit("verbatim")),
        F.when(F.coalesce(late, F.lit(False)), F.lit("late")),
    ))
    return keys.unionByName(whole).unionByName(each.select(key, "c.component_id", F.explode(of_components).alias("violation")))


def leaves(cases: DataFrame, key: str, depth: int = 2) -> DataFrame:
    """Cases with bucket (the first digits of the key's hash) and leaf (the SHA-256 of the case's canonical JSON)."""
    row = canonical_value(F.struct(*[F.col(c) for c in cases.columns]), cases.schema)
    bucket = F.coalesce(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, depth), F.lit("-" * depth))
    return cases.withColumns({"bucket": bucket, "leaf": F.sha2(row, 256)})


def digest_tree(leafed: DataFrame, depth: int = 2) -> DataFrame:
    """Nodes of the tree over leaves: prefix ('' for the root), n (cases) and digest.

    A bucket's digest comes from the sums of its leaves' parts, so no bucket is
    gathered; a node's is the SHA-256 of its children's, of which it has 16 at most.
    """
    parts = [F.sum(F.conv(F.substring("leaf", 16 * i + 1, 16), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"p{i}") for i in range(4)]
    sums = leafed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *parts)
    level = sums.select(F.col("bucket").alias("prefix"), "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), *[f"p{i}" for i in range(4)]), 256).alias("digest"))
    out = level
    for n in range(depth - 1, -1, -1):
        children = F.transform(F.array_sort(F.collect_list(F.struct("prefix", "digest"))), lambda c: F.concat(c["prefix"], F.lit(":"), c["digest"]))
        level = level.groupBy(F.substring("prefix", 1, n).alias("up")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(children, ","), 256).alias("digest")).withColumnRenamed("up", "prefix")
        out = out.unionByName(level)
    return out


def changed_buckets(ours: DataFrame, theirs: DataFrame, depth: int = 2) -> DataFrame:
    """Buckets whose digests differ between two trees, found from the root down: only children of nodes that differ are looked at."""
    a, b = (t.select("prefix", F.col("digest").alias(n)) for t, n in ((ours, "__a"), (theirs, "__b")))
    nodes = a.join(b, "prefix", "full")
    open_nodes = nodes.where((F.length("prefix") == 0) & ~F.col("__a").eqNullSafe(F.col("__b"))).select("prefix")
    for n in range(1, depth + 1):
        level = nodes.where((F.length("prefix") == n) & ~F.col("__a").eqNullSafe(F.col("__b"))).select("prefix")
        open_nodes = level.join(open_nodes.select(F.col("prefix").alias("__up")), F.substring("prefix", 1, n - 1) == F.col("__up"), "left_semi")
    return open_nodes.select(F.col("prefix").alias("bucket"))


def freeze(cases: DataFrame, key: str, path: str, depth: int = 2) -> str:
    """Write cases by bucket, and the tree of their digests; returns the root's digest, which tells the whole package."""
    spark = cases.sparkSession
    leaves(cases, key, depth).withColumn("part", F.concat(F.lit("b"), "bucket")).repartition("part").write.partitionBy("part").parquet(f"{path}/cases")
    leafed = spark.read.parquet(f"{path}/cases").select("leaf", "bucket")
    digest_tree(leafed, depth).coalesce(1).write.parquet(f"{path}/tree")
    root = spark.read.parquet(f"{path}/tree").where("prefix = ''").first()
    return root["digest"] if root else ""


def changed_cases(spark: SparkSession, ours: str, theirs: str, key: str, depth: int = 2) -> DataFrame:
    """key and change (added, removed, changed) between two frozen packages; only buckets that differ are read."""
    buckets = [r["bucket"] for r in changed_buckets(*(spark.read.parquet(f"{p}/tree") for p in (ours, theirs)), depth).collect()]

    def read(path: str, name: str) -> DataFrame:
        rows = spark.read.parquet(f"{path}/cases")
        return rows.where(F.col("part").isin([f"b{b}" for b in buckets])).select(key, F.col("leaf").alias(name))

    both = read(ours, "__a").join(read(theirs, "__b"), key, "full").where(~F.col("__a").eqNullSafe(F.col("__b")))
    return both.select(key, F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").otherwise("changed").alias("change"))
