"""Queries on publishing, guarded reads and lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import guarded, publish
from ..session import shared_folder, table


def published_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects, components and their assessments, published as one run and read back: counts by order status, with the manifest's."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("long").alias("quantity"))
    assessed = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("components"), F.sum("quantity").alias("quantity"))
    root = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    publish.publish({"projects": orders, "components": lines, "assessments": assessed}, root, "run-1")
    manifest, read = publish.manifests(spark, root)[-1], publish.published(spark, root)
    joined = read["projects"].join(read["assessments"], F.col("o_orderkey") == F.col("l_orderkey"), "left")
    totals = joined.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("projects"), F.sum(F.coalesce("components", F.lit(0))).alias("components"), F.sum(F.coalesce("quantity", F.lit(0))).alias("quantity"))
    return totals.select("*", *[F.lit(manifest.counts[t]).cast("long").alias(f"told_{t}") for t in ("projects", "components", "assessments")])


_PUBLISHED = """with a as (select l_orderkey, count(*) as components, cast(sum(cast(l_quantity as bigint)) as bigint) as quantity from lineitem group by 1)
select o_orderstatus, count(*) as projects, cast(coalesce(sum(components), 0) as bigint) as components, cast(coalesce(sum(quantity), 0) as bigint) as quantity,
(select count(*) from orders) as told_projects, (select count(*) from lineitem) as told_components, (select count(*) from a) as told_assessments from orders left join a on l_orderkey = o_orderkey group by 1"""


def guarded_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders, two columns of them, written under a bound and read back."""
    orders = table(spark, sf_dir, "orders")
    path = f"{shared_folder(spark)}/guarded-{uuid.uuid4().hex}"
    guarded.guarded_projection(orders, ["o_orderkey", "o_orderpriority"], F.col("o_orderstatus") == "O", 1 << 40, path, "o_orderkey")
    return spark.read.parquet(path)


_GUARDED = "select o_orderkey, o_orderpriority from orders where o_orderstatus = 'O'"


def keyed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the customers who owe money."""
    owing = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return guarded.keyed_lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), owing, "o_custkey")


_LOOKUP = "select o_orderkey, o_custkey, o_orderstatus from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0)"


def key_batch_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers asked for in batches of 60; every 97th order answers for the next batch, and batches of 700 rows are full."""
    batches = guarded.key_batches(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), "key", 60)
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey")
    answers = orders.join(batches, "key").select(F.when(F.col("o_orderkey") % 97 == 0, F.col("batch") + 1).otherwise(F.col("batch")).alias("batch"), "key")
    return guarded.batch_violations(answers, batches, "key", 700)


_BATCHES = """with b as (select c_custkey as key, cast((row_number() over (order by c_custkey) - 1) // 60 as bigint) as batch from customer),
a as (select case when o_orderkey % 97 = 0 then batch + 1 else batch end as batch, key from orders join b on o_custkey = key)
select 'outside' as "check", a.batch, a.key, count(*) as n from a where not exists (select 1 from b where b.key = a.key and b.batch = a.batch) group by a.batch, a.key
union all select 'full', batch, null, count(*) from a group by batch having count(*) >= 700"""

QUERIES = {
    "published_run": (published_run, _PUBLISHED), "guarded_projection": (guarded_projection, _GUARDED),
    "keyed_lookup": (keyed_lookup, _LOOKUP), "key_batch_checks": (key_batch_checks, _BATCHES),
}
