"""Queries on published formats, label subsets and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import checks
from ..operators import ledger
from ..session import table
from ..sources import published


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as a page of a notice search: values as texts, lists and texts by language in turn; every 40th page with a field too many."""
    k = F.col("o_orderkey")
    title, place = F.concat(F.lit("Order "), k.cast("string")), F.col("o_orderpriority")
    # each notice as JSON text, so that a field can be a text in one and a list or an object in another
    common = F.concat(
        F.lit('{"publication-number":["'), k.cast("string"), F.lit('"],"publication-date":"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('+02:00","notice-title":'),
        F.when(k % 3 == 0, F.concat(F.lit('"'), title, F.lit('"'))).when(k % 3 == 1, F.concat(F.lit('{"deu":"andere","por":["'), title, F.lit('"]}'))).otherwise(F.concat(F.lit('["  ","'), title, F.lit('"]'))),
        F.lit(',"classification-cpv":'), F.when(k % 2 == 0, F.concat(F.lit('["'), place, F.lit('"," "]'))).otherwise(F.concat(F.lit('"'), place, F.lit('"'))),
        F.lit(',"estimated-value-proc":'), F.when(k % 5 == 0, F.lit("12.50")).otherwise((k * 10).cast("string")), F.lit(',"estimated-value-cur-proc":"'), F.when(k % 7 == 0, F.lit("USD")).otherwise(F.lit("eur")),
        F.lit('","links":{"html":"'), F.when(k % 4 == 0, F.lit("http:")).otherwise(F.lit("https:")), F.lit('//n/'), k.cast("string"), F.lit('"}'), F.when(F.col("o_custkey") % 40 == 0, F.lit(',"buyer-name":"x"')).otherwise(F.lit("")), F.lit("}"),
    )
    pages = table(spark, sf_dir, "orders").select("o_custkey", common.alias("n")).groupBy("o_custkey").agg(F.array_join(F.collect_list("n"), ",").alias("n"))
    late = F.when(F.col("o_custkey") % 60 == 0, F.lit("")).otherwise(F.lit(',"timedOut":false'))
    return published.parsed_pages(pages.select("o_custkey", F.concat(F.lit('{"notices":['), "n", F.lit("]"), late, F.lit("}")).alias("text")), "text")


def published_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = published.published_notices(_pages(spark, sf_dir), "o_custkey", "https://notices/")
    return n.select("notice_id", "publication_date", "title", F.array_join("codes", ",").alias("codes"), "value_eur", "url")


_NOTICES = """select cast(o_orderkey as varchar) as notice_id, cast(o_orderdate as date) as publication_date, 'Order ' || o_orderkey as title, o_orderpriority as codes,
case when o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 then o_orderkey * 10 end as value_eur, case when o_orderkey % 4 = 0 then 'https://notices/' else 'https://n/' end || o_orderkey as url from orders"""


def published_page_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published.page_violations(_pages(spark, sf_dir), "o_custkey")


_PAGES = """select distinct o_custkey, 'field buyer-name' as violation from orders where o_custkey % 40 = 0 union all select distinct o_custkey, 'no_timed_out' from orders where o_custkey % 60 = 0"""


def project_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records of another source, all columns as texts."""
    k = F.col("o_orderkey")
    records = table(spark, sf_dir, "orders").select(
        k.cast("string").alias("operation_code"), F.when(k % 3 == 0, F.lit(" ")).otherwise(F.col("o_orderpriority")).alias("project_title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("project_start"),
        F.lit("").alias("project_end"), F.floor("o_totalprice").cast("string").alias("approved_funding_eur"), F.col("o_orderstatus").alias("project_scope_text"), F.lit("https://x").alias("source_url"),
    )
    return published.project_records(records).select("operation_code", "project_title", "project_start", "project_end", "approved_funding_eur", "region", "temporal_provenance")


_RECORDS = """select cast(o_orderkey as varchar) as operation_code, case when o_orderkey % 3 <> 0 then o_orderpriority end as project_title, cast(o_orderdate as date) as project_start, cast(null as date) as project_end,
cast(floor(o_totalprice) as bigint) as approved_funding_eur, cast(null as varchar) as region, 'UNRESOLVED' as temporal_provenance from orders"""


def labelled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are labelled as bad, which must have a source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return checks.labelled_rows(docs, table(spark, sf_dir, "labels"), "doc_id", F.col("quality") == 0, "source")


_LABELLED = "select doc_id, lang, source from documents where doc_id in (select doc_id from labels where quality = 0)"


def subset_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in credit without an order, and customers of orders who aren't in credit."""
    c, o = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    return checks.not_in(c, o, "key").withColumn("side", F.lit("customer")).unionByName(checks.not_in(o, c, "key").withColumn("side", F.lit("orders")))


_SUBSETS = """select c_custkey as key, 'customer' as side from customer where c_acctbal > 0 and c_custkey not in (select o_custkey from orders) union all select distinct o_custkey, 'orders' from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)"""


def snapshot_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of each nation's customers, some with an unknown or a repeated member, and the digest of the sound ones."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = F.col("c_nationkey")
    keys = F.concat(F.array_sort(F.collect_list("c_custkey")), F.when(n % 5 == 0, F.array(F.lit(-1).cast("long"))).when(n % 7 == 0, F.array(F.min("c_custkey"))).otherwise(F.array().cast("array<long>")))
    lists = customers.groupBy("c_nationkey").agg(keys.alias("keys")).withColumnRenamed("c_nationkey", "snapshot_id")
    return ledger.snapshot_digests(ledger.snapshot(lists, customers, "c_custkey"), customers, "c_custkey")


_SNAPSHOTS = """with c as (select c_nationkey as n, c_custkey as k, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || c_nationkey || '}') as d from customer)
select n as snapshot_id, count(*) + max(case when n % 5 = 0 or n % 7 = 0 then 1 else 0 end) as members, cast(max(case when n % 5 = 0 or n % 7 = 0 then 1 else 0 end) as bigint) as faults,
case when n % 5 <> 0 and n % 7 <> 0 then sha256(string_agg(d, ',' order by k)) end as digest from c group by n"""

QUERIES = {
    "published_notices": (published_notices, _NOTICES), "published_page_violations": (published_page_violations, _PAGES), "project_records": (project_records, _RECORDS),
    "labelled_rows": (labelled_rows, _LABELLED), "subset_checks": (subset_checks, _SUBSETS), "snapshot_digests": (snapshot_digests, _SNAPSHOTS),
}
