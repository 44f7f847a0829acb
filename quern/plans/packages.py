"""Queries on gold packages, dossiers, public views and stratified selection."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dossier, gold, projection, sampling, sourcing
from ..session import shared_folder, table

_CUTOFF = "1998-06-01"


def gold_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as projects and a case for most of them, with faults of every kind at given ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = F.col("doc_id")
    part = F.substring("text", 6, 10)
    evidence = F.array(F.struct(F.when(d % 8 == 0, F.to_date(F.lit("1998-07-01"))).otherwise(F.to_date(F.lit("1998-01-01"))).alias("published"), (d % 16 != 8).alias("accepted")))
    state = F.when(d % 2 == 0, "CLOSED").otherwise("OPEN")
    component = F.struct(
        F.lit("c1").alias("component_id"), F.lit(5).cast("long").alias("start"), F.when(d % 17 == 0, F.length("text") + 1).otherwise(5 + F.length(part)).cast("long").alias("end"),
        F.when(d % 9 == 0, F.concat(F.lit("x"), part)).otherwise(part).alias("text"), state.alias("state"), evidence.alias("evidence"),
    )
    cutoff = F.to_date(F.when(d % 19 == 0, F.lit("1998-06-02")).otherwise(F.lit(_CUTOFF)))
    cases = docs.where(d % 11 != 0).select("doc_id", cutoff.alias("cutoff"), F.array(component).alias("components"), F.when(d % 7 == 0, "PARTIAL").otherwise(state).alias("state"))
    cases = cases.unionByName(cases.where(d % 13 == 0)).unionByName(cases.where(d % 50 == 0).withColumn("doc_id", -1 - d))
    return gold.gold_violations(docs, cases, "doc_id", "text", F.to_date(F.lit(_CUTOFF)))


_GOLD = """with c as (select doc_id, text, substr(text, 6, 10) as part from documents where doc_id % 11 <> 0), c2 as (select * from c union all select * from c where doc_id % 13 = 0),
e as (select *, case when doc_id % 17 = 0 then length(text) + 1 else 5 + length(part) end as e from c2)
select doc_id, cast(null as varchar) as component_id, 'missing' as violation from documents where doc_id % 11 = 0
union all select -1 - doc_id, null, 'unknown' from c where doc_id % 50 = 0
union all select -1 - doc_id, null, 'repeated' from c where doc_id % 50 = 0 and doc_id % 13 = 0 and false
union all select distinct doc_id, null, 'repeated' from c where doc_id % 13 = 0
union all select doc_id, null, 'cutoff' from c2 where doc_id % 19 = 0
union all select doc_id, null, 'state' from c2 where doc_id % 7 = 0
union all select doc_id, 'c1', 'span' from e where not (e > 5 and e <= length(text))
union all select doc_id, 'c1', 'verbatim' from e where e > 5 and e <= length(text) and doc_id % 9 = 0
union all select doc_id, 'c1', 'late' from c2 where doc_id % 8 = 0 and doc_id % 16 <> 8"""


def gold_changed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders frozen twice, the second time with some changed, removed and added."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    later = orders.where(k % 103 != 0).withColumn("o_orderpriority", F.when(k % 101 == 0, "9-NEW").otherwise(F.col("o_orderpriority")))
    later = later.unionByName(orders.where(k % 107 == 0).withColumn("o_orderkey", -k))
    root = f"{shared_folder(spark)}/gold-{uuid.uuid4().hex}"
    for name, df in (("a", orders), ("b", later)):
        gold.freeze(df, "o_orderkey", f"{root}/{name}")
    return gold.changed_cases(spark, f"{root}/a", f"{root}/b", "o_orderkey")


_CHANGED_CASES = """select o_orderkey, 'removed' as change from orders where o_orderkey % 103 = 0 and o_orderkey <> 0 union all select o_orderkey, 'changed' from orders where o_orderkey % 101 = 0 and o_orderkey % 103 <> 0
union all select -o_orderkey, 'added' from orders where o_orderkey % 107 = 0 and o_orderkey <> 0"""


def dossier_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dossier for each order from its customer's package and its nation's snapshot: what blocks it, or its digest."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey", F.struct("c_name", "c_mktsegment").alias("package"))
    packages = dossier.with_digest(customers, "package", "package_sha256")
    nations = dossier.with_digest(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.struct("n_name", "n_regionkey").alias("snapshot")), "snapshot", "snapshot_sha256")
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate").join(packages, "o_custkey").join(nations, "c_nationkey")
    day = F.to_date("o_orderdate")
    bindings = {
        "package": (F.when(k % 11 != 0, F.col("c_name")).otherwise(F.lit("other")), F.col("c_name")),
        "package_sha256": (F.col("package_sha256"), F.col("package_sha256")),
        "snapshot_sha256": (F.when(k % 23 != 0, F.col("snapshot_sha256")), F.col("snapshot_sha256")),
    }
    blocks = dossier.request_blocks(
        F.concat(F.lit("org_"), F.md5(F.col("o_custkey").cast("string").cast("binary"))), F.when(k % 29 == 0, "not a reference").otherwise(F.concat(F.lit("P-"), k.cast("string"))), k % 31 != 0,
        F.when(k % 37 == 0, day), F.when(k % 13 == 0, F.date_sub(day, 1)).otherwise(F.date_add(day, 30)), day, {"package": F.col("package_sha256")},
    ) + dossier.release_blocks(bindings) + dossier.forbidden_words([F.col("o_orderpriority")], ["Urgent"])
    payload = F.struct(F.lit("v2").alias("schema"), k.alias("dossier"), F.col("package"), F.struct("snapshot", "snapshot_sha256").alias("dimensioning"), F.array(F.col("o_orderpriority"), F.lit(None)).alias("notes"), (k % 2 == 0).alias("even"))
    out = dossier.composed(rows, "o_orderkey", payload, blocks)
    return out.select("o_orderkey", F.array_join("blocks", ",").alias("blocks"), "digest")


_DOSSIERS = """with p as (select c_custkey, c_name, c_nationkey, '{"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}' as package from customer),
n as (select n_nationkey, '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' as snapshot from nation),
r as (select o_orderkey as k, o_orderpriority, package, snapshot, sha256(snapshot) as s from orders join p on c_custkey = o_custkey join n on n_nationkey = c_nationkey),
b as (select *, list_filter([case when k % 29 = 0 then 'purchase' end, case when k % 31 = 0 then 'package_incomplete' end, case when k % 31 <> 0 and k % 37 = 0 then 'package_invalidated' end,
case when k % 31 <> 0 and k % 37 <> 0 and k % 13 = 0 then 'package_refresh_required' end, case when k % 11 = 0 then 'release_differs_package' end, case when k % 23 = 0 then 'release_lacks_snapshot_sha256' end,
case when contains(lower(o_orderpriority), 'urgent') then 'phrase_Urgent' end], lambda x: x is not null) as xs from r)
select k as o_orderkey, array_to_string(xs, ',') as blocks, case when len(xs) = 0 then sha256('{"dimensioning":{"snapshot":' || snapshot || ',"snapshot_sha256":"' || s || '"},"dossier":' || k || ',"even":' || case when k % 2 = 0 then 'true' else 'false' end ||
',"notes":["' || o_orderpriority || '",null],"package":' || package || ',"schema":"v2"}') end as digest from b"""


def public_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as projects, their order's lines as components, suppliers as evidence: what is shown of each, and what stands against it."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.element_at(F.split("text", "\n"), 1).alias("title"), F.concat(F.lit(" \n"), F.when(F.col("doc_id") % 41 != 0, F.col("text")).otherwise(F.lit("")), F.lit(" ")).alias("scope"), F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("url"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("key"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").join(docs.select("key", "scope"), "key")
    n = F.col("l_linenumber")
    component_id = F.concat_ws("-", "key", n.cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    text = F.substring("scope", (n * 3 + 1).cast("int"), F.lit(8))
    span = F.struct(text.alias("text"), (n * 3).cast("long").alias("start"), (n * 3 + F.length(text)).cast("long").alias("end"))
    state = F.when(F.col("l_returnflag") == "R", "CLOSED").when(F.col("l_returnflag") == "A", "OPEN").otherwise("UNRESOLVED")
    evidence_id = F.concat(F.lit("e"), F.col("l_suppkey").cast("string"))
    told = F.when((state == "CLOSED") & (n % 5 != 3) | (state == "OPEN") & (F.col("l_partkey") % 20 == 0), F.array(evidence_id)).otherwise(F.array().cast("array<string>"))
    components = lines.select("key", component_id.alias("component_id"), F.lit("line").alias("category"), state.alias("state"), F.when(F.col("l_partkey") % 15 == 0, "other").otherwise(text).alias("scope_evidence"), F.when(F.col("l_partkey") % 33 != 0, F.array(span)).otherwise(F.array().cast(f"array<{lines.select(span.alias('s')).schema['s'].dataType.simpleString()}>")).alias("spans"), told.alias("evidence_ids"))
    name = F.col("s_name")
    candidates = lines.where(state == "CLOSED").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey").select(
        component_id.alias("component_id"), evidence_id.alias("evidence_id"), F.when(n == 6, "REVIEW").otherwise("HIGH_CONFIDENCE").alias("disposition"), F.lit("n1").alias("notice_id"), F.to_date(F.lit("1998-01-01")).alias("published"),
        name.alias("title"), F.lit(None).cast("string").alias("scope"), F.when(F.col("l_partkey") % 12 != 0, "TITLE").otherwise("SCOPE_DESCRIPTION").alias("field"), F.substring(name, 3, 5).alias("text"),
        F.when(F.col("l_partkey") % 14 != 0, F.lit(2)).cast("long").alias("start"), F.lit(7).cast("long").alias("end"),
    )
    view = projection.public_view(docs, components, candidates)
    matches = F.aggregate("components", F.lit(0), lambda s, c: s + F.size(c["matches"]))
    return view.select("key", "wording.type", "wording.start", "wording.end", "state", F.size("components").cast("long").alias("components"), matches.cast("long").alias("matches"), F.array_join("violations", ",").alias("violations"))


_PUBLIC = r"""with d as (select cast(doc_id as varchar) as key, string_split(text, chr(10))[1] as title, ' ' || chr(10) || case when doc_id % 41 <> 0 then text else '' end || ' ' as scope from documents),
l as (select d.key, scope, l_linenumber as n, l_partkey as p, l_suppkey, case l_returnflag when 'R' then 'CLOSED' when 'A' then 'OPEN' else 'UNRESOLVED' end as state, substr(scope, l_linenumber * 3 + 1, 8) as part from lineitem join d on d.key = cast(l_orderkey as varchar)),
v as (select key, n, state, case when state = 'CLOSED' and n <> 6 then 1 else 0 end as accepted, list_filter([
case when p % 33 = 0 then 'no_span' end, case when p % 33 <> 0 and not (length(part) > 0 and p % 15 <> 0) then 'span_differs' end,
case when state = 'CLOSED' and (n % 5 = 3) <> (n = 6) then 'closed_ids_differ' end, case when state = 'CLOSED' and n = 6 then 'closed_without_evidence' end, case when state = 'OPEN' and p % 20 = 0 then 'open_with_evidence' end,
case when state = 'CLOSED' and n <> 6 and p % 14 = 0 then 'match_without_evidence' when state = 'CLOSED' and n <> 6 and p % 12 = 0 then 'match_not_verbatim' end], lambda x: x is not null) as xs from l),
a as (select key, count(*) as components, sum(accepted) as matches, list_distinct(flatten(list(xs))) as xs, bool_or(state = 'UNRESOLVED') as u, bool_or(state = 'OPEN') as o, bool_or(state = 'CLOSED') as c from v group by 1),
w as (select d.key, trim(title, e' \t\n\r') as t, trim(scope, e' \t\n\r') as s, scope, a.* exclude (key) from d left join a on a.key = d.key)
select key, case when t = s then 'Project title' else 'Project description' end as type, cast(length(scope) - length(ltrim(scope, e' \t\n\r')) as bigint) as "start", cast(length(scope) - length(ltrim(scope, e' \t\n\r')) + length(s) as bigint) as "end",
case when components is null or u or not (o or c) then 'UNRESOLVED' when o and c then 'PARTIAL' when c then 'CLOSED' else 'OPEN' end as state, coalesce(components, 0) as components, cast(coalesce(matches, 0) as bigint) as matches,
array_to_string(list_sort(list_concat(case when s = '' then ['no_wording'] else [] end, coalesce(xs, []))), ',') as violations from w"""



def source_package_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents of a customer's package, their lines as requirements, with faults of every kind at given keys."""
    k, n, p = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    o = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    documents = orders.where(o % 43 != 0).select(
        F.col("o_custkey").alias("package_id"), o.cast("string").alias("document_id"), F.when(o % 11 == 0, "FACT_EXTRACTION_ONLY").when(o % 47 == 0, "BLOCKED").otherwise("FULL_TEXT").alias("reuse_mode"),
        F.lit("https://x").alias("reuse_url"), F.when(o % 53 != 0, F.col("o_orderpriority")).otherwise(" ").alias("reuse_note"), F.when(o % 59 != 0, F.sha2(o.cast("string"), 256)).otherwise("none").alias("sha256"),
    )
    lines = table(spark, sf_dir, "lineitem").join(orders.select(o.alias("l_orderkey"), "o_custkey"), "l_orderkey")
    kind = F.when(n == 1, "MINIMUM_EUR").when(n == 2, "MAXIMUM_MONTHS").otherwise("DECLARATION")
    requirements = lines.select(
        F.col("o_custkey").alias("package_id"), F.concat_ws("-", k.cast("string"), n.cast("string"), p.cast("string"), F.col("l_suppkey").cast("string"), F.col("l_extendedprice").cast("decimal(20,2)").cast("string")).alias("requirement_id"), k.cast("string").alias("document_id"), kind.alias("kind"),
        F.when((n <= 2) & (p % 13 != 0), p).when((n == 4) & (p % 17 == 0), -p).alias("boundary"), F.when(n == 1, "proposed_funding_eur").when((n == 2) & (p % 19 != 0), "proposed_duration_months").when(n == 2, "proposed_funding_eur").alias("input"), F.when(p % 3 == 0, "text").otherwise("").alias("source_text"),
    )
    return sourcing.package_violations(documents, requirements).groupBy("package_id", "violation").agg(F.count(F.lit(1)).alias("n"))


_SOURCING = """with d as (select * from orders where o_orderkey % 43 <> 0), r as (select o_custkey as c, l_orderkey as k, l_linenumber as n, l_partkey as p from lineitem join orders on o_orderkey = l_orderkey),
v as (select o_custkey as c, 'digest' as violation from d where o_orderkey % 59 = 0 union all select o_custkey, 'reuse_basis' from d where o_orderkey % 53 = 0 union all select o_custkey, 'blocked' from d where o_orderkey % 47 = 0 and o_orderkey % 11 <> 0
union all select c, 'no_document' from r where k % 43 = 0 union all select c, 'boundary' from r where (n <= 2 and p % 13 = 0) or (n = 4 and p % 17 = 0) union all select c, 'input' from r where n = 2 and p % 19 = 0
union all select c, 'text_not_reusable' from r where k % 43 <> 0 and k % 11 = 0 and p % 3 = 0) select c as package_id, violation, count(*) as n from v group by 1, 2"""

_REQUIRED = [("lang", "en"), ("lang", "de"), ("lang", "fr"), ("lang", "es"), ("band", "short"), ("band", "long"), ("toxic", "1"), ("quality", "0"), ("quality", "1"), ("source", "src7"), ("toxic", "0")]
_SPREAD = ["source", "tenth"]


def stratified_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60 labelled documents that cover languages, lengths and labels, and two sources and tenths at least."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    band = F.when(F.col("n_chars") < 800, "short").when(F.col("n_chars") < 3000, "middle").otherwise("long")
    rows = docs.select("doc_id", "lang", "source", band.alias("band"), F.col("toxic").cast("string").alias("toxic"), F.col("quality").cast("string").alias("quality"), (F.col("doc_id") % 10).cast("string").alias("tenth"))
    return sampling.greedy_selection(rows, "doc_id", _REQUIRED, _SPREAD, 60, "strata").select("doc_id", "hash", "pick")


def _selection_sql() -> str:
    steps = ["""with r as materialized (select doc_id, lang, source, case when n_chars < 800 then 'short' when n_chars < 3000 then 'middle' else 'long' end as band, cast(toxic as varchar) as toxic, cast(quality as varchar) as quality,
cast(doc_id % 10 as varchar) as tenth, sha256('strata' || chr(0) || doc_id) as hash from documents join labels using (doc_id)), s0 as materialized (select *, 0 as pick from r where false)"""]
    wanted = [f"{c} = '{v}'" for c, v in _REQUIRED]
    for i, want in enumerate(wanted, 1):
        steps.append(f"s{i} as materialized (select * from s{i - 1} union all (select *, {i} from r where {want} and not exists (select 1 from s{i - 1} where {want}) order by hash, doc_id limit 1))")
    i = len(wanted)
    for c in _SPREAD:
        i += 1
        steps.append(f"s{i} as materialized (select * from s{i - 1} union all (select *, {i} from r where {c} not in (select {c} from s{i - 1}) and (select count(distinct {c}) from s{i - 1}) < 2 order by hash, doc_id limit 1))")
    steps.append(f"f as (select *, {i + 1} as pick from r where doc_id not in (select doc_id from s{i}) order by hash, doc_id limit 60 - (select count(*) from s{i}))")
    return ", ".join(steps) + f" select doc_id, hash, row_number() over (order by pick, hash, doc_id) as pick from (select * from s{i} union all select * from f)"


QUERIES = {
    "gold_violations": (gold_violations, _GOLD), "gold_changed_cases": (gold_changed_cases, _CHANGED_CASES), "dossier_digests": (dossier_digests, _DOSSIERS),
    "public_projects": (public_projects, _PUBLIC), "source_package_violations": (source_package_violations, _SOURCING), "stratified_selection": (stratified_selection, _selection_sql()),
}
