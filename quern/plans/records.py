"""Queries on events and other records: versions, ingest, rounds, packages, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import checks
from ..functions import codes
from ..functions.hashing import canonical_json, content_digest, hash_rank, set_digest, uuid5
from ..operators import ledger, linkage, scoring
from ..session import table
from ..sources import notices

_EARLY, _LATE = ("view", "click"), ("purchase", "signup")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions of each user: their events in time order, where the type changes."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return ledger.versions_of(events, "user_id", ["ts", "event_id"], "event_type", "user")


_CHANGES = """select user_id, ts, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as version_no from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) where before is distinct from event_type"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _changes(spark, sf_dir)
    name = lambda n: F.concat_ws(":", F.col("user_id").cast("string"), n.cast("string"))
    return changes.select(
        name(F.col("version_no")).alias("version_id"), F.col("user_id").alias("logical_id"), F.sha2("event_type", 256).alias("digest"),
        F.when(F.col("version_no") > 1, name(F.col("version_no") - 1)).alias("supersedes"), "event_type",
    )


def ledger_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("user_id", "event_id", "event_type", "version_no")


def ledger_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.current_versions(_versions(spark, sf_dir)).select("logical_id", "version_id", "event_type")


_CURRENT = f"""select user_id as logical_id, user_id || ':' || version_no as version_id, event_type from (select *, max(version_no) over (partition by user_id) as m from ({_CHANGES})) where version_no = m"""


def ledger_append_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report of a user's cheapest event type would append."""
    cheapest = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("logical_id")).agg(F.min_by("event_type", F.struct("value", "event_id")).alias("t"))
    incoming = cheapest.where("logical_id % 4 <> 0").unionByName(spark.createDataFrame([(-1, "view")], "logical_id long, t string")).withColumn("digest", F.sha2("t", 256))
    return ledger.append_plan(_versions(spark, sf_dir), incoming, "user").select("logical_id", "digest", "supersedes", "version_id")


_APPEND = f"""with c as ({_CURRENT}), i as (select user_id as logical_id, sha256(first(event_type order by value, event_id)) as digest from events where user_id % 4 <> 0 group by 1 union all select -1, sha256('view')),
a as (select i.logical_id, i.digest, c.version_id as supersedes from i left join c on c.logical_id = i.logical_id where sha256(c.event_type) is distinct from i.digest),
h as (select *, sha1(from_hex('{ledger.NAMESPACE.replace("-", "")}') || encode(concat_ws(':', 'user', logical_id, digest, coalesce(supersedes, 'first')))) as h from a)
select logical_id, digest, supersedes, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', cast('0x' || substr(h, 17, 1) as int) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as version_id from h"""


def version_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("nation:"), F.col("n_name")).alias("name"))
    return rows.select("n_nationkey", uuid5(ledger.NAMESPACE, F.col("name")).alias("id"))


_UUID = f"""with h as (select n_nationkey, sha1(from_hex('{ledger.NAMESPACE.replace("-", "")}') || encode('nation:' || n_name)) as h from nation)
select n_nationkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as id from h"""


def package_state_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each user's package on a day: the latest event up to then, a purchase invalidating an older one."""
    events = table(spark, sf_dir, "events")
    moment = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    latest = ledger.as_of(events.where("event_type <> 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"), F.max("value").alias("value")), "user_id", "ts", moment)
    void = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("invalidated_at"))
    state = ledger.package_state(F.col("value") > 5, F.when(F.col("invalidated_at") >= F.col("ts"), F.col("invalidated_at")), F.col("ts") + F.expr("interval 7 days"), moment)
    return latest.join(void, "user_id", "left").select("user_id", "event_id", state.alias("state"))


_ASOF = """with e as (select user_id, ts, max(event_id) as event_id, max(value) as value from events where event_type <> 'purchase' and ts <= timestamp '2024-01-20' group by 1, 2), l as (select * from (select *, row_number() over (partition by user_id order by ts desc) as r from e) where r = 1),
v as (select user_id, min(ts) as inv from events where event_type = 'purchase' group by 1)
select l.user_id, event_id, case when not value > 5 then 'INCOMPLETE' when inv >= ts and inv <= timestamp '2024-01-20' then 'INVALIDATED' when ts + interval 7 days < timestamp '2024-01-20' then 'REFRESH_REQUIRED' else 'FRESH' end as state from l left join v on v.user_id = l.user_id"""


def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.col("event_type") == "click").alias("gone"))
    return ledger.latest_wins(log, "user_id", "event_id", "gone").select("user_id", "event_id", "event_type")


_LATEST = """select user_id, event_id, event_type from (select *, max(event_id) over (partition by user_id) as m from events) where event_id = m and event_type <> 'click'"""


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"), F.col("o_custkey").alias("customer"))
    return o.select("o_orderkey", content_digest("customer", "o_orderkey", "priority").alias("digest"), canonical_json("priority", "customer").alias("json"))


_HASHES = """with v as (select o_orderkey, o_custkey, case when o_orderkey % 5 <> 0 then '"' || o_orderpriority || '"' else 'null' end as p from orders)
select o_orderkey, sha256('{"customer":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"priority":' || p || '}') as digest, '{"customer":' || o_custkey || ',"priority":' || p || '}' as json from v"""


def universe_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, distinct keys, collapsed repeats, and a digest of the set of keys."""
    lines = table(spark, sf_dir, "lineitem")
    counts = lines.agg(F.count(F.lit(1)).alias("raw"), F.count_distinct("l_orderkey").alias("logical"))
    digest = set_digest(lines.select(F.concat(F.lit("O-"), F.col("l_orderkey").cast("string")).alias("k")), "k")
    return counts.join(F.broadcast(digest), F.col("logical") == F.col("n")).select("raw", "logical", (F.col("raw") - F.col("logical")).alias("collapsed"), "digest")


_PARTS = ", ".join(f"sum(cast('0x' || substr(h, {16 * i + 1}, 16) as ubigint)::hugeint) as p{i}" for i in range(4))
_UNIVERSE = f"""with k as (select distinct sha256('O-' || l_orderkey) as h from lineitem), p as (select count(*) as n, {_PARTS} from k)
select (select count(*) from lineitem) as raw, n as logical, (select count(*) from lineitem) - n as collapsed, sha256(concat_ws('|', n, p0, p1, p2, p3)) as digest from p"""


def dedup_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    return events.dropDuplicates(["user_id", "day", "event_type"]).groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("users"))


_INGEST = "select cast(ts as date) as day, event_type, count(distinct user_id) as users from events group by 1, 2"


def segment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("year"))
    merged = notices.disjoint(o, "o_orderkey", "year")
    return merged.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))


_MERGE = "select cast(year(o_orderdate) as bigint) as year, count(*) as n, min(o_orderkey) as first from orders group by 1"


def type_lifecycle_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.linked_types(table(spark, sf_dir, "events"), "user_id", "event_type", _EARLY, _LATE)


_LINKED = f"""select *, early * 10000 // keys as early_bps, late * 10000 // keys as late_bps, linked * 10000 // keys as linked_bps from (select count(*) as keys, cast(count_if(e) as bigint) as early, cast(count_if(l) as bigint) as late, cast(count_if(e and l) as bigint) as linked from (select user_id, bool_or(event_type in {_EARLY}) as e, bool_or(event_type in {_LATE}) as l from events group by 1))"""


def repeated_mechanisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = table(spark, sf_dir, "events").where("value > 95").select("user_id", F.dayofmonth("ts").alias("round"))
    return scoring.repeated_in_rounds(failed, "user_id", "round", 2)


_REPEATED = "select user_id, count(distinct day(ts)) as rounds from events where value > 95 group by 1 having count(distinct day(ts)) >= 2"


def package_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return checks.broken_rules(pages, "page_id", {
        "https": codes.has_shape(F.col("url"), r"https://.*"), "no_query": ~F.contains("url", F.lit("?")), "host_shape": codes.has_shape(F.regexp_extract("url", r"://([^/?#]+)", 1), r"[a-z0-9.-]+"),
        "has_title": F.contains("html", F.lit("<title>")), "id_range": F.col("page_id") % 17 != 3,
    })


_VIOLATIONS = """select page_id, rule from (select page_id, not starts_with(url, 'https://') as https, contains(url, '?') as no_query, not regexp_full_match(regexp_extract(url, '://([^/?#]+)', 1), '[a-z0-9.-]+') as host_shape, not contains(html, '<title>') as has_title, page_id % 17 = 3 as id_range from pages)
unpivot (bad for rule in (https, no_query, host_shape, has_title, id_range)) where bad"""


def key_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of violations of four table checks."""
    lines, orders, labels, docs = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "labels", "documents"))
    found = [
        ("orders_without_lines", checks.dangling(orders, lines.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")),
        ("repeated_users", checks.repeated_keys(table(spark, sf_dir, "events"), "user_id", "event_type")),
        ("conflicting_parts", checks.conflicting_keys(lines, "l_partkey", "l_returnflag")),
        ("unlabelled", checks.unmatched(docs, labels, "doc_id")),
    ]
    parts = [v.agg(F.lit(n).alias("check"), F.count(F.lit(1)).alias("violations")) for n, v in found]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_CHECKS = """select 'orders_without_lines' as "check", (select count(*) from orders where o_orderkey not in (select l_orderkey from lineitem)) as violations union all
select 'repeated_users', (select count(*) from (select 1 from events group by user_id, event_type having count(*) > 1)) union all
select 'conflicting_parts', (select count(*) from (select 1 from lineitem group by l_partkey having count(distinct l_returnflag) > 1)) union all
select 'unlabelled', (select count(*) from documents d full join labels l on d.doc_id = l.doc_id where d.doc_id is null or l.doc_id is null)"""


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the intersection and differences of two sets of customers."""
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    active = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k"))
    both, only, rest = rich.intersect(active), rich.subtract(active), active.subtract(rich)
    sized = [d.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("n")) for n, d in (("both", both), ("rich_only", only), ("active_only", rest))]
    return sized[0].unionByName(sized[1]).unionByName(sized[2])


_SETS = """with r as (select c_custkey as k from customer where c_acctbal > 5000), a as (select o_custkey as k from orders where o_orderstatus = 'O') select 'both' as part, (select count(*) from (select k from r intersect select k from a)) as n union all
select 'rich_only', (select count(*) from (select k from r except select k from a)) union all select 'active_only', (select count(*) from (select k from a except select k from r))"""


def nearest_hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event type's share in the first tenth of the hash order."""
    first = F.substring(hash_rank("split", F.col("event_id"), ":"), 1, 2) < "1a"
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(first).alias("held"))


_SPLIT = "select event_type, count(*) as n, cast(count_if(substr(sha256('split:' || event_id), 1, 2) < '1a') as bigint) as held from events group by 1"

QUERIES = {
    "ledger_versions": (ledger_versions, f"select user_id, event_id, event_type, version_no from ({_CHANGES})"), "ledger_current": (ledger_current, _CURRENT), "ledger_append_plan": (ledger_append_plan, _APPEND),
    "version_identifiers": (version_identifiers, _UUID), "package_state_asof": (package_state_asof, _ASOF), "latest_wins": (latest_wins, _LATEST), "content_hashes": (content_hashes, _HASHES), "universe_digest": (universe_digest, _UNIVERSE),
    "dedup_ingest": (dedup_ingest, _INGEST), "segment_merge": (segment_merge, _MERGE), "type_lifecycle_links": (type_lifecycle_links, _LINKED), "repeated_mechanisms": (repeated_mechanisms, _REPEATED),
    "package_violations": (package_violations, _VIOLATIONS), "key_checks": (key_checks, _CHECKS), "set_operations": (set_operations, _SETS), "nearest_hash_split": (nearest_hash_split, _SPLIT),
}
