"""Queries on reviews of texts, cohorts and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text as tx
from ..operators import cohort, ledger, rules, scoring
from ..session import table
from .texts import RULES


def case_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as cases, of which every tenth failed: good ones should be told by language and source."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    cases = rows.select("doc_id", (F.col("doc_id") % 10 == 0).alias("failed"))
    gold = rows.where("quality = 1").select("doc_id", "lang", "source")
    predicted = rows.where("n_chars % 3 <> 0").select("doc_id", "lang", F.when(F.col("n_chars") % 2 == 0, F.col("source")).otherwise("src0").alias("source"))
    return scoring.case_scores(cases, gold, predicted, "doc_id", ["lang", "source"], ["lang"])


def _case_sql(name: str, tp: str) -> str:
    return f"""count_if({tp}) as {name}_tp, count_if(p and not ({tp})) as {name}_fp, count_if(g and not ({tp})) as {name}_fn, count_if(not failed and case when g then {tp} else not p end) as {name}_matched"""


_CASES = f"""with c as (select doc_id % 10 = 0 as failed, quality = 1 as g, n_chars % 3 <> 0 as p, n_chars % 2 = 0 or source = 'src0' as same from documents join labels using (doc_id)),
s as (select {_case_sql('exact', 'g and p and same')}, {_case_sql('semantic', 'g and p')}, count(*) as cases, count_if(failed) as failed_cases, count_if(not g) as abstentions, count_if(not g and not failed and not p) as abstained,
count_if(not g and not failed and p) as false_alarms, count_if(not g and failed) as failed_abstentions from c), t as (select columns(*)::bigint from s)
select *, """ + ", ".join(f"case when {n}_tp + {n}_fp > 0 then {n}_tp * 10000 // ({n}_tp + {n}_fp) end as {n}_precision_bps, case when {n}_tp + {n}_fn > 0 then {n}_tp * 10000 // ({n}_tp + {n}_fn) end as {n}_recall_bps, case when 2 * {n}_tp + {n}_fp + {n}_fn > 0 then 2 * {n}_tp * 10000 // (2 * {n}_tp + {n}_fp + {n}_fn) end as {n}_f1_bps" for n in ("exact", "semantic")) + " from t"


def scope_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", rules.boundary_unclear(F.col("text"), r"@(mail\d)", r"(\d+)@mail").alias("unclear"))


_BOUNDARY = r"""select doc_id, len(list_distinct(regexp_extract_all(text, '@(mail\d)', 1))) > 1 or len(list_filter(regexp_extract_all(text, '(\d+)@mail', 1), lambda x: cast(x as int) > 1)) > 0 as unclear from documents"""

_PHRASES = ("that the", "of the", "les")


def normalised_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", tx.normalised_tokens(tx.tokens(F.col("text"), r"[a-zà-ÿ']+")).alias("words"))
    return words.select("doc_id", rules.normalised_hits(F.col("words"), _PHRASES).alias("hits")).where("hits > 0")


_NORMALISED = rf"""with w as (select doc_id, list_transform(regexp_extract_all(lower(text), '[a-zà-ÿ'']+'), lambda w: regexp_replace(regexp_replace(translate(w, '{tx.ACCENTED}', '{tx.PLAIN}'), '^[^''’]*[''’]', ''), '^(.{{4,}}?)(?:azioni|azione|amento|amenti|izione|izioni|are|ere|ire|ing|tion|ment)$', '\1')) as raw from documents),
n as (select doc_id, list_transform(raw, lambda s: case when length(s) >= 6 then regexp_replace(s, '[aeio]$', '') else s end) as ws from w)
select doc_id, hits from (select doc_id, cast(len(list_filter(range(1, len(ws)), lambda i: ws[i + 1] = 'the' and ws[i] in ('that', 'of'))) + len(list_filter(ws, lambda x: x = 'les')) as bigint) as hits from n) where hits > 0"""

_GATED = (rules.Rule("fr", "article", ("les", "une")), rules.Rule("de", "article", ("der", "die")), rules.Rule("en", "article", ("the",)))


def gated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return rules.gated_occurrences(docs, "text", F.col("lang"), _GATED).select("doc_id", "rule", "hits")


_GATED_SQL = "with w as (select doc_id, lang, unnest(regexp_extract_all(lower(text), '[\\pL\\pN_]+')) as w from documents) " + " union all ".join(
    f"select doc_id, '{r.key}' as rule, count(*) as hits from w where lang = '{r.domain}' and w in ({', '.join(repr(p) for p in r.phrases)}) group by 1" for r in _GATED
)


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.datediff(F.to_date("l_shipdate"), F.to_date(F.lit("1995-01-01"))).cast("long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))


def overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir)
    return scoring.overlap_report(spans.where("l_linenumber % 3 = 1 and l_orderkey % 4 <> 0"), spans.where("l_linenumber % 3 = 2"), "l_orderkey")


_REPORT = """with s as (select l_orderkey as c, l_linenumber as l, cast(l_shipdate as date) - date '1995-01-01' as a, cast(l_shipdate as date) - date '1995-01-01' + cast(l_quantity as bigint) as e from lineitem),
g as (select distinct c, a, e from s where l % 3 = 1 and c % 4 <> 0), p as (select distinct c, a, e from s where l % 3 = 2),
x as (select p.c, p.a as pa, p.e as pe, g.a as ga, g.e as ge from p join g on p.c = g.c and greatest(p.a, g.a) < least(p.e, g.e)),
t as (select (select count(*) from p) as predicted, (select count(*) from g) as gold, (select count(*) from (select distinct c, pa, pe from x)) as predicted_hit, (select count(*) from (select distinct c, ga, ge from x)) as gold_hit,
(select count(distinct c) from g) as cases, (select count(distinct c) from x) as cases_hit, (select count(distinct c) from p where c not in (select c from g)) as false_alarms)
select *, predicted_hit * 10000 // predicted as precision_bps, gold_hit * 10000 // gold as recall_bps, cases_hit * 10000 // cases as case_recall_bps from t"""


def lead_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.when(F.col("l_returnflag") != "R", F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).cast("long"))
    return scoring.spread(lines.select("o_orderpriority", days.alias("days")), "o_orderpriority", "days")


_SPREAD = """select o_orderpriority, count(d) as measured, cast(2 * median(d) as bigint) as median_x2, max(d) as largest from (select o_orderpriority, case when l_returnflag <> 'R' then cast(l_shipdate as date) - cast(o_orderdate as date) end as d from lineitem join orders on l_orderkey = o_orderkey) group by 1"""

_AIMS = (("AUTOMOBILE", 12_000_000, 3), ("BUILDING", 9_000_000, 1), ("MACHINERY", 20_000_000, 2))


def joint_comparables(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.max("l_shipdate")).alias("last"))
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(ends, "o_orderkey")
    months = F.when((F.col("c_mktsegment") != "MACHINERY") & (F.col("o_orderkey") % 3 != 0), dates.completed_months(F.to_date("o_orderdate"), F.col("last")))
    df = rows.select("o_orderkey", "c_mktsegment", F.expr("cast(round(o_totalprice * 100) as bigint)").alias("cents"), months.alias("months"))
    targets = spark.createDataFrame([*_AIMS, ("HOUSEHOLD", 1, None)], "c_mktsegment string, first_target long, second_target long")
    return cohort.joint_comparables(df, "o_orderkey", "cents", "months", "c_mktsegment", targets, 4)


_JOINT = f"""with l as (select l_orderkey, cast(max(l_shipdate) as date) as e from lineitem group by 1),
v as (select o_orderkey, c_mktsegment, cast(round(o_totalprice * 100) as bigint) as cents, case when c_mktsegment <> 'MACHINERY' and o_orderkey % 3 <> 0 and e >= d then (year(e) - year(d)) * 12 + month(e) - month(d) - cast(day(e) < day(d) as int) end as months
 from (select *, cast(o_orderdate as date) as d from orders) join customer on o_custkey = c_custkey join l on l_orderkey = o_orderkey),
a as (select *, count(*) over (partition by c_mktsegment order by cents range between unbounded preceding and current row) * 10000 // count(*) over (partition by c_mktsegment) as pa, count(months) over (partition by c_mktsegment) as known from v),
b as (select o_orderkey, count(*) over (partition by c_mktsegment order by months range between unbounded preceding and current row) * 10000 // count(*) over (partition by c_mktsegment) as pb from v where months is not null),
r as (select a.*, pb from a join b on b.o_orderkey = a.o_orderkey where known >= 15),
t as (select * from (values {', '.join(str(x) for x in _AIMS)}) t(c_mktsegment, first_target, second_target)),
w as (select t.*, coalesce((select max(pa) from a where a.c_mktsegment = t.c_mktsegment and cents <= first_target), 0) as ta, coalesce((select max(pb) from r where r.c_mktsegment = t.c_mktsegment and months <= second_target), 0) as tb from t),
d as (select c_mktsegment, cast(first_target as bigint) as first_target, cast(second_target as bigint) as second_target, o_orderkey, abs(cents - first_target) as v, abs(months - second_target) as u, 7 * abs(pa - ta) + 3 * abs(pb - tb) as distance from r join w using (c_mktsegment))
select c_mktsegment, first_target, second_target, position, o_orderkey, distance from (select *, row_number() over (partition by c_mktsegment order by distance, v, u, o_orderkey) as position from d) where position <= 4"""


def snapshot_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array(F.col("n_nationkey").cast("long"), F.col("n_nationkey").cast("long") * 50, F.col("n_nationkey").cast("long"))
    memberships = table(spark, sf_dir, "nation").select(F.col("n_name").alias("snapshot_id"), keys.alias("keys"))
    return ledger.snapshot(memberships, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), "key")


_SNAPSHOT = """with m as (select n_name as snapshot_id, unnest([n_nationkey, n_nationkey * 50, n_nationkey])::bigint as key, unnest([0, 1, 2])::bigint as place from nation),
r as (select *, row_number() over (partition by snapshot_id, key order by place) as mention from m)
select snapshot_id, key, place, case when c_custkey is null then 'unknown' when mention > 1 then 'repeated' else 'member' end as status from r left join customer on c_custkey = key"""


def source_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    contracts = n.select(
        F.col("n_name").alias("source_id"), F.when(F.col("n_regionkey") != 2, "LIVE").otherwise("PAUSED").alias("status"),
        F.array(F.col("n_nationkey") % 5 != 1, F.when(F.col("n_nationkey") != 7, F.lit(True))).alias("gates"), F.date_add(F.to_date(F.lit("2026-01-01")), F.col("n_nationkey") * 10).alias("review_due"),
    )
    return ledger.source_gate(contracts, F.to_date(F.lit("2026-03-02"))).select("source_id", "open")


_GATES = """select n_name as source_id, n_regionkey <> 2 and n_nationkey % 5 <> 1 and n_nationkey <> 7 and date '2026-01-01' + n_nationkey * 10 >= date '2026-03-02' as open from nation"""


def first_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each type of each user, in order of arrival."""
    events = table(spark, sf_dir, "events")
    return events.groupBy("user_id", "event_type").agg(F.min_by(F.struct("event_id", "props"), F.struct("ts", "event_id")).alias("x")).select("user_id", "event_type", "x.event_id", F.get_json_object("x.props", "$.k").cast("long").alias("k"))


_FIRST = """select user_id, event_type, event_id, cast(json_extract_string(props, '$.k') as bigint) as k from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as r from events) where r = 1"""

QUERIES = {
    "case_scores": (case_scores, _CASES),
    "scope_boundary": (scope_boundary, _BOUNDARY), "normalised_phrases": (normalised_phrases, _NORMALISED), "gated_phrases": (gated_phrases, _GATED_SQL), "overlap_report": (overlap_report, _REPORT), "lead_spread": (lead_spread, _SPREAD),
    "joint_comparables": (joint_comparables, _JOINT), "snapshot_members": (snapshot_members, _SNAPSHOT), "source_gates": (source_gates, _GATES), "first_occurrences": (first_occurrences, _FIRST),
}
