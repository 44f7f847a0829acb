"""Queries on orders and line items as projects and procurement evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, dates
from ..operators import cohort, ledger, linkage, matching, relevance, scoring
from ..session import table

CUTOFF = "1998-06-01"
#: Most line numbers of which each is counted by itself; evidence with more of them is gathered in lists.
FEW = 16
#: How a line's state follows from its data, for both engines.
_LINE_STATE = f"case when l_shipdate <= timestamp '{CUTOFF}' and l_linestatus = 'F' then 'CLOSED' when l_shipdate <= timestamp '{CUTOFF}' and l_linestatus = 'O' then 'OPEN' else 'UNRESOLVED' end"
_CENTS = "cast(round(o_totalprice * 100) as bigint)"


def _line_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.expr(_LINE_STATE.replace("timestamp '", "timestamp_ntz '")).alias("state"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")


def order_state_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.rolled_up(_line_states(spark, sf_dir), "o_orderkey")


_ROLLUP = f"""select o_orderkey, count(state) as components, case when bool_or(state = 'UNRESOLVED') or count(state) = 0 then 'UNRESOLVED'
when bool_or(state = 'OPEN') and bool_or(state = 'CLOSED') then 'PARTIAL' when bool_or(state = 'CLOSED') then 'CLOSED' else 'OPEN' end as state
from (select o_orderkey, case when l_orderkey is null then null else {_LINE_STATE} end as state from orders left join lineitem on l_orderkey = o_orderkey) group by o_orderkey"""


def state_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    amounts = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(f"case when o_orderpriority <> '5-LOW' then {_CENTS} end").alias("cents"))
    return matching.state_summary(order_state_rollup(spark, sf_dir).join(amounts, "o_orderkey"), "cents")


_SUMMARY = f"""with r as ({_ROLLUP}), a as (select state, case when o_orderpriority <> '5-LOW' then {_CENTS} end as cents from r join orders using (o_orderkey))
select s.state, cast(count(a.state) as bigint) as n, cast(coalesce(sum(cents), 0) as bigint) as known, cast(count(a.state) - count(cents) as bigint) as missing
from (values ('OPEN'), ('CLOSED'), ('PARTIAL'), ('UNRESOLVED')) s(state) left join a on a.state = s.state group by s.state"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of lines of an order (component, candidate evidence), with tier and disposition."""
    lines = table(spark, sf_dir, "lineitem")
    a = lines.select("l_orderkey", *[F.col(c).alias(f"a_{c[2:]}") for c in lines.columns if c != "l_orderkey"])
    b = lines.select("l_orderkey", *[F.col(c).alias(f"b_{c[2:]}") for c in lines.columns if c != "l_orderkey"])
    pairs = a.join(b, "l_orderkey").where("a_linenumber <> b_linenumber")
    same = lambda c: F.col(f"a_{c}") == F.col(f"b_{c}")
    ship = lambda p: F.to_date(f"{p}_shipdate")
    reference, geography, code = F.col("a_suppkey") % 7 == F.col("b_suppkey") % 7, same("tax"), F.col("a_partkey") % 10 == F.col("b_partkey") % 10
    title = same("discount") | geography
    window = dates.in_window(ship("b"), F.when(F.col("a_linenumber") != 3, F.date_sub(ship("a"), 40)), F.when(F.col("a_linenumber") % 3 != 0, F.date_add(ship("a"), 40)))
    found = matching.tier(reference, same("linestatus"), geography, title, code, same("returnflag"), window, F.col("b_quantity") > 25, F.abs(F.col("a_quantity") - F.col("b_quantity")) < 3)
    day = dates.effective_date(ship("b"), F.when(F.col("b_returnflag") == "R", F.date_sub(ship("b"), 30)))
    judged = [F.col("tier"), matching.plausible(reference, code, geography, title), F.col("b_quantity") % 4 != 0, day, F.to_date(F.lit(CUTOFF))]
    return pairs.withColumn("tier", found).withColumn("disposition", matching.disposition(*judged)).withColumn("reason", matching.disposition_reason(*judged))


_PAIRS = f"""select l_orderkey, a_linenumber, b_linenumber, a_quantity, a_returnflag, tier,
case when late then 'REJECT' when tier in ('A', 'B') then if(exact_span, 'ACCEPT', 'REVIEW') when tier = 'C' or reference or (code and title) then 'REVIEW' else 'REJECT' end as disposition,
case when late then 'after the cutoff' when tier in ('A', 'B') and not exact_span then 'strong, but without an exact span' when tier in ('A', 'B') then 'strong, with an exact span'
 when tier = 'C' then 'corroborated, but not strong' when reference or (code and title) then 'plausible, so it may not be left out' when tier = 'D' then 'alike in words only' else 'no rule holds' end as reason
from (select *, case when not (overlap and inside) then if(semantic, 'D', 'NONE') when reference then 'A' when authority and place and code then 'B' when title and code and corroborating then 'C' when semantic then 'D' else 'NONE' end as tier
 from (select a.l_orderkey, a.l_linenumber as a_linenumber, b.l_linenumber as b_linenumber, a.l_quantity as a_quantity, a.l_returnflag as a_returnflag,
  a.l_suppkey % 7 = b.l_suppkey % 7 as reference, a.l_linestatus = b.l_linestatus as authority, a.l_tax = b.l_tax as place, a.l_discount = b.l_discount or a.l_tax = b.l_tax as title,
  a.l_partkey % 10 = b.l_partkey % 10 as code, a.l_returnflag = b.l_returnflag as overlap, b.l_quantity > 25 as corroborating, abs(a.l_quantity - b.l_quantity) < 3 as semantic, b.l_quantity % 4 <> 0 as exact_span,
  case when a.l_linenumber = 3 then false when a.l_linenumber % 3 = 0 then cast(b.l_shipdate as date) >= cast(a.l_shipdate as date) - 40 else abs(cast(b.l_shipdate as date) - cast(a.l_shipdate as date)) <= 40 end as inside,
  cast(b.l_shipdate as date) - if(b.l_returnflag = 'R', 30, 0) > date '{CUTOFF}' as late
  from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber <> b.l_linenumber))"""


def candidate_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("l_orderkey", "a_linenumber", "b_linenumber", "tier", "disposition", "reason")


def component_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    key = lambda p: (F.col("l_orderkey") * 10 + F.col(f"{p}linenumber")).alias("component")
    components = lines.select(key("l_"), (F.col("l_quantity") >= 45).alias("boundary_unclear"), (F.col("l_returnflag") != "R").alias("coverage_complete"))
    evidence = _pairs(spark, sf_dir).select(key("a_"), F.col("b_linenumber").alias("evidence_id"), "disposition")
    numbers = sorted(r[0] for r in lines.select("l_linenumber").where("l_linenumber is not null").distinct().limit(FEW + 1).collect())
    if len(numbers) <= FEW:
        out, named = matching.component_states(components, evidence, "component", {n: f"E{n:02d}" for n in numbers}), F.col("evidence_ids")
    else:
        out, named = matching.component_states(components, evidence, "component"), F.transform("evidence_ids", lambda n: F.format_string("E%02d", n))
    return out.select("component", "state", "reason", F.array_join(named, ",").alias("evidence_ids"))


_CLASSIFIED = f"""with p as ({_PAIRS}), e as (select l_orderkey * 10 + a_linenumber as component,
 string_agg(format('E{{:02d}}', b_linenumber), ',' order by b_linenumber) filter (disposition = 'ACCEPT') as accepted,
 string_agg(format('E{{:02d}}', b_linenumber), ',' order by b_linenumber) filter (disposition = 'REVIEW') as review from p group by 1),
c as (select l_orderkey * 10 + l_linenumber as component, accepted, review, case when l_quantity >= 45 then 'boundary' when accepted is not null then 'accepted'
 when review is not null then 'review' when l_returnflag = 'R' then 'coverage' else 'none found' end as reason from lineitem left join e on e.component = l_orderkey * 10 + l_linenumber)
select component, case reason when 'accepted' then 'CLOSED' when 'none found' then 'OPEN' else 'UNRESOLVED' end as state, reason,
case reason when 'boundary' then concat_ws(',', accepted, review) when 'accepted' then accepted when 'review' then review else '' end as evidence_ids from c"""


def existence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.col("tier")
    flags = matching.existence_flags(_pairs(spark, sf_dir), "l_orderkey", {"exact": tier == "A", "compatible": tier.isin("A", "B"), "structural": tier.isin("A", "B", "C")})
    return matching.flag_totals(flags, "exact", "compatible", "structural")


_FLAGS = f"""with p as (select l_orderkey, bool_or(tier = 'A') as exact, bool_or(tier in ('A', 'B')) as compatible, bool_or(tier in ('A', 'B', 'C')) as structural from ({_PAIRS}) group by 1)
select flag, cast(hits as bigint) as hits, cast(hits * 10000 // n as bigint) as bps from (select count(*) as n, count_if(exact) as exact, count_if(compatible) as compatible, count_if(structural) as structural from p)
unpivot (hits for flag in (exact, compatible, structural))"""


def code_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    lists = F.when(F.col("p_size") % 10 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand", F.concat(F.lit("9"), F.col("p_size").cast("string"))))
    return part.select("p_partkey", codes.code_has_prefix(lists, F.array(F.lit("1"), F.lit("23"), F.lit("94"))).alias("hit"))


_PREFIX = """select p_partkey, p_size % 10 <> 0 and (regexp_matches(regexp_replace(p_brand, '\\D', '', 'g'), '^(1|23|94)') or regexp_matches('9' || p_size, '^94')) as hit from part"""


def geo_hierarchy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    full = F.format_string("R%dN%02d", "n_regionkey", "n_nationkey")
    places = nation.select("n_nationkey", "n_regionkey", full.alias("code"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "n_regionkey", F.when(F.col("c_custkey") % 2 == 0, F.format_string("r%d", "n_regionkey")).otherwise(F.col("code")).alias("own"))
    s = table(spark, sf_dir, "supplier").join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", F.concat("code", F.lit(" | x")).alias("listed")).agg(F.count(F.lit(1)).alias("k"))
    hits = c.join(s, "n_regionkey").where(codes.in_hierarchy(F.col("own"), F.col("listed")))
    return hits.groupBy("c_custkey").agg(F.sum("k").alias("suppliers"))


_GEO = """select c_custkey, count(*) as suppliers from customer join nation n on c_nationkey = n.n_nationkey join nation m on m.n_regionkey = n.n_regionkey and (c_custkey % 2 = 0 or m.n_nationkey = n.n_nationkey)
join supplier on s_nationkey = m.n_nationkey group by 1"""


def date_window_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")).alias("s"), F.when(F.col("o_orderstatus") == "F", F.date_add(F.to_date("o_orderdate"), 60)).alias("e"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("d"))
    inside = dates.in_window(F.col("d"), F.col("s"), F.col("e"))
    return o.join(lines, "o_orderkey").groupBy("o_orderkey").agg(F.count_if(inside).alias("inside"), F.count(F.lit(1)).alias("lines"))


_WINDOW = """select o_orderkey, count_if(case o_orderstatus when 'P' then false when 'F' then cast(l_shipdate as date) between cast(o_orderdate as date) and cast(o_orderdate as date) + 60
else cast(l_shipdate as date) >= cast(o_orderdate as date) end)::bigint as inside, count(*) as lines from orders join lineitem on l_orderkey = o_orderkey group by 1"""


def exact_reference_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References equal an order's code or its alias; the join is by key, of which an order has one for each."""
    refs = table(spark, sf_dir, "lineitem").select(F.expr("case l_linenumber % 5 when 0 then ' o-' || l_orderkey || ' ' when 1 then 'O-' || l_orderkey when 2 then '' when 3 then 'alt/' || l_orderkey end").alias("ref"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("O-"), F.col("o_orderkey").cast("string")).alias("code"), F.when(F.col("o_orderkey") % 3 != 0, F.array(F.concat(F.lit("ALT/"), F.col("o_orderkey").cast("string")), F.lit(" "))).alias("aliases"))
    keyed = o.select("o_orderkey", "code", "aliases", F.explode(codes.reference_keys(F.col("code"), F.col("aliases"))).alias("key"))
    hits = keyed.join(refs, (F.col("key") == F.lower(F.trim("ref"))) & codes.same_reference(F.col("code"), F.col("ref"), F.col("aliases")))
    return hits.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("hits"))


_REFERENCE = """select l_orderkey as o_orderkey, count(*) as hits from lineitem join orders on l_orderkey = o_orderkey where l_linenumber % 5 in (0, 1) or l_linenumber % 5 = 3 and l_orderkey % 3 <> 0 group by 1"""


def title_or_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages (notices) whose text holds the site name in their own URL, or whose number agrees in place, next to a blank title."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    title = F.when(F.col("doc_id") % 10 == 0, F.lit("  ")).when(F.col("doc_id") % 10 != 1, F.concat(F.lit(" THE "), F.col("lang"), F.lit(" "))).otherwise(F.lit(None).cast("string"))
    place = codes.in_hierarchy(F.when(F.col("doc_id") % 4 != 0, F.col("source")), F.concat(F.lit("src1|"), F.col("lang")))
    return d.select("doc_id", codes.title_or_location(title, place, F.col("text"), F.col("source")).alias("hit"))


_TITLE = """select doc_id, coalesce(doc_id % 4 <> 0 and (starts_with(source, 'src1') or starts_with('src1', source) or starts_with(source, lang) or starts_with(lang, source)), false)
or (doc_id % 10 > 1 and coalesce(contains(lower(text), 'the ' || lang) or contains(lower(source), 'the ' || lang), false)) as hit from documents"""


def relevance_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "part").where(F.startswith(codes.digits(F.col("p_brand")), F.lit("2"))).select("p_partkey")
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit(CUTOFF).cast("timestamp_ntz")).join(wanted, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    o = table(spark, sf_dir, "orders")
    return o.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))


_PREFILTER = f"""select o_orderpriority, count(*) as orders from orders where o_orderkey in (select l_orderkey from lineitem where l_shipdate <= timestamp '{CUTOFF}'
and l_partkey in (select p_partkey from part where regexp_replace(p_brand, '\\D', '', 'g') like '2%')) group by 1"""


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.expr(_CENTS).alias("cents"))


def funding_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.ecdf(_amounts(spark, sf_dir), "cents", "o_orderpriority").select("o_orderpriority", "cents", "at_most", "n", "bps")


_ECDF = f"""with v as (select o_orderpriority, {_CENTS} as cents from orders), r as (select *, count(*) over (partition by o_orderpriority order by cents range between unbounded preceding and current row) as at_most,
count(*) over (partition by o_orderpriority) as n from v) select distinct o_orderpriority, cents, at_most, n, at_most * 10000 // n as bps from r"""


def funding_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.quantiles(_amounts(spark, sf_dir), "cents", "o_orderpriority").select("o_orderpriority", "n", "q1", "median_low", "q3", "p90", "least", "most")


_QUANTILES = f"""select o_orderpriority, count(*) as n, quantile_disc(c, 0.25) as q1, quantile_disc(c, 0.5) as median_low, quantile_disc(c, 0.75) as q3, quantile_disc(c, 0.9) as p90, min(c) as least, max(c) as most
from (select o_orderpriority, {_CENTS} as c from orders) group by 1"""


def readiness_cohort_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.format_string("%s-%02d", "c_mktsegment", F.col("c_nationkey") * 2 + (F.col("c_custkey") % 2).cast("int")).alias("cohort"), F.abs(F.round("c_acctbal").cast("long")).alias("amount"))
    c = c.where("c_custkey % 2 = 0 or c_custkey % 5 = 0")
    proposed = c.groupBy("cohort").agg(F.when(~F.startswith("cohort", F.lit("M")), F.min("c_custkey") * 100).alias("proposed"))
    return cohort.tiered_quantiles(c, "amount", "cohort", proposed)


_TIERS = """with v as (select format('{}-{:02d}', c_mktsegment, c_nationkey * 2 + c_custkey % 2) as cohort, c_custkey, abs(cast(round(c_acctbal) as bigint)) as x from customer where c_custkey % 2 = 0 or c_custkey % 5 = 0),
p as (select cohort, case when cohort not like 'M%' then min(c_custkey) * 100 end as proposed from v group by 1),
q as (select cohort, count(*) as n, quantile_disc(x, 0.25) as q1, quantile_disc(x, 0.75) as q3, quantile_disc(x, 0.9) as p90, min(x) as least, max(x) as most, list_sort(list(x)) as xs, count_if(x <= proposed) as below, any_value(proposed) as proposed
 from v join p using (cohort) group by 1)
select cohort, n, case when n >= 30 then 'FULL' when n >= 15 then 'DESCRIPTIVE' else 'REFERENCE' end as tier,
case when n < 15 then null when n % 2 = 1 then xs[(n + 1) // 2]::varchar else ((xs[n // 2] + xs[n // 2 + 1]) // 2) || if((xs[n // 2] + xs[n // 2 + 1]) % 2 = 0, '', '.5') end as median,
case when n >= 15 then least end as least, case when n >= 15 then most end as most, case when n >= 30 then q1 end as q1, case when n >= 30 then q3 end as q3, case when n >= 30 then p90 end as p90,
case when n >= 30 and proposed is not null then cast(below as bigint) end as count_at_most, case when n >= 30 and proposed is not null then cast(below * 10000 // n as bigint) end as position_bps from q"""

_TARGETS = (("1-URGENT", 15_000_000), ("3-MEDIUM", 9_000_000), ("5-LOW", 1))


def closest_comparables(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = spark.createDataFrame(list(_TARGETS), "o_orderpriority string, target long")
    return cohort.comparables(_amounts(spark, sf_dir), "o_orderkey", "cents", "o_orderpriority", targets, 5)


_NEAREST = f"""with v as (select o_orderkey, o_orderpriority, {_CENTS} as cents from orders), e as (select *, count(*) over (partition by o_orderpriority order by cents range between unbounded preceding and current row) * 10000 // count(*) over (partition by o_orderpriority) as bps from v),
t as (select * from (values {', '.join(f"('{p}', {x})" for p, x in _TARGETS)}) t(o_orderpriority, target)),
b as (select t.*, coalesce((select max(bps) from e where e.o_orderpriority = t.o_orderpriority and cents <= target), 0) as tb from t),
r as (select o_orderpriority, cast(target as bigint) as target, row_number() over (partition by o_orderpriority order by abs(bps - tb), abs(cents - target), o_orderkey) as position, o_orderkey, cents, bps from e join b using (o_orderpriority))
select * from r where position <= 5"""


def high_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = spark.createDataFrame([(p, x + 24_000_000) for p, x in _TARGETS], "o_orderpriority string, target long")
    return cohort.at_or_above(_amounts(spark, sf_dir), "o_orderkey", "cents", "o_orderpriority", targets)


_HIGH_END = f"""with t as (select o_orderpriority, cast(target + 24000000 as bigint) as target from (values {', '.join(f"('{p}', {x})" for p, x in _TARGETS)}) t(o_orderpriority, target))
select o_orderpriority, target, row_number() over (partition by o_orderpriority order by {_CENTS}, o_orderkey) as position, o_orderkey, {_CENTS} as cents from orders join t using (o_orderpriority) where {_CENTS} >= target"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.max("l_shipdate")).alias("last"), F.to_date(F.min("l_shipdate")).alias("first"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus").join(ends, "o_orderkey")


def completed_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).select("o_orderkey", dates.completed_months(F.col("day"), F.col("last")).alias("months"), dates.completed_months(F.col("last"), F.col("first")).alias("backwards"))


_MONTHS = """with s as (select o_orderkey, cast(o_orderdate as date) as d, cast(max(l_shipdate) as date) as l, cast(min(l_shipdate) as date) as f from orders join lineitem on l_orderkey = o_orderkey group by 1, 2)
select o_orderkey, case when l >= d then (year(l) - year(d)) * 12 + month(l) - month(d) - cast(day(l) < day(d) as int) end as months, case when f >= l then 0 end as backwards from s"""


def lead_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads of the orders whose outcome is not before its signal; the others are refused."""
    spans = _spans(spark, sf_dir).where(~ledger.leads_backwards(F.col("day"), F.col("first")))
    return spans.select("o_orderkey", ledger.lead_days(F.col("day"), F.col("first")).alias("lead"))


_LEAD = """select o_orderkey, cast(f - d as bigint) as lead from
(select o_orderkey, cast(o_orderdate as date) as d, cast(max(l_shipdate) as date) as l, cast(min(l_shipdate) as date) as f from orders join lineitem on l_orderkey = o_orderkey group by 1, 2) where f >= d"""


def boundary_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("o_orderstatus") != "P", F.col("cents"))
    least, most = F.when(F.col("k") % 3 != 0, F.lit(5_000_000)), F.when(F.col("k") % 2 == 0, F.lit(20_000_000))
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", F.expr(_CENTS).alias("cents"), F.col("o_orderkey").alias("k"))
    return rows.groupBy(cohort.boundary_check(value, least, most).alias("result")).agg(F.count(F.lit(1)).alias("n"))


_BOUNDARY = f"""select case when o_orderstatus = 'P' then 'UNKNOWN' when o_orderkey % 3 = 0 and o_orderkey % 2 <> 0 then 'NO_BOUNDARY' when o_orderkey % 3 <> 0 and {_CENTS} < 5000000 then 'BELOW_MINIMUM'
when o_orderkey % 2 = 0 and {_CENTS} > 20000000 then 'ABOVE_MAXIMUM' else 'WITHIN' end as result, count(*) as n from orders group by 1"""


def key_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber >= 5")
    signed = linkage.key_signatures(lines, "l_partkey", "l_returnflag", "l_linestatus")
    return signed.groupBy("status", "variants").agg(F.count(F.lit(1)).alias("keys"), F.sum("rows").alias("rows"))


_CONFLICTS = """select case when v = 1 then 'usable' else 'ambiguous' end as status, v as variants, count(*) as keys, cast(sum(r) as bigint) as "rows" from
(select l_partkey, count(distinct l_returnflag || '|' || l_linestatus) as v, count(*) as r from lineitem where l_linenumber >= 5 group by 1) group by 1, 2"""


def unambiguous_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber >= 6").withColumnRenamed("l_partkey", "p_partkey")
    return linkage.unambiguous_join(table(spark, sf_dir, "part").select("p_partkey"), lines, "p_partkey", "l_returnflag")


_UNAMBIGUOUS = """with k as (select l_partkey, count(distinct l_returnflag) as v, min(l_returnflag) as f from lineitem where l_linenumber >= 6 group by 1)
select p_partkey, case when v = 1 then f end as l_returnflag, case when v is null then 'absent' when v = 1 then 'usable' else 'ambiguous' end as status from part left join k on l_partkey = p_partkey"""


def linkage_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 11 != 0, F.col("c_custkey")).alias("k"))
    return linkage.link_coverage(customers, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


_COVERAGE = """with c as (select distinct c_custkey as k from customer where c_custkey % 11 <> 0), o as (select distinct o_custkey as k from orders)
select *, in_both * 10000 // left_keys as covered_bps from (select count(c.k) as left_keys, count(o.k) as right_keys, cast(count_if(c.k is not null and o.k is not null) as bigint) as in_both,
cast(count_if(o.k is null) as bigint) as left_only, cast(count_if(c.k is null) as bigint) as right_only from c full join o on c.k = o.k)"""


def lifecycle_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linestatus", F.to_date("l_shipdate").alias("planned"), F.when(F.col("l_returnflag") == "R", F.to_date("l_shipdate")).when(F.col("l_returnflag") == "A", F.to_date(F.lit("9999-12-31"))).alias("actual"))
    return linkage.lifecycle(lines, "l_partkey", "planned", "actual", F.col("l_linestatus") == "O", F.to_date(F.lit("1997-03-15")), "1996-01-01", "2001-06-30", ["9999-12-31"])


_LIFECYCLE = """select l_partkey, count(*) as "rows", min(p) as earliest, max(p) as latest, min(p) <> max(p) as conflict, min(p) between date '1997-03-15' and date '1998-03-15' as due_12, min(p) between date '1997-03-15' and date '1999-03-15' as due_24
from (select l_partkey, cast(l_shipdate as date) as p from lineitem where l_linestatus = 'O' and l_returnflag <> 'R') where p between date '1996-01-01' and date '2001-06-30' group by 1"""


def nested_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return linkage.most_common_each(lines, "p_type", "p_brand", 3)


_NESTED = """select * from (select p_type, p_brand, n, row_number() over (partition by p_type order by n desc, p_brand) as position from (select p_type, p_brand, count(*) as n from lineitem join part on l_partkey = p_partkey group by 1, 2)) where position <= 3"""


def prefix_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return linkage.prefix_prevalence(lines, codes.digits(F.col("p_brand")), {"ones": ["1"], "teens": ["11", "12", "13"], "fives": ["5", "15", "25"]})


_PREVALENCE = """with v as (select regexp_replace(p_brand, '\\D', '', 'g') as c from lineitem join part on l_partkey = p_partkey), s as (select count(*) as total, count_if(c like '1%') as ones, count_if(regexp_matches(c, '^1[123]')) as teens,
count_if(regexp_matches(c, '^(5|15|25)')) as fives, count_if(regexp_matches(c, '^(1|5|25)')) as "union" from v) select family, cast(n as bigint) as n, cast(n * 10000 // total as bigint) as bps from s unpivot (n for family in (ones, teens, fives, "union"))"""


def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.datediff(F.to_date("l_shipdate"), F.to_date(F.lit("1995-01-01"))).cast("long")
    spans = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))
    found = scoring.overlaps(spans.where("l_linenumber % 2 = 1"), spans.where("l_linenumber % 2 = 0"), "l_orderkey")
    return found.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("pairs"), F.sum("shared").alias("shared"))


_OVERLAP = """with s as (select l_orderkey, l_linenumber, cast(l_shipdate as date) - date '1995-01-01' as a, cast(l_shipdate as date) - date '1995-01-01' + cast(l_quantity as bigint) as e from lineitem)
select l.l_orderkey, count(*) as pairs, cast(sum(least(l.e, r.e) - greatest(l.a, r.a)) as bigint) as shared from s l join s r on l.l_orderkey = r.l_orderkey and l.l_linenumber % 2 = 1 and r.l_linenumber % 2 = 0
and greatest(l.a, r.a) < least(l.e, r.e) group by 1"""


def _opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_name", "n_regionkey")
    o = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderstatus", "o_orderpriority", "c_mktsegment", "n_name", "n_regionkey", F.expr(_CENTS).alias("cents"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", codes.digits(F.col("p_brand")).alias("code"))
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "p_type", "code")
    return relevance.opportunities(o, lines, "o_orderkey")


_OPPORTUNITIES = f"""select o_orderkey, o_orderstatus, o_orderpriority, c_mktsegment, n_name, n_regionkey, {_CENTS} as cents, l_linenumber, p_type, code from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
left join (select l_orderkey, l_linenumber, p_type, regexp_replace(p_brand, '\\D', '', 'g') as code from lineitem join part on l_partkey = p_partkey where l_returnflag = 'N') on l_orderkey = o_orderkey"""


def opportunity_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relevance.searched(_opportunities(spark, sf_dir), "Build", ["n_name", "c_mktsegment", "p_type"], o_orderstatus="O")
    shown = relevance.page(found, [F.desc("cents"), F.asc("o_orderkey"), F.asc_nulls_first("l_linenumber")], 3, 25)
    return shown.select("o_orderkey", F.coalesce("l_linenumber", F.lit(0)).cast("long").alias("line"), "cents", "n_name", relevance.status_text(F.lit("OPEN")).alias("says"))


_SEARCH = f"""select o_orderkey, cast(coalesce(l_linenumber, 0) as bigint) as line, cents, n_name, 'No procurement match found up to the cutoff' as says from ({_OPPORTUNITIES})
where o_orderstatus = 'O' and contains(lower(concat_ws(' ', n_name, c_mktsegment, p_type)), 'build') order by cents desc, o_orderkey, l_linenumber nulls first limit 25 offset 50"""


def last_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page beyond the end is the last one."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return relevance.page(suppliers, [F.desc("s_suppkey")], 10**6, 25)


_LAST_PAGE = """select s_suppkey, s_name from (select *, row_number() over (order by s_suppkey desc) as r, count(*) over () as n from supplier) where r > (n - 1) // 25 * 25"""


def relevance_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _opportunities(spark, sf_dir)
    score = relevance.relevance_score(
        relevance.criterion(F.array("c_mktsegment"), F.array(F.lit("BUILDING"), F.lit("MACHINERY"))), relevance.prefix_criterion(F.when(F.col("code").isNotNull(), F.array("code")), F.array(F.lit("1"), F.lit("24"))),
        F.col("n_regionkey").isin(1, 3), F.col("cents") >= 10_000_000,
    )
    scored = rows.withColumn("score", score).withColumn("label", relevance.relevance_label(F.col("score"), F.col("o_orderkey") % 13 != 0))
    return scored.orderBy(F.desc("score"), "o_orderkey", F.asc_nulls_first("l_linenumber")).limit(200).select("o_orderkey", F.coalesce("l_linenumber", F.lit(0)).cast("long").alias("line"), "score", "label")


_RANKING = f"""with s as (select o_orderkey, l_linenumber, cast(c_mktsegment in ('BUILDING', 'MACHINERY') as bigint) + cast(coalesce(regexp_matches(code, '^(1|24)'), false) as bigint) + cast(n_regionkey in (1, 3) as bigint) + cast(cents >= 10000000 as bigint) as score from ({_OPPORTUNITIES}))
select o_orderkey, cast(coalesce(l_linenumber, 0) as bigint) as line, score, case when o_orderkey % 13 = 0 or score = 2 then 'LOW' when score = 4 then 'HIGH' when score = 3 then 'MEDIUM' else 'NOT_RELEVANT' end as label from s order by s.score desc, o_orderkey, l_linenumber nulls first limit 200"""


def market_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.when(F.col("o_orderkey") % 9 != 0, F.expr(_CENTS)).alias("cents"))
    sums = o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("cents"), F.lit(0)).alias("known"), F.count("cents").alias("with_amount"))
    return sums.select("o_orderpriority", "n", "known", scoring.basis_points(F.col("with_amount"), F.col("n")).alias("coverage_bps"))


_MARKET = f"""select o_orderpriority, count(*) as n, cast(sum({_CENTS}) filter (o_orderkey % 9 <> 0) as bigint) as known, count(*) filter (o_orderkey % 9 <> 0) * 10000 // count(*) as coverage_bps from orders group by 1"""



def parseable_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of amounts written with a comma, of which some are ambiguous, negative or missing."""
    cents = F.expr(_CENTS)
    whole, rest = F.floor(cents / 100).cast("long").cast("string"), F.lpad((cents % 100).cast("string"), 2, "0")
    written = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("1.2."), rest)).when(F.col("o_orderkey") % 7 == 1, F.concat(F.lit("-"), whole)).when(F.col("o_orderkey") % 7 != 2, F.concat(F.lit(" "), whole, F.lit(","), rest))
    sums = scoring.parseable_sum(table(spark, sf_dir, "orders").select("o_orderstatus", written.alias("amount")), "o_orderstatus", "amount")
    return sums.select("o_orderstatus", "rows", "parsed", (F.col("total") * 100).cast("long").alias("cents"))


_PARSEABLE = f"""select o_orderstatus, count(*) as "rows", count(*) filter (o_orderkey % 7 > 2) as parsed, cast(sum({_CENTS}) filter (o_orderkey % 7 > 2) as bigint) as cents from orders group by 1"""

QUERIES = {
    "order_state_rollup": (order_state_rollup, _ROLLUP), "state_summary": (state_summary, _SUMMARY),
    "candidate_tiers": (candidate_tiers, f"select l_orderkey, a_linenumber, b_linenumber, tier, disposition, reason from ({_PAIRS})"),
    "component_classification": (component_classification, _CLASSIFIED), "existence_flags": (existence_flags, _FLAGS), "code_prefix_match": (code_prefix_match, _PREFIX),
    "geo_hierarchy_match": (geo_hierarchy_match, _GEO), "date_window_match": (date_window_match, _WINDOW), "exact_reference_join": (exact_reference_join, _REFERENCE),
    "relevance_prefilter": (relevance_prefilter, _PREFILTER), "funding_ecdf": (funding_ecdf, _ECDF), "funding_quantiles": (funding_quantiles, _QUANTILES),
    "readiness_cohort_tiers": (readiness_cohort_tiers, _TIERS), "closest_comparables": (closest_comparables, _NEAREST), "completed_months": (completed_months, _MONTHS),
    "lead_days": (lead_days, _LEAD), "boundary_matrix": (boundary_matrix, _BOUNDARY), "key_conflicts": (key_conflicts, _CONFLICTS), "unambiguous_link": (unambiguous_link, _UNAMBIGUOUS),
    "linkage_coverage": (linkage_coverage, _COVERAGE), "lifecycle_windows": (lifecycle_windows, _LIFECYCLE), "nested_counts": (nested_counts, _NESTED), "prefix_prevalence": (prefix_prevalence, _PREVALENCE),
    "high_end": (high_end, _HIGH_END), "title_or_location": (title_or_location, _TITLE), "last_page": (last_page, _LAST_PAGE), "parseable_sums": (parseable_sums, _PARSEABLE),
    "interval_overlap": (interval_overlap, _OVERLAP), "opportunity_search_page": (opportunity_search_page, _SEARCH), "relevance_ranking": (relevance_ranking, _RANKING), "market_summary": (market_summary, _MARKET),
}
