"""Source divergence audit: how far each source's vocabulary lies from the other sources of its language, by relational steps alone.

Terms are counted per language and source. A language keeps the terms that
enough of its documents hold. Every source of a language gives every kept term
a share in parts of a billion, with five occurrences added to each count, so
a term that a source never uses has a share too. Two sources differ in a term
by the distance of their shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, written

#: What lies between terms, which are runs of ASCII letters and all characters beyond ASCII.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GROUP = ["lang", "source"]
#: Shares are whole parts of this; so many occurrences are added to each count.
PARTS, ADDED = 1_000_000_000, 5


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(PARTS * (count + ADDED) / (total + ADDED * terms)), exactly."""
    wide = ((count + F.lit(ADDED)).cast("decimal(19,0)") * F.lit(PARTS).cast("decimal(10,0)"))
    return F.lit(1) + F.call_function("div", wide, (total + F.lit(ADDED) * terms).cast("decimal(19,0)"))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it), of whole texts; null text, lang and source are read as empty.

    A text's terms are sorted within the row, so the first of equal ones stands for the document and no
    document has to be told from another.
    """
    read = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in GROUP], F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).alias("text"))
    terms = read.select(*GROUP, F.sort_array(F.split("text", BETWEEN)).alias("terms"))
    each = terms.select(*GROUP, "terms", F.posexplode_outer("terms").alias("at", "term"))  # an inner one has the text split twice
    first = (F.col("at") == 0) | (F.get("terms", F.col("at") - 1) != F.col("term"))
    return each.where("term <> ''").groupBy(*GROUP, "term").agg(F.count("*").alias("n"), F.sum(first.cast("long")).alias("docs"))


def kept_counts(docs: DataFrame, least_docs: int = 30) -> DataFrame:
    """The counts of terms that at least least_docs documents of the language hold, and the language's count as lang_n."""
    over = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumns({"lang_n": F.sum("n").over(over), "lang_docs": F.sum("docs").over(over)})
    return counts.where(F.col("lang_docs") >= least_docs).select(*GROUP, "term", "n", "lang_n")


def source_divergence(docs: DataFrame, least_docs: int = 30, most_terms: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: distances between sources (part `pair`) and terms that a source overuses (part `term`).

    `pair`: for each other source of the language, the distance of their shares summed over all kept terms, every rank.
    `term`: for each kept term of the source whose share is above the language's, by how much, the first most_terms.
    Ties rank by the item's UTF-8 bytes. A source without a kept term has the share of count zero for all of them; a
    language without a kept term has pairs of value 0. Repeated rows count each time; no rows give no rows; other
    columns are ignored. Counts may reach 10^18.

    The rows of a term meet in one place per language and term, of which there are as many as sources, never those of
    a source or a language.
    """
    kept = written(kept_counts(docs, least_docs), "divergence")
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in GROUP]).distinct()
    of_lang = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = written(
        groups.join(kept.groupBy(*GROUP).agg(F.sum("n").alias("total")), GROUP, "left").join(of_lang, "lang", "left").na.fill(0, ["total", "terms", "lang_total"]),
        "divergence-groups",
    )
    near = small_side(totals)

    overused = (
        kept.join(near, GROUP)
        .withColumn("value", _share(F.col("n"), F.col("total"), F.col("terms")) - _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")))
        .where("value > 0")
        .select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    )

    dense = kept.select("lang", "term").distinct().join(near, "lang").join(kept.select(*GROUP, "term", "n"), ["lang", "term", "source"], "left")
    shares = dense.select("lang", "term", "source", _share(F.coalesce("n", F.lit(0)), F.col("total"), F.col("terms")).alias("share"))
    other = shares.select("lang", "term", F.col("source").alias("item"), F.col("share").alias("other"))
    sums = shares.join(other, ["lang", "term"]).where("source < item").groupBy(*GROUP, "item").agg(F.sum(F.abs(F.col("share") - F.col("other"))).alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    all_pairs = totals.select(*GROUP).join(totals.select("lang", F.col("source").alias("item")), "lang").where("source != item")
    pairs = all_pairs.join(both, [*GROUP, "item"], "left").select(*GROUP, F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    by_value = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    columns = [*GROUP, "part", "item", "value", "rank"]
    top = overused.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= most_terms)
    return pairs.withColumn("rank", F.row_number().over(by_value)).select(*columns).unionByName(top.select(*columns))


#: The same in DuckDB's SQL, of `documents`, with 30 documents and 50 terms.
SQL = r"""
with docs as (
    select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
    from documents
), occurrences as (
    select row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs
), vocabulary as (
    select lang, term, count(*) as lang_n from occurrences group by lang, term having count(distinct row) >= 30
), groups as (
    select distinct lang, source from docs
), counts as (
    select lang, source, term, count(*) as n from occurrences group by lang, source, term
), dense as (
    select g.lang, g.source, v.term, v.lang_n, coalesce(c.n, 0) as n,
        sum(coalesce(c.n, 0)) over (partition by g.lang, g.source) as total,
        sum(v.lang_n) over (partition by g.lang, g.source) as lang_total,
        count(*) over (partition by g.lang, g.source) as terms
    from groups g join vocabulary v on g.lang = v.lang
    left join counts c on c.lang = g.lang and c.source = g.source and c.term = v.term
), shares as (
    select lang, source, term, n, 1 + (1000000000 * (n + 5)::hugeint) // (total + 5 * terms) as p,
        1 + (1000000000 * (lang_n + 5)::hugeint) // (lang_total + 5 * terms) as q
    from dense
), pairs as (
    select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
    from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source
    group by a.lang, a.source, b.source
), ranked as (
    select a.lang, a.source, 'pair' as part, b.source as item, coalesce(p.value, 0) as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
    union all
    select lang, source, 'term', term, p - q from shares where n > 0 and p > q
), numbered as (
    select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from ranked
)
select lang, source, part, item, value::bigint as value, rank::int as rank from numbered where part = 'pair' or rank <= 50
"""
