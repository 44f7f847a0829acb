"""Coverage, linkage and conflict diagnostics between two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_signatures(df: DataFrame, key: str, *signature: str) -> DataFrame:
    """Per key: rows, distinct signatures, and status: usable if all its rows share one signature, else ambiguous."""
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.struct(*signature)).alias("variants"))
    return out.withColumn("status", F.when(F.col("variants") == 1, "usable").otherwise("ambiguous"))


def unambiguous_join(left: DataFrame, right: DataFrame, key: str, *signature: str) -> DataFrame:
    """left with status (usable, ambiguous or absent) of its key in right, and the signature of usable keys."""
    per_key = right.where(F.col(key).isNotNull()).groupBy(key).agg(
        *[F.min(c).alias(c) for c in signature], F.count_distinct(F.struct(*signature)).alias("variants")
    )
    known = per_key.select(key, *[F.when(F.col("variants") == 1, F.col(c)).alias(c) for c in signature], F.when(F.col("variants") == 1, "usable").otherwise("ambiguous").alias("status"))
    return left.join(known, key, "left").withColumn("status", F.coalesce("status", F.lit("absent")))


def link_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys of either side, in both, only left, only right, and the covered basis points of left."""
    sides = left.select(F.col(key).alias("k"), F.lit(1).alias("side")).unionByName(right.select(F.col(key).alias("k"), F.lit(2).alias("side"))).where("k is not null")
    keys = sides.groupBy("k").agg(F.bool_or(F.col("side") == 1).alias("l"), F.bool_or(F.col("side") == 2).alias("r"))
    out = keys.agg(
        F.count_if("l").alias("left_keys"), F.count_if("r").alias("right_keys"), F.count_if(F.col("l") & F.col("r")).alias("in_both"),
        F.count_if(F.col("l") & ~F.col("r")).alias("left_only"), F.count_if(~F.col("l") & F.col("r")).alias("right_only"),
    )
    return out.withColumn("covered_bps", F.when(F.col("left_keys") > 0, F.expr("in_both * 10000 div left_keys")).otherwise(F.lit(0)).cast("long"))


def most_common(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """The k most frequent values, ties by value."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *columns).limit(k)


def most_common_each(df: DataFrame, group: str, column: str, k: int) -> DataFrame:
    """The k most frequent values of each group, with position."""
    counts = df.groupBy(group, column).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), column))
    return counts.withColumn("position", rank.cast("long")).where(F.col("position") <= k)


def ceiling(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row on two flags of the same keys: total, sizes of a, b, union, intersection, a without b, and union in basis points."""
    out = df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(a).alias("a"), F.count_if(b).alias("b"), F.count_if(a | b).alias("a_or_b"),
        F.count_if(a & b).alias("a_and_b"), F.count_if(a & ~b).alias("a_not_b"),
    )
    return out.withColumn("union_bps", F.when(F.col("total") > 0, F.expr("a_or_b * 10000 div total")).otherwise(F.lit(0)).cast("long"))


def lifecycle(df: DataFrame, key: str, planned: str, actual: str, active: Column, as_of: Column, low: str, high: str, open_marks: Sequence[str] = ()) -> DataFrame:
    """Per key of the active rows not yet begun: rows, earliest and latest plan within [low, high], conflict, and whether due within 12 or 24 months.

    A row has not begun if its actual day is null or one of open_marks.
    """
    begun = F.col(actual).isNotNull()
    if open_marks:
        begun = begun & ~F.col(actual).isin(*[F.to_date(F.lit(m)) for m in open_marks])
    cohort = df.where(active & ~begun & F.col(planned).between(F.to_date(F.lit(low)), F.to_date(F.lit(high))))
    out = cohort.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.min(planned).alias("earliest"), F.max(planned).alias("latest"))
    within = lambda m: (F.col("earliest") >= as_of) & (F.col("earliest") <= F.add_months(as_of, m))
    return out.select(key, "rows", "earliest", "latest", (F.col("earliest") != F.col("latest")).alias("conflict"), within(12).alias("due_12"), within(24).alias("due_24"))


def linked_types(df: DataFrame, key: str, kind: str, early: Sequence[str], late: Sequence[str]) -> DataFrame:
    """One row: keys, those with an early type, with a late type, and with both, each also in basis points of all keys (floor; 0 of none)."""
    per = df.groupBy(key).agg(F.bool_or(F.col(kind).isin(*early)).alias("e"), F.bool_or(F.col(kind).isin(*late)).alias("l"))
    sums = per.agg(F.count(F.lit(1)).alias("keys"), F.count_if("e").alias("early"), F.count_if("l").alias("late"), F.count_if(F.col("e") & F.col("l")).alias("linked"))
    return sums.select("*", *[F.when(F.col("keys") > 0, F.expr(f"{c} * 10000 div keys")).otherwise(0).cast("long").alias(f"{c}_bps") for c in ("early", "late", "linked")])


def prefix_prevalence(df: DataFrame, code: Column, families: dict[str, Sequence[str]]) -> DataFrame:
    """Per family of code prefixes, and for their union (counted once): rows, and basis points of all rows."""
    hits = {n: F.coalesce(code.rlike("^(?:" + "|".join(p) + ")"), F.lit(False)) for n, p in families.items()}
    union = F.lit(False)
    for h in hits.values():
        union = union | h
    sums = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(h).alias(n) for n, h in {**hits, "union": union}.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("family"), F.col(f"`{n}`").alias("n"), F.expr(f"`{n}` * 10000 div total").alias("bps")) for n in [*families, "union"]])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def field_availability(df: DataFrame, title: Column, other: Column) -> DataFrame:
    """One row: rows, with a title, with the other field, with both, with either, other that differs from the title, distinct others."""
    t, o = F.coalesce(F.trim(title) != "", F.lit(False)), F.coalesce(F.trim(other) != "", F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(t).alias("title"), F.count_if(o).alias("other"), F.count_if(t & o).alias("in_both"), F.count_if(t | o).alias("either"),
        F.count_if(o & t & (F.trim(title) != F.trim(other))).alias("differs"), F.count_distinct(F.when(o, F.trim(other))).alias("distinct_other"),
    )


def length_profile(df: DataFrame, text: Column, thresholds: Sequence[int]) -> DataFrame:
    """One row per threshold: how many texts have at least so many code points."""
    sums = df.agg(*[F.count_if(F.length(text) >= t).alias(str(t)) for t in thresholds])
    rows = F.array(*[F.struct(F.lit(t).cast("long").alias("least"), F.col(f"`{t}`").alias("n")) for t in thresholds])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def blind_value(df: DataFrame, by_title: Column, by_text: Column, by_code: Column) -> DataFrame:
    """One row on three ways to find a row: any, text only (not title), and without the code, in basis points of all."""
    found = by_title | by_text | by_code
    sums = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(found).alias("any"), F.count_if(by_text & ~by_title).alias("text_only"), F.count_if((by_title | by_text) & ~by_code).alias("code_blind"))
    return sums.select("total", "any", "text_only", "code_blind", *[F.expr(f"{c} * 10000 div total").alias(f"{c}_bps") for c in ("any", "text_only", "code_blind")])
