"""Precision and recall, overlap scores, release gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import plain_decimal


def basis_points(part: Column, whole: Column) -> Column:
    """part * 10000 div whole; null if whole is 0."""
    return F.when(whole > 0, F.floor(part * 10000 / F.nullif(whole, F.lit(0)))).cast("long")


def rate_or_zero(part: Column, whole: Column) -> Column:
    """part / whole as a double; 0.0 if whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / F.nullif(whole, F.lit(0)))


def confusion(gold: DataFrame, predicted: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, precision_bps, recall_bps and f1_bps of predicted keys against gold keys, for all or by columns of the keys."""
    g, p = gold.select(*keys).distinct().withColumn("g", F.lit(True)), predicted.select(*keys).distinct().withColumn("p", F.lit(True))
    both = g.join(p, list(keys), "full_outer")
    counts = both.groupBy(*by).agg(
        F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"),
        F.count_if(F.col("g").isNull()).alias("fp"),
        F.count_if(F.col("p").isNull()).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision_bps": basis_points(tp, tp + fp), "recall_bps": basis_points(tp, tp + fn), "f1_bps": basis_points(2 * tp, 2 * tp + fp + fn)})


def case_scores(cases: DataFrame, gold: DataFrame, predicted: DataFrame, case: str, exact: Sequence[str], semantic: Sequence[str]) -> DataFrame:
    """One row that scores predictions over all cases (case, failed), by exact and by semantic keys.

    For each kind of keys: tp, fp, fn, precision_bps, recall_bps, f1_bps, and
    matched, the cases that didn't fail and are predicted as they should. A case
    without gold asks for abstention: abstained counts those without a
    prediction, false_alarms those with one, failed_abstentions those that
    failed. Rows of gold and predicted outside the cases are no part of it: see
    stray_cases. Repeats count once.
    """
    out = None
    for name, keys in (("exact", exact), ("semantic", semantic)):
        on = [case, *keys]
        g, p = gold.select(*on).distinct().withColumn("__g", F.lit(True)), predicted.select(*on).distinct().withColumn("__p", F.lit(True))
        per = g.join(p, on, "full_outer").groupBy(case).agg(F.count_if(F.col("__g") & F.col("__p")).alias("tp"), F.count_if(F.col("__g").isNull()).alias("fp"), F.count_if(F.col("__p").isNull()).alias("fn"))
        each = cases.join(per, case, "left").na.fill(0, ["tp", "fp", "fn"])
        sound = ~F.col("failed")
        silent = F.col("tp") + F.col("fn") == 0
        sums = each.agg(
            F.count(F.lit(1)).alias("cases"), F.count_if("failed").alias("failed_cases"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")], F.count_if(sound & (F.col("fp") + F.col("fn") == 0)).alias("matched"),
            F.count_if(silent).alias("abstentions"), F.count_if(silent & sound & (F.col("fp") == 0)).alias("abstained"), F.count_if(silent & sound & (F.col("fp") > 0)).alias("false_alarms"), F.count_if(silent & F.col("failed")).alias("failed_abstentions"),
        )
        tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
        rated = sums.withColumns({"precision_bps": basis_points(tp, tp + fp), "recall_bps": basis_points(tp, tp + fn), "f1_bps": basis_points(2 * tp, 2 * tp + fp + fn)})
        counted = rated.select(*[F.col(c).alias(f"{name}_{c}") for c in ("tp", "fp", "fn", "matched", "precision_bps", "recall_bps", "f1_bps")], *([] if out is None else ["cases", "failed_cases", "abstentions", "abstained", "false_alarms", "failed_abstentions"]))
        out = counted if out is None else out.join(counted, how="cross")  # one row each
    return out


def stray_cases(cases: DataFrame, rows: DataFrame, case: str) -> DataFrame:
    """Cases of rows that are not among the cases."""
    return rows.select(case).distinct().join(cases.select(case), case, "left_anti")


def overlaps(a: DataFrame, b: DataFrame, case: str) -> DataFrame:
    """Pairs of intervals (start, end; end exclusive) of a case that share a point, with the length shared."""
    l, r = a.alias("l"), b.alias("r")
    first, last = F.greatest("l.start", "r.start"), F.least("l.end", "r.end")
    return l.join(r, (F.col(f"l.{case}") == F.col(f"r.{case}")) & (first < last)).select(
        F.col(f"l.{case}").alias(case), F.col("l.start").alias("a_start"), F.col("l.end").alias("a_end"), F.col("r.start").alias("b_start"), F.col("r.end").alias("b_end"), (last - first).alias("shared")
    )


def zero_event_bound(n: Column) -> Column:
    """The exact upper 95 % bound of a rate of which none was seen in n; 1.0 for none at all."""
    return F.when(n > 0, 1 - F.pow(F.lit(0.05), 1 / n)).otherwise(F.lit(1.0))


def gate(metrics: DataFrame, checks: dict[str, Column], soft: Sequence[str] = ()) -> DataFrame:
    """A row of metrics with failures (names, sorted) and decision: GO, CONDITIONAL if only soft checks failed, or NO-GO."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda c: c.isNotNull())
    hard = F.size(F.array_except("failures", F.array(*[F.lit(s) for s in soft]).cast("array<string>"))) > 0
    out = metrics.withColumn("failures", F.array_sort(failed))
    return out.withColumn("decision", F.when(F.size("failures") == 0, "GO").when(hard, "NO-GO").otherwise("CONDITIONAL"))


def repeated_in_rounds(df: DataFrame, rule: str, round_: str, least: int = 2) -> DataFrame:
    """Rules that failed in at least so many different rounds."""
    return df.groupBy(rule).agg(F.count_distinct(round_).alias("rounds")).where(F.col("rounds") >= least)


def overlap_report(gold: DataFrame, predicted: DataFrame, case: str) -> DataFrame:
    """One row on intervals (case, start, end): predictions and gold spans, those that overlap one another, cases with gold, with a hit, and false alarms without gold."""
    pairs = overlaps(predicted, gold, case)
    hit_p, hit_g = pairs.select(case, F.col("a_start").alias("start"), F.col("a_end").alias("end")).distinct(), pairs.select(case, F.col("b_start").alias("start"), F.col("b_end").alias("end")).distinct()
    per = [
        (predicted.select(case, "start", "end").distinct(), "predicted"), (gold.select(case, "start", "end").distinct(), "gold"), (hit_p, "predicted_hit"), (hit_g, "gold_hit"),
    ]
    rows = None
    for df, name in per:
        part = df.groupBy(case).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    names = [n for _, n in per]
    cases = rows.groupBy(case).agg(*[F.coalesce(F.sum(F.when(F.col("what") == n, F.col("n"))), F.lit(0)).alias(n) for n in names])
    sums = cases.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names], F.count_if(F.col("gold") > 0).alias("cases"), F.count_if(F.col("gold_hit") > 0).alias("cases_hit"),
        F.count_if((F.col("gold") == 0) & (F.col("predicted") > 0)).alias("false_alarms"),
    )
    return sums.withColumns({"precision_bps": basis_points(F.col("predicted_hit"), F.col("predicted")), "recall_bps": basis_points(F.col("gold_hit"), F.col("gold")), "case_recall_bps": basis_points(F.col("cases_hit"), F.col("cases"))})


def spread(df: DataFrame, by: str, value: str) -> DataFrame:
    """Per group: measured rows, twice the median (exact for whole numbers), and the largest value; nulls are not measured."""
    return df.groupBy(by).agg(F.count(value).alias("measured"), (2 * F.median(value)).cast("long").alias("median_x2"), F.max(value).alias("largest"))


def parseable_sum(df: DataFrame, group: str, text: str, scale: int = 2) -> DataFrame:
    """Per group: rows, how many amounts (text) are plain decimals, and their sum; others are left out, not taken for 0."""
    amount = plain_decimal(F.col(text), scale)
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.count(amount).alias("parsed"), F.sum(amount).alias("total"))
