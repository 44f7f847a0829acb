"""Cohort statistics: exact quantiles, ECDF positions, nearest comparables, tiers of disclosure.

Positions come from a count per distinct value. A cohort is cut into ranges of
values at approximate quantiles; counts are cumulated inside each range, and
the ranges before it are added, so no task orders a whole cohort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FULL, DESCRIPTIVE, REFERENCE = "FULL", "DESCRIPTIVE", "REFERENCE"


def disclosure_tier(n: Column, full: int = 30, descriptive: int = 15) -> Column:
    return F.when(n >= full, FULL).when(n >= descriptive, DESCRIPTIVE).otherwise(REFERENCE)


#: Ranges that a cohort is cut into.
RANGES = 64


def ecdf(df: DataFrame, value: str, cohort: str, ranges: int = RANGES) -> DataFrame:
    """Every distinct known value of each cohort with n, at_most (rows up to it) and bps = at_most * 10000 div n."""
    known = df.where(F.col(value).isNotNull())
    counts = known.groupBy(cohort, value).agg(F.count(F.lit(1)).alias("here"))
    cuts = known.groupBy(cohort).agg(F.percentile_approx(value, F.lit([i / ranges for i in range(1, ranges)]), 1000).alias("__cuts"))
    dealt = counts.join(cuts, cohort).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    sums = dealt.groupBy(cohort, "__range").agg(F.sum("here").alias("__sum"))
    upward = Window.partitionBy(cohort).orderBy("__range")
    before = sums.select(cohort, "__range", (F.sum("__sum").over(upward) - F.col("__sum")).alias("__before"), F.sum("__sum").over(Window.partitionBy(cohort)).alias("n"))
    inside = Window.partitionBy(cohort, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = dealt.join(before, [cohort, "__range"]).withColumn("at_most", F.sum("here").over(inside) + F.col("__before"))
    return ranked.select(cohort, value, "here", "at_most", "n", F.expr("at_most * 10000 div n").alias("bps"))


def quantiles(df: DataFrame, value: str, cohort: str, shares: tuple[tuple[str, int, int], ...] = (("q1", 1, 4), ("median_low", 1, 2), ("q3", 3, 4), ("p90", 9, 10))) -> DataFrame:
    """Nearest-rank quantiles of each cohort: the smallest value with at least ceil(n * a / b) rows up to it, for (name, a, b)."""
    ranked = ecdf(df, value, cohort)
    picks = [F.min(F.when(F.col("at_most") * b >= F.col("n") * a, F.col(value))).alias(name) for name, a, b in shares]
    upper = F.min(F.when(F.col("at_most") * 2 > F.col("n"), F.col(value))).alias("median_high")
    return ranked.groupBy(cohort).agg(F.max("n").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), upper, *picks)


def tiered_quantiles(df: DataFrame, value: str, cohort: str, proposed: DataFrame | None = None) -> DataFrame:
    """What may be shown of each cohort: n; from DESCRIPTIVE up also median, least and most; the quartiles, p90 and the
    place of a proposed value only in FULL ones.

    proposed: cohort and proposed, one row per cohort; it adds count_at_most
    (rows up to the value) and position_bps.
    """
    q = quantiles(df, value, cohort).withColumn("tier", disclosure_tier(F.col("n")))
    full, shown = F.col("tier") == FULL, F.col("tier") != REFERENCE
    halves = (F.col("median_low") + F.col("median_high")).cast("long")
    median = F.concat(F.floor(halves / 2).cast("string"), F.when(halves % 2 != 0, ".5").otherwise(""))
    out = [
        cohort, "n", "tier", F.when(shown, median).alias("median"), F.when(shown, F.col("least")).alias("least"), F.when(shown, F.col("most")).alias("most"),
        *[F.when(full, F.col(c)).alias(c) for c in ("q1", "q3", "p90")],
    ]
    if proposed is not None:
        below = df.join(proposed, cohort).groupBy(cohort).agg(F.count_if((F.col(value) <= F.col("proposed")) & F.col("proposed").isNotNull()).alias("__below"), F.max("proposed").alias("__proposed"))
        q = q.join(below, cohort, "left")
        place = full & F.col("__proposed").isNotNull()
        out += [F.when(place, F.col("__below")).alias("count_at_most"), F.when(place, F.expr("__below * 10000 div n")).alias("position_bps")]
    return q.select(*out)


def comparables(df: DataFrame, key: str, value: str, cohort: str, targets: DataFrame, k: int) -> DataFrame:
    """The k rows of its cohort nearest to each target (cohort, target): by distance of ECDF positions, then of values, then key."""
    positions = ecdf(df, value, cohort)
    below = (F.col(f"p.{cohort}") == F.col(f"t.{cohort}")) & (F.col(f"p.{value}") <= F.col("t.target"))
    at = targets.alias("t").join(positions.alias("p"), below, "left").select(f"t.{cohort}", "t.target", "p.at_most", "p.n")
    target_bps = at.groupBy(cohort, "target").agg(F.coalesce(F.max(F.expr("at_most * 10000 div n")), F.lit(0)).alias("target_bps"))
    rows = df.select(key, cohort, value).join(positions.select(cohort, value, "bps"), [cohort, value]).join(target_bps, cohort)
    order = [F.abs(F.col("bps") - F.col("target_bps")), F.abs(F.col(value) - F.col("target")), F.col(key)]
    near = rows.withColumn("near", F.struct(order[0].alias("d_bps"), order[1].alias("d_value"), F.col(key).alias("key")))
    # the best k of each part first, so that no task orders a whole cohort
    part = Window.partitionBy(cohort, "target", F.pmod(F.xxhash64(key), F.lit(64))).orderBy("near")
    best = near.withColumn("r", F.row_number().over(part)).where(F.col("r") <= k)
    rank = F.row_number().over(Window.partitionBy(cohort, "target").orderBy("near"))
    return best.withColumn("position", rank.cast("long")).where(F.col("position") <= k).select(cohort, "target", "position", key, value, "bps")


def boundary_check(value: Column, least: Column, most: Column) -> Column:
    """How a value stands to a minimum and maximum, either of which may be null."""
    return (
        F.when(value.isNull(), "UNKNOWN")
        .when(least.isNull() & most.isNull(), "NO_BOUNDARY")
        .when(least.isNotNull() & (value < least), "BELOW_MINIMUM")
        .when(most.isNotNull() & (value > most), "ABOVE_MAXIMUM")
        .otherwise("WITHIN")
    )


def joint_comparables(df: DataFrame, key: str, first: str, second: str, cohort: str, targets: DataFrame, k: int, weights: tuple[int, int] = (7, 3), least: int = 15) -> DataFrame:
    """The k rows nearest to each target (cohort, first_target, second_target) by the weighted distance of both ECDF positions.

    Only rows that know both values are compared. A cohort in which fewer than
    `least` rows know the second value has no list, and neither has a target
    without a second value. Ties go to the nearer first value, then to the
    nearer second one, then to the key.
    """
    places = {c: ecdf(df, c, cohort) for c in (first, second)}
    group = [cohort, "first_target", "second_target"]

    def aimed(targets: DataFrame, column: str, target: str) -> DataFrame:
        below = places[column].select(F.col(cohort).alias("__cohort"), F.col(column).alias("__v"), F.col("bps").alias("__at"))
        here = targets.join(below, (F.col(cohort) == F.col("__cohort")) & (F.col("__v") <= F.col(target)), "left")
        return here.groupBy(*targets.columns).agg(F.coalesce(F.max("__at"), F.lit(0)).alias(f"__{target}"))

    aims = aimed(aimed(targets.where(F.col("second_target").isNotNull()).select(*group).distinct(), first, "first_target"), second, "second_target")
    second_place = places[second].where(F.col("n") >= least)
    rows = df.select(key, cohort, first, second).join(places[first].select(cohort, first, F.col("bps").alias("__bps_1")), [cohort, first])
    rows = rows.join(second_place.select(cohort, second, F.col("bps").alias("__bps_2")), [cohort, second])
    pairs = rows.join(aims, cohort)
    distance = weights[0] * F.abs(F.col("__bps_1") - F.col("__first_target")) + weights[1] * F.abs(F.col("__bps_2") - F.col("__second_target"))
    near = pairs.withColumn("near", F.struct(distance.alias("d"), F.abs(F.col(first) - F.col("first_target")).alias("v"), F.abs(F.col(second) - F.col("second_target")).alias("w"), F.col(key).alias("k")))
    part = Window.partitionBy(*group, F.pmod(F.xxhash64(key), F.lit(64))).orderBy("near")
    best = near.withColumn("r", F.row_number().over(part)).where(F.col("r") <= k)
    ranked = best.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy("near")).cast("long")).where(F.col("position") <= k)
    return ranked.select(*group, "position", key, F.col("near.d").alias("distance"))


def at_or_above(df: DataFrame, key: str, value: str, cohort: str, targets: DataFrame) -> DataFrame:
    """The rows of each target's cohort (cohort, target) whose known value is at least the target, lowest first: position by value, then key."""
    rows = df.select(key, cohort, value).join(targets, cohort).where(F.col(value) >= F.col("target"))
    return rows.select(cohort, "target", F.row_number().over(Window.partitionBy(cohort, "target").orderBy(value, key)).cast("long").alias("position"), key, value)
