"""Evidence tiers, dispositions and component states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSED, PARTIAL, UNRESOLVED = "OPEN", "CLOSED", "PARTIAL", "UNRESOLVED"


def tier(reference: Column, authority: Column, geography: Column, title: Column, code: Column, overlap: Column, window: Column, corroborating: Column, semantic: Column) -> Column:
    """Strength of the evidence that a notice is about a component.

    A, B and C all need an overlap of scope (a phrase of the component) and a
    date inside the project's window. Then A: the same reference. B: same
    authority, same place and a code of the component. C: title or location, a
    code, and an amount or date that corroborates. D: semantic likeness only.
    NONE otherwise. A null check does not hold.
    """
    said = lambda c: F.coalesce(c, F.lit(False))
    within = said(overlap) & said(window)
    return (
        F.when(within & said(reference), "A")
        .when(within & said(authority) & said(geography) & said(code), "B")
        .when(within & said(title) & said(code) & said(corroborating), "C")
        .when(said(semantic), "D")
        .otherwise("NONE")
    )


def plausible(reference: Column, code: Column, geography: Column, title: Column) -> Column:
    """Whether a notice may be about a component, whatever its tier: it has the reference, or a code together with place, title or location."""
    said = lambda c: F.coalesce(c, F.lit(False))
    return said(reference) | (said(code) & (said(geography) | said(title)))


def _judged(tier_: Column, may_be: Column, exact_span: Column, day: Column, cutoff: Column) -> list[tuple[Column, str, str]]:
    strong = tier_.isin("A", "B")
    return [
        (day.isNull() | (day > cutoff), "REJECT", "after the cutoff"),
        (strong & ~F.coalesce(exact_span, F.lit(False)), "REVIEW", "strong, but without an exact span"),
        (strong, "ACCEPT", "strong, with an exact span"),
        (tier_ == "C", "REVIEW", "corroborated, but not strong"),
        (F.coalesce(may_be, F.lit(False)), "REVIEW", "plausible, so it may not be left out"),
        (tier_ == "D", "REJECT", "alike in words only"),
    ]


def disposition(tier_: Column, may_be: Column, exact_span: Column, day: Column, cutoff: Column) -> Column:
    """ACCEPT, REVIEW or REJECT of evidence with a tier, a plausibility and an effective date.

    Nothing after the cutoff, or without a date, counts. A and B are accepted
    with an exact source span and reviewed without one; C is reviewed, and so is
    whatever else is plausible. Semantic likeness alone (D) and the rest are
    rejected.
    """
    out = F.lit("REJECT")
    for holds, says, _ in reversed(_judged(tier_, may_be, exact_span, day, cutoff)):
        out = F.when(holds, says).otherwise(out)
    return out


def disposition_reason(tier_: Column, may_be: Column, exact_span: Column, day: Column, cutoff: Column) -> Column:
    """Why `disposition` decides as it does."""
    out = F.lit("no rule holds")
    for holds, _, why in reversed(_judged(tier_, may_be, exact_span, day, cutoff)):
        out = F.when(holds, why).otherwise(out)
    return out


def component_states(components: DataFrame, evidence: DataFrame, key: str, names: dict | None = None) -> DataFrame:
    """State of each component (key, boundary_unclear, coverage_complete) from its evidence (key, evidence_id, disposition).

    In this order: an unclear boundary is UNRESOLVED; accepted evidence closes;
    evidence to review is UNRESOLVED; so is incomplete coverage; else OPEN. A
    component without evidence keeps its row. evidence_ids are those that the
    state rests on, sorted; of an unclear boundary first the accepted ones, then
    those to review. names: every evidence_id that occurs, in their order, with
    the string to give out for it, where these are few: they are then counted
    in place of gathered. Rejected evidence is not filtered out: a filter moves
    into the join that made the evidence, with all the rules of its disposition
    written out in the condition.
    """
    if names is None:
        ids = lambda d: F.array_sort(F.collect_list(F.when(F.col("disposition") == d, F.col("evidence_id"))))
        sums = evidence.groupBy(key).agg(ids("ACCEPT").alias("accepted"), ids("REVIEW").alias("review"))
        kind = evidence.schema["evidence_id"].dataType.simpleString()
    else:
        times = lambda d: [F.count_if((F.col("disposition") == d) & (F.col("evidence_id") == i)).alias(f"{d}_{k}") for k, i in enumerate(names)]
        listed = lambda d: F.flatten(F.array(*[F.array_repeat(F.lit(name), F.col(f"{d}_{k}").cast("int")) for k, name in enumerate(names.values())]).cast("array<array<string>>"))
        sums = evidence.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *times("ACCEPT"), *times("REVIEW")).select(key, listed("ACCEPT").alias("accepted"), listed("REVIEW").alias("review"))
        kind = "string"
    joined = components.join(sums, key, "left")
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    none = F.array().cast(f"array<{kind}>")
    state = (
        F.when(F.col("boundary_unclear"), UNRESOLVED)
        .when(some("accepted"), CLOSED)
        .when(some("review"), UNRESOLVED)
        .when(~F.col("coverage_complete"), UNRESOLVED)
        .otherwise(OPEN)
    )
    reason = (
        F.when(F.col("boundary_unclear"), "boundary")
        .when(some("accepted"), "accepted")
        .when(some("review"), "review")
        .when(~F.col("coverage_complete"), "coverage")
        .otherwise("none found")
    )
    both = F.concat(F.coalesce("accepted", none), F.coalesce("review", none))
    used = F.when(reason == "boundary", both).when(reason == "accepted", F.col("accepted")).when(reason == "review", F.col("review")).otherwise(none)
    return joined.select(*components.columns, state.alias("state"), reason.alias("reason"), used.alias("evidence_ids"))


def rolled_up(states: DataFrame, key: str, state: str = "state") -> DataFrame:
    """State of each key from its components' states, nulls being keys without a component.

    No component or any UNRESOLVED: UNRESOLVED; OPEN and CLOSED together: PARTIAL.
    """
    has = lambda s: F.coalesce(F.bool_or(F.col(state) == s), F.lit(False))
    flags = states.groupBy(key).agg(has(OPEN).alias("o"), has(CLOSED).alias("c"), has(UNRESOLVED).alias("u"), F.count(state).alias("components"))
    verdict = F.when(F.col("u") | ~(F.col("o") | F.col("c")), UNRESOLVED).when(F.col("o") & F.col("c"), PARTIAL).when(F.col("c"), CLOSED).otherwise(OPEN)
    return flags.select(key, "components", verdict.alias("state"))


def rolled_up_state(states: Column) -> Column:
    """The same of an array of states in one row; a null array has no component."""
    has = lambda s: F.coalesce(F.array_contains(states, s), F.lit(False))
    return F.when(has(UNRESOLVED) | ~(has(OPEN) | has(CLOSED)), UNRESOLVED).when(has(OPEN) & has(CLOSED), PARTIAL).when(has(CLOSED), CLOSED).otherwise(OPEN)


def state_summary(projects: DataFrame, amount: str, state: str = "state") -> DataFrame:
    """One row per state, also those without a project: count, sum of the known amounts, and how many are unknown."""
    spark = projects.sparkSession
    every = spark.createDataFrame([(s,) for s in (OPEN, CLOSED, PARTIAL, UNRESOLVED)], "state string")
    found = projects.groupBy(F.col(state).alias("state")).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("known"), F.count_if(F.col(amount).isNull()).alias("missing"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return F.broadcast(every).join(found, "state", "left").select("state", zero("n"), zero("known"), zero("missing"))


def existence_flags(pairs: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """Per key, whether any of its pairs has each feature."""
    return pairs.groupBy(key).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in flags.items()])


def flag_totals(flags: DataFrame, *names: str) -> DataFrame:
    """One row per flag: how many keys have it, and the basis points of all (floor)."""
    sums = flags.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(c) for c in names])
    rows = F.array(*[F.struct(F.lit(c).alias("flag"), F.col(c).alias("hits"), F.when(F.col("n") > 0, F.expr(f"{c} * 10000 div n")).otherwise(F.lit(0)).cast("long").alias("bps")) for c in names])
    return sums.select(F.explode(rows).alias("r")).select("r.*")
