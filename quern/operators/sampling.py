"""Deterministic hash sampling, stratified selection and review queues."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

from ..functions.hashing import hash_rank


def hash_sample(df: DataFrame, key: str, seed: str, n: int, separator: str = "\0") -> DataFrame:
    """The n rows that come first in the hash order of a seed, with hash and rank (from 1). Only n rows meet in one task."""
    first = df.withColumn("hash", hash_rank(seed, F.col(key), separator)).orderBy("hash", key).limit(n)
    return first.withColumn("rank", F.row_number().over(Window.orderBy("hash", key)).cast("long"))


def hash_holdout(sample: DataFrame, key: str, seed: str, n: int, share: float, separator: str = "\0") -> DataFrame:
    """A sample of n rows with holdout: the first ceil(n * share) in the hash order of '<seed>:holdout'."""
    order = Window.orderBy(hash_rank(f"{seed}:holdout", F.col(key), separator), key)
    return sample.withColumn("holdout", F.row_number().over(order) <= math.ceil(n * share))


def numbered(sample: DataFrame, rank: str, form: str) -> Column:
    """A printed number of a ranked row, as 'DEV-0001'."""
    return F.format_string(form, F.col(rank))


def top_of_each(df: DataFrame, group: str, order: Sequence[Column], k: int, parts: int = 32) -> DataFrame:
    """The first k rows of each group with position and truncated (whether there were more).

    Two steps: k of each part of a group, then k of those, so a large group is
    never ordered in one task.
    """
    salted = df.withColumn("part", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c != group]), F.lit(parts)))
    w = Window.partitionBy(group, "part").orderBy(*order)
    best = salted.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("group_size"))
    ranked = best.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("position") <= k)
    return ranked.join(sizes, group).withColumn("truncated", F.col("group_size") > k).drop("part", "group_size")


def _meets(column: Column, kind: DataType, value: str) -> Column:
    """Whether a stratum's column, which may be an array of values, has a value."""
    return F.coalesce(F.array_contains(column, value) if isinstance(kind, ArrayType) else column == value, F.lit(False))


def missing_requirements(df: DataFrame, required: Sequence[tuple[str, str]], spread: Sequence[str]) -> DataFrame:
    """stratum and value of what no selection of df can cover: required values that no row has, and columns of spread without two values (value null)."""
    found = [F.struct(F.lit(c).alias("stratum"), F.lit(v).alias("value"), F.coalesce(F.bool_or(_meets(F.col(c), df.schema[c].dataType, v)), F.lit(False)).alias("ok")) for c, v in required]
    found += [F.struct(F.lit(c).alias("stratum"), F.lit(None).cast("string").alias("value"), F.coalesce(F.min(c) < F.max(c), F.lit(False)).alias("ok")) for c in spread]
    kind = "array<struct<stratum:string,value:string,ok:boolean>>"
    return df.agg(F.array(*found).cast(kind).alias("f")).select(F.explode("f").alias("f")).where("not f.ok").select("f.stratum", "f.value")


def greedy_selection(df: DataFrame, key: str, required: Sequence[tuple[str, str]], spread: Sequence[str], total: int, seed: str) -> DataFrame:
    """Rows of df picked until every required stratum is covered, with hash and pick (from 1).

    For each required (column, value) in order, unless a row picked so far has
    it, the first row by hash that has it is picked; then for each column of
    spread, until two of its values are picked, the first row with another
    value; the rest up to `total` follows by hash. What no row can cover is
    left out here and told by missing_requirements; null values cover nothing.
    Keys have to be unique; rows without one are never picked. If covering takes
    more rows than `total`, that is an error.

    Which row covers a requirement first doesn't depend on what is picked
    before, so one aggregation finds these rows: as many as there are
    requirements, whatever the size of df. No more come to the driver.
    """
    columns = list(dict.fromkeys([*[c for c, _ in required], *spread]))
    ranked = df.where(F.col(key).isNotNull()).withColumn("hash", hash_rank(seed, F.col(key)))
    order, row = F.struct("hash", key), F.struct(F.col(key).alias("key"), *[F.col(c).alias(f"of_{c}") for c in columns])

    def firsts(conditions: Sequence[Column]) -> list:
        found = ranked.agg(*[F.min_by(row, F.when(c, order)).alias(f"r{i}") for i, c in enumerate(conditions)]).first()
        return [found[f"r{i}"] for i in range(len(conditions))]

    def has(pick, column: str, value: str) -> bool:
        own = pick[f"of_{column}"]
        return value in own if isinstance(own, list) else own == value

    picked = []
    found = firsts([_meets(F.col(c), df.schema[c].dataType, v) for c, v in required]) if required else []
    for (c, v), first in zip(required, found):
        if first is not None and not any(has(p, c, v) for p in picked):
            picked.append(first)
    for c in spread:
        while len(values := {p[f"of_{c}"] for p in picked} - {None}) < 2:
            other = firsts([F.col(c).isNotNull() & ~F.col(c).isin(list(values)) if values else F.col(c).isNotNull()])[0]
            if other is None:
                break
            picked.append(other)
    if len(picked) > total:
        raise ValueError(f"{total} rows cannot cover the required strata: it takes {len(picked)}")
    numbers = {p["key"]: i + 1 for i, p in enumerate(picked)}
    chosen = ranked.where(F.col(key).isin(list(numbers)))
    number = F.lit(None).cast("long")
    for k, n in numbers.items():
        number = F.when(F.col(key) == k, F.lit(n).cast("long")).otherwise(number)
    rest = ranked.where(~F.col(key).isin(list(numbers))).orderBy("hash", key).limit(total - len(picked))
    rest = rest.withColumn("pick", F.row_number().over(Window.orderBy("hash", key)).cast("long") + len(picked))
    return chosen.withColumn("pick", number).unionByName(rest)


def missing_strata(df: DataFrame, stratum: str, required: Sequence[str]) -> DataFrame:
    """Required values of a stratum that no row has."""
    have = F.collect_set(F.col(stratum).cast("string"))
    return df.agg(F.array_sort(F.array_except(F.array(*[F.lit(str(x)) for x in required]), have)).alias("missing")).select(F.explode("missing").alias(stratum))
