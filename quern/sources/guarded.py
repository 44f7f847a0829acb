"""Reads that fail closed: allowlisted projections with a bound on rows, and lookups by a list of keys."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import kept


class GuardError(RuntimeError):
    """A read went past its allowlist or its bound."""


def guarded_projection(source: DataFrame, columns: Sequence[str], where: Column, bound: int, path: str, key: str | None = None) -> int:
    """Write the allowed columns of the rows that a filter keeps to path, and return their number.

    A result of `bound` rows or more may have been cut short by whoever set the
    bound, so it is refused and nothing appears at path. Rows are counted while
    they are written, so the source is scanned once; projection and filter reach
    the scan. A column that the source lacks is an error; so is a null key.
    """
    missing = [c for c in columns if c not in source.columns]
    if missing:
        raise GuardError(f"the source lacks {missing}")
    if key is not None and key not in columns:
        raise GuardError(f"the key {key} is not among the allowed columns")
    spark, seen = source.sparkSession, Observation()
    nulls = F.count_if(F.col(key).isNull() if key else F.lit(False)).alias("nulls")
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    source.where(where).select(*columns).observe(seen, F.count(F.lit(1)).alias("rows"), nulls).write.parquet(staged)
    rows, nulls = seen.get["rows"], seen.get["nulls"]
    at, to = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (staged, path))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if rows >= bound or nulls or fs.exists(to):
        fs.delete(at, True)
        raise GuardError(f"{rows} rows reach the bound of {bound}" if rows >= bound else f"{nulls} rows without {key}" if nulls else f"{path} exists")
    if not fs.rename(at, to):
        raise GuardError(f"{path} can't be written")
    return rows


def escaped_columns(df: DataFrame, allowed: Sequence[str]) -> list[str]:
    """Columns outside an allowlist, in order."""
    return sorted(set(df.columns) - set(allowed))


#: Bits of the key filter for each key, and keys up to which it is broadcast: 2 bytes a key, so 32 MB at most.
KEY_BITS, FILTER_KEYS = 16, 16_000_000


def _bit(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def key_filter(keys: DataFrame, key: str, n: int) -> tuple[DataFrame, int]:
    """A Bloom filter of one hash as rows of bitmaps (word: the block's number, bits: 4 kB), and its size in bits."""
    bits = max(1, -(-n * KEY_BITS // 32768)) * 32768
    at = keys.select(_bit(F.col(key), bits).alias("at"))
    blocks = at.groupBy(F.floor(F.col("at") / 32768).alias("word")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(32768)).cast("long")).alias("bits"))
    return blocks, bits


def _held(bits: Column, at: Column) -> Column:
    """Whether a bitmap has a bit: bit i is bit i mod 8 of byte i div 8."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, (at % 8).cast("int")) == 1


def keyed_lookup(source: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of source whose key is in keys; null keys match nothing, and repeated ones once.

    The keys are counted. Up to FILTER_KEYS of them first pass a Bloom filter of
    2 bytes a key, which is broadcast, so that only rows that may match are
    shuffled; then an exact semi-join decides. More keys go straight to the join.
    """
    wanted = keys.select(key).where(F.col(key).isNotNull()).distinct()
    n = wanted.count()
    rows = source.where(F.col(key).isNotNull())
    if n <= FILTER_KEYS:
        blocks, bits = key_filter(wanted, key, n)
        at = _bit(F.col(key), bits)
        numbered = rows.withColumn("__at", F.pmod(at, F.lit(32768))).withColumn("__word", F.floor(at / 32768))
        met = numbered.join(F.broadcast(blocks.select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))), "__word")
        rows = met.where(_held(F.col("__bits"), F.col("__at"))).select(*source.columns)
    return rows.join(wanted, key, "left_semi")


def numbered_rows(df: DataFrame, *order: str, number: str = "number") -> DataFrame:
    """Rows with their place from 0 in an order of columns, which must tell all rows apart.

    Ranges of the order are numbered side by side; only a row count a range
    comes to the driver. Written once, so the ranges cannot change in between.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    rows = kept(ranged, "numbered").withColumn("__part", F.shiftright("__id", 33))
    sizes = sorted(map(tuple, rows.groupBy("__part").agg(F.count(F.lit(1))).collect()))
    firsts = [(part, before - n) for (part, n), before in zip(sizes, accumulate(n for _, n in sizes))]
    offsets = spark.createDataFrame(firsts, "__part long, __first long")
    return rows.join(F.broadcast(offsets), "__part").select(*df.columns, (F.col("__first") + F.col("__id").bitwiseAND((1 << 33) - 1)).alias(number))


def key_batches(keys: DataFrame, key: str, size: int) -> DataFrame:
    """Distinct keys in runs of `size` of their order: batch (from 0) and key."""
    wanted = keys.select(key).where(F.col(key).isNotNull()).distinct()
    return numbered_rows(wanted, key).select(F.floor(F.col("number") / size).alias("batch"), key)


def batch_violations(answers: DataFrame, batches: DataFrame, key: str, bound: int) -> DataFrame:
    """What is wrong with answers (batch, key): rows of check, batch, key and n.

    `outside`: answers whose key was not asked for in their batch, by batch and
    key; a null key is outside any. `full`: batches with `bound` rows or more,
    which may have been cut short.
    """
    asked = batches.select("batch", key).withColumn("__asked", F.lit(True))
    counted = answers.groupBy("batch", key).agg(F.count(F.lit(1)).alias("n"))
    known = counted.join(asked, ["batch", key], "left")
    outside = known.where(F.col("__asked").isNull()).select(F.lit("outside").alias("check"), "batch", key, "n")
    full = counted.groupBy("batch").agg(F.sum("n").alias("n")).where(F.col("n") >= bound)
    none = F.lit(None).cast(batches.schema[key].dataType)
    return outside.unionByName(full.select(F.lit("full").alias("check"), "batch", none.alias(key), "n"))
