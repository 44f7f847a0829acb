"""Incremental ingest of landed files: each key once, in order of arrival, until what is there is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def landed(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    """A stream of the Parquet files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def each_key_once(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Each key once; a key may come back within `delay` of its event time, which bounds the state."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return timed.dropDuplicatesWithinWatermark(keys)


def up_to(df: DataFrame, at: str, cutoff: str) -> DataFrame:
    """Rows up to a cutoff of event time: later ones never change what was told before."""
    return df.where(F.col(at) <= F.lit(cutoff).cast("timestamp"))


def counts_by_window(stream: DataFrame, at: str, width: str, delay: str, *by: str) -> DataFrame:
    """An addition to the reference's operators: rows per window of event time, and by columns."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return timed.groupBy(F.window(at, width), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def ingest_available(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Append all that is there now to a Parquet table, exactly once."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
