"""Helpers shared by the operators: written intermediate tables and words of a text as numpy arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15


class Cache(dict):
    """What a process has worked out; it stays there when a function that uses it is sent elsewhere."""

    def __reduce__(self):
        return (type(self), ())


_powers = Cache()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of this machine in local mode only."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    known = context._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quern-"))
        known = context._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder, with the writer's options, and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def counted(df: DataFrame, name: str, digest: Column | None = None) -> DataFrame:
    """Like written; its rows are counted while it is written (table.seen["rows"]), and so is an aggregate `digest` of them.

    So no job has to ask for either.
    """
    seen = Observation()
    asked = [F.count(F.lit(1)).alias("rows"), *([] if digest is None else [digest.alias("digest")])]
    table = written(df.observe(seen, *asked), name)
    table.seen = seen.get
    return table


def forget(*tables: DataFrame) -> None:
    """Remove written tables; only once all that was made of them is itself written."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def without_summary(model, spark: SparkSession):
    """A fitted model of Spark ML, written and read back: the summary of its training stays behind.

    The summary holds the session, which can't be sent to executors once a table was observed in it.
    """
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    return type(model).load(path)


def small_side(df: DataFrame, rows: int = 300_000) -> DataFrame:
    """A written table of a few numbers a row, for one side of a join: marked for broadcast if it has at most so many rows.

    A larger one is joined by a shuffle.
    """
    seen = vars(df).get("seen")
    return F.broadcast(df) if (df.limit(rows + 1).count() if seen is None else seen["rows"]) <= rows else df


def join_spread(rows: DataFrame, table: DataFrame, key: str, weight: str, how: str = "inner", hot: int = 50_000) -> DataFrame:
    """Join rows with a written table of one row per key, whose column `weight` counts the key's rows.

    Broadcast if the table is small. Else keys of more than `hot` rows are
    broadcast, of which there is one for so many rows at most, so their rows stay
    where they are; the rest is joined by a shuffle.
    """
    near = small_side(table)
    if near is not table:
        return rows.join(near, key, how)
    heavy = table.where(F.col(weight) > hot)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(table.where(F.col(weight) <= hot), key, how)
    return rows.join(F.broadcast(heavy), key).unionByName(rest)


def sliced(batches: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """The same rows in frames of at most so many, so that what a worker makes of them goes out before it makes more."""
    for batch in batches:
        for first in range(0, len(batch), rows):
            yield batch.iloc[first : first + rows]


def words_in(text: Column) -> Column:
    """Number of words of a whole text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_share(doc_id: Column, parts: int) -> Column:
    """crc32 of the decimal doc_id, modulo parts: the share that a document falls in."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words in UTF-8 data."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least."""
    if len(_powers.get(_BASE, ())) < n:
        size = max(n, 1 << 16)
        for key, b in ((_BASE, _BASE), (-_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[key] = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, b, dtype=np.uint64))))
    return _powers[_BASE], _powers[-_BASE]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of values, from running sums: a span's hash doesn't depend on where it stands."""
    power, inverse = _tables(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[: len(values)], out=total[1:])
    return mixed((total[ends] - total[starts]) * inverse[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of UTF-8 data."""
    return span_hashes(data, starts, ends)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, or of all words if there are fewer; empty for no words."""
    k = min(k, len(hashes))
    if not k:
        return hashes
    firsts = np.arange(len(hashes) - k + 1)
    return span_hashes(hashes, firsts, firsts + k)


def text_words(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 data of a text, and the starts and ends of its words; null is empty."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    return (data, *word_spans(data))
