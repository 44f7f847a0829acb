"""Mixing sources to target weights by cube-method balanced sampling.

A source's target divided by its size is how often each of its documents is
taken. The whole part is taken outright; the fraction is an inclusion
probability, and the cube method turns all fractions of a source into 0 or 1
while holding the totals of words and of documents: in each flight step three
undecided documents move along the null space of the two balance equations
until one of them is decided. Flights run in bounded blocks; what a block
cannot decide (two documents at most) flies again with the leftovers of the
other blocks of its source, level by level. What the last block leaves, two documents
at most, lands together with its shortest documents on the choice that leaves
the word total closest to target; then documents of any size change places as
long as that brings the total closer.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import words_in, written

#: Documents in a flight block, and decided ones that the landing may decide again.
BLOCK, LANDING = 4096, 10
_UNIT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("source_size", T.LongType()),
        T.StructField("target", T.DoubleType()),
        T.StructField("whole", T.LongType()),
        T.StructField("p", T.DoubleType()),
        T.StructField("nth", T.LongType()),
    ]
)


def source_targets(sizes: dict, weights: tuple[float, ...], share: float, most: float) -> dict:
    """Target of each source: weights repeat over the sources in code-point order (null last) and share
    `share` times the total; a target stops at `most` times its source's size, and the excess is shared
    again by weight until none is above. Empty sources get 0."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * rest / total > most * sizes[s]} if total else set()
        if not over:
            target |= {s: weight[s] * rest / total if total else 0.0 for s in free}
            break
        for s in over:
            target[s] = float(most * sizes[s])
            rest -= target[s]
        free -= over
    return target


def _flight(x: list[float], p: list[float], chance: np.random.Generator) -> None:
    """Move p in place until at most two entries lie strictly between 0 and 1, holding the sums of p and of p times x."""
    eps = 1e-9
    held: list[int] = []
    for i in range(len(p)):
        if not eps < p[i] < 1 - eps:
            p[i] = float(p[i] >= 0.5)
            continue
        held.append(i)
        while len(held) == 3:
            a, b, c = held
            u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[k]) / d if d > 0 else p[k] / -d for k, d in zip(held, u) if d)
            down = min(p[k] / d if d > 0 else (1 - p[k]) / -d for k, d in zip(held, u) if d)
            step = up if chance.random() < down / (up + down) else -down
            for k, d in zip(held, u):
                p[k] = min(1.0, max(0.0, p[k] + step * d))
            for k in held:
                if not eps < p[k] < 1 - eps:
                    p[k] = float(p[k] >= 0.5)
            held = [k for k in held if 0.0 < p[k] < 1.0]


def _land(x: list[float], p: list[float], want: float) -> None:
    """Decide the last fractions, and the LANDING shortest documents again, so that the word total comes closest to want.

    Among equally close choices the one that changes the fewest decisions, then the first.
    """
    rest = [i for i in range(len(p)) if 0.0 < p[i] < 1.0]
    free = rest + sorted((i for i in range(len(p)) if i not in rest), key=lambda i: (x[i], i))[:LANDING]
    held = sum(x[i] * p[i] for i in set(range(len(p))) - set(free))
    choice = np.arange(1 << len(free))[:, None] >> np.arange(len(free)) & 1
    off = np.abs(choice @ np.array([x[i] for i in free]) + held - want).round(6)
    changed = (choice[:, len(rest) :] != np.array([p[i] for i in free[len(rest) :]])).sum(axis=1)
    best = choice[np.lexsort((changed, off))[0]]
    for i, taken in zip(free, best):
        p[i] = float(taken)


def _exchange(x: list[float], p: list[float], want: float) -> None:
    """Swap a taken document for one that isn't, of any sizes, as long as that brings the word total closer to want.

    The number of documents stays; among equally close swaps the first by size and place is made.
    """
    size, taken = np.array(x), np.array(p) > 0.5
    while True:
        off = float(size[taken].sum() - want)
        ins, outs = np.flatnonzero(~taken), np.flatnonzero(taken)
        if abs(off) < 0.5 or not len(ins) or not len(outs):
            break
        ins, outs = ins[np.lexsort((ins, size[ins]))], outs[np.lexsort((outs, size[outs]))]
        at = np.searchsorted(size[ins], size[outs] - off)
        near = np.stack([np.clip(at - 1, 0, len(ins) - 1), np.clip(at, 0, len(ins) - 1)])
        left = np.abs(off - size[outs] + size[ins][near])
        k, o = np.unravel_index(np.argmin(left), left.shape)
        if left[k, o] >= abs(off) - 1e-6:
            break
        taken[outs[o]], taken[ins[near[k, o]]] = False, True
    p[:] = taken.astype(float).tolist()


def _fly(seed: int, last: bool):
    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*(["size"] if last else []), "turn", "doc_id", "nth"], ascending=[*([False] if last else []), True, True, True], kind="stable")
        x, p = rows["size"].astype(float).tolist(), rows["p"].tolist()
        want = sum(a * b for a, b in zip(x, p))
        _flight(x, p, np.random.default_rng([seed, len(x), int(rows["turn"].iloc[0]) & 0xFFFFFFFF]))
        if last:
            _land(x, p, want)
            _exchange(x, p, want)
        rows["p"] = p
        return rows.drop(columns=["turn", "block"])

    return block


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    size=None,
) -> DataFrame:
    """How many words of each document a mixture takes.

    Returns doc_id, source, size, source_size, target, whole (outright repeats),
    times (all repeats) and taken = times * size, one row per row of docs.
    Documents without words (null or empty text) have size 0 and take no part
    in the balance; repeated rows are separate documents, told apart by a
    number; null is a source of its own; texts of any length count whole; other
    columns of docs are not read. The same rows give the same mix, however they
    are stored. The table of sources, one row per source, is worked out on the
    driver.
    """
    size = words_in(F.col("text")) if size is None else size
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("same"))
    sized = written(counted.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), "same")).alias("nth")), "sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    sizes, counts = {r.source: int(r.s or 0) for r in by_source}, {r.source: r.n for r in by_source}
    targets = source_targets(sizes, weights, share, most)
    spark = docs.sparkSession
    table = spark.createDataFrame(
        [(s, sizes[s], float(targets[s]), counts[s]) for s in sizes],
        "source string, source_size long, target double, n long",
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = sized.alias("d").join(F.broadcast(table).alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select(
        "doc_id", "d.source", "size", "source_size", "target", F.floor(rate).cast("long").alias("whole"), (rate - F.floor(rate)).alias("p"), "nth", "n"
    )
    undecided = (F.col("p") > 0) & (F.col("size") > 0)
    done = [joined.where(~undecided).drop("n").withColumn("p", F.lit(0.0))]
    flying, most_left, level = joined.where(undecided), max(counts.values(), default=0), 0
    while True:
        # a level leaves two documents of each block at most
        turn = F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "size", "nth")
        last = most_left <= BLOCK
        blocks = F.lit(1) if last else F.ceil(F.col("n") / F.lit(BLOCK))
        moved = (
            flying.withColumn("turn", turn)
            .withColumn("block", F.pmod(F.col("turn"), blocks))
            .drop("n")
            .groupBy("source", "block")
            .applyInPandas(_fly(seed + level, last), _UNIT)
        )
        if last:
            done.append(moved)
            break
        moved = written(moved, f"flight{level}")
        between = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(moved.where(~between))
        left = {s: 2 * math.ceil(n / BLOCK) for s, n in counts.items()}
        counts, most_left, level = left, max(left.values()), level + 1
        again = spark.createDataFrame(list(left.items()), "source string, n long")
        flying = moved.where(between).alias("m").join(F.broadcast(again).alias("a"), F.col("m.source").eqNullSafe(F.col("a.source"))).select("m.*", "a.n")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    times = (F.col("whole") + F.col("p").cast("long")).alias("times")
    return out.select("doc_id", "source", "size", "source_size", "target", "whole", times).withColumn("taken", F.col("times") * F.col("size"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, each row as often as the mixture takes it.

    Rows with the same doc_id, source and text are emitted as copies of one of
    them, as often as all of them are taken together.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    keyed = docs.select(key.alias("doc_id"), "source", "text")
    times = mix_sources(keyed, **options).groupBy(F.col("doc_id").alias("__key")).agg(F.sum("times").alias("__times")).where("__times > 0")
    taken = docs.withColumn("__key", key).join(times, "__key").dropDuplicates(["__key", "doc_id"])
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__times"))).select(*[F.col(f"`{c}`") for c in docs.columns])
