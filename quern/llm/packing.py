"""Best-fit packing into bins of several permitted sequence lengths.

Texts longer than the longest length are cut into pieces of that length. The
pieces are dealt at random into shards of bounded size, and each shard packs
its pieces in decreasing order: into the open bin with the least room that
still holds the piece, or else into a new bin. A sequence of c words costs
c + OVERHEAD + c * c / ATTENTION: its words, what any sequence costs, and
attention, which grows with the square. A new bin gets the length whose cost
per word is least, given the words that are still to come, fit in its room and
have no place in the bins that are open. At the end each bin shrinks to the
shortest permitted length that holds its contents. A shard is also packed with
each length preferred, and the packing of least total cost is taken.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_in, written

#: Permitted sequence lengths; what a sequence costs beyond its length, and the length at which attention costs as much as words do.
LENGTHS, OVERHEAD, ATTENTION = (512, 1024, 2048, 4096, 8192), 128, 32_768
#: Pieces in a shard, on average.
SHARD = 20_000


def bin_cost(length: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    return length + overhead + length * length / attention


def pack(sizes: Sequence[int], lengths: Sequence[int], overhead: int = OVERHEAD, attention: int = ATTENTION) -> tuple[list[int], list[int], list[int]]:
    """Bin, offset in it, and the bin's final length, for each piece of a list in decreasing order.

    Packed once with the length of each new bin chosen by its cost per word, and
    once with each length preferred; the packing of least total cost is taken.
    """

    def total(packed: tuple[list[int], list[int], list[int]]) -> float:
        return sum(bin_cost(c, overhead, attention) for c in dict(zip(packed[0], packed[2])).values())

    return min((_packed(sizes, sorted(lengths), overhead, attention, c) for c in (None, *sorted(lengths))), key=total)


def _packed(sizes: Sequence[int], lengths: list[int], overhead: int, attention: int, preferred: int | None) -> tuple[list[int], list[int], list[int]]:
    most = max(lengths)
    to_come = list(accumulate(reversed(sizes), initial=0))  # words of the last k pieces
    rising = list(reversed(sizes))
    open_bins: list[list[int]] = [[] for _ in range(most + 1)]  # by room left
    rooms = 0  # bit r is set if a bin with room r is open
    at, offset, used = [], [], []
    open_room = 0
    for i, size in enumerate(sizes):
        found = rooms >> size
        if found:
            room = size + (found & -found).bit_length() - 1
            k = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
            open_room -= room
        else:

            def per_word(c: int) -> tuple[float, int]:
                fits = to_come[min(bisect_right(rising, c - size), len(sizes) - i - 1)]
                return bin_cost(c, overhead, attention) / (size + min(c - size, max(0, fits - open_room))), c

            room = preferred if preferred and preferred >= size else min((c for c in lengths if c >= size), key=per_word)
            k = len(used)
            used.append(0)
        at.append(k)
        offset.append(used[k])
        used[k] += size
        if room > size:
            open_bins[room - size].append(k)
            rooms |= 1 << (room - size)
            open_room += room - size
    final = [next(c for c in lengths if c >= u) for u in used]
    return at, offset, [final[k] for k in at]


def _pack_shard(lengths: Sequence[int], overhead: int, attention: int):
    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "copy", "start"], ascending=[False, True, True, True], kind="stable")
        at, offset, length = pack(rows["length"].tolist(), lengths, overhead, attention)
        rows["bin"], rows["bin_offset"], rows["bin_length"] = at, offset, length
        return rows

    return packed


def best_fit_pack(
    docs: DataFrame,
    lengths: Sequence[int] = LENGTHS,
    overhead: int = OVERHEAD,
    attention: int = ATTENTION,
    size: Column | None = None,
    shard: int = SHARD,
) -> DataFrame:
    """Place every word of every document in a bin.

    size counts a document's words (or tokens); by default words of `text`.
    Returns one row per piece: doc_id, start and length (words of the document
    that it holds), shard and bin (together the bin's id), bin_offset and
    bin_length. A document without words (null or empty text) has no piece;
    repeated rows are packed as often as they occur; pieces of one length are
    taken by doc_id, number among equal rows and start; other columns are not
    read. The same rows give the same bins, however they are stored.
    """
    most = max(lengths)
    size = words_in(F.col("text")) if size is None else size
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.cast("long").alias("size")).where("size > 0").groupBy("doc_id", "size").agg(F.count(F.lit(1)).alias("same")), "sizes")
    pieces = sized.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "same"))).select(
        "doc_id", "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(most).cast("long"))).alias("start"), "size"
    ).select("doc_id", "copy", "start", F.least(F.col("size") - F.col("start"), F.lit(most).cast("long")).alias("length"))
    n = sized.agg(F.sum(F.ceil(F.col("size") / F.lit(most)) * F.col("same"))).first()[0] or 0
    shards = max(1, -(-int(n) // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy", "start"), F.lit(shards)))
    schema = "doc_id long, copy long, start long, length long, shard long, bin long, bin_offset long, bin_length long"
    return dealt.groupBy("shard").applyInPandas(_pack_shard(tuple(lengths), overhead, attention), schema).drop("copy")
