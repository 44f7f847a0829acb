"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint maps to the number of set bits in each of 32 segments of
two bits. The Manhattan distance of two such vectors is never above the
Hamming distance of the fingerprints. The range join over the grid of these
vectors takes as a cell the coordinates of some blocks of segments: within
distance R, at most R of the blocks differ, so of B blocks two fingerprints in
range agree on some B - R whole ones, and share one of the cells that take so
many blocks each. Within Hamming distance R they agree on these blocks bit for
bit, so a cell holds the bits of its blocks, too: few strangers meet. Pairs in
a cell pass the Manhattan bound, then the exact Hamming distance.

The number of blocks only sets how many strangers meet in a cell; whatever it
is, every pair in range shares one.

A count of 0, 1 or 2 is stored as the two bits 00, 01, 11, so the Manhattan
distance of two vectors is the number of differing bits of their codes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .collocations import _bitmap, _marked
from .common import counted, forget, join_spread, sliced, small_side, windows, word_hashes, word_spans, written
from .components import link_cells, possible_pairs

#: Similarity of near-duplicate documents, and words in a shingle.
SIMILARITY, SHINGLE = 0.8, 5
#: Texts of the sample that tells common shingles, texts of it that hold one, and most of them.
SAMPLE, COMMON, MOST = 3000, 6, 50_000
#: Times that what crowded cells leave apart gets new prefixes, before its whole sets are compared.
ROUNDS = 1
_LOW = 0x5555555555555555


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _majority(hashes: list[int] | np.ndarray) -> int:
    """The 64-bit number whose bits are those set in over half the hashes, signed; 0 for none."""
    if not len(hashes):
        return 0
    h = hashes.view("<u8") if isinstance(hashes, np.ndarray) else np.array(hashes, dtype="<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def shingle_fingerprint(text: str | None, shingle: int) -> int:
    """SimHash of the shingles of a whole text, A-Z lower-cased, repeats included, by XXH64 with seed 42."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if len(words) <= shingle:
        return _majority([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [])
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[: len(words) - shingle]))
    digest = xxhash.xxh64_intdigest
    return _majority([digest(line[s:e], 42) for s, e in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist())])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each whole text; a null or empty text has 0."""

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches):
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": [shingle_fingerprint(t, shingle) for t in batch["text"]]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(marked, "doc_id long, fp long")


def segment_counts(x: Column) -> Column:
    """The popcount of each two-bit segment of x, each count as two bits."""
    shifted, low = F.shiftright(x, 1), F.lit(_LOW)
    both = x.bitwiseAND(shifted).bitwiseAND(low)
    return F.shiftleft(both, 1).bitwiseOR(x.bitwiseOR(shifted).bitwiseAND(low))


def block_masks(blocks: int, agree: int) -> list[int]:
    """Masks of every choice of `agree` among blocks of whole segments, as equal as may be, of the 64 bits."""
    cuts = [2 * (32 * b // blocks) for b in range(blocks + 1)]
    block = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:])]
    return [sum(some) for some in combinations(block, agree)]


def blocks_for(nodes: int, reach: int) -> int:
    """The fewest blocks, reach + 3 at least, of whose cells an average one holds under one of `nodes` random fingerprints."""
    blocks = reach + 3
    while blocks < 32 and nodes * 16 > 1 << 64 * (blocks - reach) // blocks:
        blocks += 1
    return blocks


def _grid(masks: list[int]) -> Column:
    """Cells of the column fp: its segment counts and its bits under each mask, with the mask's number."""
    sets = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(_signed(m)).alias("m")) for k, m in enumerate(masks)])
    return F.transform(sets, lambda s: F.xxhash64(s["k"], segment_counts(F.col("fp")).bitwiseAND(s["m"]), F.col("fp").bitwiseAND(s["m"])))


def _within(reach: int) -> Callable[[Column, Column], Column]:
    """Manhattan distance of the counts as a lower bound, then the exact Hamming distance."""

    def close(a: Column, b: Column) -> Column:
        bound = F.bit_count(segment_counts(a["fp"]).bitwiseXOR(segment_counts(b["fp"]))) <= reach
        return bound & (F.bit_count(a["fp"].bitwiseXOR(b["fp"])) <= reach)

    return close


def fingerprint_classes(docs: DataFrame, shingle: int = 4, reach: int = 4) -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id reachable over links of at most `reach` differing bits.

    One row per row of docs. Null and empty texts share the fingerprint 0, which
    links like any other. Documents with equal fingerprints are one node. A row
    with a null doc_id gets the component of its fingerprint, or null if no
    document with an id has that fingerprint. Texts of any length are read
    whole; repeated rows get the same answer; other columns are not read.
    """
    marked = written(fingerprints(docs, shingle), "fingerprints")
    nodes = counted(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")), "nodes")
    blocks = blocks_for(nodes.seen["rows"], reach)
    found = link_cells(nodes, _grid(block_masks(blocks, blocks - reach)), _within(reach), carry=["fp"])
    of_fp = written(nodes.join(small_side(found), "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"), "n"), "classes")
    return join_spread(marked, of_fp, "fp", "n", "left").select("doc_id", "fp", "component_id")


def _shingles(words: bytes, shingle: int) -> np.ndarray:
    data = np.frombuffer(words, dtype=np.uint8)
    return np.unique(windows(word_hashes(data, *word_spans(data)), shingle)).view(np.int64)


def prefix(members: np.ndarray, similarity: float, common: np.ndarray, crowded: bytes | None = None) -> np.ndarray:
    """Those of a text's shingles of which any text of at least that similarity has one among its own such.

    Shingles have one order everywhere: common ones (sorted) and those of a bitmap last, else by their hash. Of n shingles similar
    texts share ceil(similarity * n) at least, so the first of these is among the first n - ceil(similarity * n) + 1 of both.
    """
    n = len(members)
    last = np.isin(members, common)
    if crowded is not None and n:
        last |= _marked(np.frombuffer(crowded, dtype=np.uint8), members)
    return np.concatenate((members[~last], members[last]))[: n - math.ceil(similarity * n - 1e-9) + 1] if n else members


def _sketch(shingle: int, similarity: float, common: np.ndarray, crowded=None):
    """crowded: a broadcast bitmap of shingles that come last, besides the common ones."""

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches):
            digests, marks, sizes, cells = [], [], [], []
            for text in batch["text"]:
                words = b" ".join((text or "").encode("utf-8", "replace").lower().split())
                members = _shingles(words, shingle)
                digests.append(xxhash.xxh3_64_intdigest(words) - (1 << 63))
                marks.append(_majority(members))
                sizes.append(len(members))
                cells.append(prefix(members, similarity, common, crowded and crowded.value))
            yield batch.drop(columns="text").assign(id=digests, fp=marks, n_shingles=sizes, cells=cells)

    return sketched


def _shingle_sets(shingle: int):
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches):
            found = [_shingles((text or "").encode("utf-8", "replace").lower(), shingle) for text in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "members": found})

    return sets


def common_shingles(plain: DataFrame, shingle: int) -> np.ndarray:
    """Sorted shingles that many texts of a sample hold: any list will do for whole results, a good one saves candidates."""
    some = plain.sample(min(1.0, SAMPLE / max(1, plain.count())), seed=3).select(F.col("text_hash").alias("id"), "text")
    held = some.mapInPandas(_shingle_sets(shingle), "id long, members array<long>").dropDuplicates(["id"]).select(F.explode("members").alias("member"))
    often = held.groupBy("member").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "member").limit(MOST)
    return np.array(sorted(r.member for r in often.collect()), dtype=np.int64)


def _near_size(similarity: float) -> Callable[[Column, Column], Column]:
    """Whether two sets of such sizes can be so similar at all."""

    def close(a: Column, b: Column) -> Column:
        x, y = a["n_shingles"], b["n_shingles"]
        return F.least(x, y) >= F.greatest(x, y) * similarity - 1e-6

    return close


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, reach: int = 4) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text) and kept of each row of docs; repeated rows are told once.

    Texts with the same words (A-Z lower-cased) are copies. Distinct texts link
    if the Jaccard similarity of their word shingles is at least `similarity`.
    Candidates come from the grid of fingerprints of the shingles (Manhattan
    bound, then `reach` differing bits). Similar texts can differ in more bits
    than any grid reaches, so what the grid leaves apart meets by the shingles
    of its prefixes, of which every such pair shares one, wherever its edits
    lie and however many texts there are. Two texts that share only shingles of
    crowded cells get new prefixes, in which these shingles come last, as they
    share one of those, too; only what is in crowded cells after ROUNDS of this
    meets by its whole sets. All candidates are held against each
    other exactly. Of each component one row stays: that with the smallest
    doc_id, a null one last. Texts without words (null, empty) are copies of
    one another; texts of any length are read whole.
    """
    text = F.col("text").cast("string")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    schema = "doc_id long, text_hash long, id long, fp long, n_shingles int, cells array<long>"
    common = common_shingles(plain, shingle)
    marked = written(plain.mapInPandas(_sketch(shingle, similarity, common), schema), "sketches")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    nodes = counted(marked.groupBy("id").agg(F.min(row).alias("row")), "nodes")

    def texts_of(ids: DataFrame) -> DataFrame:
        needed = written(nodes.join(small_side(ids), "id").select("id", F.col("row.doc_id").alias("doc_id"), F.col("row.text_hash").alias("text_hash")), "needed")
        same = F.col("p.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("p.text_hash") == F.col("n.text_hash"))
        return plain.alias("p").join(small_side(needed).alias("n"), same).select("n.id", "p.text")

    def sets_of(ids: DataFrame) -> DataFrame:
        return texts_of(ids).mapInPandas(_shingle_sets(shingle), "id long, members array<long>")

    def possible_in(sketches: DataFrame) -> Callable[[DataFrame], DataFrame]:
        prefixes = sketches.select("id", F.col("n_shingles").alias("n"), F.col("cells").alias("members"))
        return lambda pairs: possible_pairs(pairs, prefixes, similarity)

    def linked(sketches: DataFrame, known: DataFrame, bits: bytes | None = None, rounds: int = 0) -> DataFrame:
        def deeper(cells: DataFrame, ids: DataFrame, found: DataFrame) -> DataFrame:
            now = _bitmap(cells.select(F.col("cell").alias("id")))
            now = now if bits is None else (np.frombuffer(now, dtype=np.uint8) | np.frombuffer(bits, dtype=np.uint8)).tobytes()
            crowded = docs.sparkSession.sparkContext.broadcast(now)
            again = written(texts_of(ids).mapInPandas(_sketch(shingle, similarity, common, crowded), "id long, fp long, n_shingles int, cells array<long>"), "sketches")
            crowded.destroy()
            got = linked(again, found, now, rounds + 1)
            forget(again)
            return got

        return link_cells(sketches, F.col("cells"), _near_size(similarity), sets_of, possible_in(sketches), similarity, ["n_shingles"], room=12, known=known, deeper=deeper if rounds < ROUNDS else None)

    blocks = blocks_for(nodes.seen["rows"], reach)
    by_print = link_cells(marked.select("id", "fp").distinct(), _grid(block_masks(blocks, blocks - reach)), _within(reach), sets_of, possible_in(marked), similarity, ["fp"], room=12)
    found = linked(marked, by_print)
    classed = nodes.join(small_side(found), "id", "left").withColumn("component", F.coalesce("component", "id"))
    winners = classed.groupBy("component").agg(F.min("row").alias("row")).select("row.doc_id", "row.text_hash", F.lit(True).alias("kept"))
    rows = marked.select("doc_id", "text_hash").distinct()
    same = F.col("m.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("m.text_hash") == F.col("w.text_hash"))
    return rows.alias("m").join(winners.alias("w"), same, "left").select("m.doc_id", "m.text_hash", F.coalesce("kept", F.lit(False)).alias("kept"))


def without_near_duplicates(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that near_duplicates keeps; of rows with the same doc_id and text one stays."""
    kept = judged.where("kept").select(F.col("doc_id").alias("__id"), "text_hash")
    hashed = docs.withColumn("__hash", F.xxhash64(F.col("text").cast("string")))
    stays = hashed.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("text_hash")), "left_semi")
    return stays.dropDuplicates(["doc_id", "__hash"]).select(*[F.col(f"`{c}`") for c in docs.columns])
