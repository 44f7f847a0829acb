"""Substring dedup: paragraph MinHash banding with exact verification.

Two kinds of paragraphs are looked at. A line of a text, or all of some
successive lines that are too short to be one each; and, for passages that
repeat inside otherwise different lines, windows of WINDOW words. A window
starts where the hash of its words is the least of REACH successive ones, so
any two texts that share WINDOW + REACH - 1 words in a row have a window in
common.

MinHash signatures of lines over five-word shingles are cut into bands, as many
as catch nearly every pair at the similarity asked for. Lines that collide in a
band are held against each other by exact Jaccard similarity, and the components
of the verified pairs are the clusters. A window is looked for unchanged, so the
digest of its words is its only cell, and equal windows are a cluster of
similarity 1. The first occurrence in a cluster stays, the others are removals; windows of a text that overlap and go, or stay, for the
same text are told as one passage.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, join_spread, mixed, small_side, span_hashes, text_words, windows, word_hashes, word_spans, words_in, written
from .components import link_cells

#: Least words of a line, words of a window, and successive windows of which one is taken (together 20 words).
MIN_WORDS, WINDOW, REACH = 20, 12, 9
SIMILARITY, SHINGLE, RECALL = 0.8, 5, 0.997


def tune_bands(similarity: float, recall: float, loose: float = 0.5) -> tuple[int, int]:
    """Bands and rows of each: the fewest bands that catch `recall` of the pairs at `similarity`,
    while at most `loose` of the pairs at half that similarity become candidates."""
    for rows in range(1, 20):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if 1 - (1 - (similarity / 2) ** rows) ** bands <= loose:
            break
    return bands, rows


def window_starts(hashes: np.ndarray, window: int = WINDOW, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the windows that are taken from the words of a text."""
    if len(hashes) < window:
        return np.zeros(0, dtype=np.int64), hashes[:0]
    h = windows(hashes, window)
    if len(h) <= reach:
        at = np.array([h.argmin()])
    else:
        view = np.lib.stride_tricks.sliding_window_view(h, reach)
        at = np.unique(view.argmin(axis=1) + np.arange(len(view)))
    return at, h[at]


class Signer:
    """MinHash band hashes of the paragraphs of a text, all at once."""

    def __init__(self, bands: int, rows: int) -> None:
        draw = np.random.default_rng(5).integers(0, 1 << 63, (2, bands * rows), dtype=np.uint64)
        self.bands, self.rows, self.factor, self.shift = bands, rows, draw[0] | np.uint64(1), draw[1]

    def bands_of(self, shingles: np.ndarray, firsts: np.ndarray, lasts: np.ndarray) -> np.ndarray:
        """For each run of shingles [first, last]: one hash of each band of the least value under every hash function."""
        if not len(firsts):
            return np.zeros((0, self.bands), dtype=np.int64)
        cuts = np.stack([firsts, lasts + 1], axis=1).ravel()
        padded = np.append(shingles, np.uint64(np.iinfo(np.uint64).max))
        least = np.empty((len(self.factor), len(firsts)), dtype=np.uint64)
        for k in range(len(least)):
            least[k] = np.minimum.reduceat(padded * self.factor[k] + self.shift[k], cuts)[::2]
        out = np.repeat(np.arange(1, self.bands + 1, dtype=np.uint64)[:, None], len(firsts), axis=1)
        grouped = least.reshape(self.bands, self.rows, len(firsts))
        for r in range(self.rows):
            out = mixed(out * np.uint64(0xD1342543DE82EF95) + grouped[:, r])
        return np.ascontiguousarray(out.T).view(np.int64)


def _units(texts: list[bytes], signer: Signer) -> tuple[np.ndarray, np.ndarray, list]:
    """Lines and windows of some texts: rows (text number, level, start, end, first word, n_words), digests, and band hashes.

    Offsets are code points of the text. The texts stand one after another, a
    line apart, so that short ones share the cost of a numpy call.
    """
    data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros((6, 0), dtype=np.int64), np.zeros(0, dtype=np.uint64), []
    text_starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    owner = np.searchsorted(text_starts, starts, side="right") - 1
    hashes = word_hashes(data, starts, ends)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    line_of = np.searchsorted(np.flatnonzero(data == 10), starts)
    firsts = np.concatenate(([0], np.flatnonzero(np.diff(line_of)) + 1))
    short = np.diff(np.append(firsts, len(starts))) < MIN_WORDS
    joined = short[1:] & short[:-1] & (owner[firsts[1:]] == owner[firsts[:-1]])
    firsts = firsts[np.concatenate(([True], ~joined))]
    lasts = np.append(firsts[1:], len(starts))
    long = lasts - firsts >= MIN_WORDS
    firsts, lasts = firsts[long], lasts[long]
    at, same = window_starts(hashes)
    within = owner[at] == owner[at + WINDOW - 1] if len(at) else np.zeros(0, dtype=bool)
    at, same = at[within], same[within]
    a, b = np.concatenate((firsts, at)), np.concatenate((lasts, at + WINDOW))
    if not len(a):
        return np.zeros((6, 0), dtype=np.int64), np.zeros(0, dtype=np.uint64), []
    bands = [*signer.bands_of(windows(hashes, SHINGLE), firsts, lasts - SHINGLE), *[None] * len(at)]
    level = np.concatenate((np.zeros(len(firsts), dtype=np.int64), np.ones(len(at), dtype=np.int64)))
    first_word = np.searchsorted(owner, np.arange(len(texts)))
    zero = lead[text_starts[owner[a]]]
    rows = np.stack([owner[a], level, lead[starts[a]] - zero, lead[ends[b - 1]] - zero, a - first_word[owner[a]], b - a])
    return rows, np.concatenate((span_hashes(hashes, firsts, lasts), mixed(same))), bands


def _chunks(texts: list[bytes], size: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    first = total = 0
    for i, t in enumerate(texts):
        if i > first and total + len(t) > size:
            yield first, texts[first:i]
            first, total = i, 0
        total += len(t)
    if texts:
        yield first, texts[first:]


def _unit_rows(bands: int, rows: int):
    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer(bands, rows)
        for batch in batches:
            for first, part in _chunks([(t or "").encode("utf-8", "replace") for t in batch["text"]]):
                at, digests, band = _units(part, signer)
                own = batch[["doc_id", "text_hash"]].iloc[first + at[0]].reset_index(drop=True)
                yield own.assign(
                    level=at[1].astype(np.int32), start=at[2].astype(np.int32), end=at[3].astype(np.int32), word=at[4].astype(np.int32), n_words=at[5].astype(np.int32),
                    id=digests.view(np.int64), bands=pd.Series(band, dtype=object),
                )

    return marked


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        shingles = [np.unique(windows(word_hashes(*text_words(t)), SHINGLE)).view(np.int64) for t in batch["part"]]
        yield pd.DataFrame({"id": batch["id"], "members": shingles})


def _passages(found: DataFrame) -> DataFrame:
    """Windows of a text that overlap, and go or stay for the same text, as one row."""
    text = Window.partitionBy("doc_id", "text_hash").orderBy("word", "id")
    last = F.lag(F.struct(F.col("word"), "removed", "kept_doc_id", "kept_hash")).over(text)
    breaks = F.coalesce(
        (F.col("word") - last["word"] > WINDOW) | (last["removed"] != F.col("removed")) | ~last["kept_doc_id"].eqNullSafe(F.col("kept_doc_id")) | (last["kept_hash"] != F.col("kept_hash")), F.lit(True)
    )
    merged = found.withColumn("breaks", breaks).withColumn("run", F.sum(F.col("breaks").cast("int")).over(text)).groupBy("doc_id", "text_hash", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max("word") + WINDOW - F.min("word")).alias("n_words"), F.min_by("cluster", "word").alias("cluster"),
        F.min("cluster_size").alias("cluster_size"), F.first("removed").alias("removed"), F.first("kept_doc_id").alias("kept_doc_id"),
    )
    return merged.withColumn("level", F.lit(1))


def repeated_passages(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Every line or passage that occurs twice or more, exactly or nearly.

    Returns doc_id, level ('text', 'line' or 'passage'), start and end (code
    points), n_words, cluster (the same for all occurrences of a text or line;
    for a passage, that of its first window), cluster_size, removed (false for
    the first occurrence by doc_id and start, null ids last) and kept_doc_id
    (the document where that occurrence stays). Whole texts of WINDOW words
    or more that are equal to the letter are told as such; of each, only the one
    that stays is looked into. Windows that lie in a removed line go with it.
    What goes with something larger is not told, and is no occurrence. Lines of fewer than
    MIN_WORDS words, and runs of fewer than WINDOW, are left alone, and so are
    null and empty texts; runs of WINDOW + REACH - 1 words are always found,
    shorter ones by chance. Rows repeated in docs are occurrences of their own,
    of which the first stays; texts of any length are read whole; white space
    does not matter to equality; other columns are not read.
    """
    bands, rows = tune_bands(similarity, recall)
    text = F.col("text").cast("string")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    keys = written(every.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"), F.max(words_in(F.col("text"))).alias("n_words"), F.max(F.length("text")).alias("length")), "keys")
    texts = written(keys.groupBy("text_hash").agg(F.sum("n").alias("cluster_size"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("first")), "texts")
    same = F.col("e.doc_id").eqNullSafe(F.col("t.first.doc_id")) & (F.col("e.text_hash") == F.col("t.text_hash"))
    plain = every.alias("e").join(small_side(texts.select("text_hash", "first"), 2_000_000).alias("t"), same, "left_semi")

    schema = "doc_id long, text_hash long, level int, start int, end int, word int, n_words int, id long, bands array<long>"
    units = plain.mapInPandas(_unit_rows(bands, rows), schema).withColumn("line_no", F.when(F.col("level") == 0, F.monotonically_increasing_id()))
    units = written(units, "units")
    cells = F.coalesce("bands", F.array("id"))
    again = units.select(F.explode(cells).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cell")
    again = small_side(written(again, "cells"))
    met = units.where("level = 0").select("line_no", F.explode("bands").alias("cell")).join(again, "cell", "left_semi").select("line_no").distinct()
    some = units.where("level = 0").join(met, "line_no", "left_semi").select(units.columns)
    some = some.unionByName(units.where("level = 1").withColumn("cell", F.col("id")).join(again, "cell", "left_semi").select(units.columns))
    some = written(some.drop("line_no").dropDuplicates(["doc_id", "text_hash", "id", "start"]), "repeated")
    forget(units)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "start", "end", "text_hash")

    def sets_of(ids: DataFrame) -> DataFrame:
        spots = some.join(small_side(written(ids, "needed")), "id", "left_semi").groupBy("id").agg(F.min(place).alias("at"))
        spots = spots.groupBy("at.doc_id", "at.text_hash").agg(F.collect_list(F.struct("id", F.col("at.start").alias("start"), F.col("at.end").alias("end"))).alias("spots"))
        here = F.col("p.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("p.text_hash") == F.col("s.text_hash"))
        parts = every.alias("p").join(small_side(written(spots, "spots"), 100_000).alias("s"), here).withColumn("spot", F.explode("spots"))
        parts = parts.select("spot.id", F.expr("substring(text, spot.start + 1, spot.end - spot.start)").alias("part"))
        return parts.mapInPandas(_sets, "id long, members array<long>")

    near = link_cells(some.where("level = 0").select("id", "bands"), F.col("bands"), sets_of=sets_of, similarity=similarity, room=12)
    counts = some.groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(near, "id", "left")
    clusters = written(counts.where("n > 1 or component is not null").select("id", F.coalesce("component", "id").alias("cluster"), "n"), "clusters")
    found = written(join_spread(some.drop("bands"), clusters, "id", "n").drop("n"), "occurrences")

    def told(rows: DataFrame) -> DataFrame:
        firsts = written(rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"), F.min(place).alias("first")).where("cluster_size > 1"), "firsts")
        rows = join_spread(rows, firsts, "cluster", "cluster_size").withColumn("removed", F.col("first") != place)
        return rows.withColumn("kept_doc_id", F.col("first.doc_id")).withColumn("kept_hash", F.col("first.text_hash")).drop("first")

    lines = written(told(found.where("level = 0")), "lines")
    gone = lines.where("removed").select(*[F.col(c).alias(f"gone_{c}") for c in ("doc_id", "text_hash", "start", "end")])
    inside = F.col("doc_id").eqNullSafe(F.col("gone_doc_id")) & (F.col("text_hash") == F.col("gone_text_hash"))
    inside = inside & (F.col("start") >= F.col("gone_start")) & (F.col("end") <= F.col("gone_end"))
    left = written(found.where("level = 1").join(gone, inside, "left_anti"), "windows")
    out = ["doc_id", "level", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("n_words").cast("long").alias("n_words"), "cluster", "cluster_size", "removed", "kept_doc_id"]
    copies = texts.where("cluster_size > 1").join(keys.where(F.col("n_words") >= WINDOW), "text_hash").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("nth") == 1)
    copies = copies.select("doc_id", F.lit(2).alias("level"), F.lit(0).alias("start"), F.col("length").alias("end"), "n_words", F.col("text_hash").alias("cluster"), "cluster_size", (~stays).alias("removed"), F.col("first.doc_id").alias("kept_doc_id"))
    rows = lines.select(*out).unionByName(_passages(told(left)).select(*out)).unionByName(copies.select(*out))
    return rows.withColumn("level", F.element_at(F.array(F.lit("line"), F.lit("passage"), F.lit("text")), F.col("level") + 1))
