"""Packing along a space-filling curve: documents of like content share training sequences.

A document's token ids are hashed into a vector, and the vector is projected
to a few dimensions. The Hilbert key of that point orders all documents, so
neighbours on the curve are neighbours in content. Sequences are cut out of
the documents laid end to end in that order; only what is left after the last
whole sequence is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, small_side, written

#: Ids of a sequence; the id that ends a document.
LENGTH, END = 2048, 1
#: Buckets that token ids are hashed to, dimensions they are projected to, bits of a dimension.
BUCKETS, DIMENSIONS, BITS = 512, 4, 15
#: Characters of text encoded at once (one longer text is taken alone), and words whose ids a worker remembers before it starts anew.
CHUNK, REMEMBERED = 4 << 20, 500_000

_made = Cache()


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """The place along the Hilbert curve of each row of whole coordinates below 2**bits; bits times columns is 63 at most.

    By the bitwise transformation of axes: from the highest bit down, each axis
    either inverts the lower bits of the first axis or exchanges them with its
    own; a Gray code then gives the place.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        low = np.int64((1 << bit) - 1)
        for i in range(n):
            is_set = (x[i] >> bit) & 1 == 1
            swapped = np.where(is_set, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(is_set, low, 0) ^ swapped
            x[i] ^= swapped
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> bit) & 1 == 1, np.int64((1 << bit) - 1), 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def _projection(size: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and sign of each id, and the directions of the buckets."""
    r = np.random.default_rng(seed)
    return r.integers(0, BUCKETS, size), r.choice([-1.0, 1.0], size), r.standard_normal((BUCKETS, DIMENSIONS))


def curve_places(ids: np.ndarray, ends: np.ndarray, size: int, seed: int) -> np.ndarray:
    """The Hilbert key of each document, of its ids up to its end; documents of equal ids have equal keys."""
    if ("projection", size, seed) not in _made:
        _made["projection", size, seed] = _projection(size, seed)
    bucket, sign, directions = _made["projection", size, seed]
    n = np.diff(ends, prepend=0)
    doc = np.repeat(np.arange(len(ends)), n)
    vectors = np.bincount(doc * BUCKETS + bucket[ids], weights=sign[ids], minlength=len(ends) * BUCKETS).reshape(len(ends), BUCKETS)
    vectors = np.sign(vectors) * np.log1p(np.abs(vectors))
    norms = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    at = np.einsum("db,bk->dk", vectors / np.where(norms > 0, norms, 1), directions)
    spread = 0.5 + 0.5 * np.tanh(at * 0.8)  # about even for directions drawn from a normal distribution
    return hilbert_keys(np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def _encode_each(words: list[str]) -> list[np.ndarray]:
    return [np.array(e.ids, dtype=np.int32) for e in _made["tokenizer"].encode_batch_fast(words, add_special_tokens=False)]


def _encode_words(words: list[str], ends: np.ndarray) -> list[np.ndarray]:
    """Ids of each of many words of letters, encoded as one text: where each is one token of it, its last id marks an end."""
    ids = np.array(_made["tokenizer"].encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=np.int32)
    cuts = np.flatnonzero(ends[ids]) + 1
    if len(cuts) != len(words):
        return _encode_each(words)
    starts = np.concatenate(([0], cuts[:-1])).tolist()
    return [ids[a:b] for a, b in zip(starts, cuts.tolist())]


class _Known:
    """Ids of the runs that a worker has seen: where each run's ids lie in one array."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, runs: list[str], ids: list[np.ndarray]) -> None:
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.flat = np.concatenate([self.flat, *ids])
        self.number.update(zip(runs, range(len(self.number), len(self.number) + len(runs))))


#: ASCII characters that never share a token with a letter beside them; an apostrophe may, and <|> stand in names of special tokens.
#: Latin letters that are one letter in lower case and in any normal form.
_APART, _LETTER = r"[!-&(-;=?@\[-`{}~]", r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}]"


def encoded(texts: list[str], spec: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and where each text's ids end.

    No token of this kind of vocabulary spans a space or a line end, or holds both a Latin letter and one of the
    characters above beside it, and case doesn't matter. So each distinct run between such places is encoded once, and its ids are
    laid out wherever it occurs. Texts that may hold the names of special tokens, where case does matter, keep their case.
    """
    if "tokenizer" not in _made:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _made["tokenizer"] = Tokenizer.from_str(spec)
        vocabulary = _made["tokenizer"].get_vocab()
        _made["ends"] = np.zeros(1 + max(vocabulary.values()), dtype=bool)
        _made["ends"][[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
    if len(_made.get("known", _Known()).number) > REMEMBERED:
        del _made["known"]
    known = _made.setdefault("known", _Known())
    plain = pa.array(texts, pa.large_string())
    plain = pc.if_else(pc.match_substring(plain, "<|"), plain, pc.ascii_lower(plain))
    for pattern in (f"({_LETTER})({_APART})", f"({_APART})({_LETTER})"):
        plain = pc.replace_substring_regex(plain, pattern, r"\1 \2")
    split = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")
    runs = split.flatten().dictionary_encode()
    distinct = runs.dictionary.to_numpy(zero_copy_only=False).tolist()
    new = [w for w in distinct if w not in known.number]
    words = [w for w in new if w.isalpha() and (w.isascii() or w.lower().isalpha() and unicodedata.is_normalized("NFC", w))]
    if words:
        known.add(words, _encode_words(words, _made["ends"]))
    rest = [w for w in new if w not in known.number]
    known.add(rest, _encode_each(rest))
    at = np.fromiter(map(known.number.__getitem__, distinct), dtype=np.int64, count=len(distinct))[runs.indices.to_numpy()]
    n = known.sizes[at]
    reached = np.concatenate(([0], np.cumsum(n)))
    ids = known.flat[np.repeat(known.starts[at] - reached[:-1], n) + np.arange(reached[-1])]
    bounds = split.offsets.to_numpy()
    return ids, reached[bounds[1:] - bounds[0]]


def _encode(batches: Iterator[pd.DataFrame], spec: str, size: int, seed: int) -> Iterator[pd.DataFrame]:
    kind = np.uint16 if size <= 1 << 16 else np.uint32
    for batch in batches:
        texts = [t if isinstance(t, str) else "" for t in batch["text"]]
        chars = np.cumsum([0, *map(len, texts)])
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(chars, chars[low] + CHUNK, side="right")) - 1)
            ids, ends = encoded(texts[low:high], spec)
            places = curve_places(ids, ends, size, seed)
            ids, starts = ids.astype(kind), np.concatenate(([0], ends[:-1]))
            yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[low:high], "place": places, "tokens": ends - starts + 1, "ids": [ids[a:b].tobytes() for a, b in zip(starts, ends)]})
            low = high


def token_table(docs: DataFrame, tokenizer: str, seed: int = 13) -> tuple[DataFrame, int]:
    """row, doc_id, place (Hilbert key), tokens (ids and the end), ids (little-endian) of every document, as a written table; and the size of the vocabulary."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    known = json.loads(spec)
    size = 1 + max(END, *known["model"]["vocab"].values(), *[t["id"] for t in known["added_tokens"]])
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    table = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(lambda b: _encode(b, sent.value, size, seed), "doc_id string, place long, tokens long, ids binary")
    return written(table.select(F.monotonically_increasing_id().alias("row"), "*"), "tokens"), size


def _laid(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ids of the range before each row, in rows that come in the order of the curve."""
    reached, part = 0, TaskContext.get().partitionId()
    for batch in batches:
        ends = reached + batch["tokens"].cumsum()
        yield pd.DataFrame({"row": batch["row"], "part": part, "before": ends - batch["tokens"], "tokens": batch["tokens"]})
        reached = int(ends.iloc[-1]) if len(ends) else reached


def laid_end_to_end(table: DataFrame) -> tuple[DataFrame, int]:
    """row and at, the ids before each document along the curve, and the number of all ids.

    Ranges of keys are summed up side by side; equal keys go by row, so a large group of copies is split too. Only a
    sum for each range comes to the driver.
    """
    ranged = table.select("place", "row", "tokens").repartitionByRange("place", "row").sortWithinPartitions("place", "row")
    laid = written(ranged.select("row", "tokens").mapInPandas(_laid, "row long, part int, before long, tokens long"), "laid")
    sums = sorted(map(tuple, laid.groupBy("part").agg(F.sum("tokens")).collect()))
    firsts, total = [], 0
    for part, tokens in sums:
        firsts.append((part, total))
        total += tokens
    ranges = small_side(laid.sparkSession.createDataFrame(firsts, "part int, first long"))
    return laid.join(ranges, "part").select("row", (F.col("before") + F.col("first")).alias("at")), total


def sequence_bounds(total: int, length: int) -> list[int]:
    """Where sequences end beyond the last whole one: the rest in powers of two."""
    reached, ends = total - total % length, []
    while reached < total:
        reached += 1 << (total - reached).bit_length() - 1
        ends.append(reached)
    return ends


def _cut(batches: Iterator[pd.DataFrame], total: int, length: int, kind: type) -> Iterator[pd.DataFrame]:
    whole = total // length
    tail = np.array([whole * length, *sequence_bounds(total, length)])
    for batch in batches:
        for lo in range(0, len(batch), 1000):
            rows = batch.iloc[lo : lo + 1000]
            out: dict[str, list] = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            for doc_id, at, data in zip(rows["doc_id"], rows["at"], rows["ids"]):
                ids = np.append(np.frombuffer(data, dtype=kind), END).astype("<u4")
                end = at + len(ids)
                cuts = np.arange(at // length * length + length, min(end, tail[0] + 1), length)
                edges = np.unique(np.concatenate(([at], cuts, tail[(tail > at) & (tail < end)], [end])))
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    sequence = a // length if a < tail[0] else whole + int(np.searchsorted(tail, a, side="right")) - 1
                    first = sequence * length if a < tail[0] else int(tail[sequence - whole])
                    for c, v in zip(out, (doc_id, a - at, b - a, zlib.crc32(ids[a - at : b - at].tobytes()), len(ids), sequence, a - first)):
                        out[c].append(v)
            yield pd.DataFrame(out)


def curve_pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, seed: int = 13) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer is the path of a vocabulary file whose tokens span no space, such as `word_bpe_49k.json`; the driver
    reads it. Every id of every whole text is in exactly one piece, and id 1 ends each document. A null or empty text
    has that id alone; rows that repeat, or have no doc_id, are packed each for themselves; copies lie side by side;
    no rows give no rows; other columns are ignored.
    """
    table, size = token_table(docs, tokenizer, seed)
    laid, total = laid_end_to_end(table)
    kind = np.uint16 if size <= 1 << 16 else np.uint32
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    pieces = table.select("row", "doc_id", "ids").join(laid, "row").select("doc_id", "at", "ids")
    cut = pieces.mapInPandas(lambda b: _cut(b, total, length, kind), "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return cut.withColumn("doc_id", F.col("doc_id").cast(doc_type))
