"""Phrase collocations from vertical positional inverted lists.

The corpus is held as shards of bounded size, each of one language, and a
shard as inverted lists: for every word, then every frequent phrase, the
positions where it begins. A list's length is the frequency in the shard, and
the sum over shards the exact frequency. A phrase grows by merging its list
with the postings of the adjacent word: positions p of the phrase that are
followed, at p + 1, by the phrase that drops its first word and ends in the
new one. For two words that is the word's own posting; for more it is the
posting thinned to the places where that shorter phrase is frequent, which no
frequent phrase can do without.

Lists never leave their shard. What is frequent in all shards together comes
back to them as a bitmap of fixed size with a bit for each frequent phrase: it
may let a rare one through, whose exact count drops it, but keeps every
frequent one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, small_side, written

#: Bytes of text of a shard (one longer text is a shard of its own), and of all languages together before a task ends its shards.
SHARD, HELD = 2 << 20, 8 << 20
#: Pairs that a task holds before it sends their counts, and words of the corpus for each bucket that pairs are dealt into.
HELD_PAIRS, BUCKET = 1 << 21, 1 << 20
#: Bits of the bitmap of frequent phrases (8 MB): beyond some 60 million phrases of a length it hardly thins any more.
FILTER = 1 << 26
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_STOPS = b".,;:!?\n\x0b\x0c\r"
_SPACED = bytes.maketrans(_STOPS + b"\t", b" " * 11)
_KIND = np.zeros(256, dtype=np.int8)  # 0 in a word, 1 between words, 2 between pieces
_KIND[list(b" \t")], _KIND[list(_STOPS)] = 1, 2

#: Rows of megabytes: a codec that works through a page piece by piece, not one with buffers of a whole page outside the heap;
#: and row groups of a few rows, looked at after every row, not after a hundred, as a reader unpacks a row group at once.
PACKED = {"compression": "zstd", "parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}
LISTS = "shard long, ids array<long>, sizes array<int>, gaps array<int>"


def _grouped(codes: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes, the number of positions of each, and the positions code by code, ascending."""
    order = np.lexsort((positions, codes))
    codes, positions = codes[order], positions[order]
    firsts = np.flatnonzero(np.concatenate((np.ones(min(1, len(codes)), dtype=bool), codes[1:] != codes[:-1])))
    return codes[firsts], np.diff(np.append(firsts, len(codes))), positions


def word_lists(text: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of a shard's text, the number of places of each, and the places word by word. A place is skipped between pieces."""
    text = text.translate(_LOWER)
    words = text.translate(_SPACED).split()
    kind = np.concatenate((np.full(1, 2, dtype=np.int8), _KIND[np.frombuffer(text, dtype=np.uint8)]))
    starts = np.flatnonzero((kind[1:] == 0) & (kind[:-1] != 0)) + 1
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    gaps = np.cumsum(np.diff(piece, prepend=piece[:1]) > 0)
    coded = pa.array(words, pa.binary()).dictionary_encode()
    codes, sizes, positions = _grouped(coded.indices.to_numpy(zero_copy_only=False), np.arange(len(words)) + gaps)
    return coded.dictionary.take(pa.array(codes)).to_pylist(), sizes, positions


def word_ids(lang: str, words: list[bytes]) -> np.ndarray:
    """Spark's xxhash64(lang, word) of each word."""
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "replace"), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words)).view(np.int64)


_P = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def phrase_ids(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Spark's xxhash64(first, second) of pairs of longs: XXH64 of 8 bytes, the first hash seeding the second."""
    h = np.full(len(first), 42, dtype=np.uint64)
    for x in (first.view(np.uint64), second.view(np.uint64)):
        h = (h + _P[4] + np.uint64(8)) ^ (_turned(x * _P[1], 31) * _P[0])
        h = _turned(h, 27) * _P[0] + _P[3]
        h = (h ^ (h >> np.uint64(33))) * _P[1]
        h = (h ^ (h >> np.uint64(29))) * _P[2]
        h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


def _row(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in columns.values()], names=list(columns))


def gaps_of(sizes: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Each list's positions as its first one and the gaps from one to the next, which are small and pack well."""
    gaps = np.diff(positions, prepend=0)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    gaps[starts] = positions[starts]
    return gaps


def positions_of(sizes: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    sums = np.cumsum(gaps, dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    return sums - np.repeat(np.concatenate(([0], sums))[starts], sizes)


def _list_row(shard: int, ids: np.ndarray, sizes: np.ndarray, positions: np.ndarray, **more: tuple[object, pa.DataType]) -> pa.RecordBatch:
    return _row({"shard": (shard, pa.int64()), **more, "ids": (ids, pa.list_(pa.int64())), "sizes": (sizes, pa.list_(pa.int32())), "gaps": (gaps_of(sizes, positions), pa.list_(pa.int32()))})


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shard: its language, its words and their lists."""
    texts: dict[str, list[bytes]] = defaultdict(list)
    held: dict[str, int] = defaultdict(int)
    number = TaskContext.get().partitionId() << 40

    def ended(lang: str) -> pa.RecordBatch:
        nonlocal number
        number += 1
        words, sizes, positions = word_lists(b"\n".join(texts.pop(lang)))
        held.pop(lang)
        told = [w.decode("utf-8", "replace") for w in words]
        return _list_row(number, word_ids(lang, words), sizes, positions, lang=(lang, pa.string()), words=(told, pa.list_(pa.string())))

    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            lang, data = lang.as_py(), text.as_py().encode("utf-8", "replace")
            if held[lang] and held[lang] + len(data) > SHARD:
                yield ended(lang)
            texts[lang].append(data)
            held[lang] += len(data)
            if sum(held.values()) > HELD:
                for each in list(texts):
                    yield ended(each)
    for each in list(texts):
        yield ended(each)


def _marked(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    slot = ids.view(np.uint64) >> np.uint64(64 - (FILTER.bit_length() - 1))
    return (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _merged(batch: pa.RecordBatch, row: int, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of marked lists that meet at adjacent positions of the shard, the number of such positions, and the positions pair by pair."""
    ids, sizes, gaps = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("ids", "sizes", "gaps"))
    marked = _marked(bitmap, ids)
    positions = positions_of(sizes, gaps)[np.repeat(marked, sizes)]
    ids, sizes = ids[marked], sizes[marked]
    at = np.repeat(np.arange(len(ids)), sizes)
    order = np.argsort(positions, kind="stable")
    positions, at = positions[order], at[order]
    met = np.flatnonzero(positions[1:] == positions[:-1] + 1)
    codes, n, places = _grouped(at[met].astype(np.int64) * len(ids) + at[met + 1], positions[met])
    return ids[codes // max(1, len(ids))], ids[codes % max(1, len(ids))], n, places


def _dealt(parts: list[tuple[np.ndarray, ...]], buckets: int) -> pa.RecordBatch:
    """Pairs and their counts, summed up and dealt into buckets: one row a bucket, in which equal first ids stand together.

    A first id goes to one bucket of 64, and to more the more buckets there are, by its second ids.
    """
    first, second, n = (np.concatenate(c) for c in zip(*parts))
    slot = ((first.view(np.uint64) ^ (second.view(np.uint64) % np.uint64(-(-buckets // 64)))) * _P[0] >> np.uint64(33)) % np.uint64(buckets)
    order = np.lexsort((second, first, slot))
    slot, first, second, n = slot[order], first[order], second[order], n[order]
    firsts = np.flatnonzero(np.concatenate((np.ones(min(1, len(n)), dtype=bool), (first[1:] != first[:-1]) | (second[1:] != second[:-1]))))
    n = np.add.reduceat(n, firsts) if len(n) else n
    slot, first, second = slot[firsts], first[firsts], second[firsts]
    ends = np.flatnonzero(np.diff(slot, append=np.uint64(buckets)))
    offsets = pa.array(np.concatenate(([0], ends + 1)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((first, pa.int64()), (second, pa.int64()), (n, pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array(slot[ends].astype(np.int64), pa.int64()), *lists], names=["bucket", "first", "second", "n"])


def _pair_counts(batches: Iterator[pa.RecordBatch], bitmap: bytes, buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts of the pairs of a task's shards, dealt into buckets whenever HELD_PAIRS are held."""
    bits, parts = np.frombuffer(bitmap, dtype=np.uint8), []
    for batch in batches:
        for row in range(len(batch)):
            parts.append(_merged(batch, row, bits)[:3])
            if sum(len(p[0]) for p in parts) > HELD_PAIRS:
                yield _dealt(parts, buckets)
                parts = []
    if parts:
        yield _dealt(parts, buckets)


def _frequent(rows: pa.Table, least: int) -> pa.Table:
    """The pairs of a bucket that occur often enough in all shards together."""
    first, second, n = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("first", "second", "n"))
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    firsts = np.flatnonzero(np.concatenate((np.ones(min(1, len(first)), dtype=bool), (first[1:] != first[:-1]) | (second[1:] != second[:-1]))))
    total = np.add.reduceat(n[order], firsts) if len(firsts) else n
    keep = total >= least
    return pa.table({"first": first[firsts][keep], "second": second[firsts][keep], "a": total[keep]}, schema=pa.schema([("first", pa.int64()), ("second", pa.int64()), ("a", pa.int64())]))


def _longer_lists(batches: Iterator[pa.RecordBatch], bitmap: bytes, longer: bytes) -> Iterator[pa.RecordBatch]:
    """The lists of phrases of one word more that are marked in `longer`, one row for each shard."""
    bits, wanted = np.frombuffer(bitmap, dtype=np.uint8), np.frombuffer(longer, dtype=np.uint8)
    for batch in batches:
        for row in range(len(batch)):
            first, second, n, places = _merged(batch, row, bits)
            ids = phrase_ids(first, second)
            marked = _marked(wanted, ids)
            yield _list_row(batch.column("shard")[row].as_py(), ids[marked], n[marked], places[np.repeat(marked, n)])


def _bitmap(table: DataFrame) -> bytes:
    """A bit for each id, by its leading bits: FILTER bits however many ids there are."""
    slot = F.shiftrightunsigned("id", 64 - (FILTER.bit_length() - 1))
    blocks = table.select(slot.alias("slot")).groupBy(F.shiftright("slot", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(32767)).alias("bits"))
    out = bytearray(FILTER // 8)
    for block, bits in blocks.collect():
        out[block * 4096 : (block + 1) * 4096] = bits
    return bytes(out)


def phrase_tables(docs: DataFrame, least: int = 100, longest: int = 5) -> tuple[DataFrame, list[DataFrame]]:
    """Words in all per language (lang, n), and for each length from 1 the frequent phrases, as written tables.

    A phrase has id, lang, phrase, a (its frequency), heads (of its first 1, 2, ... words) and tails (of all but its
    first 1, 2, ... words), and from two words on first and second, the ids of the phrases without its last and its
    first word. A phrase is told by the pair of these; ids of words are hashes, and that no two words share one is
    checked.
    """
    spark = docs.sparkSession
    read = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    lists = written(read.mapInArrow(_shards, "shard long, lang string, words array<string>, ids array<long>, sizes array<int>, gaps array<int>"), "shards", **PACKED)
    counts = lists.select("lang", F.explode(F.arrays_zip("words", "sizes")).alias("e")).groupBy("lang", F.col("e.words").alias("phrase")).agg(F.sum("e.sizes").alias("a"))
    words = written(counts.withColumn("id", F.xxhash64("lang", "phrase")), "words")
    if words.groupBy("id").count().where("count > 1").limit(1).count():
        raise ArithmeticError("two words share a hash")
    totals = written(words.groupBy("lang").agg(F.sum("a").alias("n")), "totals")
    none = F.array().cast("array<long>")
    tables = [written(words.where(F.col("a") >= least).select("id", "lang", "phrase", "a", none.alias("heads"), none.alias("tails")), "phrases1")]
    forget(words)
    buckets = max(64, -(-(totals.agg(F.sum("n")).first()[0] or 0) // BUCKET))
    marks = spark.sparkContext.broadcast(_bitmap(tables[0]))
    for n in range(2, longest + 1):
        shorter, own, rows = tables[-1], marks, lists.select("shard", "ids", "sizes", "gaps")
        dealt = rows.mapInArrow(lambda b, x=own: _pair_counts(b, x.value, buckets), "bucket long, first array<long>, second array<long>, n array<long>")
        pairs = dealt.groupBy("bucket").applyInArrow(lambda rows: _frequent(rows, least), "first long, second long, a long")
        p = small_side(shorter.select(F.col("id").alias("first"), "lang", F.col("phrase").alias("begin"), F.array_append("heads", F.col("a")).alias("heads")))
        q = small_side(shorter.select(F.col("id").alias("second"), F.substring_index("phrase", " ", -1).alias("word"), F.array_prepend("tails", F.col("a")).alias("tails")))
        grown = pairs.join(p, "first").join(q, "second")
        tables.append(written(grown.select(F.xxhash64("first", "second").alias("id"), "lang", F.concat_ws(" ", "begin", "word").alias("phrase"), "a", "heads", "tails", "first", "second"), f"phrases{n}"))
        if n < longest:
            marks = spark.sparkContext.broadcast(_bitmap(tables[-1]))
            longer = written(rows.mapInArrow(lambda b, x=own, y=marks: _longer_lists(b, x.value, y.value), LISTS), f"lists{n}", **PACKED)
            forget(lists)
            lists = longer
    forget(lists)
    return totals, tables


def _least_cut(a: Column, n: Column, heads: Column, tails: Column) -> Column:
    """The cut of the lowest floor(1000 * a * n / (l * r)), then the shortest first part: its score, k, l and r."""
    wide = lambda c: c.cast("decimal(18,0)")
    cut = lambda k: F.struct(
        F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (wide(a) * wide(n)).cast("decimal(34,0)"), wide(F.element_at(heads, k)) * wide(F.element_at(tails, k))).alias("score"),
        k.alias("k"), F.element_at(heads, k).alias("l"), F.element_at(tails, k).alias("r"),
    )
    return F.array_min(F.transform(F.sequence(F.lit(1), F.size(heads)), cut))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's phrases that hold together most, the first `most`.

    Candidates are phrases of 2 to `longest` words that occur `least` times within pieces of text. A candidate's score
    is its lowest over all cuts; one that a longer candidate as frequent contains is dropped. Null lang is `und`, a null
    or empty text has no words, repeated rows count each time, ties go by frequency and then by the phrase's bytes; no
    rows give no rows; other columns are ignored. Frequencies may reach 10^17, and a * n 10^34.

    It is enough to look at candidates one word longer: a phrase inside a longer one as frequent is inside one of
    those, as frequent too.
    """
    totals, tables = phrase_tables(docs, least, longest)
    found = None
    for words, table in enumerate(tables[1:], 2):
        kept = table
        if words < longest:
            longer = tables[words]
            inside = longer.select(F.col("first").alias("id"), F.col("a").alias("held")).unionByName(longer.select(F.col("second").alias("id"), F.col("a").alias("held")))
            kept = table.join(inside.groupBy("id").agg(F.max("held").alias("held")), "id", "left").where(F.coalesce(F.col("held"), F.lit(0)) < F.col("a"))
        kept = kept.select("lang", "phrase", "a", "heads", "tails")
        found = kept if found is None else found.unionByName(kept)
    scored = found.join(small_side(totals), "lang").withColumn("cut", _least_cut(F.col("a"), F.col("n"), F.col("heads"), F.col("tails")))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same in DuckDB's SQL, of `documents`, for 100 times, five words and the first 2000.
SQL = r"""
with pieces as (
    select lang, row_number() over () as piece, piece as text from (
        select coalesce(lang, 'und') as lang,
            unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
        from documents)
), listed as (
    select lang, piece, regexp_extract_all(text, '[^\x20\x09]+') as words from pieces
), words as (
    select lang, piece, unnest(words) as w1, generate_subscripts(words, 1) as place from listed
), totals as (
    select lang, count(*) as n from words group by lang
), runs as (
    select lang, w1, lead(w1, 1) over w as w2, lead(w1, 2) over w as w3, lead(w1, 3) over w as w4, lead(w1, 4) over w as w5
    from words window w as (partition by lang, piece order by place)
), each as (
    select lang, 1 as words, w1 as phrase from runs
    union all select lang, 2, w1 || ' ' || w2 from runs where w2 is not null
    union all select lang, 3, w1 || ' ' || w2 || ' ' || w3 from runs where w3 is not null
    union all select lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 from runs where w4 is not null
    union all select lang, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 from runs where w5 is not null
), frequent as (
    select lang, words, phrase, count(*) as a from each group by lang, words, phrase having count(*) >= 100
), cuts as (
    select lang, words, phrase, a, string_split(phrase, ' ') as parts, unnest(range(1, words)) as k from frequent where words > 1
), scored as (
    select c.lang, c.words, c.phrase, c.a, c.k, l.a as l, r.a as r, t.n, (1000 * c.a::hugeint * t.n) // (l.a::hugeint * r.a) as score
    from cuts c join totals t on t.lang = c.lang
    join frequent l on l.lang = c.lang and l.phrase = array_to_string(c.parts[1:c.k], ' ')
    join frequent r on r.lang = c.lang and r.phrase = array_to_string(c.parts[c.k + 1:], ' ')
), least as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), inner_runs as (
    select f.lang, f.a as held, array_to_string(string_split(f.phrase, ' ')[i:i + j - 1], ' ') as phrase
    from frequent f, unnest(range(1, 5)) as lengths(j), unnest(range(1, 5)) as starts(i)
    where j >= 2 and j < f.words and i + j - 1 <= f.words
), kept as (
    select * from least c where not exists (select 1 from inner_runs i where i.lang = c.lang and i.phrase = c.phrase and 100 * i.held >= 100 * c.a)
), ranked as (
    select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked where rank <= 2000
"""
