"""Operators on whole corpora: collocations, source divergence, packing along a curve."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from functools import cache

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern.llm import collocations, curve_packing, divergence, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, n long, id long, place long, row long, words string, n_docs int, shard int, part int, total long, phrase string"
TEXTS = [None, "", " \t\n", "one", "a b a b, a b! a b" * 40, "Zürich 😀 NAÏVE. ÉTÉ Straße\n\nline\nline", "word " * 30_000, "x" * 5000, "\0 nul\0 A-b_c", "a\x0bb\x0cc\rd a;b:c?d", "<|endoftext|> don't   é \x85\x1c 12,5 é́"]


def odd_rows(spark):
    """Nulls in every column, empty and blank texts, repeated rows, a long text, columns with clashing names."""
    extra = ("t", 7, 8, 9, 10, "w", 1, 2, 3, 4, "p")
    rows = [(i, t, "en", f"s{i % 2}", 1, *extra) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (None, "no id a b", None, None, None, *[None] * 11), (None, None, None, None, None, *[None] * 11), (3, "a b", "und", "", 3, *extra)]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    found, df = con.sql(queries.ORACLE[name]), queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)
    assert rows_of(df.select(columns)) == want and (want or name == "op11_collocations")


# collocations


def brute_collocations(docs, least, longest, most):
    count, words = defaultdict(Counter), Counter()
    for text, lang in docs:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            p = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(p)
            for k in range(1, longest + 1):
                count[lang or "und"].update(tuple(p[i : i + k]) for i in range(len(p) - k + 1))
    out = []
    for lang, f in count.items():
        frequent = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        inside = {p[i:j] for q in [frequent] for p, a in q.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and f[p[i:j]] <= a}
        ranked = []
        for p, a in frequent.items():
            if p not in inside:
                score, k = min((1000 * a * words[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(ranked)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, words[lang], -s))
    return sorted(out, key=repr)


def test_collocations_against_brute_force(spark, monkeypatch):
    r = random.Random(3)
    vocabulary = ["the", "of", "New", "york", "times", "É", "ß", "x-y"]
    docs = []
    for i in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randrange(0, 60))]
        for _ in range(r.randrange(3)):
            words[r.randrange(len(words) + 1) :] = ["New", "york", "times", "of", "the"]
        docs.append((i, "".join(w + r.choice([" ", " ", " ", "\t", ", ", ".\n", "  "]) for w in words), r.choice(["en", "en", None, "de"])))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    want = brute_collocations([d[1:] for d in docs], 4, 5, 40)
    assert len({w[0] for w in want}) == 3 and max(len(w[2].split()) for w in want) == 5
    assert rows_of(collocations.collocations(df, 4, 5, 40)) == want
    monkeypatch.setattr(collocations, "small_side", lambda t: t)  # tables too large to broadcast
    assert rows_of(collocations.collocations(df.repartition(7), 4, 5, 40)) == want


def test_collocations_take_odd_rows(spark):
    docs = odd_rows(spark)
    assert rows_of(collocations.collocations(docs, 3)) == brute_collocations([(d.text, d.lang) for d in docs.collect()], 3, 5, 2000)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_word_lists_split_shards_alike():
    words, sizes, positions = collocations.word_lists("a B,b \tÉ. a".encode())
    ends = np.cumsum(sizes)
    lists = {w.decode(): positions[e - n : e].tolist() for w, e, n in zip(words, ends, sizes)}
    assert lists == {"a": [0, 6], "b": [1, 3], "É": [4]}
    sizes = np.array([2, 0, 3, 1])
    gaps = collocations.gaps_of(sizes, np.array([4, 9, 0, 5, 6, 2]))
    assert gaps.tolist() == [4, 5, 0, 5, 1, 2] and collocations.positions_of(sizes, gaps).tolist() == [4, 9, 0, 5, 6, 2]
    assert collocations.positions_of(sizes[:0], collocations.gaps_of(sizes[:0], gaps[:0])).tolist() == []


def test_ids_are_those_of_spark(spark):
    rows = spark.createDataFrame([("en", "a"), ("", "Zürich"), ("und", "x" * 100)], "lang string, word string").selectExpr("lang", "word", "xxhash64(lang, word) as h").collect()
    assert all(collocations.word_ids(r.lang, [r.word.encode()]).tolist() == [r.h] for r in rows)
    pairs = np.array([[1, -5], [2**62, 3], [-(2**63), 0]])
    want = [r.h for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs.tolist())], "i int, a long, b long").selectExpr("i", "xxhash64(a, b) as h").orderBy("i").collect()]
    assert collocations.phrase_ids(pairs[:, 0].copy(), pairs[:, 1].copy()).tolist() == want


@pytest.mark.parametrize("bits", [1 << 16, 1 << 18])
def test_a_full_bitmap_changes_nothing(spark, monkeypatch, bits):
    r = random.Random(8)
    docs = [(i, " ".join(f"w{int(r.paretovariate(0.6)) % 700}" for _ in range(300)), "en") for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    monkeypatch.setattr(collocations, "FILTER", bits)
    monkeypatch.setattr(collocations, "_bitmap", (lambda f: lambda t: b"\xff" * (bits // 8) if bits == 1 << 16 else f(t))(collocations._bitmap))
    assert rows_of(collocations.collocations(df, 3)) == brute_collocations([d[1:] for d in docs], 3, 5, 2000)


def test_a_reader_of_lists_unpacks_a_few_shards_at_once(spark, monkeypatch):
    """A row group is unpacked whole: one of a hundred shards takes more than a gigabyte of the JVM for each core."""
    monkeypatch.setattr(collocations, "SHARD", 1 << 20)
    monkeypatch.setattr(collocations, "forget", lambda *tables: None)
    tables, put = [], collocations.written
    monkeypatch.setattr(collocations, "written", lambda df, name, **options: tables.append((name, put(df, name, **options))) or tables[-1][1])
    words = F.transform(F.sequence(F.lit(1), F.lit(130_000)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64(i, "doc_id"), F.lit(2500))))
    docs = spark.range(0, 36, 1, 1).withColumnRenamed("id", "doc_id").select("doc_id", F.lit("en").alias("lang"), F.array_join(words, " ").alias("text"))
    collocations.phrase_tables(docs, 10_000, 2)
    metas = [pq.ParquetFile(file.removeprefix("file://")).metadata for name, table in tables if name == "shards" for file in table.inputFiles()]
    groups = [meta.row_group(i).total_byte_size for meta in metas for i in range(meta.num_row_groups)]
    assert sum(groups) > 8 << 20 > max(groups)


# source divergence


def brute_divergence(docs, least_docs, most):
    n, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        n[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    kept = {lang: sorted(t for t, c in h.items() if c >= least_docs) for lang, h in held.items()}

    def share(count, total, lang):
        return 1 + int(Fraction(10**9 * (count + 5), total + 5 * len(kept[lang])))

    out, p, q = [], {}, {}
    for lang, source in n:
        total = sum(n[lang, source][t] for t in kept[lang])
        p[lang, source] = {t: share(n[lang, source][t], total, lang) for t in kept[lang]}
    for lang in kept:
        whole = Counter()
        for (other, _), c in n.items():
            if other == lang:
                whole.update(c)
        total = sum(whole[t] for t in kept[lang])
        q[lang] = {t: share(whole[t], total, lang) for t in kept[lang]}
    for lang, source in n:
        far = [(-sum(abs(p[lang, source][t] - p[lang, s][t]) for t in kept[lang]), s) for other, s in n if other == lang and s != source]
        over = [(q[lang][t] - p[lang, source][t], t) for t in kept[lang] if n[lang, source][t] and p[lang, source][t] > q[lang][t]]
        for part, items in (("pair", sorted(far, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(over, key=lambda x: (x[0], x[1].encode()))[:most])):
            out += [(lang, source, part, item, -value, rank) for rank, (value, item) in enumerate(items, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("wide", [False, True])
def test_divergence_against_brute_force(spark, monkeypatch, wide):
    if wide:
        monkeypatch.setattr(divergence, "small_side", lambda t: t)
    r = random.Random(5)
    docs = [(i, " ".join(r.choice(["A", "b", "É", "né", "don't", "x9y", "ß"][: r.randrange(1, 8)]) for _ in range(r.randrange(0, 30))), r.choice(["en", None, "de"]), r.choice(["s1", "s2", "S3", None])) for i in range(80)]
    docs += [(100, None, "fr", "a"), (101, "1 2 3", "fr", "b"), (102, "lonely", "xx", "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    want = brute_divergence([d[1:] for d in docs], 5, 3)
    assert {w[2] for w in want} == {"pair", "term"} and ("fr", "a", "pair", "b", 0, 1) in want
    assert rows_of(divergence.source_divergence(df, 5, 3)) == want


def test_divergence_takes_odd_rows(spark):
    docs = odd_rows(spark)
    assert rows_of(divergence.source_divergence(docs, 2)) == brute_divergence([(d.text, d.lang, d.source) for d in docs.collect()], 2, 50)
    assert divergence.source_divergence(docs.limit(0)).count() == 0


# packing along a curve


@cache
def plain_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def plain_ids(text):
    return plain_tokenizer().encode(text or "", add_special_tokens=False).ids


def check_pieces(docs, pieces, length):
    """Every id of every document once, sequences without gaps, no padding but at the end of whole sequences or powers of two."""
    want = Counter((d, zlib.crc32(np.array([*plain_ids(t), 1], dtype="<u4").tobytes())) for d, t in docs)
    sequences = defaultdict(list)
    for doc_id, start, n, crc, doc_tokens, sequence, offset in pieces:
        assert 0 < n <= length and start + n <= doc_tokens
        sequences[sequence].append((offset, n))
    for parts in sequences.values():
        reached = 0
        for offset, n in sorted(parts):
            assert offset == reached
            reached += n
        assert reached == length or reached & (reached - 1) == 0
    whole = Counter((p[0], p[3]) for p in pieces if p[1] == 0 and p[2] == p[4])
    assert not whole - want
    cut = want - whole
    by_doc = defaultdict(list)
    for p in pieces:
        if p[2] != p[4]:
            by_doc[p[0], p[4]].append(p)
    ids = {d: np.array([*plain_ids(t), 1], dtype="<u4") for d, t in docs}
    for (doc_id, tokens), own in by_doc.items():
        if sum(p[2] for p in own) == tokens:  # else rows share the id: told by their number alone
            reached = 0
            for p in sorted(own, key=lambda p: p[1]):
                assert p[1] == reached and p[3] == zlib.crc32(ids[doc_id][reached : reached + p[2]].tobytes())
                reached += p[2]
            assert reached == tokens == len(ids[doc_id])
            cut -= Counter({(doc_id, zlib.crc32(ids[doc_id].tobytes())): 1})
    return sum(cut.values())


def test_curve_packing_round_trip(spark):
    pieces = [tuple(r) for r in queries.op13_curve_packing(spark, SF).collect()]
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert check_pieces(docs, pieces, 2048) == 0
    assert {p[0] for p in pieces} == {d for d, _ in docs}


def test_curve_packing_takes_odd_rows(spark):
    docs = odd_rows(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = [tuple(r) for r in curve_packing.curve_pack(docs.repartition(3), path, 64).collect()]
    texts = [(d.doc_id, d.text) for d in docs.collect()]
    assert sum(p[2] for p in pieces) == sum(len(plain_ids(t)) + 1 for _, t in texts)
    assert check_pieces(texts, pieces, 64) <= 6  # the repeated and the id-less rows share ids
    assert curve_packing.curve_pack(docs.limit(0), path).count() == 0


def test_runs_encode_as_whole_texts():
    r = random.Random(9)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    pieces = ["It's", "don't", " ", "  ", "\n", "\t", " ", "\x1c", "\x85", "é", "é", "́", "ΟΔΟΣ", "İ", "1234", "!!!", "😀", "<|endoftext|>", "한국", "x" * 300, "'", "s", ".", ",", "a.'s", "B", "<|ENDOFTEXT|>", "ß", "\u0958", "=\u0338", "#", "_", "A\u030a", "e\u0301", "\u1e9e"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(0, 25))) for _ in range(400)] + [t or "" for t in TEXTS]
    ids, ends = curve_packing.encoded(texts, spec)
    for t, a, b in zip(texts, np.concatenate(([0], ends[:-1])), ends):
        assert ids[a:b].tolist() == plain_ids(t)


def test_hilbert_keys_visit_neighbours():
    side = np.arange(8)
    points = np.array([(a, b, c) for a in side for b in side for c in side])
    keys = curve_packing.hilbert_keys(points, 3)
    assert sorted(keys.tolist()) == list(range(512))
    along = points[np.argsort(keys)]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_on_the_curve_are_alike(spark):
    """Sequences hold fewer languages than the same sequences in order of ids would."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {d.doc_id: d.lang for d in docs.select("doc_id", "lang").collect()}
    held, by_id, reached = defaultdict(Counter), defaultdict(Counter), 0
    pieces = queries.op13_curve_packing(spark, "/root/testdata/sf0.01").collect()
    for p in pieces:
        held[p.sequence_id][lang[p.doc_id]] += p.length
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        by_id[reached // 2048][lang[p.doc_id]] += p.length
        reached += p.length
    same = lambda x: sum(max(c.values()) for c in x.values()) / sum(sum(c.values()) for c in x.values())
    assert same(held) > same(by_id) + 0.05, (same(held), same(by_id))
