"""Operators on pairs of texts, components, and the pipeline."""

import random
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import common, components, queries, simhash_dedup, substring_dedup
from quern.llm.common import windows

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, cell long, component long, digest string, fp long, kept boolean"


def find(parent, i):
    while parent.setdefault(i, i) != i:
        i = parent[i]
    return i


def classes(pairs, ids):
    """Smallest id of each id's component."""
    parent = {i: i for i in ids}
    for a, b in pairs:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {i: find(parent, i) for i in ids}


def odd_rows(spark, copies=40):
    texts = [None, "", " \t", "one", "One", "a b c d", "w " * 20_000, "Zürich 😀 " * 40]
    rows = [(i, t, "en", "s", len(t or ""), 1, 2, 3, "d", 4, True) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id", *[None] * 9), (None, None, *[None] * 9)]
    rows += [(1000 + i, "same text for all of these rows " * 8, None, None, None, *[None] * 6) for i in range(copies)]
    return spark.createDataFrame(rows, SCHEMA)


def near_copies(n, words, edits, seed):
    """A family of texts that differ from one original in a few words."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n - 1):
        own = list(base)
        for _ in range(edits):
            own[r.randrange(words)] = f"e{r.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (5, 6), (6, 5)]
    got = {x.id: x.component for x in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    ids = {i for p in pairs for i in p if p[0] != p[1]}
    want = classes([p for p in pairs if p[0] != p[1]], ids)
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("room", [2, 5, 64])
def test_crowded_cells_lose_no_component(spark, room):
    r = random.Random(room)
    values = [(i, r.randrange(2000), r.randrange(3)) for i in range(250)]
    df = spark.createDataFrame(values, "id long, v long, c long")
    close = lambda a, b: F.abs(a["v"] - b["v"]) <= 6
    got = {x.id: x.component for x in components.link_cells(df, F.array("c"), close, carry=["v"], room=room).collect()}
    want = classes([(a, b) for a, v, c in values for b, w, d in values if a < b and c == d and abs(v - w) <= 6], [i for i, _, _ in values])
    assert {i: got.get(i, i) for i in want} == want


def test_hot_keys_are_joined_like_the_others(spark, monkeypatch):
    monkeypatch.setattr(common, "small_side", lambda df, rows=0: df)
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 3), (3, 1)) for i in range(n)], "k long, i long")
    table = spark.createDataFrame([(1, "a", 50), (2, "b", 3)], "k long, v string, n long")
    for how in ("inner", "left"):
        got = sorted(((r.k, r.i, r.v) for r in common.join_spread(rows, table, "k", "n", how, 10).collect()), key=repr)
        assert got == sorted(((r.k, r.i, r.v) for r in rows.join(table, "k", how).collect()), key=repr)


def jobs_of(spark, work):
    """Number of Spark's jobs in work(), and what it returns."""
    group = f"counted-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    got = work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), got


@pytest.mark.parametrize("rows", [0, 7])
def test_rows_of_a_counted_table_are_known_without_a_job(spark, rows):
    table = common.counted(spark.range(100).where(F.col("id") < rows), "counted")
    jobs, near = jobs_of(spark, lambda: (common.small_side(table, 7), common.small_side(table, 6)))
    assert jobs == 0
    assert (near[0] is not table, near[1] is not table) == (True, rows <= 6)
    assert near[0].count() == rows


def test_stars_are_told_from_one_round(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(components, "counted", lambda df, name, *more, f=common.counted: tables.append(name) or f(df, name, *more))
    found = components.connected_components(spark.createDataFrame([(1, 2), (3, 1), (9, 8)], "a long, b long"))
    assert {(r.id, r.component) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}
    assert tables.count("edges") == 2  # the first and what one round makes of it


def test_tables_of_cells_do_not_pass_whole_through_the_driver(spark, monkeypatch):
    limits = []
    monkeypatch.setattr(components, "small_side", lambda df, rows=300_000, f=common.small_side: limits.append(rows) or f(df, rows))
    texts = block_copies(20, 16)
    assert kept_of(spark, texts) == set(classes(jaccard_links(texts), texts).values())
    assert limits and max(limits) <= 300_000


# SimHash


def plain_fingerprint(text, k=4):
    words = WORD.findall(re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_classes_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(near_copies(150, 60, 1, 3) + near_copies(60, 30, 2, 4) + [None, "", "a", "A", "b c", "Ä É", "x y z w v"])]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    spark.createDataFrame(rows, "doc_id long, text string").createOrReplaceTempView("simhash_rows")
    got = {r.doc_id: r for r in simhash_dedup.fingerprint_classes(spark.table("simhash_rows")).collect()}
    fps = {d: plain_fingerprint(t) for d, t in rows}
    want = classes([(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4], fps)
    assert {d: got[d].fp % 2**64 for d in fps} == fps
    assert {d: got[d].component_id for d in fps} == want
    assert len(set(want.values())) < len(fps) - 50


def test_block_masks_cover_every_pair_in_reach():
    r = random.Random(8)
    for nodes in (10, 10**6, 10**9, 10**12):
        blocks = simhash_dedup.blocks_for(nodes, 4)
        masks = simhash_dedup.block_masks(blocks, blocks - 4)
        assert nodes <= 2 ** min(m.bit_count() for m in masks)
        for _ in range(50):
            x = sum({1 << r.randrange(64) for _ in range(4)})
            assert any(not x & m for m in masks)


def test_manhattan_distance_is_a_lower_bound(spark):
    r = random.Random(5)
    pairs = [(r.getrandbits(64), r.getrandbits(64)) for _ in range(200)]
    pairs = [(a - (1 << 63), (a ^ (b & b >> 1 & a)) - (1 << 63)) for a, b in pairs]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", simhash_dedup.segment_counts(F.col("a")).alias("x"), simhash_dedup.segment_counts(F.col("b")).alias("y"))
    for row in df.collect():
        counts = [[(v >> s & 1) + (v >> s + 1 & 1) for s in range(0, 64, 2)] for v in (row.a % 2**64, row.b % 2**64)]
        manhattan = sum(abs(p - q) for p, q in zip(*counts))
        assert (row.x ^ row.y).bit_count() % 65 == manhattan or bin((row.x ^ row.y) % 2**64).count("1") == manhattan
        assert manhattan <= bin((row.a ^ row.b) % 2**64).count("1")


def test_simhash_of_odd_rows(spark):
    odd = odd_rows(spark)
    got = simhash_dedup.fingerprint_classes(odd).collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.doc_id in (0, 1, 2)} == {0} and {r.component_id for r in got if (r.doc_id or 0) >= 1000} == {1000}
    assert simhash_dedup.fingerprint_classes(odd.limit(0)).count() == 0


def jaccard_links(texts, k=5):
    sets = {}
    for d, t in texts.items():
        w = WORD.findall((t or "").lower())
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    return [(a, b) for a in sets for b in sets if a < b and (sets[a] or not sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]


def test_near_duplicates_against_brute_force(spark):
    texts = dict(enumerate(near_copies(40, 200, 1, 6) + near_copies(20, 300, 3, 7) + near_copies(3, 100, 40, 8)))
    texts |= {500 + r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id for r in simhash_dedup.near_duplicates(df).where("kept").collect()}
    want = set(classes(jaccard_links(texts), texts).values())
    assert want <= kept  # nothing that stands alone goes
    assert len(kept - want) <= 0.03 * (len(texts) - len(want))


def block_copies(n, seed):
    """Pairs of texts of which the second has a replaced tail or an appended passage; similarity 0.8 or a little more."""
    r = random.Random(seed)
    fresh = lambda k: [f"w{r.randrange(10**6)}" for _ in range(k)]
    texts = {}
    for i in range(n):
        words = r.randrange(60, 400)
        base = fresh(words)
        other = base[: -(words // 12)] + fresh(words // 12) if i % 2 else base + fresh(words // 5)
        texts |= {2 * i: " ".join(base), 2 * i + 1: " ".join(other)}
    return texts


def kept_of(spark, texts):
    return {r.doc_id for r in simhash_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).where("kept").collect()}


def test_near_duplicates_with_edits_in_one_block(spark):
    texts = block_copies(60, 12)
    links = jaccard_links(texts)
    assert len(links) >= 50
    assert kept_of(spark, texts) == set(classes(links, texts).values())


def test_near_duplicates_are_alike_at_every_size(spark):
    texts = block_copies(40, 13)
    r = random.Random(14)
    others = {10_000 + i: " ".join(f"z{r.randrange(10**7)}" for _ in range(30)) for i in range(4000)}
    want = set(classes(jaccard_links(texts), texts).values())
    assert kept_of(spark, texts) == want
    assert kept_of(spark, texts | others) == want | set(others)


@pytest.mark.parametrize("rounds", [0, 1])
def test_crowded_cells_get_new_prefixes_not_whole_sets(spark, monkeypatch, rounds):
    monkeypatch.setattr(simhash_dedup, "COMMON", 10**6)  # the sample tells nothing
    monkeypatch.setattr(simhash_dedup, "ROUNDS", rounds)
    whole = []
    monkeypatch.setattr(components, "rare_pairs", lambda nodes, *more, f=components.rare_pairs: whole.append(nodes.count()) or f(nodes, *more))
    passage = " ".join(f"p{i}" for i in range(40))
    texts = {d: f"{passage} {t}" for d, t in block_copies(30, 15).items()}
    links = jaccard_links(texts)
    assert len(links) >= 25
    assert kept_of(spark, texts) == set(classes(links, texts).values())
    assert sum(whole) <= 0.6 * len(texts) if rounds else sum(whole) >= 0.9 * len(texts)  # the first is how it was


def test_near_duplicates_of_odd_rows(spark):
    odd = odd_rows(spark)
    judged = simhash_dedup.near_duplicates(odd)
    left = simhash_dedup.without_near_duplicates(odd, judged)
    assert left.columns == odd.columns
    ids = sorted((r.doc_id for r in left.collect()), key=lambda d: (d is None, d))
    assert ids == [0, 3, 5, 6, 7, 1000, None]
    assert simhash_dedup.without_near_duplicates(odd.limit(0), simhash_dedup.near_duplicates(odd.limit(0))).count() == 0


def test_workers_hand_out_small_frames():
    batch = pd.DataFrame({"id": range(1000), "doc_id": range(1000), "text": [f"a b c d e {i}" for i in range(1000)]})
    for worker in (simhash_dedup._shingle_sets(5), simhash_dedup._sketch(5, 0.8, np.zeros(0, dtype=np.int64))):
        frames = list(worker(iter([batch, batch[:0]])))
        assert max(map(len, frames)) <= 256
        assert pd.concat(frames)["doc_id" if "doc_id" in frames[0] else "id"].tolist() == list(range(1000))
    assert [len(s) for s in pd.concat(simhash_dedup._shingle_sets(5)(iter([batch])))["members"]] == [2] * 1000


# substring dedup


def test_bands_reach_the_recall():
    bands, rows = substring_dedup.tune_bands(0.8, 0.997)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.997 and 1 - (1 - 0.4**rows) ** bands <= 0.5


def test_twenty_shared_words_always_share_a_window():
    r = np.random.default_rng(9)
    for _ in range(50):
        shared = r.integers(0, 1 << 63, 20, dtype=np.uint64)
        texts = [np.concatenate([r.integers(0, 1 << 63, r.integers(0, 90), dtype=np.uint64), shared, r.integers(0, 1 << 63, r.integers(0, 90), dtype=np.uint64)]) for _ in range(2)]
        a, b = (set(substring_dedup.window_starts(t)[1].tolist()) for t in texts)
        assert a & b


def test_windows_do_not_depend_on_place():
    h = np.arange(100, dtype=np.uint64) * np.uint64(977)
    assert (windows(h, 5)[10:20] == windows(h[10:24], 5)).all() and len(windows(h[:3], 5)) == 1 and len(windows(h[:0], 5)) == 0


def test_repeated_passages_are_found_and_clean_texts_left(spark):
    r = random.Random(10)
    fresh = lambda n: " ".join(f"v{r.randrange(10**7)}" for _ in range(n))
    passage, line = fresh(55), fresh(60)
    edited = line.split()
    edited[30] = "changed"
    rows = [(1, f"{fresh(40)} {passage} {fresh(30)}"), (2, f"{fresh(7)}\n{fresh(90)} {passage}"), (3, f"{fresh(50)}\n{line}\n{fresh(20)}"), (4, f"{' '.join(edited)}\n{fresh(45)}"), (5, fresh(400)), (6, fresh(10)), (7, f"é {line}")]
    rows += [(100 + i, f"{fresh(200)}\n{fresh(35)}") for i in range(20)]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    assert {x.doc_id for x in found} == {1, 2, 3, 4, 7}
    clusters = defaultdict(list)
    for x in found:
        clusters[(x.level, x.cluster)].append(x)
        assert len(WORD.findall(texts[x.doc_id][x.start : x.end])) == x.n_words
    for members in clusters.values():
        assert len(members) == members[0].cluster_size and sum(not x.removed for x in members) == 1
    near = next(m for m in clusters.values() if {x.doc_id for x in m} >= {3, 4})
    assert next(x for x in near if not x.removed).doc_id == 3
    shared = [x for x in found if x.doc_id in (1, 2)]
    assert len(shared) == 2 and all(texts[x.doc_id][x.start : x.end] in passage and x.n_words >= 55 - 2 * 8 and x.kept_doc_id == 1 for x in shared)


def test_passages_equal_brute_force_on_documents(spark):
    """Every window that two texts of `documents` share, and that lies in no removed line, lies in a told passage."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = substring_dedup.repeated_passages(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    spans = defaultdict(list)
    for x in found:
        spans[x.doc_id].append((x.start, x.end))
    runs, size = defaultdict(list), substring_dedup.WINDOW + substring_dedup.REACH - 1
    for d, t in docs.items():
        words = [m.span() for m in WORD.finditer(t)]
        for i in range(len(words) - size + 1):
            runs[tuple(t[a:b] for a, b in words[i : i + size])].append((d, words[i][0], words[i + size - 1][1]))
    gone = {x.doc_id for x in found if x.level == "text" and x.removed}
    assert gone == {d for d, t in docs.items() if len(t.split()) >= substring_dedup.MIN_WORDS and any(e < d and u == t for e, u in docs.items())}
    shared = [r for rs in runs.values() if len({d for d, _, _ in rs}) > 1 for r in rs]
    assert len(shared) > 500
    assert all(any(a < end and start < b for a, b in spans[d]) for d, start, end in shared)
    copied = {d for d, _, _ in shared}
    assert {x.doc_id for x in found if x.level == "passage"} <= copied | {d for d, t in docs.items() if len(set(t.split())) < len(t.split())}


def test_paragraph_recall_against_brute_force(spark):
    lines = [t for s in range(6) for t in near_copies(8, 60, 1, 20 + s)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = [x for x in substring_dedup.repeated_passages(df).collect() if x.level == "line"]
    want = classes(jaccard_links(dict(enumerate(lines))), range(len(lines)))
    groups = defaultdict(set)
    for x in got:
        groups[x.cluster].add(x.doc_id)
    expected = defaultdict(set)
    for d, c in want.items():
        expected[c].add(d)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in expected.values() if len(g) > 1)


def test_a_passage_in_the_first_of_several_copies_is_still_linked(spark):
    r = random.Random(15)
    fresh = lambda n: " ".join(f"v{r.randrange(10**7)}" for _ in range(n))
    passage = fresh(60)
    copied = f"{fresh(50)} {passage} {fresh(40)}"
    rows = [(1, f"{fresh(70)} {passage} {fresh(80)}"), (2, f"{fresh(30)}\n{copied}"), (3, f"{copied}\n{fresh(30)}")]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x.doc_id, x.removed) for x in found if x.level == "line"} == {(2, False), (3, True)}
    assert {(x.doc_id, x.removed) for x in found if x.level == "passage"} == {(1, False), (2, True)}
    assert all(x.cluster_size == 2 for x in found)


def test_passages_of_twenty_words_are_found(spark):
    r = random.Random(16)
    fresh = lambda n: " ".join(f"v{r.randrange(10**7)}" for _ in range(n))
    line, run, short, end = fresh(24), fresh(20), fresh(12), fresh(11)
    rows = [(1, f"{fresh(40)}\n{line} a"), (2, f"{line} b\n{fresh(50)}"), (3, f"{fresh(60)} {run} {fresh(30)}"), (4, f"{fresh(33)} {run}\n{fresh(70)}")]
    rows += [(5, f"{fresh(60)}\n{short}\n{end} a\n{fresh(40)}"), (6, f"{short}\n\n{end} b\n{fresh(30)}"), (7, fresh(300))]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id for x in found if x.level == "line"} == {1, 2, 5, 6}
    assert {x.doc_id for x in found if x.level == "passage"} == {3, 4}


def test_equal_short_texts_are_told(spark):
    """Equal whole texts of 12 to 19 words are told as copies, also where another text holds one of them."""
    words = [f"w{i}" for i in range(40)]
    for n in (12, 15, 19):
        rows = [(i, " ".join(words[:n])) for i in range(1, 6)] + [(9, "before " + " ".join(words[:n]) + " after " + " ".join(words[20:39])), (10, " ".join(words[: n - 1] + ["else"])), (11, " ".join(words[:11])), (12, " ".join(words[:11]))]
        got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).where("level = 'text'").collect()
        assert sorted((r.doc_id, r.removed, r.kept_doc_id, r.cluster_size, r.n_words) for r in got) == [(i, i > 1, 1, 5, n) for i in range(1, 6)]


def test_passages_of_odd_rows(spark):
    odd = odd_rows(spark)
    found = substring_dedup.repeated_passages(odd).collect()
    copies = [x for x in found if (x.doc_id or 0) >= 1000]
    assert len([x for x in copies if x.level == "text"]) == 40 and [x.doc_id for x in copies if x.level == "text" and not x.removed] == [1000]
    assert {x.doc_id for x in found if x.level != "text"} <= {6, 7, 1000}
    twice = substring_dedup.repeated_passages(spark.createDataFrame([(1, "v " * 30 + "x")] * 2 + [(None, "v " * 30 + "x")], "doc_id long, text string")).where("level = 'text'").collect()
    assert sorted(((x.doc_id, x.removed, x.cluster_size, x.kept_doc_id) for x in twice), key=str) == [(1, False, 3, 1), (1, True, 3, 1), (None, True, 3, 1)]
    assert substring_dedup.repeated_passages(odd.limit(0)).count() == 0


# the pipeline


def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    insults = re.compile(r"\b(?:idiot|moron|loser|scum|worthless)\b")
    out = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id for r in out.select("doc_id").distinct().collect()}
        out = stage(spark, out, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            rows = out.collect()
            left = {r.doc_id for r in rows}
            if name == "near_duplicates":
                gone = before - left
                links = classes(jaccard_links({d: texts[d] for d in before}), before)
                assert all(links[d] != d for d in gone)
            if name == "secrets":
                assert left == before and not any(re.search(r'token = "[0-9a-f]{40}"', r.text) for r in rows)
            if name == "toxicity":
                assert len([d for d in before - left if not insults.search(texts[d])]) <= 0.05 * len(before)
            out = spark.createDataFrame(rows, docs.schema)
    assert out.count() > 0 and {"doc_id", "bin", "bin_length"} <= set(out.columns)


def test_pipeline_takes_odd_rows(spark):
    out = odd_rows(spark).select("doc_id", "text", "lang", "source", "n_chars", F.lit(1).alias("score"), F.lit("x").alias("size"))
    for empty in (False, True):
        docs = out.limit(0) if empty else out
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert (docs.count() == 0) == empty


def test_queries_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES if q != "pipeline"} and "pipeline" in queries.QUERIES


def test_repeated_cells_are_shuffled_above_300_000(spark, monkeypatch):
    limits = []
    monkeypatch.setattr(substring_dedup, "small_side", lambda df, rows=300_000, f=common.small_side: limits.append((tuple(df.columns), rows)) or f(df, rows))
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"{text} a"), (2, f"b {text}")], "doc_id long, text string")
    assert substring_dedup.repeated_passages(docs).where("removed").count() >= 1
    assert dict(limits)[("cell",)] <= 300_000
