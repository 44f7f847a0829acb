"""Canonical JSON, dossiers, gold packages, public views, stratified selection."""

import hashlib
import json
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quern.functions.canonical import canonical_value
from quern.operators import dossier, gold, projection, sampling, sourcing

NESTED = "b long, a struct<z:string,y:array<int>,x:map<string,struct<k:boolean>>>, c string, d decimal(20,0), e array<array<string>>"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain(value):
    """A row as dictionaries and lists."""
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    return int(value) if type(value).__name__ == "Decimal" else value


def test_canonical_json_of_nested_values(spark):
    odd = ['"quoted" \\ back', "tab\t line\n \x00\x01\x1f\x7f é 😀 / \\u000B", "", None]
    rows = [(i, (s, [1, None, -3] if i % 2 else None, {"b": (True,), "a": None, "A": (None,)} if i else {}), s, Decimal(10**19), [[s], [], None]) for i, s in enumerate(odd)] + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, NESTED)
    got = df.select(F.struct(*df.columns).alias("row"), canonical_value(F.struct(*[F.col(c) for c in df.columns]), df.schema).alias("text")).collect()
    assert [r.text for r in got] == [json.dumps(plain(r.row), ensure_ascii=False, sort_keys=True, separators=(",", ":")) for r in got]


@pytest.mark.parametrize("kind", ["double", "float", "date", "timestamp", "binary", "decimal(9,2)", "map<int,string>", "array<struct<x:double>>", "struct<`é`:int>"])
def test_unsupported_values_are_refused(spark, kind):
    df = spark.createDataFrame([], f"v {kind}")
    with pytest.raises(TypeError, match=r"at \$"):
        canonical_value(F.col("v"), df.schema["v"].dataType)


def test_map_keys_beyond_ascii_are_refused(spark):
    df = spark.createDataFrame([({"é": "x"},)], "v map<string,string>")
    with pytest.raises(Exception, match="non-ASCII key"):
        df.select(canonical_value(F.col("v"), df.schema["v"].dataType)).collect()


def requests(spark, **change):
    row = {"id": 1, "tenant": "org_" + "0" * 32, "purchase": "P-1", "complete": True, "bad": None, "fresh": "2026-02-01", "at": "2026-01-01", "sha": "a" * 64, "bound": "a" * 64, "word": "fine"} | change
    kinds = "id long, tenant string, purchase string, complete boolean, bad string, fresh string, at string, sha string, bound string, word string"
    return spark.createDataFrame([tuple(row.values())], kinds)


def compose(df):
    day = lambda c: F.to_date(c)
    blocks = dossier.request_blocks(F.col("tenant"), F.col("purchase"), F.col("complete"), day("bad"), day("fresh"), day("at"), {"snapshot": F.col("sha")})
    blocks += dossier.release_blocks({"snapshot": (F.col("bound"), F.col("sha"))}) + dossier.forbidden_words([F.col("word")], ["Approved by us"])
    return dossier.composed(df, "id", F.struct("purchase", F.struct("sha").alias("snapshot")), blocks)


@pytest.mark.parametrize("change, block", [
    ({}, None), ({"tenant": "org_1"}, "tenant"), ({"purchase": "a b"}, "purchase"), ({"purchase": "P-1\n"}, "purchase"), ({"purchase": None}, "purchase"), ({"complete": False}, "package_incomplete"), ({"bad": "2026-01-01"}, "package_invalidated"),
    ({"fresh": "2025-12-31"}, "package_refresh_required"), ({"bound": "b" * 64}, "release_differs_snapshot"), ({"bound": None}, "release_lacks_snapshot"), ({"sha": "short", "bound": "short"}, "digest_snapshot"), ({"word": "was APPROVED by us"}, "phrase_Approved_by_us"),
])
def test_dossier_is_blocked_by_name(spark, change, block):
    got = compose(requests(spark, **change)).first()
    assert got.blocks == ([block] if block else [])
    if block:
        assert got.payload is got.canonical is got.digest is None
    else:
        assert got.canonical == '{"purchase":"P-1","snapshot":{"sha":"' + "a" * 64 + '"}}' and got.digest == hashlib.sha256(got.canonical.encode()).hexdigest()


def test_changed_dossiers_are_told(spark):
    kept = compose(requests(spark).unionByName(requests(spark, id=2, tenant="x")))
    assert dossier.dossier_violations(kept, "id").count() == 0
    leaf = kept.withColumn("payload", F.col("payload").withField("purchase", F.lit("P-2")))
    assert rows_of(dossier.dossier_violations(leaf, "id")) == [(1, "payload"), (2, "payload")] or rows_of(dossier.dossier_violations(leaf, "id")) == [(1, "payload")]
    assert rows_of(dossier.dossier_violations(kept.withColumn("digest", F.when(F.col("digest").isNotNull(), F.lit("0" * 64))), "id")) == [(1, "digest")]
    spaced = kept.withColumn("canonical", F.replace("canonical", F.lit(","), F.lit(", "))).withColumn("digest", F.sha2("canonical", 256))
    assert rows_of(dossier.dossier_violations(spaced, "id")) == [(1, "payload")]


# gold packages


def case(key, **change):
    c = {"component_id": "c1", "start": 1, "end": 3, "text": "é😀", "state": "OPEN", "evidence": [("2026-01-01", True)]} | change.pop("component", {})
    return (key, change.get("cutoff", "2026-06-01"), [tuple(c.values())], change.get("state", "OPEN"))


CASES = "k long, cutoff string, components array<struct<component_id:string,start:bigint,end:bigint,text:string,state:string,evidence:array<struct<published:string,accepted:boolean>>>>, state string"


def gold_cases(spark, *cases):
    df = spark.createDataFrame(list(cases), CASES)
    return df.withColumn("cutoff", F.to_date("cutoff")).withColumn("components", F.col("components").cast(gold.COMPONENT))


@pytest.mark.parametrize("cases, want", [
    ([case(1)], []), ([], [(1, None, "missing")]), ([case(1), case(2)], [(2, None, "unknown")]), ([case(1), case(1)], [(1, None, "repeated")]), ([case(1), case(None)], [(None, None, "unknown")]),
    ([case(1, cutoff="2026-06-02")], [(1, None, "cutoff")]), ([case(1, state="CLOSED")], [(1, None, "state")]), ([case(1, component={"end": 6})], [(1, "c1", "span")]), ([case(1, component={"start": -1})], [(1, "c1", "span")]),
    ([case(1, component={"text": "é"})], [(1, "c1", "verbatim")]), ([case(1, component={"text": None})], [(1, "c1", "verbatim")]), ([case(1, component={"evidence": [("2026-06-02", True)]})], [(1, "c1", "late")]),
    ([case(1, component={"evidence": [("2026-06-02", False), (None, True), ("2026-06-01", True)]})], []), ([case(1, component={"evidence": None})], []),
])
def test_gold_violations_are_told(spark, cases, want):
    manifest = spark.createDataFrame([(1, "aé😀bc")], "k long, scope string")
    found = gold.gold_violations(manifest, gold_cases(spark, *cases), "k", "scope", F.to_date(F.lit("2026-06-01")))
    assert rows_of(found) == sorted(want, key=repr)


def test_repeated_project_is_told(spark):
    manifest = spark.createDataFrame([(1, "aé😀bc"), (1, "aé😀bc")], "k long, scope string")
    assert rows_of(gold.gold_violations(manifest, gold_cases(spark, case(1)), "k", "scope", F.to_date(F.lit("2026-06-01")))) == [(1, None, "repeated")]


def test_one_changed_case_is_found_in_its_bucket(spark, tmp_path):
    a = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("v"))
    b = a.withColumn("v", F.when(F.col("k") == 123, "changed").otherwise(F.col("v")))
    roots = [gold.freeze(df, "k", str(tmp_path / n), 1) for n, df in (("a", a), ("b", b), ("c", a.orderBy(F.desc("k")).repartition(5)))]
    assert roots[0] == roots[2] != roots[1]
    trees = [spark.read.parquet(str(tmp_path / n / "tree")) for n in "abc"]
    assert gold.changed_buckets(trees[0], trees[1], 1).count() == 1 and gold.changed_buckets(trees[0], trees[2], 1).count() == 0
    assert rows_of(gold.changed_cases(spark, *(str(tmp_path / n) for n in "ab"), "k", 1)) == [(123, "changed")]
    gone = a.where("k <> 7").unionByName(spark.createDataFrame([(900, "n")], "k long, v string"))
    gold.freeze(gone, "k", str(tmp_path / "d"), 1)
    assert rows_of(gold.changed_cases(spark, *(str(tmp_path / n) for n in "ad"), "k", 1)) == [(7, "removed"), (900, "added")]
    plan = spark.read.parquet(str(tmp_path / "a" / "cases")).where(F.col("part").isin(["b3"]))._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*part#\d+ = b3", plan)


def test_tree_adds_up(spark):
    leafed = gold.leaves(spark.range(100), "id", 2)
    tree = {r.prefix: r for r in gold.digest_tree(leafed, 2).collect()}
    assert tree[""].n == 100 == sum(r.n for p, r in tree.items() if len(p) == 1) == sum(r.n for p, r in tree.items() if len(p) == 2)
    children = ",".join(f"{p}:{r.digest}" for p, r in sorted(tree.items()) if len(p) == 1)
    assert tree[""].digest == hashlib.sha256(children.encode()).hexdigest()


# public views


def view_of(spark, title="A title", scope="  A title\n", component=(), candidates=(("e1", "HIGH_CONFIDENCE", "Heat pump", None, "TITLE", "pump", 5, 9),)):
    c = dict(state="CLOSED", scope_evidence="A title", spans=[("A title", 2, 9)], evidence_ids=["e1"]) | dict(component)
    projects = spark.createDataFrame([("p", title, scope, "https://x.org")], "key string, title string, scope string, url string")
    components = spark.createDataFrame([("p", "c1", "heat", *c.values())], "key string, component_id string, category string, state string, scope_evidence string, spans array<struct<text:string,start:bigint,end:bigint>>, evidence_ids array<string>")
    found = spark.createDataFrame([("c1", e, d, "n1", None, t, s, f, x, a, b) for e, d, t, s, f, x, a, b in candidates], "component_id string, evidence_id string, disposition string, notice_id string, published date, title string, scope string, field string, text string, start long, end long")
    return projection.public_view(projects, components, found)


def test_public_view_of_a_sound_project(spark):
    row = view_of(spark).first()
    assert row.wording.asDict() == {"type": "Project title", "text": "A title", "start": 2, "end": 9} and row.state == "CLOSED" and row.violations == []
    assert row.components[0].matches[0].evidence.asDict() == {"field": "TITLE", "text": "pump", "start": 5, "end": 9}
    shown = json.dumps(plain(row) | {}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert "violations" in shown and row.digest == view_of(spark).first().digest != view_of(spark, title="B").first().digest
    assert view_of(spark, title="Another").first().wording.type == view_of(spark, title=None).first().wording.type == "Project description"
    assert projection.safe_view(view_of(spark)).columns == ["key", "url", "wording", "state", "components", "digest"]


@pytest.mark.parametrize("change, want", [
    ({"scope": " \n"}, ["no_wording", "span_not_in_wording"]), ({"scope": None}, ["no_wording", "span_not_in_wording"]), ({"component": {"spans": []}}, ["no_span"]), ({"component": {"scope_evidence": "x"}}, ["span_differs"]),
    ({"component": {"spans": [("A title", 1, 8)]}}, ["span_not_in_wording"]), ({"component": {"spans": [("A title", 9, 9)]}}, ["span_differs", "span_not_in_wording"]),
    ({"component": {"evidence_ids": ["e2"]}}, ["closed_ids_differ"]), ({"component": {"evidence_ids": None}}, ["closed_ids_differ"]), ({"candidates": []}, ["closed_ids_differ", "closed_without_evidence"]),
    ({"component": {"state": "OPEN"}}, ["open_with_evidence"]), ({"candidates": [("e1", "HIGH_CONFIDENCE", "Heat pump", None, "TITLE", "pump", 4, 8)]}, ["match_not_verbatim"]),
    ({"candidates": [("e1", "HIGH_CONFIDENCE", "Heat pump", None, "SCOPE_DESCRIPTION", "pump", 5, 9)]}, ["match_not_verbatim"]), ({"candidates": [("e1", "HIGH_CONFIDENCE", "Heat pump", None, None, "pump", 5, 9)]}, ["match_without_evidence"]),
    ({"candidates": [("e1", "HIGH_CONFIDENCE", "Heat pump", None, "TITLE", "pump", 5, 9)] * 2}, ["evidence_repeated"]), ({"candidates": [("e1", "HIGH_CONFIDENCE", "Heat pump", None, "TITLE", "pump", 5, 9), ("e3", "REVIEW", "x", None, None, None, None, None)]}, []),
])
def test_each_violation_fails_closed(spark, change, want):
    view = view_of(spark, **change)
    assert view.first().violations == want and projection.safe_view(view).count() == (not want)


def test_a_project_without_components_is_unresolved(spark):
    view = view_of(spark)
    alone = projection.public_view(spark.createDataFrame([("q", None, "text", None)], "key string, title string, scope string, url string"), spark.createDataFrame([], "key string, component_id string, category string, state string, scope_evidence string, spans array<struct<text:string,start:bigint,end:bigint>>, evidence_ids array<string>"), spark.createDataFrame([], "component_id string, evidence_id string, disposition string, notice_id string, published date, title string, scope string, field string, text string, start long, end long"))
    assert alone.first().state == "UNRESOLVED" and alone.first().violations == [] and alone.columns == view.columns


# stratified selection


def plain_selection(rows, required, spread, total, seed):
    """The rule as a loop over rows in hash order."""
    ranked = sorted((r for r in rows if r["k"] is not None), key=lambda r: (hashlib.sha256(f"{seed}\0{r['k']}".encode()).hexdigest(), r["k"]))
    has = lambda r, c, v: v in r[c] if isinstance(r[c], list) else r[c] == v
    out = []
    for c, v in required:
        if not any(has(p, c, v) for p in out):
            out += [r for r in ranked if has(r, c, v)][:1]
    for c in spread:
        while len({p[c] for p in out} - {None}) < 2:
            more = [r for r in ranked if r[c] is not None and r[c] not in {p[c] for p in out}][:1]
            if not more:
                break
            out += more
    if len(out) > total:
        return None
    taken = {p["k"] for p in out}
    out += [r for r in ranked if r["k"] not in taken][: total - len(out)]
    return [(r["k"], i + 1) for i, r in enumerate(out)]


@pytest.mark.parametrize("seed", range(10))
def test_selection_equals_the_plain_loop(spark, seed):
    r = random.Random(seed)
    for n in range(5):
        rows = [{"k": i, "d": r.sample("xyz", r.randrange(0, 3)) if r.random() < 0.9 else [], "a": r.choice(["p", "q", "q", None]), "g": r.choice(["g1"] * r.randrange(1, 30) + ["g2", None])} for i in range(r.randrange(0, 40))]
        required = r.sample([("d", "x"), ("d", "y"), ("d", "z"), ("a", "p"), ("a", "q"), ("a", "nowhere")], r.randrange(0, 6))
        spread, total = r.sample(["g", "a"], r.randrange(0, 3)), r.choice([3, 6, 50])
        df = spark.createDataFrame([(x["k"], x["d"], x["a"], x["g"]) for x in rows], "k long, d array<string>, a string, g string")
        want = plain_selection(rows, required, spread, total, f"s{n}")
        if want is None:
            with pytest.raises(ValueError, match="cannot cover"):
                sampling.greedy_selection(df, "k", required, spread, total, f"s{n}")
        else:
            assert sorted(map(tuple, sampling.greedy_selection(df, "k", required, spread, total, f"s{n}").select("k", "pick").collect())) == sorted(want)
        lacking = {(c, v) for c, v in required if not any((v in x[c] if c == "d" else x[c] == v) for x in rows)} | {(c, None) for c in spread if len({x[c] for x in rows} - {None}) < 2}
        assert {tuple(m) for m in sampling.missing_requirements(df, required, spread).collect()} == lacking


def test_values_that_no_row_has(spark):
    df = spark.createDataFrame([(i, f"s{i % 5}") for i in range(9)], "k long, y string")
    assert sampling.missing_strata(df, "y", ["s1", "s9"]).first().y == "s9"


# source packages


@pytest.mark.parametrize("doc, requirement, want", [
    ({}, {}, []), ({"sha256": "x"}, {}, [("d", "digest")]), ({"reuse_note": " "}, {}, [("d", "reuse_basis")]), ({"reuse_url": None}, {}, [("d", "reuse_basis")]), ({"reuse_mode": "BLOCKED"}, {}, [("d", "blocked")]),
    ({}, {"document_id": "other"}, [("r", "no_document")]), ({}, {"document_id": None}, [("r", "no_document")]), ({}, {"boundary": None}, [("r", "boundary")]), ({}, {"boundary": -1}, [("r", "boundary")]), ({}, {"kind": "DECLARATION"}, [("r", "boundary"), ("r", "input")]),
    ({}, {"kind": "DECLARATION", "boundary": None, "input": None}, []), ({}, {"input": "proposed_duration_months"}, [("r", "input")]), ({}, {"kind": "MINIMUM_MONTHS"}, [("r", "input")]), ({}, {"kind": "MAXIMUM_MONTHS", "input": "proposed_duration_months"}, []), ({}, {"input": None}, [("r", "input")]),
    ({"reuse_mode": "FACT_EXTRACTION_ONLY"}, {}, [("r", "text_not_reusable")]), ({"reuse_mode": "FACT_EXTRACTION_ONLY"}, {"source_text": " "}, []), ({"reuse_mode": None}, {}, []),
])
def test_source_package_violations(spark, doc, requirement, want):
    d = {"package_id": 1, "document_id": "d", "reuse_mode": "FULL", "reuse_url": "https://x", "reuse_note": "law", "sha256": "a" * 64} | doc
    r = {"package_id": 1, "requirement_id": "r", "document_id": "d", "kind": "MINIMUM_EUR", "boundary": 5, "input": "proposed_funding_eur", "source_text": "text"} | requirement
    docs = spark.createDataFrame([tuple(d.values())], "package_id long, document_id string, reuse_mode string, reuse_url string, reuse_note string, sha256 string")
    reqs = spark.createDataFrame([tuple(r.values())], "package_id long, requirement_id string, document_id string, kind string, boundary long, input string, source_text string")
    assert rows_of(sourcing.package_violations(docs, reqs)) == [(1, *w) for w in want]
    twice = rows_of(sourcing.package_violations(docs.unionByName(docs), reqs.unionByName(reqs)))
    assert (1, "d", "repeated") in twice and (1, "r", "repeated") in twice
