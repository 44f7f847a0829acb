import io
import json
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from quern import checks
from quern.operators import cohort, ledger, matching, relevance, rules, sampling, scoring
from quern.sources import notices, operations, sinks
from quern.streaming import ingest


FACTS = ("reference", "authority", "geography", "title", "code", "overlap", "window", "corroborating", "semantic")


def test_tiers_in_order(spark):
    f = lambda on: [F.lit(n in on.split()) for n in FACTS]
    cases = [
        ("reference overlap window", "A"), ("reference overlap", "NONE"), ("reference window code", "NONE"), ("authority geography overlap code window", "B"), ("authority geography overlap window", "NONE"),
        ("authority geography code window corroborating", "NONE"), ("title overlap code window corroborating", "C"), ("title overlap code window semantic", "D"), ("geography overlap code window corroborating", "NONE"), ("semantic", "D"), ("", "NONE"),
    ]
    row = spark.range(1).select(*[matching.tier(*f(on)).alias(str(i)) for i, (on, _) in enumerate(cases)]).first()
    assert [row[str(i)] for i in range(len(cases))] == [t for _, t in cases]


def test_dispositions_guard_against_false_open(spark):
    rows = [
        ("A", True, True, "ACCEPT"), ("A", True, False, "REVIEW"), ("B", False, True, "ACCEPT"), ("B", False, None, "REVIEW"), ("C", False, True, "REVIEW"),
        ("NONE", True, True, "REVIEW"), ("D", True, True, "REVIEW"), ("D", False, True, "REJECT"), ("NONE", False, True, "REJECT"), ("NONE", None, True, "REJECT"),
    ]
    df = spark.createDataFrame(rows, "t string, p boolean, e boolean, want string")
    day = F.to_date(F.lit("2026-01-01"))
    got = df.select("want", matching.disposition(F.col("t"), F.col("p"), F.col("e"), day, day).alias("x"), matching.disposition(F.col("t"), F.col("p"), F.col("e"), F.date_add(day, 1), day).alias("late")).collect()
    assert all(r.x == r.want and r.late == "REJECT" for r in got)
    facts = spark.createDataFrame([(True, False, False, False, True), (False, True, True, False, True), (False, True, False, True, True), (False, True, False, None, False), (False, False, True, True, False)], "r boolean, c boolean, g boolean, t boolean, want boolean")
    assert all(r.x == r.want for r in facts.select("want", matching.plausible(F.col("r"), F.col("c"), F.col("g"), F.col("t")).alias("x")).collect())


def test_component_state_order(spark):
    components = spark.createDataFrame([("b", True, True), ("a", False, False), ("r", False, True), ("c", False, False), ("o", False, True)], "k string, boundary_unclear boolean, coverage_complete boolean")
    evidence = spark.createDataFrame([("b", "e1", "REVIEW"), ("b", "e7", "ACCEPT"), ("b", "e6", "REJECT"), ("a", "e3", "ACCEPT"), ("a", "e2", "ACCEPT"), ("a", "e9", "REVIEW"), ("r", "e4", "REVIEW"), ("o", "e5", "REJECT")], "k string, evidence_id string, disposition string")
    got = {r.k: (r.state, r.evidence_ids) for r in matching.component_states(components, evidence, "k").collect()}
    assert got == {"b": ("UNRESOLVED", ["e7", "e1"]), "a": ("CLOSED", ["e2", "e3"]), "r": ("UNRESOLVED", ["e4"]), "c": ("UNRESOLVED", []), "o": ("OPEN", [])}


def test_few_ids_are_counted_as_lists_would_gather_them(spark):
    components = spark.createDataFrame([(k, k == 3, k != 4) for k in (1, 2, 3, 4, 5, 5)], "k long, boundary_unclear boolean, coverage_complete boolean")
    rows = [(1, 2, "ACCEPT"), (1, 1, "ACCEPT"), (1, 2, "ACCEPT"), (1, 3, "REVIEW"), (2, 3, "REVIEW"), (2, 1, "REJECT"), (3, 3, "ACCEPT"), (3, 1, "REVIEW"), (4, 1, "REJECT"), (5, 2, "REVIEW"), (9, 1, "ACCEPT"), (None, 1, "ACCEPT")]
    evidence = spark.createDataFrame(rows, "k long, evidence_id int, disposition string")
    told = lambda df, name: sorted((r.k, r.state, r.reason, [name(i) for i in r.evidence_ids]) for r in df.collect())
    gathered = told(matching.component_states(components, evidence, "k"), "E{}".format)
    assert told(matching.component_states(components, evidence, "k", {1: "E1", 2: "E2", 3: "E3"}), str) == gathered
    assert gathered[0] == (1, "CLOSED", "accepted", ["E1", "E2", "E2"]) and gathered[2] == (3, "UNRESOLVED", "boundary", ["E3", "E1"])


def test_roll_up_is_fail_closed(spark):
    cases = {"none": [None], "u": ["OPEN", "UNRESOLVED"], "c": ["CLOSED", "CLOSED"], "o": ["OPEN"], "p": ["OPEN", "CLOSED"]}
    df = spark.createDataFrame([(k, s) for k, ss in cases.items() for s in ss], "k string, state string")
    assert {r.k: r.state for r in matching.rolled_up(df, "k").collect()} == {"none": "UNRESOLVED", "u": "UNRESOLVED", "c": "CLOSED", "o": "OPEN", "p": "PARTIAL"}


def test_late_evidence_is_rejected(spark):
    days = [date(2026, 1, 1), date(2026, 1, 2), None]
    df = spark.createDataFrame([(d,) for d in days], "d date").select(matching.disposition(F.lit("A"), F.lit(True), F.lit(True), F.col("d"), F.to_date(F.lit("2026-01-01"))).alias("x"))
    assert [r.x for r in df.collect()] == ["ACCEPT", "REJECT", "REJECT"]


@pytest.mark.parametrize(("n", "tier"), [(14, "REFERENCE"), (15, "DESCRIPTIVE"), (29, "DESCRIPTIVE"), (30, "FULL")])
def test_disclosure_tiers(spark, n, tier):
    df = spark.createDataFrame([("c", i) for i in range(1, n + 1)], "cohort string, v long")
    row = cohort.tiered_quantiles(df, "v", "cohort", spark.createDataFrame([("c", 3)], "cohort string, proposed long")).first()
    assert (row.tier, row.n) == (tier, n)
    assert [row[c] is None for c in ("median", "least", "most")] == [n < 15] * 3 and [row[c] is None for c in ("q1", "q3", "p90", "count_at_most", "position_bps")] == [n < 30] * 5
    if n >= 15:
        assert row.median == (str((n + 1) // 2) if n % 2 else f"{n // 2}.5")
    if n >= 30:
        assert (row.q1, row.count_at_most, row.position_bps) == (-(-n // 4), 3, 30_000 // n)


def test_ecdf_by_ranges_equals_plain_counts(spark):
    values = [(i % 3, (i * i) % 400) for i in range(900)] + [(0, 7)] * 500
    rows = cohort.ecdf(spark.createDataFrame(values, "c int, v int"), "v", "c").collect()
    assert {(r.c, r.v): (r.at_most, r.n) for r in rows} == {(c, v): (sum(a == c and b <= v for a, b in values), sum(a == c for a, _ in values)) for c, v in set(values)}


def test_ecdf_is_right_continuous_with_ties(spark):
    rows = cohort.ecdf(spark.createDataFrame([("c", v) for v in (5, 5, 5, 9, None)], "c string, v long"), "v", "c").collect()
    assert {r.v: r.bps for r in rows} == {5: 7500, 9: 10000}


def test_comparables_break_ties_by_key(spark):
    df = spark.createDataFrame([(i, "c", v) for i, v in enumerate((10, 20, 20, 30, 40))], "k long, c string, v long")
    rows = cohort.comparables(df, "k", "v", "c", spark.createDataFrame([("c", 20)], "c string, target long"), 3).orderBy("position").collect()
    assert [r.k for r in rows] == [1, 2, 3]


def test_versions_return_to_an_earlier_digest(spark):
    none = spark.createDataFrame([], "version_id string, logical_id string, digest string, supersedes string")
    versions, seen = none, []
    for state in ("A", "A", "B", "A"):
        plan = ledger.append_plan(versions, spark.createDataFrame([("x", state)], "logical_id string, digest string"), "project").select(*none.columns).collect()
        seen += plan
        versions = spark.createDataFrame([tuple(r) for r in seen], none.schema)
    assert [r.digest for r in seen] == ["A", "B", "A"] and len({r.version_id for r in seen}) == 3
    assert [r.version_id for r in ledger.current_versions(versions).collect()] == [seen[-1].version_id]


def test_append_rejects_known_versions(spark, tmp_path):
    one = spark.createDataFrame([("v1", 1)], "version_id string, x int")
    ledger.append(one, f"{tmp_path}/t")
    with pytest.raises(checks.CheckFailed):
        ledger.append(one, f"{tmp_path}/t")
    ledger.append(one.withColumn("version_id", F.lit("v2")), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2


def test_lead_days(spark):
    df = spark.createDataFrame([(date(2026, 1, 1), date(2026, 6, 16), 166), (date(2026, 1, 2), None, None)], "s date, o date, n long")
    assert all(r.x == r.n for r in df.select("n", ledger.lead_days(F.col("s"), F.col("o")).alias("x")).collect())
    backwards = spark.createDataFrame([(date(2026, 1, 2), date(2026, 1, 1))], "s date, o date")
    assert backwards.where(ledger.leads_backwards(F.col("s"), F.col("o"))).count() == 1
    with pytest.raises(Exception, match="before its signal"):
        backwards.select(ledger.lead_days(F.col("s"), F.col("o"))).collect()


def test_scores_without_denominator_are_null(spark):
    none = spark.createDataFrame([], "k int")
    row = scoring.confusion(none, none, ["k"]).first()
    assert (row.tp, row.precision_bps, row.recall_bps) == (0, None, None)
    row = scoring.confusion(spark.createDataFrame([(1,), (2,), (3,)], "k int"), spark.createDataFrame([(2,), (3,), (4,)], "k int"), ["k"]).first()
    assert (row.tp, row.fp, row.fn, row.f1_bps) == (2, 1, 1, 6666)


def test_gate_decisions(spark):
    m = spark.createDataFrame([(1, 1), (1, 0), (0, 1)], "a int, b int")
    got = {(r.a, r.b): r.decision for r in scoring.gate(m, {"a": F.col("a") == 1, "b": F.col("b") == 1}, soft=["b"]).collect()}
    assert got == {(1, 1): "GO", (1, 0): "CONDITIONAL", (0, 1): "NO-GO"}


def test_top_of_each_matches_plain_ranking(spark):
    df = spark.createDataFrame([(i % 3, i, (i * 7) % 11) for i in range(100)], "g int, i int, v int")
    got = {(r.g, r.position): r.i for r in sampling.top_of_each(df, "g", [F.desc("v"), F.asc("i")], 4).collect()}
    want = {(g, k + 1): r[1] for g in range(3) for k, r in enumerate(sorted(((-((i * 7) % 11), i) for i in range(100) if i % 3 == g))[:4])}
    assert got == want


def test_case_scores_tell_abstention_and_failure(spark):
    cases = spark.createDataFrame([(1, False), (2, False), (3, True), (4, False), (5, True)], "k int, failed boolean")
    gold = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "a", "x"), (5, "b", "z")], "k int, s string, e string")
    told = spark.createDataFrame([(1, "a", "y"), (2, "a", "x"), (4, "c", "q"), (5, "b", "z")], "k int, s string, e string")
    got = scoring.case_scores(cases, gold, told, "k", ["s", "e"], ["s"]).first().asDict()
    assert (got["exact_tp"], got["exact_fp"], got["exact_fn"], got["exact_matched"]) == (2, 2, 1, 1) and (got["semantic_tp"], got["semantic_fp"], got["semantic_fn"], got["semantic_matched"]) == (3, 1, 0, 2)
    assert (got["cases"], got["failed_cases"], got["abstentions"], got["abstained"], got["false_alarms"], got["failed_abstentions"]) == (5, 2, 2, 0, 1, 1) and got["semantic_recall_bps"] == 10000
    assert scoring.stray_cases(cases, spark.createDataFrame([(1,), (9,)], "k int"), "k").first().k == 9
    empty = scoring.case_scores(cases.limit(0), gold.limit(0), told.limit(0), "k", ["s", "e"], ["s"]).first()
    assert empty.cases == empty.exact_tp == 0 and empty.exact_f1_bps is None


def test_extraction_summary_and_grouped_segments(spark):
    rs = (rules.Rule("water", "pump", ("pump", "pumps")), rules.Rule("road", "bridge", ("bridge",)))
    df = spark.createDataFrame([(1, "New pumps. A bridge!"), (2, "pumps..."), (3, "nothing here")], "k int, t string")
    got = {r.k: (r.components, r.needs_model) for r in rules.extraction_summary(rules.rule_segments(df, "k", "t", rs), "k").collect()}
    assert got == {1: (2, False), 2: (1, True), 3: (0, True)}


def test_empty_criteria_differ(spark):
    row = spark.range(1).select(
        relevance.prefix_criterion(F.array(F.lit("45")), F.array().cast("array<string>")).alias("any"), relevance.prefix_criterion(F.lit(None).cast("array<string>"), F.array(F.lit("4"))).alias("none"),
        relevance.relevance_label(relevance.relevance_score(F.lit(None).cast("boolean"), F.lit(True), F.lit(False), F.lit(False))).alias("label"),
    ).first()
    assert tuple(row) == (True, False, "NOT_RELEVANT")
    labels = spark.range(5).select(relevance.relevance_label(F.col("id")).alias("x"), relevance.relevance_label(F.col("id"), F.lit(False)).alias("none")).collect()
    assert [r.x for r in labels] == ["NOT_RELEVANT", "NOT_RELEVANT", "LOW", "MEDIUM", "HIGH"] and {r.none for r in labels} == {"LOW"}


def _zipped(tmp_path, name, header, *rows):
    body = "﻿" + ";".join(header) + "\n" + "".join(";".join(r) + "\n" for r in rows)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("list.csv", body.encode())
    (tmp_path / name).write_bytes(buffer.getvalue())
    return str(tmp_path / name)


ROW = ["P", "Prog", "L1", "", "Title", "", "2026-01-01", "10,99", "", "F", "2021", "cat", "obj", "2025-01-01", "", "40", "PT", "1000", "B", "Name"]


def test_operation_lists(spark, tmp_path):
    path = _zipped(tmp_path, "a.zip", operations.HEADER, ROW)
    lists = operations.read_operation_lists(spark, path)
    assert not set(operations.DROPPED) & set(lists.columns)
    row = operations.funding_projects(operations.operations(lists)).first()
    assert (row.code, row.approved_eur, row.scope, row.end) == ("L1", 10, "Title", None)
    with pytest.raises(Exception, match="unexpected header"):
        operations.read_operation_lists(spark, _zipped(tmp_path, "b.zip", operations.HEADER[::-1], ROW)).collect()
    bad = [*ROW]
    bad[13] = "01/01/2025"
    with pytest.raises(checks.CheckFailed, match="can't be read"):
        operations.operations(operations.read_operation_lists(spark, _zipped(tmp_path, "c.zip", operations.HEADER, bad)))


def _page(*ids, total=None, **more):
    notice = lambda i: {"notice_id": [f" {i} "], "publication_date": "2026-01-02Z", "title": {"por": "T", "eng": " "}, "codes": ["45 ", ""], "amount": 10.5, "currency": "EUR"}
    return json.dumps({"notices": [notice(i) for i in ids], "total": total} | more)


def test_notice_pages(spark, tmp_path):
    (tmp_path / "p1.json").write_text(_page("a", "b", total=3) + "\n" + _page("b", "c", total=3))
    pages = notices.read_pages(spark, str(tmp_path / "p1.json"))
    got = notices.deduplicated(notices.canonical_notices(pages)).orderBy("notice_id").collect()
    assert [r.notice_id for r in got] == ["a", "b", "c"]
    assert (got[0].title, got[0].codes, got[0].value_eur, got[0].publication_date) == ("T", ["45"], None, date(2026, 1, 2))
    assert tuple(notices.completeness(pages).first()) == (3, 3, "complete")
    runs = {"missing_iteration_token": [_page("a", total=9)], "count_mismatch": [_page("a", total=9, next_token="t"), _page(total=9)], "max_pages": [_page("a", total=9, next_token="t")], "timed_out": [_page("a", timed_out=True)]}
    for reason, lines in runs.items():
        (tmp_path / f"{reason}.json").write_text("\n".join(lines))
        assert notices.completeness(notices.read_pages(spark, str(tmp_path / f"{reason}.json"))).first().stop_reason == reason


def test_segments_must_be_disjoint(spark):
    a, b = spark.createDataFrame([("x",)], "k string"), spark.createDataFrame([("x",), ("y",)], "k string")
    with pytest.raises(checks.CheckFailed):
        notices.merged_segments([a, b], "k")
    assert notices.merged_segments([a, b.where("k = 'y'")], "k").count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 'a"b', ["x", "y"]), (1, None, [])], "k int, t string, xs array<string>")
    first, again = sinks.write_json_lines(df, f"{tmp_path}/j"), sinks.write_json_lines(df.orderBy("k"), f"{tmp_path}/j2")
    assert first == again and {"k": 1, "t": None, "xs": []} in [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/j").collect()]
    sinks.write_csv(df, f"{tmp_path}/c")
    assert '"2","a""b","x | y"' in [r.value for r in spark.read.text(f"{tmp_path}/c").collect()]


def test_stream_ingest_reads_each_key_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2026-01-01 00:00:00"), (1, "2026-01-01 00:01:00"), (2, "2026-01-01 00:02:00")], "k long, at string").withColumn("at", F.col("at").cast("timestamp"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = ingest.each_key_once(ingest.landed(spark, f"{tmp_path}/in", rows.schema), ["k"], "at", "1 hour")
    for _ in range(2):
        ingest.ingest_available(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    ingest.ingest_available(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]


def test_column_allowlist_is_recursive(spark):
    df = spark.createDataFrame([(1, [("x",)])], "a int, b array<struct<c: string>>")
    assert checks.require_columns(df, ["a", "b", "b.c"]) is df
    with pytest.raises(checks.CheckFailed, match="b.c"):
        checks.require_columns(df, ["a", "b"])
    assert checks.forbidden_columns(df, ["C"]) == ["b.c"]


def test_boundary_and_gated_phrases(spark):
    df = spark.createDataFrame([(1, "PK 12 and pk 12", "water"), (2, "PK 12, PN 13", "road"), (3, "8 crossings", "road"), (4, None, "road")], "k int, t string, d string")
    got = {r.k: r.u for r in df.select("k", rules.boundary_unclear(F.col("t"), r"(?i)\b(p[kn] \d+)", r"(\d+) crossings").alias("u")).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False}
    found = rules.gated_occurrences(df, "t", F.col("d"), [rules.Rule("road", "x", ("pk", "crossings"))]).collect()
    assert {(r.k, r.hits) for r in found} == {(2, 1), (3, 1)}


def test_snapshots_gates_and_manifests(spark):
    members = spark.createDataFrame([("s", ["a", "x", "a"])], "snapshot_id string, keys array<string>")
    got = sorted((r.place, r.status) for r in ledger.snapshot(members, spark.createDataFrame([("a",)], "key string"), "key").collect())
    assert got == [(0, "member"), (1, "unknown"), (2, "repeated")]
    day = date(2026, 3, 1)
    contracts = spark.createDataFrame([("a", "LIVE", [True], day), ("b", "LIVE", [True, None], day), ("c", "PAUSED", [True], day), ("d", "LIVE", [], date(2026, 2, 1))], "source_id string, status string, gates array<boolean>, review_due date")
    assert {r.source_id for r in ledger.source_gate(contracts, F.lit(day)).where("open").collect()} == {"a"}
    counts = spark.createDataFrame([("rows", 3), ("files", 1)], "name string, n long")
    one, again = (ledger.run_manifest(c, "r", "x", "y").first() for c in (counts, counts.orderBy("n")))
    assert one.digest == again.digest and one.counts == {"rows": 3, "files": 1}
    with pytest.raises(checks.CheckFailed):
        ledger.run_manifest(counts.withColumn("n", -F.col("n")), "r", "x", "y")


def test_new_observations_are_told_once(spark):
    seen = spark.createDataFrame([("v", "r1"), ("v", "r2"), ("v", "r2")], "version_id string, run_id string")
    assert [r.run_id for r in ledger.new_observations(seen, seen.limit(0)).orderBy("run_id").collect()] == ["r1", "r2"]
    assert ledger.new_observations(seen, seen.where("run_id = 'r1'")).count() == 1


def test_joint_comparables_need_enough_known_seconds(spark):
    df = spark.createDataFrame([(i, "few", 10 * i, i if i < 5 else None) for i in range(20)] + [(100 + i, "many", 10 * i, 20 - i) for i in range(20)], "k long, c string, a long, b long")
    targets = spark.createDataFrame([("few", 50, 1), ("many", 50, 1), ("many", 60, None)], "c string, first_target long, second_target long")
    got = {(r.c, r.first_target, r.position): r.k for r in cohort.joint_comparables(df, "k", "a", "b", "c", targets, 2).collect()}
    assert set(got) == {("many", 50, 1), ("many", 50, 2)} and got[("many", 50, 1)] in range(105, 113)


def test_joint_ties_go_to_first_then_second_then_key(spark):
    df = spark.createDataFrame([(9, "c", 5, 5), (8, "c", 5, 5), (7, "c", 5, 4), (6, "c", 4, 5)] + [(20 + i, "c", 100, 100) for i in range(16)], "k long, c string, a long, b long")
    got = cohort.joint_comparables(df, "k", "a", "b", "c", spark.createDataFrame([("c", 5, 5)], "c string, first_target long, second_target long"), 4).orderBy("position").collect()
    assert [r.k for r in got][:2] == [8, 9]


def test_references_and_titles(spark):
    from quern.functions import codes

    rows = [(" A-1 ", "a-1", None, True), ("A-1", "b", ["x", " B "], True), ("A-1", "b", ["x", None], False), ("", "", [""], False), (None, "b", ["B"], True), ("A", None, ["A"], False)]
    df = spark.createDataFrame(rows, "code string, ref string, alias array<string>, want boolean")
    assert all(r.x == r.want for r in df.select("want", codes.same_reference(F.col("code"), F.col("ref"), F.col("alias")).alias("x")).collect())
    titles = spark.createDataFrame([("New Bridge ", False, "the NEW BRIDGE of x", None, True), ("  ", False, "  a", "b", False), (None, True, "x", "y", True), ("Bridge", None, None, "a bridge", True), ("Bridge", False, None, None, False)], "t string, g boolean, x string, y string, want boolean")
    assert all(r.x == r.want for r in titles.select("want", codes.title_or_location(F.col("t"), F.col("g"), F.col("x"), F.col("y")).alias("x")).collect())


def test_pages_stop_at_the_last(spark):
    df = spark.range(57)
    ids = lambda n: [r.id for r in relevance.page(df, [F.asc("id")], n, 25).collect()]
    assert ids(3) == ids(99) == list(range(50, 57)) and ids(0) == list(range(25))
    assert relevance.page(df.limit(0), [F.asc("id")], 5, 25).count() == 0
