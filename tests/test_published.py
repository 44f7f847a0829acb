"""Files under their published names."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quern import checks
from quern.checks import CheckFailed
from quern.operators import ledger
from quern.sources import operations, published

ROW = dict(zip(published.LIST_NAMES, ["1", "P", "OP1", "CUP1", "A title", "", "2026-01-01", "x", "y", "12,50", "", "F", "21-27", "C", "O", "2025-01-01", "", "40", "IT", "1"]))


def write_list(path, rows, header=published.LIST_HEADER, members=("list.csv",)):
    text = "﻿" + ";".join(header) + "\r\n" + "".join(";".join(r.values()) + "\r\n" for r in rows)
    with zipfile.ZipFile(path, "w") as z:
        for m in members:
            z.writestr(m, text)


def test_published_list_is_read(spark, tmp_path):
    write_list(tmp_path / "a.zip", [ROW, ROW | {"local_id": "OP2", "cup": " ", "title": " ", "summary": "what; it is".replace(";", ",")}], [f" {h} " for h in published.LIST_HEADER])
    rows = published.read_published_lists(spark, str(tmp_path))
    assert "beneficiary" not in rows.columns and "beneficiary_id" not in rows.columns
    got = {r.local_id: r for r in operations.operations(rows).collect()}
    assert (got["OP1"].scope, str(got["OP1"].total_cost), got["OP2"].title, got["OP2"].cup) == ("A title", "12.50", "what, it is", None)


@pytest.mark.parametrize("change", [{"header": published.LIST_HEADER[::-1]}, {"header": published.LIST_HEADER[:-1]}, {"members": ()}, {"members": ("a.csv", "b.csv")}, {"rows": []}])
def test_other_lists_are_refused(spark, tmp_path, change):
    write_list(tmp_path / "a.zip", change.get("rows", [ROW]), change.get("header", published.LIST_HEADER), change.get("members", ("list.csv",)))
    with pytest.raises(Exception, match="header|expected one CSV|number of fields|no rows"):
        published.read_published_lists(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("change", [{"local_id": " "}, {"title": "", "summary": " "}, {"updated_on": "01/01/2026"}, {"total_cost": "1.2.3"}, {"start": "soon"}])
def test_one_bad_row_rejects_the_batch(spark, tmp_path, change):
    write_list(tmp_path / "a.zip", [ROW, ROW | {"local_id": "OP2"} | change])
    with pytest.raises(CheckFailed):
        operations.operations(published.read_published_lists(spark, str(tmp_path))).collect()


NOTICE = {"publication-number": "1-2026", "publication-date": "2026-02-03+01:00", "notice-title": {"deu": "x", "eng": " Title "}, "description-proc": {"fra": ["", "Texte"]}, "classification-cpv": ["45000000", " "], "estimated-value-proc": 100, "estimated-value-cur-proc": "EUR", "place-of-performance-subdiv-proc": ["ITC4C", "ITC41"], "links": {"html": {"ENG": "https://a"}, "xml": "https://b"}}


def pages(spark, *bodies):
    return published.parsed_pages(spark.createDataFrame([(i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "n int, text string"), "text")


def test_notices_under_published_names(spark, tmp_path):
    more = {"publication-number": [" ", "2"], "publication-date": ["2026-02-03"], "notice-title": "Plain", "estimated-value-proc": "1e2", "estimated-value-cur-proc": "eur"}
    odd = more | {"publication-number": "3", "estimated-value-proc": "1.5", "links": None, "classification-cpv": "45"}
    body = {"notices": [NOTICE, more, odd], "timedOut": False, "totalNoticeCount": 3}
    got = {r.notice_id: r for r in published.published_notices(pages(spark, body), "n", "u/").collect()}
    assert (got["1-2026"].title, got["1-2026"].description, got["1-2026"].codes, got["1-2026"].value_eur, got["1-2026"].nuts, got["1-2026"].url) == ("Title", "Texte", ["45000000"], 100, "ITC4C", "https://b")
    assert (got["2"].title, got["2"].value_eur, got["2"].url, got["2"].codes, str(got["2"].publication_date)) == ("Plain", 100, "u/2", [], "2026-02-03")
    assert (got["3"].value_eur, got["3"].codes, got["3"].url) == (None, ["45"], "u/3")
    (tmp_path / "p.json").write_text(json.dumps(body, indent=1))
    assert published.published_notices(published.read_search_pages(spark, str(tmp_path)), "file").count() == 3


@pytest.mark.parametrize("body, want", [
    ({"notices": [NOTICE], "timedOut": False}, []), ({"notices": [], "timedOut": False}, []), ("not json", ["not_json"]), ("[1]", ["not_json"]), ({"timedOut": False}, ["no_notices"]), ({"notices": []}, ["no_timed_out"]), ({"notices": "x", "timedOut": False}, ["not_a_list"]),
    ({"notices": [], "timedOut": False, "extra": 1}, ["field extra"]), ({"notices": [NOTICE | {"buyer-name": "x"}], "timedOut": False}, ["field buyer-name"]),
    ({"notices": [NOTICE | {"notice-title": {"eng": " "}}], "timedOut": False}, ["identity"]), ({"notices": [NOTICE | {"publication-date": None}], "timedOut": False}, ["identity"]),
])
def test_page_violations_are_told(spark, body, want):
    assert [r.violation for r in published.page_violations(pages(spark, body), "n").collect()] == want


RECORD = {"operation_code": "C1", "project_scope_text": "scope", "source_url": "https://x", "project_start": "2025-01-01", "approved_funding_eur": "7", "first_seen_at": "2025-01-01T00:00:00Z", "theme": ""}


def records(spark, **change):
    r = RECORD | change
    return spark.createDataFrame([tuple(r.values())], ", ".join(f"{c} string" for c in r))


def test_project_records(spark):
    got = published.project_records(records(spark), "OBSERVED").first()
    assert (got.approved_funding_eur, str(got.project_start), got.theme, got.region, got.temporal_provenance) == (7, "2025-01-01", None, None, "OBSERVED")
    for change in ({"project_start": "2025-13-01"}, {"approved_funding_eur": "-7"}, {"approved_funding_eur": "7.5"}, {"source_url": " "}, {"operation_code": None}, {"person": "x"}):
        with pytest.raises(CheckFailed):
            published.project_records(records(spark, **change))


def test_json_lines_under_a_schema(spark, tmp_path):
    schema = "code string, amount long, tags array<string>"
    path = tmp_path / "a.jsonl"
    path.write_text('{"code": "a", "amount": 1, "tags": ["x"]}\n\n  \n{"code": "b"}\n')
    assert sorted(map(tuple, published.read_json_lines(spark, str(path), schema).collect())) == [("a", 1, ["x"]), ("b", None, None)]
    for bad in ('{"code": "a", "amount": "many"}', '{"code": "a", "more": 1}', "[1]", "{", "\n"):
        path.write_text(bad + "\n")
        with pytest.raises(CheckFailed):
            published.read_json_lines(spark, str(path), schema)


def test_label_subset(spark):
    rows = spark.createDataFrame([(1, "a"), (2, " "), (3, "c")], "k long, t string")
    labels = spark.createDataFrame([(1, "no"), (1, "no"), (3, "yes")], "k long, label string")
    assert [r.k for r in checks.labelled_rows(rows, labels, "k", F.col("label") == "no", "t").collect()] == [1]
    for extra in (2, 9):
        with pytest.raises(CheckFailed):
            checks.labelled_rows(rows, labels.unionByName(spark.createDataFrame([(extra, "no")], "k long, label string")), "k", F.col("label") == "no", "t")


def test_subset_and_snapshot_digest(spark):
    a, b = spark.createDataFrame([(1,), (1,), (None,)], "k long"), spark.createDataFrame([(1,), (2,)], "k long")
    assert [r.k for r in checks.not_in(a, b, "k").collect()] == [None] and [r.k for r in checks.not_in(b, a, "k").collect()] == [2]
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    lists = spark.createDataFrame([("s", [1, 2]), ("t", [2, 1]), ("u", [1, 1]), ("v", [1, 9]), ("w", [1, 2])], "snapshot_id string, keys array<long>")
    got = {r.snapshot_id: r for r in ledger.snapshot_digests(ledger.snapshot(lists, rows, "k"), rows, "k").collect()}
    assert got["s"].digest == got["w"].digest != got["t"].digest and got["u"].digest is got["v"].digest is None and (got["u"].faults, got["v"].faults) == (1, 1)
