"""Publishing with a commit marker, guarded reads, lookups by keys."""

import pytest
from pyspark.sql import functions as F

from quern.sources import guarded, publish

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark):
    return {"a": spark.range(10).withColumn("x", F.col("id") % 3), "b": spark.createDataFrame([(1, "é"), (2, None)], "k long, v string")}


def bag(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_published_tables_read_back(spark, tmp_path, tables):
    root = str(tmp_path)
    m = publish.publish(tables, root, "r1", {"seen": 7}, "in")
    assert m.number == 1 and m.counts == {"a": 10, "b": 2, "seen": 7} and m.input_digest == "in"
    read = publish.published(spark, root)
    assert {n: bag(df) for n, df in read.items()} == {n: bag(df) for n, df in tables.items()}
    assert publish.changed_tables(spark, root).count() == 0
    newer = publish.publish({"a": tables["a"].where("id > 3")}, root, "r2")
    assert newer.number == 2 and publish.published(spark, root)["a"].count() == 6 and publish.published(spark, root, "r1")["a"].count() == 10
    again = publish.publish({"a": tables["a"].orderBy(F.desc("id")).repartition(3)}, str(tmp_path / "other"), "r1")
    assert again.tables["a"]["digest"] == m.tables["a"]["digest"] != newer.tables["a"]["digest"]


def test_a_run_that_dies_before_its_manifest_is_invisible(spark, tmp_path, tables):
    root = str(tmp_path)
    publish.publish({"a": tables["a"]}, root, "r1")
    publish.stage({"a": tables["a"].limit(1)}, root, "r2")  # and then it dies
    assert [m.run for m in publish.manifests(spark, root)] == ["r1"] and publish.published(spark, root)["a"].count() == 10
    with pytest.raises(publish.PublishError, match="nothing is published"):
        publish.published(spark, root, "r2")
    assert publish.publish(tables, root, "r2").number == 2  # a later attempt of the run isn't in its way
    assert publish.forget_unpublished(spark, root, "r2") == 1 and publish.forget_unpublished(spark, root, "r2") == 0
    assert publish.published(spark, root, "r2")["a"].count() == 10


def test_two_writers_cannot_both_publish_a_run(spark, tmp_path, tables):
    root = str(tmp_path)
    first, second = publish.stage(tables, root, "r1"), publish.stage(tables, root, "r1")
    publish.commit(spark, root, "r1", *first)
    with pytest.raises(publish.PublishError, match="published already"):
        publish.commit(spark, root, "r1", *second)
    with pytest.raises(publish.PublishError, match="published already"):
        publish.publish(tables, root, "r1")
    assert [m.attempt for m in publish.manifests(spark, root)] == [first[0]]


def test_a_writer_that_finds_its_number_taken_looks_again(spark, tmp_path, tables, monkeypatch):
    root = str(tmp_path)
    mine, theirs = publish.stage(tables, root, "r1"), publish.stage(tables, root, "r2")
    take, raced = publish._next_number, []

    def slow(spark, root):
        number = take(spark, root)
        if not raced:  # between the look and the creation another run commits
            raced.append(publish.commit) or raced[0](spark, root, "r2", *theirs)
        return number

    monkeypatch.setattr(publish, "_next_number", slow)
    assert publish.commit(spark, root, "r1", *mine).number == 2
    assert [m.run for m in publish.manifests(spark, root)] == ["r2", "r1"]


def test_a_manifest_cut_short_is_passed_over(spark, tmp_path, tables):
    root = str(tmp_path)
    publish.publish(tables, root, "r1")
    (tmp_path / "manifests" / "000000000002.json").write_text('{"run": "r2", "att')
    assert [m.run for m in publish.manifests(spark, root)] == ["r1"]
    assert publish.publish({"a": tables["a"]}, root, "r2").number == 3


def test_changed_files_and_negative_counts_are_told(spark, tmp_path, tables):
    root = str(tmp_path)
    m = publish.publish(tables, root, "r1")
    tables["a"].limit(1).write.mode("append").parquet(f"{root}/{m.tables['a']['path']}")
    assert bag(publish.changed_tables(spark, root)) == [("a", 10, 11)]
    with pytest.raises(publish.PublishError, match="negative"):
        publish.publish(tables, root, "r2", {"n": -1})


@pytest.mark.parametrize("rows", [0, 4, 5, 6])
def test_projection_under_at_and_over_its_bound(spark, tmp_path, rows):
    path = str(tmp_path / "out")
    source = spark.range(20).withColumns({"x": F.col("id") * 2, "secret": F.lit("s")})
    if rows < 5:
        assert guarded.guarded_projection(source, ["id", "x"], F.col("id") < rows, 5, path, "id") == rows
        assert spark.read.parquet(path).columns == ["id", "x"] and spark.read.parquet(path).count() == rows
    else:
        with pytest.raises(guarded.GuardError, match="bound"):
            guarded.guarded_projection(source, ["id", "x"], F.col("id") < rows, 5, path, "id")
        assert not list(tmp_path.iterdir())


def test_projection_refuses_escapes(spark, tmp_path):
    source = spark.createDataFrame([(1, "a"), (None, "b")], "id long, x string")
    for columns, where, message in ((["id", "y"], F.lit(True), "lacks"), (["x"], F.lit(True), "key"), (["id", "x"], F.lit(True), "without id")):
        with pytest.raises(guarded.GuardError, match=message):
            guarded.guarded_projection(source, columns, where, 9, str(tmp_path / "out"), "id")
    guarded.guarded_projection(source, ["id"], F.col("id") == 1, 9, str(tmp_path / "out"), "id")
    with pytest.raises(guarded.GuardError, match="exists"):
        guarded.guarded_projection(source, ["id"], F.col("id") == 1, 9, str(tmp_path / "out"), "id")
    assert guarded.escaped_columns(source, ["x"]) == ["id"]


def test_projection_and_filter_reach_the_scan(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/orders.parquet")
    plan = source.where(F.col("o_orderstatus") == "O").select("o_orderkey")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,O)]" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("filtered", [True, False])
def test_lookup_equals_semi_join(spark, monkeypatch, kind, filtered):
    if not filtered:
        monkeypatch.setattr(guarded, "FILTER_KEYS", 0)
    source = spark.range(5000).select((F.col("id") % 997).cast(kind).alias("k"), "id").unionByName(spark.createDataFrame([(None, -1)], "k long, id long").select(F.col("k").cast(kind), "id"))
    keys = spark.createDataFrame([(3,), (3,), (996,), (5000,), (None,), (77,)], "k long").select(F.col("k").cast(kind))
    assert bag(guarded.keyed_lookup(source, keys, "k")) == bag(source.join(keys.where("k is not null").distinct(), "k", "left_semi").select("k", "id"))
    assert guarded.keyed_lookup(source, keys.limit(0), "k").count() == 0


def test_key_filter_rules_most_rows_out(spark):
    keys = spark.range(0, 10_000, 10)
    blocks, bits = guarded.key_filter(keys, "id", 1000)
    at = guarded._bit(F.col("id"), bits)
    rows = spark.range(10_000).withColumn("word", F.floor(at / 32768)).join(blocks, "word")
    kept = {r.id for r in rows.where(guarded._held(F.col("bits"), F.pmod(at, F.lit(32768)))).collect()}
    assert set(range(0, 10_000, 10)) <= kept and len(kept) < 2000


def test_batches_and_stray_keys(spark):
    batches = guarded.key_batches(spark.createDataFrame([(c,) for c in "edcbagf"] + [("a",), (None,)], "k string"), "k", 3)
    assert bag(batches) == [(0, "a"), (0, "b"), (0, "c"), (1, "d"), (1, "e"), (1, "f"), (2, "g")]
    answers = spark.createDataFrame([(0, "a"), (0, "a"), (0, "d"), (1, "e"), (2, None), (9, "z")], "batch long, k string")
    assert bag(guarded.batch_violations(answers, batches, "k", 3)) == [("full", 0, None, 3), ("outside", 0, "d", 1), ("outside", 2, None, 1), ("outside", 9, "z", 1)]
    assert guarded.batch_violations(answers.limit(0), batches, "k", 3).count() == 0
