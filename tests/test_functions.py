import hashlib
import uuid
from datetime import date

from pyspark.sql import functions as F

from quern.functions import codes, dates, hashing, text


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


def test_completed_months_counts_reached_days(spark):
    cases = [("2026-01-15", "2026-02-14", 0), ("2026-01-15", "2026-02-15", 1), ("2026-01-31", "2026-02-28", 0), ("2026-01-31", "2026-03-31", 2), ("2026-03-01", "2026-02-01", None)]
    df = spark.createDataFrame([(date.fromisoformat(a), date.fromisoformat(b), n) for a, b, n in cases], "a date, b date, n long")
    assert all(r.x == r.n for r in df.select("n", dates.completed_months(F.col("a"), F.col("b")).alias("x")).collect())


def test_window_needs_a_bound(spark):
    d = [date(2026, 5, i) for i in (1, 2, 3)]
    df = spark.createDataFrame([(d[1], None, None, False), (d[1], d[1], None, True), (d[1], None, d[0], False), (None, d[0], d[2], False), (d[2], d[0], d[2], True)], "d date, s date, e date, ok boolean")
    assert all(r.x == r.ok for r in df.select("ok", dates.in_window(F.col("d"), F.col("s"), F.col("e")).alias("x")).collect())


def test_phrases_are_whole_words_in_any_script(spark):
    df = spark.createDataFrame([("via ferrata", True), ("viaç", False), ("VIA.", True), ("trivia", False), ("via_x", False), (None, False)], "t string, ok boolean")
    assert all(r.x == r.ok for r in df.select("ok", text.has_phrase(F.col("t"), "via").alias("x")).collect())


def test_segments_keep_terminators_and_offsets(spark):
    t = "  One. Two😀; three\n\n..End"
    rows = text.segments(spark.createDataFrame([(1, t), (2, ""), (3, None)], "k int, t string"), "k", "t").orderBy("k", "segment_no").collect()
    assert [r.segment for r in rows] == ["One.", "Two😀;", "three", ".", ".", "End"]
    assert all(t[r.start : r.end] == r.segment for r in rows)


def test_ngrams_of_too_few_words_are_empty(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    assert [r.g for r in df.select(text.ngrams(F.col("w"), 2).alias("g")).collect()] == [["a b", "b c"], [], []]


def test_code_predicates(spark):
    df = spark.createDataFrame([(["45-23"], ["452"], True), ([], ["4"], False), (["45"], [], False), (None, ["4"], False)], "c array<string>, p array<string>, ok boolean")
    assert all(r.x == r.ok for r in df.select("ok", codes.code_has_prefix(F.col("c"), F.col("p")).alias("x")).collect())
    places = spark.createDataFrame([("ITC4", "itc|x", True), ("IT", "ITC4C", True), ("ITF", "ITC4", False), ("", "IT", False), (None, "IT", False)], "a string, b string, ok boolean")
    assert all(r.x == r.ok for r in places.select("ok", codes.in_hierarchy(F.col("a"), F.col("b")).alias("x")).collect())


def test_amounts_are_never_rounded(spark):
    df = spark.createDataFrame([("10", "EUR", 10), ("10.5", "EUR", None), ("-1", "EUR", None), ("7", "usd", None), ("7", "eur", 7)], "a string, c string, n long")
    assert all(r.x == r.n for r in df.select("n", codes.whole_euros(F.col("a").cast("decimal(20,4)"), F.col("c")).alias("x")).collect())
    decimals = spark.createDataFrame([("1 234,50", "1234.50"), ("1,2,3", None), ("-4", None), ("", None), ("7", "7.00")], "t string, v string")
    assert all((None if r.x is None else str(r.x)) == r.v for r in decimals.select("v", codes.plain_decimal(F.col("t")).alias("x")).collect())


def test_zone_of_a_date_is_ignored(spark):
    df = spark.createDataFrame([("2026-01-02Z", date(2026, 1, 2)), ("2026-01-02+02:00", date(2026, 1, 2)), ("2026-01-02T00:00", None), ("2026-13-02", None)], "t string, d date")
    assert all(r.x == r.d for r in df.select("d", codes.calendar_date(F.col("t")).alias("x")).collect())


def test_shape_has_no_line_end_loophole(spark):
    assert one(spark, codes.has_shape(F.col("v"), "[a-z]+"), v="abc") is True
    assert one(spark, codes.has_shape(F.col("v"), "[a-z]+"), v="abc\n") is False


def test_uuid5_equals_the_standard_one(spark):
    space = "5b4a7c1e-2f0d-5c3a-9e61-7d8f0a2b4c6d"
    for name in ("a", "Zürich", "x" * 100):
        assert one(spark, hashing.uuid5(space, F.col("n")), n=name) == str(uuid.uuid5(uuid.UUID(space), name))


def test_set_digest_ignores_order_and_repeats(spark):
    a = spark.createDataFrame([("x",), ("y",), ("y",)], "k string").repartition(3)
    b = spark.createDataFrame([("y",), ("x",)], "k string")
    c = spark.createDataFrame([("y",)], "k string")
    digest = lambda df: hashing.set_digest(df, "k").first().digest
    assert digest(a) == digest(b) != digest(c)


def test_canonical_json_keeps_nulls_and_orders_keys(spark):
    assert one(spark, hashing.canonical_json("b", "a"), b=None, a=1) == '{"a":1,"b":null}'
    assert one(spark, hashing.hash_rank("s", F.col("k")), k="7") == hashlib.sha256(b"s\x007").hexdigest()


def test_normalised_tokens_are_each_the_normalised_token(spark):
    from quern.functions import text as tx

    words = ["", "'", "a", "Lavorare", "lavare", "abcdare", "abcare", "dell'azione", "dell’Energia", "l'", "''ab'cdefgh", "città", "sviluppamento", "formazioni", "tion", "nation", "relation", "sixxxo", "fivea", "İstanbul", "abcdıng", "😀😀😀😀are", "x\nare", "abcdare\n", None]
    df = spark.createDataFrame([(words,), ([],), (None,)], "words array<string>")
    got = df.select(tx.normalised_tokens(F.col("words")).alias("a"), F.transform("words", tx.normalised_token).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and got[0].a[3] == "lavor"
