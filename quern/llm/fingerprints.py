"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions only.

A text's paragraphs (lines, and long lines cut at a sentence end) are hashed.
Each digest is added to one cell of each of three subtables; a cell holds the
count, the xor of the digests and the xor of their checks. Subtracting the
sketch of one version from that of another leaves the digests that differ.
Peeling takes the cells that hold a single digest, removes it from its other
cells, and so on. The printed fingerprint is a small sketch: two versions that
differ little peel from their fingerprints alone. If cells remain, both are
sketched again in larger ones, many digests in groups of bounded size, until
every group peels empty.

All of this happens within the row of a pair, on arrays of bounded length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A paragraph: up to 48 characters of a line and on to the end of the sentence, 96 characters more at most.
PARAGRAPH = r"[^\n]{1,48}[^\n.]{0,96}\.?\n*|\n+"
#: Cells of a subtable of the printed fingerprint, and digests of a group (about) in the larger sketches.
PRINTED, GROUP = 8, 24
#: Rounds of peeling, and larger sketches tried for a group, each with twice the cells: what is not empty by then is tried again.
ROUNDS, TRIES = 12, 8


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def paragraph_digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs of a whole text; none for a null or empty text."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))
    return F.array_distinct(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(-1))


def _signed(digests: Column, sign: int) -> Column:
    return F.transform(digests, lambda d: F.struct(d.alias("d"), F.lit(sign).alias("n")))


def _entries(digests: Column, size: Column, attempt: Column) -> Column:
    """What signed digests (d, n) add to cells: place p, count n, digest d and check c, one in each of three subtables of `size` cells."""
    place = lambda d, j: (F.pmod(F.xxhash64(d, 3 * attempt + j), size) + j * size).cast("int").alias("p")
    of = lambda e, c: F.array(*[F.struct(place(e["d"], j), e["n"].alias("n"), e["d"].alias("d"), c.alias("c")) for j in range(3)])
    return F.flatten(F.transform(digests, lambda e: _let(_check(e["d"]), lambda c: of(e, c))))


def _summed(entries: Column) -> Column:
    """The sketch that entries (p, n, d, c) add up to: its cells in order of place, empty ones left out.

    Entries are sorted by place, cut where the place changes, and each cut is
    added up by itself: Spark copies what a lambda returns, so none returns a
    growing array.
    """
    full = lambda cell: (cell["n"] != 0) | (cell["d"] != 0) | (cell["c"] != 0)
    begin = F.struct(F.lit(0).alias("p"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("c"))
    both = lambda a, b: F.struct(b["p"].alias("p"), (a["n"] + b["n"]).alias("n"), a["d"].bitwiseXOR(b["d"]).alias("d"), a["c"].bitwiseXOR(b["c"]).alias("c"))

    def cut(of: Column) -> Column:
        end = lambda k: F.coalesce(F.array_position(of["places"], F.try_element_at(of["distinct"], k + 2)).cast("int"), F.size(of["own"]) + 1)
        part = lambda start, k: F.slice(of["own"], start, end(k) - start)
        return F.filter(F.transform(of["distinct"], lambda p, k: F.aggregate(part(F.array_position(of["places"], p).cast("int"), k), begin, both)), full)

    def bound(every: Column) -> Column:
        places = F.sort_array(F.transform(every, lambda e: e["p"]))
        return _let(F.struct(F.sort_array(every).alias("own"), places.alias("places"), F.array_sort(F.array_distinct(F.transform(every, lambda e: e["p"]))).alias("distinct")), cut)

    return _let(entries, bound)


def _negated(cells: Column) -> Column:
    return F.transform(cells, lambda e: F.struct(e["p"].alias("p"), (-e["n"]).alias("n"), e["d"].alias("d"), e["c"].alias("c")))


def sketch(digests: Column, size: Column, attempt: Column) -> Column:
    """Non-empty cells (p, n, d, c) of the sketch, with three subtables of `size` cells, of an array of signed digests (d, n)."""
    return _summed(_entries(digests, size, attempt))


def minus(x: Column, y: Column) -> Column:
    """The sketch x less the sketch y of the same size."""
    return _summed(F.concat(x, _negated(y)))


def peel(cells: Column, size: Column, attempt: Column) -> Column:
    """found: the digests d and signs n taken out of a sketch, and left: whether cells remain after ROUNDS rounds."""
    pure = lambda cell: (F.abs(cell["n"]) == 1) & (cell["c"] == _check(cell["d"]))
    none = F.array().cast("array<struct<d:bigint,n:int>>")
    begin = F.struct(cells.alias("cells"), none.alias("found"), F.lit(True).alias("moves"))

    def step(state: Column) -> Column:
        single = F.array_distinct(F.transform(F.filter(state["cells"], pure), lambda cell: F.struct(cell["d"].alias("d"), cell["n"].alias("n"))))
        rest = lambda s: _summed(F.concat(state["cells"], _negated(_entries(s, size, attempt))))
        still = F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(False).alias("moves"))
        return _let(single, lambda s: F.when(F.size(s) > 0, F.struct(rest(s).alias("cells"), F.concat(state["found"], s).alias("found"), F.lit(True).alias("moves"))).otherwise(still))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, lambda state, _: F.when(state["moves"], step(state)).otherwise(state))
    return _let(end, lambda s: F.struct(s["found"].alias("found"), (F.size(s["cells"]) > 0).alias("left")))


def _grouped(digests: Column, groups: Column) -> Column:
    """The digests dealt by a hash into an array of `groups` arrays."""
    marks = F.transform(F.sequence(F.lit(0), groups - 1), lambda g: F.struct(g.alias("g"), F.lit(None).cast("long").alias("d")))
    own = F.transform(digests, lambda d: F.struct(F.pmod(F.xxhash64(d, F.lit(-2)), groups).cast("int").alias("g"), d.alias("d")))

    def cut(sorted_: Column) -> Column:
        # a group's mark stands before its digests
        start = lambda of, g: F.when(g < groups, F.array_position(of, g)).otherwise(F.size(of) + 1).cast("int")
        part = lambda of, g: F.slice(sorted_, start(of, g) + 1, start(of, g + 1) - start(of, g) - 1)
        return _let(F.transform(sorted_, lambda e: e["g"]), lambda of: F.transform(F.sequence(F.lit(0), groups - 1), lambda g: F.transform(part(of, g), lambda e: e["d"])))

    return F.when(groups == 1, F.array(digests)).otherwise(_let(F.sort_array(F.concat(marks, own)), cut))


def _larger(x: Column, y: Column) -> Column:
    """The signed digests in which x and y differ, from sketches that grow until they peel.

    The difference of two sketches is the sketch of what x adds and y takes.
    Should even the last of them not peel, which digests of 64 bits do not
    bring about, that is an error: nothing is left out in silence.
    """
    size = lambda a: (F.size(x) + F.size(y) + 2) * F.call_function("shiftleft", F.lit(1), a - 1)
    tried = lambda a: _let(size(a), lambda s: peel(sketch(F.concat(_signed(x, 1), _signed(y, -1)), s, a), s, a))
    begin = F.struct(F.array().cast("array<struct<d:bigint,n:int>>").alias("found"), F.lit(True).alias("left"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), begin, lambda state, a: F.when(state["left"], tried(a)).otherwise(state))
    stop = F.raise_error(F.lit(f"a difference did not peel from {TRIES} sketches")).cast("array<struct<d:bigint,n:int>>")
    return _let(end, lambda s: F.when(s["left"], stop).otherwise(s["found"]))


def sketch_difference(x: Column, y: Column, x_print: Column, y_print: Column) -> Column:
    """Array of the digests d in which the arrays x and y differ, with n = 1 if x has it and -1 if y has.

    x_print and y_print are their printed sketches, which give the answer where
    their difference peels empty.
    """
    most = F.greatest(F.size(x), F.size(y), F.lit(1))
    groups = F.call_function("shiftleft", F.lit(1), F.greatest(F.ceil(F.log2(most / GROUP)), F.lit(0)).cast("int"))

    def by_groups(n: Column) -> Column:
        return _let(F.struct(_grouped(x, n).alias("x"), _grouped(y, n).alias("y")), lambda both: F.flatten(F.zip_with(both["x"], both["y"], _larger)))

    small = peel(minus(x_print, y_print), F.lit(PRINTED), F.lit(0))
    return _let(small, lambda s: F.when(~s["left"], s["found"]).otherwise(_let(groups, by_groups)))


def likeness(x: Column, y: Column, differing: Column) -> Column:
    """The shared part of all digests of x and y, of which `differing` differ; two empty arrays are alike (1)."""
    both = F.size(x) + F.size(y)
    return F.when(both == 0, F.lit(1.0)).otherwise((both - F.size(differing)) / (both + F.size(differing)))


def printed_sketch(digests: Column) -> Column:
    return sketch(_signed(digests, 1), F.lit(PRINTED), F.lit(0))


def print_of(cells: Column, digests: Column) -> Column:
    """The fingerprint: the number of digests and the non-empty cells of the printed sketch, in hex."""
    one = lambda c: F.concat(F.lpad(F.hex(c["p"]), 2, "0"), F.hex(c["n"]), F.lit("-"), F.lpad(F.hex(c["d"]), 16, "0"), F.lpad(F.hex(c["c"]), 16, "0"))
    return F.concat(F.size(digests).cast("string"), F.lit(":"), F.array_join(F.transform(cells, one), "."))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and digests of every row, with next_text and next_digests: those of the next row by doc_id, the first's after the last.

    Rows are dealt by ranges of doc_id, and each range is put in order by
    itself; a doc_id, or null, that fills several ranges is dealt among them by
    the hash of its texts. A copy of the first row of each range goes to the end
    of the range before it, and that of the first range to the end of the last.
    Null ids come first; rows of one doc_id are in the order of that hash. The
    driver sees the bounds and first keys of ranges, a few for each partition.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions")) * 2
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    quantiles = F.percentile_approx("doc_id", F.lit([i / ranges for i in range(1, ranges)]), 10_000)
    told = base.agg(quantiles.alias("q"), F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known")).first()
    bounds = sorted(set(told.q or []))
    parts = [told.q.count(b) for b in bounds]
    first = [1 + sum(parts[:i]) for i in range(len(parts))]
    empty = max(1, -(-ranges * (told.n - told.known) // max(1, told.n)))

    h, share = F.xxhash64("text"), F.xxhash64("text") / F.lit(2.0**64) + 0.5
    nth = lambda n: F.least(F.floor(share * n), n - 1).cast("int")
    place = F.lit(0)
    if bounds:
        at = F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda b: b <= F.col("doc_id")))
        of = lambda values, i: F.element_at(F.lit(values), i)
        inside = lambda i: of(first, i) + F.when(of(bounds, i) == F.col("doc_id"), nth(of(parts, i))).otherwise(of(parts, i) - 1)
        place = _let(at, lambda i: F.when(i == 0, F.lit(0)).otherwise(inside(F.greatest(i, F.lit(1)))))
    place = F.when(F.col("doc_id").isNull(), nth(F.lit(empty)) - empty).otherwise(place)
    dealt = base.select("doc_id", "text", h.alias("h"), place.cast("int").alias("range"))

    key = F.struct(F.col("doc_id").isNotNull(), "doc_id", "h")
    heads = sorted(((r["range"], r["head"]["doc_id"], r["head"]["h"]) for r in dealt.groupBy("range").agg(F.min(key).alias("head")).collect()), key=lambda x: x[0])
    before = [(*x, heads[i - 1][0]) for i, x in enumerate(heads)]
    table = spark.createDataFrame(before, "range int, head_id long, head_h long, before int")
    at_head = (F.col("d.range") == F.col("t.range")) & F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h"))
    copies = dealt.alias("d").join(F.broadcast(table).alias("t"), at_head).select("doc_id", "text", "h", F.col("before").alias("range")).dropDuplicates(["range"])
    rows = dealt.withColumn("extra", F.lit(False)).unionByName(copies.withColumn("extra", F.lit(True)))
    rows = rows.withColumn("digests", paragraph_digests(F.col("text")))
    w = Window.partitionBy("range").orderBy("extra", F.col("doc_id").asc_nulls_first(), "h")
    return rows.withColumn("next_text", F.lead("text").over(w)).withColumn("next_digests", F.lead("digests").over(w)).where(~F.col("extra")).select("doc_id", "text", "digests", "next_text", "next_digests")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness to each other and to the next text.

    The edited text's last floor(n_chars / 2) code points are the first as many,
    or all, of the next document's. edited_differing and next_differing are the
    recovered digests d, with n = 1 for those of the text alone and -1 for those
    of the other version alone. Null counts as the empty text, whose fingerprint
    is '0:'. One row per row of docs; repeated rows are each other's next; a
    single row is its own next; texts of any length are read whole; other
    columns are not read.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    text = F.coalesce("text", F.lit(""))
    edited = F.concat(F.substring(text, F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    near = with_next(docs).withColumn("n_chars", F.length(text).cast("long")).withColumn("edited", edited)
    rows = near.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("digests").alias("x"), paragraph_digests(F.col("edited")).alias("y"), F.coalesce("next_digests", F.array().cast("array<bigint>")).alias("z"),
    )
    prints = rows.select("*", *[printed_sketch(F.col(c)).alias(f"{c}_print") for c in "xyz"])
    differing = lambda c: sketch_difference(F.col("x"), F.col(c), F.col("x_print"), F.col(f"{c}_print"))
    found = prints.select(
        "doc_id", "n_chars", "edited_sha256", print_of(F.col("x_print"), F.col("x")).alias("fingerprint"), print_of(F.col("y_print"), F.col("y")).alias("edited_fingerprint"),
        "x", "y", "z", differing("y").alias("edited_differing"), differing("z").alias("next_differing"),
    )
    return found.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("x"), F.col("y"), F.col("edited_differing")).alias("near_edited"), likeness(F.col("x"), F.col("z"), F.col("next_differing")).alias("near_next"),
        "edited_differing", "next_differing",
    )
