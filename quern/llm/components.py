"""Links between rows that share a cell, and the connected components of links."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import counted, forget, small_side, written

#: Members up to which all pairs of a cell are looked at; a larger cell is dealt into rooms of about this many.
ROOM = 32


def connected_components(edges: DataFrame) -> DataFrame:
    """id and component (its smallest id) of every id in edges (a, b), a written table, by alternating large and small stars.

    Each round points every id at the smallest id that it or its neighbours
    know, on tables written to the shared folder, until a round changes
    nothing. Loops and repeated edges do no harm; ids without an edge to
    another id are not returned. Minima are taken of parts first, and the two
    joins have one row per id on one side, so that the edges of an id with very
    many can be split among tasks (adaptive execution does).
    """
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    e = counted(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", digest)
    while True:
        known = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = known.groupBy(F.col("u").alias("v")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = e.join(low, "v").select("u", F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = e
        e = counted(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges", digest)
        forget(before)
        if e.seen == before.seen:
            found = e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
            found = counted(found, "components")
            forget(e)
            return found


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose sets (id, members: an array of distinct longs) have at least a Jaccard similarity."""
    of = lambda k, x: sets.select(F.col("id").alias(k), F.col("members").alias(x))
    both = small_side(pairs).join(of("a", "x"), "a").join(of("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b").distinct()


def possible_pairs(pairs: DataFrame, prefixes: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) that their prefixes (id, n: members of the whole set, members: its first ones in an order of all members) leave possible.

    Members that both sets have, up to the end of the prefix that ends first, are
    in both prefixes; the others are beyond that prefix in its set. So two sets
    share no more than their prefixes do and the longer rest.
    """
    of = lambda k, n, x: prefixes.select(F.col("id").alias(k), F.col("n").alias(n), F.col("members").alias(x))
    both = small_side(pairs).join(of("a", "m", "x"), "a").join(of("b", "n", "y"), "b")
    most = F.size(F.array_intersect("x", "y")) + F.greatest(F.col("m") - F.size("x"), F.col("n") - F.size("y"))
    return both.where(most >= F.ceil((F.col("m") + F.col("n")) * (similarity / (1 + similarity)) - 1e-6)).select("a", "b").distinct()


def rare_pairs(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) that hold every pair of similar sets of which one is minor and the components differ.

    nodes: id, component, minor. sets: id and members, repeated or not. Members
    are put in order, the rarest first. Of n members, two similar sets share one
    of the first n - ceil(similarity * n) + 1 of either; and from the first that
    they share, both have as many left as the similarity asks them to share.
    Members of a single set come first and need no look: only the others are
    gathered again by set.
    """
    each = sets.select("id", F.size("members").alias("n"), F.explode("members").alias("member"))
    often = written(each.groupBy("member").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "often")
    own = each.join(small_side(often), "member").groupBy("id", "n").agg(F.sort_array(F.collect_set(F.struct("often", "member"))).alias("own"))
    single = F.col("n") - F.size("own")
    first = F.slice("own", 1, F.greatest(F.col("n") - F.ceil(similarity * F.col("n")).cast("int") + 1 - single, F.lit(0)))
    ranked = own.select("id", "n", single.alias("single"), F.posexplode(first).alias("at", "m")).select("id", "n", F.col("m.member").alias("member"), (F.col("single") + F.col("at") + 1).alias("rank"))
    rare = written(ranked.join(nodes, "id"), "rare")
    forget(often)
    l, r = rare.where("minor").alias("l"), rare.alias("r")
    left = F.least(F.col("l.n") - F.col("l.rank"), F.col("r.n") - F.col("r.rank")) + 1
    asked = F.ceil((F.col("l.n") + F.col("r.n")) * (similarity / (1 + similarity)) - 1e-6)
    meet = (F.col("l.member") == F.col("r.member")) & (F.col("l.component") != F.col("r.component")) & (left >= asked)
    return l.join(r, meet).select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def link_cells(
    nodes: DataFrame,
    cells: Column,
    close: Callable[[Column, Column], Column] | None = None,
    sets_of: Callable[[DataFrame], DataFrame] | None = None,
    possible: Callable[[DataFrame], DataFrame] | None = None,
    similarity: float = 1.0,
    carry: Sequence[str] = (),
    room: int = ROOM,
    known: DataFrame | None = None,
    deeper: Callable[[DataFrame, DataFrame, DataFrame | None], DataFrame] | None = None,
) -> DataFrame:
    """Components (id, component), a written table, of the links between nodes that share a cell.

    nodes: id, and columns to carry for `close`; an id may occur again. cells:
    an array of cell numbers of a node. Two nodes that share a cell are linked
    if close(l, r) holds for the structs of the carried columns of the two
    (always, without it) and, if sets_of is given, the Jaccard similarity of
    their sets is at least `similarity`; sets_of takes a table of ids and
    returns id and members, repeated or not. possible: drops pairs (a, b) that
    cannot be so similar, before their sets are made. known: components found
    before, which stay joined.

    Three steps, each on what the one before has left apart:

    1. Every member of a cell meets the cell's lead, the member whose cells are
       the largest together: in a family of copies that is the original, or
       close to it. A member of cells larger than `room` meets only the
       heaviest of their leads. A cell of two is done with that.
    2. In cells that still hold several components, members of different ones
       meet: all pairs in a cell of at most `room` members; else in random rooms
       of that size, in the largest such cell of each member.
    3. In the larger cells that still hold several components, members outside
       the largest one are held against all members of other components: those
       that share a rare element where there are sets, else all of the cell. So
       no link that would join two components is lost.
    """
    near = F.lit(True) if close is None else close(F.col("l"), F.col("r"))
    carried = F.struct("id", *carry)
    scratch: list[DataFrame] = []

    def kept(df: DataFrame, name: str, write: Callable[[DataFrame, str], DataFrame] = counted) -> DataFrame:
        scratch.append(write(df, name))
        return scratch[-1]

    def done(*tables: DataFrame) -> None:
        """Removes tables before the end: what was made of them is written."""
        scratch[:] = [t for t in scratch if not any(t is x for x in tables)]
        forget(*tables)

    def labelled(rows: DataFrame, found: DataFrame | None) -> DataFrame:
        if found is None:
            return rows.withColumn("component", F.col("id"))
        return rows.join(small_side(found), "id", "left").withColumn("component", F.coalesce("component", "id"))

    def joined(pairs: DataFrame, found: DataFrame | None) -> DataFrame | None:
        """Components after the links among pairs (a, b) are added."""
        links = kept(pairs, "pairs")
        if possible is not None and links.seen["rows"]:
            links = kept(possible(links), "possible")
        if not links.seen["rows"]:
            return found
        if sets_of is not None:
            sets = kept(sets_of(links.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "sets", written)
            links = kept(similar_pairs(links, sets, similarity), "links")
            done(sets)
            if not links.seen["rows"]:
                return found
        every = links if found is None else links.unionByName(found.select(F.col("id").alias("a"), F.col("component").alias("b")))
        scratch.append(connected_components(every))
        return scratch[-1]

    def split(rows: DataFrame, found: DataFrame | None) -> DataFrame:
        """Those rows, with components, whose cell holds several."""
        rows = labelled(rows, found)
        several = rows.groupBy("cell").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("cell")
        return kept(rows.join(several, "cell", "left_semi"), "split")

    dealt = nodes.select("id", *carry, F.explode(cells).alias("cell"))
    shared = kept(dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cell"), "cells", written)
    members = kept(dealt.join(small_side(shared), "cell", "left_semi").distinct(), "members", written)
    done(shared)
    if known is not None:
        every, members = members, split(members, known)
        done(every)
    of_cell = members.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = kept(members.select("id", *carry, "cell").join(of_cell, "cell"), "sized")
    done(members)

    weights = sized.groupBy("id").agg(F.sum("n").alias("weight"))
    lead = F.max_by(F.struct(F.struct("weight", (-F.col("id")).alias("low")).alias("rank"), carried.alias("of")), F.struct("weight", -F.col("id")))
    leads = sized.join(weights, "id").groupBy("cell").agg(lead.alias("lead"))
    every = kept(sized.select("cell", "n", carried.alias("l")).join(leads, "cell"), "led")
    led = every.where("l.id <> lead.of.id")
    small = led.where(F.col("n") <= room).select("l", F.col("lead.of").alias("r"))
    large = led.where(F.col("n") > room).groupBy("l").agg(F.max_by("lead.of", "lead.rank").alias("r"))
    starred = small.unionByName(large).where(near).select(*_ordered(F.col("l.id"), F.col("r.id"))).distinct()
    found = joined(starred, known)
    done(every)

    apart = split(sized.where("n > 2"), found)
    done(sized)
    if apart.seen["rows"]:
        own = apart.where(F.col("n") > room).groupBy("id").agg(F.max_by("cell", F.struct("n", "cell")).alias("own"))
        seats = apart.join(own, "id", "left").where((F.col("n") <= room) | (F.col("cell") == F.col("own")))
        rooms = F.when(F.col("n") > room, F.pmod(F.xxhash64("cell", "id"), F.ceil(F.col("n") / room))).otherwise(F.lit(0).cast("long"))
        seats = kept(seats.select("cell", rooms.alias("room"), "component", carried.alias("l")), "seats")
        others = seats.select("cell", "room", F.col("component").alias("other"), F.col("l").alias("r"))
        met = seats.join(others, ["cell", "room"]).where((F.col("l.id") < F.col("r.id")) & (F.col("component") != F.col("other")) & near)
        found = joined(met.select(*_ordered(F.col("l.id"), F.col("r.id"))).distinct(), found)
        done(seats)

        before, apart = apart, split(apart.where(F.col("n") > room).drop("component"), found)
        done(before)
    if apart.seen["rows"]:
        shares = apart.groupBy("cell", "component").agg(F.count(F.lit(1)).alias("k"))
        main = shares.groupBy("cell").agg(F.max_by("component", F.struct("k", "component")).alias("main"))
        told = kept(apart.join(main, "cell"), "told") if deeper is None else apart
        if deeper is not None:
            found, rest = deeper(kept(apart.select("cell").distinct(), "crowded"), kept(apart.select("id").distinct(), "outside"), found), None
        elif sets_of is not None:
            outside = kept(told.groupBy("id", "component").agg(F.bool_or(F.col("component") != F.col("main")).alias("minor")), "outside")
            rest = rare_pairs(outside, sets_of(outside.select("id")), similarity)
        else:
            minor = told.where("component <> main").select("cell", "component", carried.alias("l"))
            all_of = told.select("cell", "main", F.col("component").alias("other"), carried.alias("r"))
            once = (F.col("other") == F.col("main")) | (F.col("l.id") < F.col("r.id"))
            rest = minor.join(all_of, "cell").where((F.col("component") != F.col("other")) & once & near).select(*_ordered(F.col("l.id"), F.col("r.id"))).distinct()
        found = found if rest is None else joined(rest, found)
    if found is None:
        found = written(nodes.select("id", F.col("id").alias("component")).limit(0), "components")
    forget(*[t for t in scratch if t is not found])
    return found
