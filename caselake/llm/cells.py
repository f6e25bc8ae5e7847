"""Links between members of cells, without all pairs of a dense or a hot cell.

A cell is a key that several nodes carry, such as a grid position or a shingle.  Nodes that may be
linked meet in a cell at least.  In each turn every member is held against one member of its cell, its
hub; what is linked becomes a component.  When few members lie outside the component that
prevails in their cell, these, and these only, are held against the members of other components.  So no
pair that meets in a cell is left out unless its ends are in one component already.

A cell with many members is dealt into parts by a hash of the node; each part has a hub of its own,
and these hubs are held against one hub of the cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize
from .components import connected_components

#: Rows that one key may hold before it is dealt into parts.
PART_ROWS = 1_024
#: Most keys that are treated as hot.  Any other key holds less than a 50,000th of the rows, however many there are.
MOST_HOT = 50_000


def hot_keys(rows: DataFrame, key: str, node: str | None = None, one_in: int = 1) -> DataFrame:
    """``(key, parts)`` of keys with over ``PART_ROWS`` rows, ``MOST_HOT`` keys at most: a table that may be broadcast.

    With ``one_in`` the rows are counted on a hash share of the nodes; the list only says how rows are dealt.
    """
    if one_in > 1:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit(5), node), F.lit(one_in)) == 0)
    counts = rows.groupBy(key).agg((F.count(F.lit(1)) * one_in).alias("n")).filter(F.col("n") > PART_ROWS)
    return counts.orderBy(F.desc("n"), key).limit(MOST_HOT).select(key, F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts"))


def deal(rows: DataFrame, hot: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` with ``parts`` (null where the key is not hot) and ``part``, from a hash of column ``by``."""
    return rows.join(F.broadcast(hot), key, "left").withColumn(
        "part", F.pmod(F.xxhash64(F.lit(7), by), F.coalesce("parts", F.lit(1))).cast("int")
    )


def shared_cells(members: DataFrame) -> DataFrame:
    """The members (``key``, ``node`` and other columns) of cells with two or more, dealt into parts, as a written table."""
    hot = materialize(hot_keys(members, "key", "node", 64), "hot")
    by_cell = Window.partitionBy("key", "part").orderBy("node")
    met = F.lag("node").over(by_cell).isNotNull() | F.lead("node").over(by_cell).isNotNull() | F.col("parts").isNotNull()
    out = materialize(deal(members, hot, "key", "node").withColumn("met", met).filter("met").drop("met"), "cells")
    discard(hot)
    return out


Bound = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def _hub_pairs(tagged: DataFrame, attrs: list[str], turn: int, bound: Bound) -> DataFrame:
    """``(a, b)``: members and the hubs of their parts, and hubs of parts and the hub of the cell."""
    names = ["node", "comp", *attrs]
    order = [F.xxhash64(F.lit(turn), "node"), F.col("node")]

    def against(rows: DataFrame, *keys: str) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(*order)
        return rows.select("key", "parts", *names, *[F.first(c).over(window).alias(f"hub_{c}") for c in names])

    dealt = against(tagged, "key", "part")
    heads = dealt.filter(F.col("parts").isNotNull() & (F.col("node") == F.col("hub_node"))).select("key", "parts", *names)
    apart = (F.col("comp") != F.col("hub_comp")) & bound(F.col, lambda c: F.col(f"hub_{c}"))
    return (
        dealt.unionByName(against(heads, "key"))
        .filter(apart)
        .select(F.col("node").alias("a"), F.col("hub_node").alias("b"))
        .distinct()
    )


def _mixed_cells(tagged: DataFrame) -> DataFrame:
    """Cells of several components: ``key``, ``major`` (the component that prevails), ``n`` and ``others``."""
    sizes = tagged.groupBy("key", "comp", "parts").agg(F.count(F.lit(1)).alias("n"))
    return (
        sizes.groupBy("key", "parts")
        .agg(
            F.max_by("comp", F.struct("n", "comp")).alias("major"),
            F.sum("n").alias("n"),
            (F.sum("n") - F.max("n")).alias("others"),
        )
        .filter(F.col("others") > 0)
    )


def _pairs_across(tagged: DataFrame, mixed: DataFrame, attrs: list[str], bound: Bound) -> DataFrame:
    """``(a, b)``: every pair of a cell with unlike components; ``b`` is outside the one that prevails in the cell."""
    every_part = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    marked = tagged.join(mixed.select("key", "major", every_part.alias("part")), ["key", "part"])
    names = ["node", "comp", *attrs]
    rest = marked.filter(F.col("comp") != F.col("major")).select(
        "key", every_part.alias("part"), *[F.col(c).alias(f"x_{c}") for c in names]
    )
    once = (F.col("comp") == F.col("major")) | (F.col("x_node") < F.col("node"))
    apart = (F.col("comp") != F.col("x_comp")) & once & bound(F.col, lambda c: F.col(f"x_{c}"))
    return rest.join(marked, ["key", "part"]).filter(apart).select(F.col("node").alias("a"), F.col("x_node").alias("b")).distinct()


def linked_components(
    cells: DataFrame,
    attrs: list[str],
    bound: Bound,
    verify: Callable[[DataFrame], DataFrame],
    links: DataFrame | None = None,
    turns: int = 4,
    enough: int = 32,
) -> DataFrame:
    """``(node, component)`` of the nodes that have a link.

    ``cells``: from :func:`shared_cells`, with columns ``attrs``.  ``bound`` holds two members' columns against each
    other and never refuses a link; ``verify`` gets pairs ``(a, b)``, each once, and returns those that are links as a written
    table.  ``links``: links known beforehand.  There are at most ``turns`` turns with hubs; fewer, if the pairs
    that are left are no more than ``enough`` times the members, or if a turn leaves most of them.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    members, own, tried = cells.count(), cells.columns, None

    def tag(roots: DataFrame, before: DataFrame | None = None) -> DataFrame:
        roots = roots.withColumnRenamed("node", "n_").withColumnRenamed("component", "c_")
        joined = cells.join(roots, F.col("node") == F.col("n_"), "left").select(*own, F.coalesce("c_", "node").alias("comp"))
        out = materialize(joined, "tagged")
        discard(before)
        return out

    def check(pairs: DataFrame) -> DataFrame:
        if tried is not None:
            pairs = pairs.join(tried, (lo == F.col("lo")) & (hi == F.col("hi")), "left_anti")
        return materialize(pairs, "pairs")

    def components() -> DataFrame:
        if links is None:
            return cells.select("node", F.col("node").alias("component")).limit(0)
        return connected_components(links)

    if links is not None and links.isEmpty():
        links = None

    before = float("inf")
    if not members:
        return components()
    roots = components()
    tagged = cells.withColumn("comp", F.col("node")) if links is None else tag(roots)
    for turn in range(turns):
        pairs = check(_hub_pairs(tagged, attrs, turn, bound))
        if not pairs.isEmpty():
            found, seen = verify(pairs), pairs.select(lo.alias("lo"), hi.alias("hi"))
            tried = seen if tried is None else tried.unionByName(seen)
            if not found.isEmpty():
                links = found if links is None else links.unionByName(found)
                roots = components()
                tagged = tag(roots, tagged)
        mixed = materialize(_mixed_cells(tagged), "mixed")
        left = mixed.agg(F.sum((F.col("others") * F.col("n")).cast("double"))).first()[0] or 0.0
        if left <= enough * members or left > 0.7 * before or turn == turns - 1:
            break
        before = left
        discard(mixed)
    if left:
        pairs = check(_pairs_across(tagged, mixed, attrs, bound))
        if not pairs.isEmpty():
            found = verify(pairs)
            if not found.isEmpty():
                links = found if links is None else links.unionByName(found)
                roots = components()
    discard(tagged, mixed)
    return roots
