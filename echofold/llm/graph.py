"""Connected groups of near-duplicates from cells of candidates, by DataFrame operations alone."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echofold.llm.tables import stage

# Cells up to this many members are compared in full at once.
SMALL_CELL = 16
# Members of a larger cell that are compared with all others in a round, and their growth by round.
FIRST_PIVOTS = 4
MORE_PIVOTS = 4


def components(links: DataFrame) -> DataFrame:
    """The smallest node reachable from each node of ``links`` (a, b): columns node, component.

    Each round, every edge's higher end is hung below the smallest neighbor of its lower end (as in
    alternating large-star and small-star steps), and stops when no edge changes. A node's neighbors
    are only ever reduced to their minimum, so a hub is pre-aggregated before its edges are dealt out.
    """
    edges = stage(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges"
    )
    before = None
    while True:
        # Large star: all larger neighbors of a node point to its smallest neighbor.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        large = large.distinct()
        # Small star: all smaller neighbors of a node, and itself, point to the smallest one.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pointed = large.join(low, "u")
        small = pointed.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        own = low.select("u", F.col("m").alias("v"))
        edges = stage(small.union(own).distinct(), "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()


def _pairs(left: DataFrame, right: DataFrame, keep: Callable[[Column, Column], Column], ordered: bool) -> DataFrame:
    """Distinct pairs of members of one cell, smaller node first."""
    a = left.select("cell", F.col("node").alias("a"), F.col("info").alias("a_info"))
    b = right.select("cell", F.col("node").alias("b"), F.col("info").alias("b_info"))
    found = a.join(b, "cell").filter((F.col("a") < F.col("b")) if ordered else (F.col("a") != F.col("b")))
    found = found.filter(keep(F.col("a_info"), F.col("b_info")))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def connect(
    cells: DataFrame, keep: Callable[[Column, Column], Column], measure: Callable[[DataFrame], DataFrame],
    small_cell: int = SMALL_CELL, known: DataFrame | None = None,
    first_pivots: int = FIRST_PIVOTS, more_pivots: int = MORE_PIVOTS,
) -> DataFrame:
    """Connected groups over all linked pairs that share a cell; returns (node, component).

    ``cells`` has (cell, node, info); ``keep`` tells from two members' info whether they can link, and
    ``measure`` returns pairs (a, b) and whether they are ``linked``; pairs that
    cannot be may be left out. Small
    cells are compared in full. In a larger one, pivots are compared with all members; a pivot is
    then done with, and so is a cell whose members are all connected. Pivots come from the members
    that are not in the cell's largest group, so the pairs of a large group of copies are never
    listed, and no link between groups is lost.

    ``known`` (a, b) are links found before; their groups count from the first round on.
    """
    by_cell = Window.partitionBy("cell")
    active = stage(cells.select("cell", "node", "info").distinct(), "cells")
    groups: DataFrame | None = None
    if known is not None:
        groups = stage(components(known), "groups")
        active = _open_cells(active, groups)
    pivots = first_pivots
    while True:
        sizes = active.groupBy("cell").agg(F.count(F.lit(1)).alias("members"))
        sized = active.join(sizes, "cell")
        small = sized.filter(F.col("members") <= small_cell)
        large = sized.filter(F.col("members") > small_cell)
        if groups is None:
            ranked = large.withColumn("group_size", F.lit(1))
        else:
            in_cell = large.groupBy("cell", "component").agg(F.count(F.lit(1)).alias("group_size"))
            ranked = large.join(in_cell, ["cell", "component"])
        order = by_cell.orderBy("group_size", F.xxhash64("node"), "node")
        chosen = ranked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= pivots)
        chosen = stage(chosen.select("cell", "node", "info"), "pivots")
        full = _open_pairs(_pairs(small, small, keep, True), groups)
        to_pivots = _open_pairs(_pairs(chosen, large, keep, False), groups)
        measured = stage(measure(stage(full.union(to_pivots).distinct(), "pairs")), "measured")
        links = measured.filter("linked").select("a", "b")
        if groups is None:
            groups = stage(components(links), "groups")
        elif not links.isEmpty():
            # A group's nodes hang on its smallest one: that is all that earlier links tell.
            held = groups.filter("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            groups = stage(components(held.union(links)), "groups")
        rest = large.select("cell", "node", "info").join(chosen.select("cell", "node"), ["cell", "node"], "left_anti")
        active = _open_cells(rest, groups)
        if active.isEmpty():
            return groups
        pivots *= more_pivots


def _open_cells(rest: DataFrame, groups: DataFrame) -> DataFrame:
    """The cells whose members are not all connected, with each member's group."""
    rest = rest.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rest = stage(rest, "rest")
    open_cells = rest.groupBy("cell").agg(F.min("component").alias("l"), F.max("component").alias("h")).filter("l < h")
    return stage(rest.join(open_cells.select("cell"), "cell", "left_semi"), "cells")


def _open_pairs(pairs: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Distinct pairs that are not connected yet."""
    pairs = pairs.distinct()
    if groups is None:
        return pairs
    a = groups.select(F.col("node").alias("a"), F.col("component").alias("a_group"))
    b = groups.select(F.col("node").alias("b"), F.col("component").alias("b_group"))
    known = pairs.join(a, "a", "left").join(b, "b", "left")
    return known.filter(~F.coalesce(F.col("a_group") == F.col("b_group"), F.lit(False))).select("a", "b")
