"""Connected components of a table of links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import cut_lineage


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Each node hangs its larger (or, if small, its lower) neighbours on the least of them.

    The least neighbour of a node is an aggregate with map-side reduction and joins
    back on stored tables, so the neighbours of a hub are never gathered.
    """
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    met = both.join(least, F.col("u") == F.col("k"))
    out = met.select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = out.unionByName(met.select("u", F.col("m").alias("v"))) if small else met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one other at most, and none hangs on a node that hangs itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    uses = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return uses.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).agg(F.count("*")).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node reachable from each node that has a link.

    ``links`` has the columns a and b; order, repeats and self-links do not matter. The
    number of rounds is about the logarithm of the longest chain; each round is a
    written table. Edges point to the lower node, so they are done when they are stars.
    """
    edges = cut_lineage(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while not _all_stars(edges):
        edges = cut_lineage(_stars(edges, small=False))
        edges = cut_lineage(_stars(edges, small=True))
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """What ``components`` gives of the links behind ``groups`` and of ``links``, stored.

    Only the groups that ``links`` join are gone through again, each as one node.
    """
    root_of = lambda end: groups.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    between = links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    now = cut_lineage(components(between.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))))
    moved = groups.join(now.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    new = now.join(groups.select("node"), "node", "left_anti")
    return cut_lineage(moved.select("node", F.coalesce("to", "root").alias("root")).unionByName(new))
