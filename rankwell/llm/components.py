"""Connected components of a large list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.scratch import staged


def _followed(parents: DataFrame) -> DataFrame:
    """Every node with the root of its tree: parents are replaced by their parents until nothing changes."""
    while True:
        above = parents.select(F.col("node").alias("_p"), F.col("parent").alias("_up"))
        after = staged(parents.join(above, F.col("parent") == F.col("_p"), "left").select(
            "node", F.coalesce("_up", "parent").alias("parent"),
            (F.coalesce("_up", "parent") != F.col("parent")).alias("moved")), "roots")
        parents = after.drop("moved")
        if after.where("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b): the component is its smallest node.

    Each round hooks every node to its smallest neighbour, follows the hooks to their roots (path
    lengths halve each time) and goes on with the links between roots.  Links shrink from round to
    round; every step is a join or a sum in a written table, and nothing is collected.
    """
    links = staged(links.where("a <> b").select("a", "b").distinct(), "links")
    found = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = _followed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_b")).select(
            "node", F.least("node", "_b").alias("parent")))
        if found is None:
            found = roots
        else:
            above = roots.select(F.col("node").alias("_p"), F.col("parent").alias("_up"))
            found = staged(found.join(above, F.col("parent") == F.col("_p"), "left").select(
                "node", F.coalesce("_up", "parent").alias("parent")), "found")
        left = roots.select(F.col("node").alias("a"), F.col("parent").alias("_ra"))
        right = roots.select(F.col("node").alias("b"), F.col("parent").alias("_rb"))
        links = staged(links.join(left, "a").join(right, "b").where("_ra <> _rb").select(
            F.least("_ra", "_rb").alias("a"), F.greatest("_ra", "_rb").alias("b")).distinct(), "links")
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.select("node", F.col("parent").alias("component"))
