"""Connected components of a table of links, as Spark joins.

Every round hooks each node to its smallest neighbour, shortens the chains by doubling and replaces the links by links
between the roots. Links shrink by half a round at least, nothing but counts reaches the driver, and each round is
written to the shared folder, so a lost executor costs one round's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.shared import Scratch


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for links (a, b): component is the smallest node that can be reached, in the type's order.

    Only nodes with a link to another node appear; links to itself, repeated links and links with a null end add
    nothing; without links the result is empty. The tables of the rounds are noted in `scratch`.
    """
    scratch = scratch or Scratch()
    rest = scratch.written(_tidy(links), "links")
    labels = None
    while not rest.isEmpty():
        both = rest.union(rest.select("b", "a"))
        nearest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("nearest"))
        roots = _shortened(scratch.written(nearest.select("node", F.least("node", "nearest").alias("component")), "hooks"), scratch)
        labels = roots if labels is None else _moved(labels, roots)
        a, b = (roots.select(F.col("node").alias(x), F.col("component").alias(f"_{x}")) for x in "ab")
        rest = scratch.written(_tidy(rest.join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))), "links")
    if labels is None:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def _tidy(links: DataFrame) -> DataFrame:
    ends = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return ends.distinct()


def _shortened(hooks: DataFrame, scratch: Scratch) -> DataFrame:
    """Every node's root; a hook leads to a smaller node or to itself, so there are no cycles."""
    while True:
        ahead = hooks.select(F.col("node").alias("component"), F.col("component").alias("_ahead"))
        moved = scratch.written(hooks.join(ahead, "component").select(
            "node", F.col("_ahead").alias("component"), (F.col("_ahead") != F.col("component")).alias("_moved")), "hooks")
        hooks = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return hooks


def _moved(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """Labels of earlier rounds led on to the roots of this one."""
    ahead = roots.select(F.col("node").alias("component"), F.col("component").alias("_ahead"))
    return labels.join(ahead, "component", "left").select("node", F.coalesce("_ahead", "component").alias("component"))
