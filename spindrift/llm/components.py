"""Connected components of a graph given as a table of links, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.staging import discard, staged

MOST_ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """Rows ``(node, component)`` for every node that occurs in ``links(a, b)``; the component is its smallest node.

    Each round joins every node to its smallest neighbour from above and from below, so that trees turn
    into stars in a number of rounds that follows the logarithm of the graph's size. The minimum of each node's
    neighbours is combined before the shuffle, and the join against it has one row a node on one side, so
    Spark can split a node with very many links. Every round is a table in the shared folder.

    Links with a null end are left out; loops keep their node. An empty table gives an empty result.
    """
    whole = links.where("a is not null and b is not null")
    now = staged(_ordered(whole), "links")
    alone = whole.where("a = b").select(F.col("a").alias("node"))
    seen = _digest(now)
    for _ in range(MOST_ROUNDS):
        then = staged(_from_below(_from_above(now)), "links")
        discard(now)
        now, before = then, seen
        seen = _digest(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"the components did not settle in {MOST_ROUNDS} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).unionByName(alone).distinct()
    return nodes.unionByName(roots.join(nodes.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))


def _ordered(links: DataFrame) -> DataFrame:
    """Distinct links from the larger end ``u`` to the smaller end ``v``."""
    return links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _from_above(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _from_below(links: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, move to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _digest(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
