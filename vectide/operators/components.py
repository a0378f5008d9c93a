"""Connected components by alternating two ways of hooking nodes to smaller ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _lowest(edges: DataFrame) -> DataFrame:
    """Each node's smallest smaller neighbour; map-side minimum, so a hub is one row per task."""
    return edges.groupBy(F.col("hi").alias("_node")).agg(F.min("lo").alias("_least"))


def _hooked(edges: DataFrame) -> DataFrame:
    """One round on edges (hi, lo): nodes meet the smallest node around their neighbours.

    First every edge moves its lower end to the smallest neighbour of that end. Then the lower ends
    of each node, and the node itself, are hooked to the smallest of them. `changed` marks edges that
    either step made; without any, every component is a star around its smallest node.
    """
    below = _lowest(edges)
    moved = edges.join(below, F.col("lo") == F.col("_node"), "left").select(
        "hi", F.coalesce("_least", "lo").alias("lo"), F.col("_least").isNotNull().alias("_moved")
    )
    least = _lowest(moved)
    around = moved.join(least, F.col("hi") == F.col("_node")).select(
        "hi", "lo", "_least", (F.col("_moved") | (F.col("lo") != F.col("_least"))).alias("changed")
    )
    ends = F.array(
        F.struct(F.col("hi").alias("hi"), F.col("_least").alias("lo")),
        F.struct(F.col("lo").alias("hi"), F.col("_least").alias("lo")),
    )
    return (
        around.select("changed", F.inline(F.filter(ends, lambda e: e["hi"] != e["lo"])))
        .groupBy("hi", "lo")
        .agg(F.max("changed").alias("changed"))
    )


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """`(node, component)`: the smallest node of the component names it.

    Each round is one job that writes the edges it leaves, with a mark on those that are new; the number
    of edges never grows and rounds grow with the logarithm of the longest path. With `nodes`, nodes
    without an edge are components of their own.
    """
    live = (
        edges.filter(F.col("i") != F.col("j"))
        .select(F.greatest("i", "j").alias("hi"), F.least("i", "j").alias("lo"))
        .distinct()
    )
    while True:
        live = cut(_hooked(live.select("hi", "lo")))
        if live.filter("changed").isEmpty():
            break
    if nodes is None:
        nodes = edges.select(F.col("i").alias("node")).union(edges.select("j")).distinct()
    stars = live.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return cut(
        nodes.select("node")
        .join(stars, "node", "left")
        .select("node", F.coalesce("component", "node").alias("component"))
    )


def graph_stats(edges: DataFrame, components: DataFrame, number: str | None = None) -> DataFrame:
    """One row: proteins, edges, isolated, components, largest_component.

    `number` names a column of `edges` that sums to their number (see `threshold_links`).
    """
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    shape = sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("proteins"),
        F.count_if(F.col("n") == 1).alias("isolated"),
        F.count(F.lit(1)).alias("components"),
        F.coalesce(F.max("n"), F.lit(0)).alias("largest_component"),
    )
    total = F.coalesce(F.sum(number), F.lit(0)) if number else F.count(F.lit(1))
    counted = edges.agg(total.alias("edges"))
    names = ["proteins", "edges", "isolated", "components", "largest_component"]
    return shape.unionByName(counted, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in names]
    )
