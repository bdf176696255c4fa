"""Taxonomy trees as (child, parent) tables: distances, siblings, shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROOT = "ROOT"


def schema_tree(schema: DataFrame) -> DataFrame:
    """(child, parent): roles under event types, types under the root."""
    types = schema.select(F.col("event_type").alias("child"), F.lit(ROOT).alias("parent"))
    return types.unionByName(schema.select(F.concat_ws("::", "event_type", "role").alias("child"), F.col("event_type").alias("parent"))).distinct()


def ancestors(tree: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """(node, ancestor, up): each node with itself and all above it, in a tree at most ``depth`` deep."""
    now = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("up"))
    out = now
    for _ in range(depth):
        now = now.join(tree, now["ancestor"] == tree["child"]).select("node", F.col("parent").alias("ancestor"), (F.col("up") + 1).alias("up"))
        out = out.unionByName(now)
    return out


def distances(tree: DataFrame, left: DataFrame, right: DataFrame, depth: int) -> DataFrame:
    """(a, b, distance) along the tree between two lists of nodes."""
    a = ancestors(tree, left, depth).select(F.col("node").alias("a"), "ancestor", F.col("up").alias("x"))
    b = ancestors(tree, right, depth).select(F.col("node").alias("b"), "ancestor", F.col("up").alias("y"))
    return a.join(b, "ancestor").groupBy("a", "b").agg(F.min(F.col("x") + F.col("y")).alias("distance"))


def similarity(found: DataFrame, diameter: int) -> DataFrame:
    """Adds 1 - distance / diameter."""
    return found.withColumn("similarity", F.lit(1.0) - F.col("distance") / F.lit(float(diameter)))


def diameter(tree: DataFrame, depth: int) -> DataFrame:
    """(diameter): the longest way between two nodes of a forest at most ``depth`` deep, of the largest of its trees; 0 without edges.

    In a tree it passes a topmost node: the two deepest branches below it count.
    """
    nodes = tree.select(F.col("child").alias("node")).unionByName(tree.select(F.col("parent").alias("node"))).distinct()
    up = ancestors(tree, nodes, depth)
    roots = up.groupBy("node").agg(F.max_by("ancestor", "up").alias("root"))
    largest = roots.groupBy("root").agg(F.count("*").alias("n")).agg(F.max_by("root", F.struct("n", "root")).alias("root"))
    # heights of the branches below a node: how far a node lies under it, by the child it goes through
    through = up.where("up > 0").join(up.select("node", F.col("ancestor").alias("branch"), F.col("up").alias("below")), "node").where("below = up - 1")
    heights = through.groupBy("ancestor", "branch").agg(F.max("up").alias("h"))
    best = heights.groupBy("ancestor").agg(F.sort_array(F.collect_list("h"), asc=False).alias("hs"))
    ways = best.select("ancestor", (F.get("hs", F.lit(0)) + F.coalesce(F.get("hs", F.lit(1)), F.lit(0))).alias("d"))
    inside = ways.join(roots.select(F.col("node").alias("ancestor"), "root"), "ancestor").where(F.col("root") == largest.scalar())
    return inside.agg(F.coalesce(F.max("d"), F.lit(0)).alias("diameter"))


def shape(tree: DataFrame) -> DataFrame:
    """Nodes, edges and average degree."""
    nodes = tree.select(F.col("child").alias("n")).unionByName(tree.select(F.col("parent").alias("n"))).distinct().agg(F.count("*").alias("n_nodes"))
    return nodes.withColumn("n_edges", tree.agg(F.count("*")).scalar()).withColumn("avg_degree", 2.0 * F.col("n_edges") / F.col("n_nodes"))
