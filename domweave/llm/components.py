"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domweave.session import written


def _stars(rows: DataFrame, broadcast: bool = True) -> DataFrame:
    """rows (u, v) with the least neighbour of u, or u itself, as m.

    Minima are reduced before the shuffle; the rows of a hub are split by adaptive execution (skew join).
    """
    least = rows.groupBy("u").agg(F.min("v").alias("least"))
    return rows.join(least if broadcast else least.hint("merge"), "u").withColumn("m", F.least("u", "least"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 64, broadcast: bool = True) -> DataFrame:
    """(node, component) of every node with an edge to another; component: its least node.

    Nodes are any ordered type.  Loops, repeated edges, either direction and nulls are
    allowed; edges with a null end are ignored, an edgeless table gives no rows.  Every round is
    written to the shared checkpoint folder, so lost executors cost one round at most.
    Only two counters per round reach the driver.  Stars halve paths, so rounds grow with
    the logarithm of the longest path; more than ``rounds`` raise an error.  Without ``broadcast`` all joins merge: edges are
    written, and by their compressed size the planner broadcasts a million of them.
    """
    now = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v"), F.col("u")))
        large = _stars(both, broadcast).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        stars = _stars(large, broadcast)
        small = stars.select(F.col("v").alias("u"), F.col("m").alias("v")).union(stars.select("u", F.col("m").alias("v")))
        now = written(small.where("u != v").distinct(), "stars")
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = tuple(row)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def joined_components(nodes: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) once ``edges`` are added to what ``nodes`` (node, component) connects already.

    Only edges between components count, with components as their ends, so the work
    is that of the new edges and not of the whole graph.
    """
    def named(side):
        return nodes.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))

    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).join(named("a"), "a", "left").join(named("b"), "b", "left")
    between = ends.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")).where("a != b").distinct()
    merged = written(connected_components(between), "merged")
    known = nodes.join(merged.select(F.col("node").alias("component"), F.col("component").alias("new")), "component", "left")
    fresh = merged.join(nodes.select("node"), "node", "left_anti")
    return known.select("node", F.coalesce("new", "component").alias("component")).union(fresh.select("node", "component"))
