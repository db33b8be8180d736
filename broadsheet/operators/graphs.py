"""Graph operators on edge tables: connected components, degrees, edge filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst", most_rounds: int = 50) -> DataFrame:
    """``node, component`` for every node of an undirected edge table; the component is its least node.

    Alternating large-star and small-star steps: every round is a few aggregations by node, with map-side combine, so a
    hub's neighbours never meet in one task; the rounds grow with the logarithm of the longest path. Each round is
    written to the shared folder, which cuts the lineage. Loops and repeated edges do no harm; null ends are left out.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    nodes = materialize(e.select(F.col("u").alias("node")).union(e.select("v")).distinct(), "nodes")
    e = materialize(e.filter("u <> v").distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        e = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
        e = materialize(e, "edges")
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.join(e, nodes["node"] == e["u"], "left").select("node", F.coalesce("v", "node").alias("component"))


def edge_filter(edges: DataFrame, least: float, weight: str = "weight") -> DataFrame:
    """Edges of at least a weight; null weights are left out."""
    return edges.filter(F.col(weight) >= least)


def largest_component(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """The edges of the component with the most nodes; of equally large ones, that of the least node."""
    parts = materialize(connected_components(edges, a, b), "components")
    best = parts.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    inside = parts.join(best, "component", "left_semi").select(F.col("node").alias(a))
    return edges.join(inside, a, "left_semi")


def top_degree(edges: DataFrame, n: int, a: str = "src", b: str = "dst") -> DataFrame:
    """The ``n`` nodes with the most edges, ties by name: a report."""
    ends = edges.select(F.col(a).alias("node")).union(edges.select(b))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(n)
