"""Graph operators on an edge table; nothing is held as a matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwatch.session import materialize


def symmetric_edges(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Both directions of every edge plus a self-loop per node, without repeats.

    Each edge is shuffled once, as an undirected one; both directions and the
    nodes come from the distinct edges, and only nodes are shuffled again.
    """
    once = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    both = once.filter("a <> b").select(F.explode(F.array(
        F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")),
    )).alias("e")).select("e.src", "e.dst")
    ends = once.select(F.explode(F.array("a", "b")).alias("src"))
    if nodes is not None:
        ends = ends.unionByName(nodes.select(F.col("node").alias("src")))
    return both.unionByName(ends.distinct().select("src", F.col("src").alias("dst")))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Degree of every node, self-loop included."""
    return symmetric_edges(edges, nodes).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def normalized_adjacency(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``src, dst, w`` with w = 1 / sqrt(degree(src) * degree(dst)).

    The edges are written once, because the degrees and both joins read them. The
    degree table has one row per node; a node with very many edges is split by
    the adaptive skew join.
    """
    both = materialize(symmetric_edges(edges, nodes), "edges")
    degree = both.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return (
        both.join(degree.select(F.col("node").alias("src"), F.col("degree").alias("d1")), "src")
        .join(degree.select(F.col("node").alias("dst"), F.col("degree").alias("d2")), "dst")
        .select("src", "dst", (1 / F.sqrt((F.col("d1") * F.col("d2")).cast("double"))).alias("w"))
    )


def neighbor_features(weights: DataFrame, panel: DataFrame, features: list[str], key: str = "county",
                      t: str = "t", prefix: str = "nb_") -> DataFrame:
    """Weighted sum of each node's neighbours (itself included) per time step; missing counts 0."""
    joined = weights.join(panel.select(F.col(key).alias("dst"), t, *features), "dst")
    return joined.groupBy(F.col("src").alias(key), t).agg(*[
        F.coalesce(F.sum(F.col("w") * F.col(c)), F.lit(0.0)).alias(f"{prefix}{c}") for c in features
    ])
