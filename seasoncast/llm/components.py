"""Connected components of a graph that only Spark holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasoncast.sources.shared import cut_lineage


def _to_roots(parents: DataFrame) -> DataFrame:
    """Pointers doubled until each node points at the root of its tree."""
    while True:
        up = parents.select(F.col("node").alias("_n"), F.col("parent").alias("_up"))
        doubled = cut_lineage(
            parents.join(up, F.col("parent") == F.col("_n"), "left").select(
                "node",
                F.coalesce("_up", "parent").alias("parent"),
                (F.col("_up") != F.col("parent")).alias("_moved"),
            )
        )
        parents = doubled.drop("_moved")
        if doubled.filter("_moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for all nodes of ``links`` (``a, b``).

    Every node points at the smallest of itself and its neighbours, trees are contracted to their
    roots, and so on until no link is left between different roots. Minima are aggregated before
    the shuffle, so a node with very many links is no hot spot.
    """
    edges = cut_lineage(links.select("a", "b").filter("a <> b").distinct())
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = cut_lineage(ends.withColumn("component", F.col("node")))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        nearest = both.groupBy("node").agg(F.min("other").alias("_least"))
        roots = _to_roots(
            cut_lineage(nearest.select("node", F.least("node", "_least").alias("parent")))
        )
        a = roots.select(F.col("node").alias("a"), F.col("parent").alias("_a"))
        b = roots.select(F.col("node").alias("b"), F.col("parent").alias("_b"))
        at = roots.select(F.col("node").alias("component"), F.col("parent").alias("_root"))
        labels = cut_lineage(
            labels.join(at, "component", "left").select(
                "node", F.coalesce("_root", "component").alias("component")
            )
        )
        edges = cut_lineage(
            edges.join(a, "a")
            .join(b, "b")
            .select(F.col("_a").alias("a"), F.col("_b").alias("b"))
            .filter("a <> b")
            .distinct()
        )
    return labels
