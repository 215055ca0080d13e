"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands the smallest of its neighbourhood to its larger neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smallest smaller neighbour to the others and to itself."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b"))).where("a <> b")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """Roots of the nodes of ``edges`` (a long, b long): one row (node, root) for each node, root the smallest node reachable.

    Loops and repeated edges do no harm, rows with nulls are left out, an empty table gives no rows.
    Each round is a handful of aggregations and joins on node; nothing is gathered per component.
    Rounds end when the edge set stops changing, which takes O(log^2) of the largest component.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(now, "edges")
    before = None
    while (state := _state(now)) != before:
        before = state
        now = materialize(_small_star(_large_star(now).distinct()).distinct(), "edges")
    children = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return children.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
