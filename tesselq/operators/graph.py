"""Graphs as edge tables: labels of components, shortest paths, spanning trees, adjacency. Rounds are stored between."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, stored


def _stars(e: DataFrame) -> DataFrame:
    """One round over edges (a, b) with a > b: every node hands the least of its neighbourhood to its larger neighbours, then to its smaller ones."""
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) over undirected edges (src, dst), by alternating stars.

    A round is aggregations and joins on node; no component is gathered, and the files of a round go when the next is written.
    Loops name a node that is alone; rows with a null end are left out.
    """
    ends = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src is not null and dst is not null")
    nodes = stored(ends.select(F.col("src").alias("node")).union(ends.select("dst")).distinct(), "nodes")
    now = stored(ends.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct(), "stars")
    state = before = None
    while state is None or state != before:
        before = state
        after = stored(_stars(now), "stars")
        state = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        dropped(now)
        now = after
    return nodes.join(now.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("component"))


def shortest_paths(edges: DataFrame, source: int) -> DataFrame:
    """node, dist from ``source`` over directed edges (src, dst, w >= 0): only nodes that improved in a round relax their edges in the next."""
    spark = edges.sparkSession
    best = stored(spark.createDataFrame([(source, 0.0)], "node long, dist double"), "paths")
    front = best
    while not front.isEmpty():
        step = front.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").cast("long").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("_d"))
        known = best.select("node", F.col("dist").alias("_old"))
        better = stored(step.join(known, "node", "left").where("_old is null or _d < _old").select("node", F.col("_d").alias("dist")), "front")
        best = stored(best.join(better.select("node"), "node", "left_anti").unionByName(better), "paths")
        front = better
    return best


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, w) of the minimum spanning forest: in each round every component takes its lightest outgoing edge (ties by ends), and components merge."""
    e = stored(edges.where("src <> dst").select(F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w")).groupBy("src", "dst").agg(F.min("w").alias("w")), "edges")
    of = stored(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("component", F.col("node")), "of")
    chosen = None
    while True:
        cut = e.join(of.select(F.col("node").alias("src"), F.col("component").alias("_a")), "src").join(of.select(F.col("node").alias("dst"), F.col("component").alias("_b")), "dst").where("_a <> _b")
        cut = stored(cut, "cut")
        if cut.isEmpty():
            return chosen if chosen is not None else e.limit(0)
        edge = F.struct("w", "src", "dst", "_a", "_b")
        light = cut.select(F.col("_a").alias("_c"), edge.alias("_e")).union(cut.select(F.col("_b"), edge)).groupBy("_c").agg(F.min("_e").alias("_e")).select("_e.*").distinct()
        light = stored(light, "light")
        part = light.select("src", "dst", "w").distinct()
        chosen = part if chosen is None else stored(chosen.union(part).distinct(), "chosen")
        merged = components(light.select(F.col("_a").alias("src"), F.col("_b").alias("dst")))
        of = stored(of.join(merged.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left").select("node", F.coalesce("_to", "component").alias("component")), "of")


def adjacency(cells: DataFrame, label: str, value: str) -> DataFrame:
    """a, b (a < b), n, least: pairs of labels that meet between side neighbours of a grid (x, y), how often, and the least ``value`` of both cells there."""
    right = cells.select((F.col("x") - 1).alias("x"), "y", F.col(label).alias("_o"), F.col(value).alias("_v"))
    below = cells.select("x", (F.col("y") - 1).alias("y"), F.col(label).alias("_o"), F.col(value).alias("_v"))
    met = cells.join(right.union(below), ["x", "y"]).where(F.col(label) != F.col("_o"))
    return met.groupBy(F.least(label, "_o").alias("a"), F.greatest(label, "_o").alias("b")).agg(F.count("*").alias("n"), F.min(F.least(value, "_v")).alias("least"))


def dot_lines(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """line: one of a graph drawing's text for each distinct edge, quotes in names escaped; null ends are left out."""
    name = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.concat(name(src), F.lit(" -> "), name(dst), F.lit(";")).alias("line")).distinct()
