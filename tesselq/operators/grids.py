"""Operators over cells (x, y, value) of grids, and over matches and flows on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def integral(cells: DataFrame, value: str, out: str) -> DataFrame:
    """Two-dimensional running sums, as two one-dimensional ones: along x within a row, then along y within a column.

    Exact where every row has every x; a missing cell counts as a row without it.
    """
    along_x = Window.partitionBy("y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    along_y = Window.partitionBy("x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("_s", F.sum(value).over(along_x)).withColumn(out, F.sum("_s").over(along_y)).drop("_s")


def block_sums(cells: DataFrame, value: str, size: int) -> DataFrame:
    """block_x, block_y, total, top, low, n of non-overlapping blocks of ``size`` x ``size`` cells."""
    return cells.groupBy(F.floor(F.col("x") / size).alias("block_x"), F.floor(F.col("y") / size).alias("block_y")).agg(F.sum(value).alias("total"), F.max(value).alias("top"), F.min(value).alias("low"), F.count("*").alias("n"))


def flow_to_matches(flow: DataFrame, valid: Column) -> DataFrame:
    """x1, y1, x2, y2 of the valid vectors of a flow (x, y, u, v)."""
    return flow.where(valid).select(F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("u")).alias("x2"), (F.col("y") + F.col("v")).alias("y2"))


def clamp(value: Column, size: int) -> Column:
    """Into [0, size - 1]."""
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), value))


def inside(x: Column, y: Column, w: int, h: int) -> Column:
    return (x >= 0) & (x < w) & (y >= 0) & (y < h)


def splat(seeds: DataFrame, before: int, after: int, values: list[str], order: str) -> DataFrame:
    """x, y and ``values`` of each cell that a seed (x, y) covers, ``before`` cells to the left and up, ``after`` to the right and down; the seed last in ``order`` wins."""
    reach = F.sequence(F.lit(-before), F.lit(after))
    cells = seeds.withColumn("_dx", F.explode(reach)).withColumn("_dy", F.explode(reach))
    cells = cells.select((F.col("x") + F.col("_dx")).alias("x"), (F.col("y") + F.col("_dy")).alias("y"), order, *values)
    return cells.groupBy("x", "y").agg(*(F.max_by(v, order).alias(v) for v in values))


def consistency(forward: DataFrame, backward: DataFrame, limit: float) -> DataFrame:
    """Forward vectors (x, y, u, v) whose landing cell's backward vector brings them back within ``limit``."""
    at = forward.withColumn("_x", F.round(F.col("x") + F.col("u")).cast("long")).withColumn("_y", F.round(F.col("y") + F.col("v")).cast("long"))
    back = backward.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("u").alias("_u"), F.col("v").alias("_v"))
    return at.join(back, ["_x", "_y"]).where(F.hypot(F.col("u") + F.col("_u"), F.col("v") + F.col("_v")) <= limit).select(*forward.columns)


def view_name(index: Column, side: int = 15) -> Column:
    """``RRCC.png`` of the 1-based place in a square array of views."""
    i = index - 1
    return F.concat(F.lpad(F.floor(i / side).cast("string"), 2, "0"), F.lpad((i % side).cast("string"), 2, "0"), F.lit(".png"))


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, chosen in proportion to ``weight`` (> 0): the least of -ln(u) / weight, with u from a hash of ``key``."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    return df.where(F.col(weight) > 0).withColumn("_k", -F.log(u) / F.col(weight)).orderBy("_k", key).limit(n).drop("_k")


def dense_labels(df: DataFrame, label: str, out: str) -> DataFrame:
    """``out``: labels numbered from 0 in their order, without gaps; there are as many rows to number as labels, not as cells."""
    distinct = df.select(label).where(F.col(label).isNotNull()).distinct()
    numbered = distinct.select(label, (F.dense_rank().over(Window.orderBy(label)) - 1).cast("long").alias(out))
    return df.join(numbered, label)


def seeds_to_cells(cells: DataFrame, label: str, seeds: DataFrame, seed: str, values: list[str]) -> DataFrame:
    """``cells`` with the ``values`` of the seed that their ``label`` names; null for a label without a seed. Seeds are broadcast if Spark's own size check allows."""
    s = seeds.select(F.col(seed).alias("_seed"), *(F.col(v).alias(f"_{v}") for v in values))
    return cells.join(s, cells[label] == s["_seed"], "left").select(cells["*"], *(F.col(f"_{v}").alias(v) for v in values))


def valid_on_levels(checks: DataFrame, seed: str, level: str, valid: Column, levels: int = 2) -> DataFrame:
    """seed, valid: whether the seed holds on each of the first ``levels`` levels of its pyramid; a null check fails."""
    return checks.where(F.col(level) < levels).groupBy(seed).agg(F.bool_and(F.coalesce(valid, F.lit(False))).alias("valid"))


def filled(cells: DataFrame, low: tuple[int, int], high: tuple[int, int], value: str, fill: float) -> DataFrame:
    """x, y and ``value`` for every place from ``low`` to ``high``, both included: the cell's, or ``fill`` where there is none."""
    steps = cells.sparkSession.range(low[1], high[1] + 1).select(F.explode(F.sequence(F.lit(low[0]).cast("long"), F.lit(high[0]).cast("long"))).alias("x"), F.col("id").alias("y"))
    return steps.join(cells.select("x", "y", F.col(value).alias("_v")), ["x", "y"], "left").select("x", "y", F.coalesce("_v", F.lit(fill)).alias(value))


def boxes_to_mask(boxes: DataFrame, weight: Column, extents: bool = True) -> DataFrame:
    """x, y and the sum of ``weight`` over the boxes (x, y, w, h) at each whole cell that they cover, or at their centres' cells.

    Covered rows are summed by differences along x, so that a box adds two rows a line and not one a cell: the
    running sum is taken within lines.
    """
    b = boxes.select(*(F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")), weight.alias("_v")).where("w >= 1 and h >= 1")
    if not extents:
        return b.groupBy(F.floor(F.col("x") + F.col("w") / 2).alias("x"), F.floor(F.col("y") + F.col("h") / 2).alias("y")).agg(F.sum("_v").alias("v"))
    lines = b.select(F.floor("x").alias("a"), F.floor(F.col("x") + F.col("w")).alias("b"), F.explode(F.sequence(F.floor("y"), F.floor(F.col("y") + F.col("h")) - 1)).alias("y"), "_v")
    edges = lines.select("y", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("_v")), F.struct(F.col("b").alias("x"), (-F.col("_v")).alias("_v")))).alias("e")).select("y", "e.*")
    edges = edges.groupBy("y", "x").agg(F.sum("_v").alias("_v"))
    w = Window.partitionBy("y").orderBy("x")
    runs = edges.select("y", "x", F.lead("x").over(w).alias("_end"), F.sum("_v").over(w).alias("v")).where("_end is not null and abs(v) > 1e-9")
    return runs.select(F.explode(F.sequence("x", F.col("_end") - 1)).alias("x"), "y", "v")


def mask_to_boxes(cells: DataFrame, value: str, w: float, h: float, least: float) -> DataFrame:
    """x, y, w, h, score: a box of one size about each cell over ``least``."""
    kept = cells.where(F.col(value) > least)
    return kept.select((F.col("x") - F.lit(w) / 2).alias("x"), (F.col("y") - F.lit(h) / 2).alias("y"), F.lit(float(w)).alias("w"), F.lit(float(h)).alias("h"), F.col(value).alias("score"))


def mass_moments(cells: DataFrame, keys: list[str], mass: str) -> DataFrame:
    """keys and the centre (mx, my) and covariance (cxx, cxy, cyy) of the mass over cells (x, y); groups without mass are left out."""
    m, x, y = (F.col(c).cast("double") for c in (mass, "x", "y"))
    s = cells.groupBy(*keys).agg(F.sum(m).alias("s"), *(F.sum(m * c).alias(n) for n, c in {"sx": x, "sy": y, "sxx": x * x, "sxy": x * y, "syy": y * y}.items())).where("s <> 0")
    mx, my = F.col("sx") / F.col("s"), F.col("sy") / F.col("s")
    return s.select(*keys, mx.alias("mx"), my.alias("my"), (F.col("sxx") / F.col("s") - mx * mx).alias("cxx"), (F.col("sxy") / F.col("s") - mx * my).alias("cxy"), (F.col("syy") / F.col("s") - my * my).alias("cyy"))
