"""Images as tables of cells (x, y, value) or arrays of channels: arithmetic, layout, statistics, colours of flows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(value: Column) -> list[Column]:
    """n, total, squares, mean, var (population), low and high of a column of cells; nulls take no part."""
    return [
        F.count(value).alias("n"), F.sum(value).alias("total"), F.sum(value * value).alias("squares"), F.avg(value).alias("mean"),
        F.var_pop(value).alias("var"), F.min(value).alias("low"), F.max(value).alias("high"),
    ]


def extremes(cells: DataFrame, keys: list[str], value: str, place: str) -> DataFrame:
    """keys, high, high_at, low, low_at, second_low of ``value``: places of ties are the least; the second least value may equal the least."""
    order = F.struct(F.col(value).alias("v"), F.col(place).alias("p"))
    two = F.slice(F.array_sort(F.collect_list(order)), 1, 2)
    # Only the two least of each partition reach the last aggregation.
    part = cells.groupBy(*keys, F.pmod(F.xxhash64(place), F.lit(64)).alias("_s")).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(place)).alias("p"))).alias("_h"), two.alias("_two"))
    whole = part.groupBy(*keys).agg(F.max("_h").alias("_h"), F.slice(F.array_sort(F.flatten(F.collect_list("_two"))), 1, 2).alias("_two"))
    return whole.select(*keys, F.col("_h.v").alias("high"), (-F.col("_h.p")).alias("high_at"), F.col("_two")[0].v.alias("low"), F.col("_two")[0].p.alias("low_at"), F.get("_two", F.lit(1)).v.alias("second_low"))


def combine(a: DataFrame, b: DataFrame, value: str, exprs: dict[str, str]) -> DataFrame:
    """x, y and ``exprs`` over the values ``a`` and ``b`` of the cells that both grids have."""
    both = a.select("x", "y", F.col(value).alias("a")).join(b.select("x", "y", F.col(value).alias("b")), ["x", "y"])
    return both.select("x", "y", *(F.expr(e).alias(k) for k, e in exprs.items()))


def crop(cells: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """Cells of the window, moved so that its corner is (0, 0)."""
    inside = (F.col("x") >= x) & (F.col("x") < x + w) & (F.col("y") >= y) & (F.col("y") < y + h)
    return cells.where(inside).withColumn("x", F.col("x") - x).withColumn("y", F.col("y") - y)


def paste(cells: DataFrame, dx: int, dy: int) -> DataFrame:
    """Cells moved by (dx, dy)."""
    return cells.withColumn("x", F.col("x") + dx).withColumn("y", F.col("y") + dy)


def flip(cells: DataFrame, width: int) -> DataFrame:
    return cells.withColumn("x", F.lit(width - 1) - F.col("x"))


def enlarge(cells: DataFrame, factor: int) -> DataFrame:
    """Each cell becomes factor x factor cells of its value."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    spread = cells.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    return spread.withColumn("x", F.col("x") * factor + F.col("_dx")).withColumn("y", F.col("y") * factor + F.col("_dy")).drop("_dx", "_dy")


def subsample(cells: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th cell either way, numbered anew."""
    return cells.where((F.col("x") % step == 0) & (F.col("y") % step == 0)).withColumn("x", F.floor(F.col("x") / step)).withColumn("y", F.floor(F.col("y") / step))


def lands_inside(w: int, h: int) -> Column:
    """1 where a vector (x, y, u, v) ends inside the image, else 0."""
    x, y = F.col("x") + F.col("u"), F.col("y") + F.col("v")
    return ((x >= 0) & (x <= w - 1) & (y >= 0) & (y <= h - 1)).cast("int")


def is_outlier(error: Column, length: Column, pixels: float = 3.0, share: float = 0.05) -> Column:
    """An end-point error above both ``pixels`` and ``share`` of the true vector's length."""
    return (error > pixels) & (error > share * length)


#: Colours between the six corners of the flow wheel (red-yellow, yellow-green, green-cyan, cyan-blue, blue-magenta, magenta-red).
WHEEL_STEPS = (15, 6, 4, 11, 13, 6)


def wheel() -> list[tuple[int, int, int]]:
    """Colours (r, g, b) around the wheel: in each section one channel is full and another rises or falls, in even steps."""
    out = []
    for section, n in enumerate(WHEEL_STEPS):
        full, moving = ((0, 1), (1, 0), (1, 2), (2, 1), (2, 0), (0, 2))[section]
        for i in range(n):
            rgb = [0, 0, 0]
            step = 255 * i // n
            rgb[full], rgb[moving] = 255, step if section % 2 == 0 else 255 - step
            out.append(tuple(rgb))
    return out


def flow_colour(u: Column, v: Column) -> tuple[Column, Column, Column]:
    """0..255 channels of a vector in units of the largest length: hue by direction, paler when shorter, darker beyond one."""
    colours, n = wheel(), sum(WHEEL_STEPS)
    length = F.hypot(u, v)
    at = (F.atan2(-v, -u) / math.pi + 1) / 2 * (n - 1)
    low = F.floor(at).cast("int")
    part = at - low
    out = []
    for channel in range(3):
        table = F.array(*(F.lit(c[channel] / 255) for c in colours))
        mixed = (1 - part) * F.get(table, low) + part * F.get(table, (low + 1) % n)
        out.append(F.floor(255 * F.when(length <= 1, 1 - length * (1 - mixed)).otherwise(mixed * 0.75)).cast("int"))
    return tuple(out)
