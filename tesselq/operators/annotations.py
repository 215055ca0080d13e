"""Annotated boxes: label filters and flags, and editing of interval timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flag_out_of_range(objects: DataFrame, ranges: dict[str, tuple[float, float]], ignored: list[str] | None = None, labels: list[str] | None = None) -> DataFrame:
    """Objects (label, x, y, w, h, ignore, ...) of ``labels`` or ``ignored`` labels, with ``ignore`` set for the latter and where a property lies outside its range.

    Properties: any column, and area, ratio (w / h). Rows aren't dropped for their ranges.
    """
    known: dict[str, Column] = {"area": F.col("w") * F.col("h"), "ratio": F.when(F.col("h") != 0, F.col("w") / F.col("h"))}
    if labels is not None:
        objects = objects.where(F.col("label").isin([*labels, *(ignored or [])]))
    out = F.col("ignore").cast("boolean")
    if ignored:
        out = out | F.col("label").isin(ignored)
    for name, (low, high) in ranges.items():
        out = out | ~F.coalesce(known.get(name, F.col(name)).between(low, high), F.lit(False))
    return objects.withColumn("ignore", out)


def visible_share(objects: DataFrame) -> DataFrame:
    """``objects`` with ``visible``: the share of the box that its visible part (bx, by, bw, bh) covers; 0 where fully hidden, 1 where not occluded."""
    share = F.col("bw") * F.col("bh") / (F.col("w") * F.col("h"))
    return objects.withColumn("visible", F.when(F.col("occluded") == 0, 1.0).when((F.col("bw") <= 0) | (F.col("bh") <= 0), 0.0).otherwise(share))


def delete_intervals(timeline: DataFrame, keys: list[str], first: str, last: str, drop: Column) -> DataFrame:
    """The timeline without the intervals where ``drop`` holds; the kept one before each gap is extended over it, and the first kept one over a gap at the start."""
    w = Window.partitionBy(*keys).orderBy(first)
    ends = timeline.withColumn("_end", F.max(last).over(Window.partitionBy(*keys))).withColumn("_start", F.min(first).over(Window.partitionBy(*keys)))
    kept = ends.where(~drop)
    kept = kept.withColumn(last, F.coalesce(F.lead(first).over(w) - 1, F.col("_end")))
    return kept.withColumn(first, F.when(F.row_number().over(w) == 1, F.col("_start")).otherwise(F.col(first))).drop("_end", "_start")


def insert_interval(timeline: DataFrame, keys: list[str], first: str, last: str, label: str, start: int, end: int, value) -> DataFrame:
    """The timeline with ``value`` over [start, end]: what it covers goes, what it cuts keeps the rest, on both sides if it lies inside.

    Keys without any interval at [start, end] get the new one as well; null ends are left as they are.
    """
    cut = timeline.withColumn("_parts", F.array(
        F.struct(F.col(first).alias("a"), F.least(F.col(last), F.lit(start - 1)).alias("b")),
        F.struct(F.greatest(F.col(first), F.lit(end + 1)).alias("a"), F.col(last).alias("b")),
    ))
    whole = timeline.where(F.col(first).isNull() | F.col(last).isNull())
    rest = cut.select("*", F.explode("_parts").alias("_p")).where("_p.a <= _p.b").withColumn(first, F.col("_p.a")).withColumn(last, F.col("_p.b")).drop("_parts", "_p")
    new = timeline.select(*keys).distinct().withColumn(first, F.lit(start)).withColumn(last, F.lit(end)).withColumn(label, F.lit(value))
    return whole.unionByName(rest.unionByName(new, allowMissingColumns=True), allowMissingColumns=True)


def move_border(timeline: DataFrame, keys: list[str], first: str, last: str, border: int, to: int) -> DataFrame:
    """The border before ``border`` (the start of an interval) moved to ``to``: the intervals on its sides grow and shrink, each keeping one place at least."""
    w = Window.partitionBy(*keys).orderBy(first)
    sides = timeline.withColumn("_is", F.col(first) == border).withColumn("_next", F.coalesce(F.lead(first).over(w) == border, F.lit(False)))
    sides = sides.withColumn("_low", F.lag(first).over(w) + 1).withColumn("_high", F.lead(last).over(w))
    start = F.least(F.greatest(F.lit(to), F.col("_low")), F.col(last))
    end = F.least(F.greatest(F.lit(to - 1), F.col(first)), F.col("_high") - 1)
    moved = sides.select(*timeline.columns, F.when(F.col("_is") & F.col("_low").isNotNull(), start).otherwise(F.col(first)).alias("_a"), F.when(F.col("_next"), end).otherwise(F.col(last)).alias("_b"))
    return moved.withColumn(first, F.col("_a")).withColumn(last, F.col("_b")).drop("_a", "_b")


def relabel(timeline: DataFrame, label: str, mapping: dict) -> DataFrame:
    """Labels replaced by ``mapping``; others stay."""
    out = F.col(label)
    for old, new in mapping.items():
        out = F.when(F.col(label) == old, F.lit(new)).otherwise(out)
    return timeline.withColumn(label, out)


def merge_timelines(timelines: list[DataFrame], keys: list[str], first: str, last: str) -> DataFrame:
    """Timelines laid end to end: each begins after the last end of those before it, by key."""
    out = None
    for t in timelines:
        if out is None:
            out = t
            continue
        ends = out.groupBy(*keys).agg(F.max(last).alias("_end"))
        starts = t.groupBy(*keys).agg(F.min(first).alias("_start"))
        shift = starts.join(ends, keys, "left").select(*keys, (F.coalesce(F.col("_end") + 1, F.col("_start")) - F.col("_start")).alias("_by"))
        moved = t.join(F.broadcast(shift) if not keys else shift, keys).withColumn(first, F.col(first) + F.col("_by")).withColumn(last, F.col(last) + F.col("_by")).drop("_by")
        out = out.unionByName(moved)
    return out
