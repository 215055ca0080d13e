"""Timelines of labelled intervals: run-length coding, lookup, cropping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def condense(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """Runs of equal ``label``: keys, label, first and last place (from 0) and the number of rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.select(*keys, F.col(label), (F.row_number().over(w) - 1).cast("long").alias("_i"), F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1).alias("_new"))
    runs = rows.withColumn("_run", F.sum("_new").over(Window.partitionBy(*keys).orderBy("_i")))
    return runs.groupBy(*keys, label, "_run").agg(F.min("_i").alias("first"), F.max("_i").alias("last"), F.count("*").alias("n")).drop("_run")


def expand(df: DataFrame, first: str, last: str, out: str) -> DataFrame:
    """One row for each place of each interval."""
    return df.withColumn(out, F.explode(F.sequence(first, last))).drop(first, last)


def crop(df: DataFrame, first: str, last: str, low: int, high: int) -> DataFrame:
    """The parts of the intervals within [low, high], counted from ``low``."""
    a, b = F.greatest(F.col(first), F.lit(low)), F.least(F.col(last), F.lit(high))
    return df.where((F.col(first) <= high) & (F.col(last) >= low)).withColumns({first: (a - low).cast("long"), last: (b - low).cast("long")})


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """Each row of ``left`` with ``values`` of the last row of ``right`` at or before it; nulls where there is none.

    Both sides are merged by time within the keys: one shuffle, no pairs.
    """
    both = left.withColumn("_side", F.lit(1)).unionByName(right.select(*keys, time, F.struct(*values).alias("_v")).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return found.select(*left.columns, *(F.col("_v")[v].alias(v) for v in values))


def robust_rate(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """keys, rate: rows a second, from the mean of the steps below three times their median."""
    steps = df.select(*keys, (F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(time))).alias("_d")).where("_d is not null")
    median = steps.groupBy(*keys).agg(F.percentile("_d", 0.5).alias("_m"))
    return steps.join(median, keys).where("_d < 3 * _m or _m = 0").groupBy(*keys).agg(F.avg("_d").alias("_d")).select(*keys, F.when(F.col("_d") > 0, 1 / F.col("_d")).alias("rate"))
