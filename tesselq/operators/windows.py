"""Moving-window operators over ordered rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def around(keys: list[str], order: list[str], radius: int):
    """The rows within ``radius`` places; the frame is clipped at both ends."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-radius, radius)


def moving(df: DataFrame, keys: list[str], order: list[str], radius: int, **columns: Column) -> DataFrame:
    """``df`` with an aggregate over each row's neighbourhood for each of ``columns``."""
    w = around(keys, order, radius)
    return df.withColumns({k: c.over(w) for k, c in columns.items()})


def moving_median(df: DataFrame, keys: list[str], order: list[str], radius: int, value: str, out: str) -> DataFrame:
    """Lower median of the non-null values in the neighbourhood."""
    held = F.array_sort(F.collect_list(value).over(around(keys, order, radius)))
    return df.withColumn(out, F.element_at(held, F.floor((F.size(held) + 1) / 2).cast("int")))


def moving_mode(df: DataFrame, keys: list[str], order: list[str], radius: int, value: str, out: str) -> DataFrame:
    """Most frequent value in the neighbourhood, the smallest of equals."""
    held = F.array_sort(F.collect_list(value).over(around(keys, order, radius)))
    best = F.aggregate(
        F.array_distinct(held),
        F.struct(F.lit(0).alias("n"), F.lit(None).cast(dict(df.dtypes)[value]).alias("v")),
        lambda s, x: F.when(F.size(F.filter(held, lambda y: y == x)) > s.n, F.struct(F.size(F.filter(held, lambda y: y == x)).alias("n"), x.alias("v"))).otherwise(s),
        lambda s: s.v,
    )
    return df.withColumn(out, best)


def local_maxima(df: DataFrame, keys: list[str], order: list[str], radius: int, value: str, threshold: float) -> DataFrame:
    """Rows whose value is the greatest of its neighbourhood and above ``threshold``."""
    top = F.max(value).over(around(keys, order, radius))
    return df.withColumn("_top", top).where((F.col(value) == F.col("_top")) & (F.col(value) > threshold)).drop("_top")
