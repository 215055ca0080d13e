"""Distances between numeric arrays and small numeric helpers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def sq_euclidean(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l1(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def cosine(a: Column, b: Column) -> Column:
    dot = _sum(F.zip_with(a, b, lambda x, y: x * y))
    norm = lambda v: F.sqrt(_sum(F.transform(v, lambda x: x * x)))
    return 1 - dot / (norm(a) * norm(b))


def chi_square(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y) / (x + y + EPS))) / 2


def earth_movers(a: Column, b: Column) -> Column:
    """Sum of absolute differences of running sums."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x - y), F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("s")), lambda s, d: F.struct((s.run + d).alias("run"), (s.s + F.abs(s.run + d)).alias("s")), lambda s: s.s)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def end_point_error(u1: Column, v1: Column, u2: Column, v2: Column) -> Column:
    return F.hypot(u1 - u2, v1 - v2)


def angular_error(u1: Column, v1: Column, u2: Column, v2: Column) -> Column:
    """Degrees between (u, v, 1) vectors; the cosine is clamped, so equal vectors give zero."""
    cos = (u1 * u2 + v1 * v2 + 1) / F.sqrt((u1 * u1 + v1 * v1 + 1) * (u2 * u2 + v2 * v2 + 1))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def valid_flow(u: Column, v: Column, limit: float = 400.0) -> Column:
    """Neither unknown (null, NaN, beyond 1e9) nor beyond ``limit``."""
    known = u.isNotNull() & v.isNotNull() & ~F.isnan(u) & ~F.isnan(v)
    return known & (F.abs(u) <= limit) & (F.abs(v) <= limit)
