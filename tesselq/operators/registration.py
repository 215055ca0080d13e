"""Fits and kernels of point-set and colour registration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linspace_grid(low: tuple[float, float, float], high: tuple[float, float, float], n: int) -> list[tuple[float, float, float]]:
    """n control points a side of a box, first axis slowest."""
    axis = [[a + (b - a) * i / (n - 1) for i in range(n)] for a, b in zip(low, high, strict=True)]
    return [(x, y, z) for x in axis[0] for y in axis[1] for z in axis[2]]


def tps_basis(x: Column, y: Column, z: Column, grid: list[tuple[float, float, float]]) -> Column:
    """Array of minus the distance to each control point: the 3-D thin-plate kernel."""
    points = F.array(*(F.struct(*(F.lit(float(v)).alias(k) for v, k in zip(p, "abc", strict=True))) for p in grid))
    return F.transform(points, lambda p: -F.sqrt((x - p.a) * (x - p.a) + (y - p.b) * (y - p.b) + (z - p.c) * (z - p.c)))


def normal_equations(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """One row: the sums s_a_b of a least-squares fit of ``target`` on ``features`` and one."""
    one = {"one": F.lit(1.0)} | {f: F.col(f).cast("double") for f in features} | {"t": F.col(target).cast("double")}
    names = list(one)
    return df.agg(*(F.sum(one[a] * one[b]).alias(f"s_{a}_{b}") for i, a in enumerate(names) for b in names[i:] if a != "t"))


def solve(sums: dict[str, float], names: list[str], target: str = "t") -> np.ndarray:
    """Coefficients of ``names`` from sums s_a_b of normal equations; of the many solutions of a singular system the shortest."""
    at = lambda a, b: sums.get(f"s_{a}_{b}", sums.get(f"s_{b}_{a}"))
    return np.linalg.lstsq(np.asarray([[at(a, b) for b in names] for a in names], float), np.asarray([at(a, target) for a in names], float), rcond=None)[0]


def fit_sums(df: DataFrame, features: dict[str, Column], targets: dict[str, Column], weight: Column | None = None) -> DataFrame:
    """One row of weighted sums s_a_b, over the pairs of features and of each feature with each target."""
    w = F.lit(1.0) if weight is None else weight
    names = list(features)
    pairs = [(a, b, features[b]) for i, a in enumerate(names) for b in names[i:]] + [(a, t, c) for a in names for t, c in targets.items()]
    return df.agg(*(F.sum(w * features[a] * c).alias(f"s_{a}_{b}") for a, b, c in pairs))


def paraboloid_features(x: Column, y: Column) -> dict[str, Column]:
    """x^2, y^2, xy, x, y and one: the terms of a paraboloid over the plane."""
    return {"xx": x * x, "yy": y * y, "xy": x * y, "x": x, "y": y, "one": F.lit(1.0)}


def fit_paraboloid(df: DataFrame, x: str, y: str, z: str) -> np.ndarray:
    """Six coefficients, as ``paraboloid_features`` has the terms, of the least-squares surface z; one pass over the rows."""
    features = paraboloid_features(*(F.col(c).cast("double") for c in (x, y)))
    sums = fit_sums(df, features, {"t": F.col(z).cast("double")}).first().asDict()
    return solve(sums, list(features))


def fit_affine(pairs: DataFrame, weight: str | None = None) -> np.ndarray:
    """2 x 3 matrix that takes (x1, y1, 1) nearest to (x2, y2) by (weighted) squares."""
    features = {"x": F.col("x1").cast("double"), "y": F.col("y1").cast("double"), "one": F.lit(1.0)}
    sums = fit_sums(pairs, features, {"u": F.col("x2").cast("double"), "v": F.col("y2").cast("double")}, None if weight is None else F.col(weight).cast("double")).first().asDict()
    return np.stack([solve(sums, list(features), t) for t in "uv"])


def robust_affine(pairs: DataFrame, key: str, tolerance: float = 5.0, tries: int = 100, confidence: float = 0.995) -> DataFrame:
    """key, matrix (six numbers, row by row) and inliers: the affine map that most pairs (x1, y1, x2, y2) of a key agree with, refitted on those.

    Maps through three pairs drawn from a fixed seed; draws on one line are passed over, and fewer are tried once the best map makes a
    better one unlikely. Without a usable draw all pairs count. A key is one group of one task; under three pairs give a null matrix.
    """

    def run(k, pdf):
        import pandas as pd

        a = np.column_stack((pdf.x1, pdf.y1, np.ones(len(pdf)))).astype(float)
        b = np.column_stack((pdf.x2, pdf.y2)).astype(float)
        best = np.ones(len(a), bool)
        matrix, count, need, rng = None, -1, tries, np.random.default_rng(0)
        for i in range(tries if len(a) >= 3 else 0):
            if i >= need:
                break
            three = rng.choice(len(a), 3, replace=False)
            if abs(np.linalg.det(a[three])) <= 1e-9:
                continue
            near = np.hypot(*(a @ np.linalg.solve(a[three], b[three]) - b).T) <= tolerance
            if near.sum() > count:
                best, count = near, int(near.sum())
                missed = 1 - (count / len(a)) ** 3
                need = 0 if missed <= 0 else min(tries, int(np.ceil(np.log(1 - confidence) / np.log(missed))) if missed < 1 else tries)
        if len(a) >= 3:
            matrix = np.linalg.lstsq(a[best], b[best], rcond=None)[0].T.ravel().tolist()
        return pd.DataFrame({key: [k[0]], "matrix": [matrix], "inliers": [int(best.sum()) if matrix else 0]})

    rows = pairs.select(key, "x1", "y1", "x2", "y2").where("x1 is not null and y1 is not null and x2 is not null and y2 is not null")
    return rows.groupBy(key).applyInPandas(run, f"`{key}` {dict(pairs.dtypes)[key]}, matrix array<double>, inliers long")


def pair_gauss_gradient(ours: list[Column], theirs: list[Column], scale: float) -> list[Column]:
    """Sums over given pairs of exp(-d2 / scale^2) times the difference of each coordinate, over scale^2: ``pair_gauss`` by our coordinates, up to -2."""
    d2 = sum(((a - b) * (a - b) for a, b in zip(ours, theirs, strict=True)), F.lit(0.0))
    return [F.sum(F.exp(-d2 / (scale * scale)) * (a - b)) / (scale * scale) for a, b in zip(ours, theirs, strict=True)]


def pair_gauss(distance2: Column, scale: float) -> Column:
    """Sum over given pairs of exp(-d2 / scale^2)."""
    return F.sum(F.exp(-distance2 / (scale * scale)))
