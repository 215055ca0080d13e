"""Point transforms and densities, as Column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def affine(point: tuple[Column, ...], matrix: list[list[float]], shift: list[float]) -> tuple[Column, ...]:
    """matrix * point + shift, in two or three dimensions."""
    return tuple(sum((F.lit(float(m)) * p for m, p in zip(row, point, strict=True)), F.lit(float(t))) for row, t in zip(matrix, shift, strict=True))


def rigid2d(point: tuple[Column, Column], angle: float, shift: list[float]) -> tuple[Column, ...]:
    c, s = math.cos(angle), math.sin(angle)
    return affine(point, [[c, -s], [s, c]], shift)


def quaternion_matrix(q: tuple[float, float, float, float]) -> list[list[float]]:
    """Rotation of the quaternion (x, y, z, w), which need not have unit length."""
    n = math.sqrt(sum(v * v for v in q))
    x, y, z, w = (v / n for v in q)
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def rigid3d(point: tuple[Column, Column, Column], q: tuple[float, float, float, float], shift: list[float]) -> tuple[Column, ...]:
    return affine(point, quaternion_matrix(q), shift)


def normal_density(x: Column, mean: float, deviation: float) -> Column:
    return F.exp(-((x - mean) * (x - mean)) / (2 * deviation * deviation)) / (deviation * math.sqrt(2 * math.pi))


def normal_density_of(x: list[Column], mean: list[float], covariance: list[list[float]]) -> Column:
    """Density of a normal distribution over several coordinates; the covariance must be regular."""
    c = np.asarray(covariance, float)
    inverse, scale = np.linalg.inv(c).tolist(), 1 / math.sqrt((2 * math.pi) ** len(x) * np.linalg.det(c))
    d = [a - float(m) for a, m in zip(x, mean, strict=True)]
    square = sum((d[i] * d[j] * inverse[i][j] for i in range(len(d)) for j in range(len(d))), F.lit(0.0))
    return F.exp(-square / 2) * float(scale)


def linear_index(y: Column, x: Column, height: int) -> Column:
    """1-based place in column order of the 1-based row and column."""
    return (x - 1) * height + y


def from_linear_index(i: Column, height: int) -> tuple[Column, Column]:
    return (i - 1) % height + 1, F.floor((i - 1) / height) + 1


def rotation_matrix(axis_angle: list[float]) -> list[list[float]]:
    """Rotation about the axis of the vector by its length in radians."""
    angle = math.sqrt(sum(v * v for v in axis_angle))
    x, y, z = (v / angle for v in axis_angle) if angle else (0.0, 0.0, 0.0)
    half = math.sin(angle / 2)
    return quaternion_matrix((x * half, y * half, z * half, math.cos(angle / 2)))
