"""Axis-aligned boxes (x, y, w, h), as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{k}") for k in "xywh")


def area(b: Box) -> Column:
    return b[2] * b[3]


def centre(b: Box) -> tuple[Column, Column]:
    return b[0] + b[2] / 2, b[1] + b[3] / 2


def shift(b: Box, dx: float, dy: float) -> Box:
    """Moves the origin by (dx, dy): coordinates go down."""
    return b[0] - dx, b[1] - dy, b[2], b[3]


def resize(b: Box, sy: float, sx: float) -> Box:
    """Scales about the centre."""
    w, h = b[2] * sx, b[3] * sy
    return b[0] + (b[2] - w) / 2, b[1] + (b[3] - h) / 2, w, h


def squarify(b: Box, ratio: float = 1.0) -> Box:
    """Width = ratio * height about the same centre, area kept."""
    h = F.sqrt(area(b) / ratio)
    w = h * ratio
    return b[0] + (b[2] - w) / 2, b[1] + (b[3] - h) / 2, w, h


def intersect(a: Box, b: Box) -> Box:
    """Common part; zeros where there is none."""
    x, y = F.greatest(a[0], b[0]), F.greatest(a[1], b[1])
    w = F.least(a[0] + a[2], b[0] + b[2]) - x
    h = F.least(a[1] + a[3], b[1] + b[3]) - y
    some = (w > 0) & (h > 0)
    return tuple(F.when(some, v).otherwise(0.0) for v in (x, y, w, h))


def union(a: Box, b: Box) -> Box:
    """Bounding box of both."""
    x, y = F.least(a[0], b[0]), F.least(a[1], b[1])
    return x, y, F.greatest(a[0] + a[2], b[0] + b[2]) - x, F.greatest(a[1] + a[3], b[1] + b[3]) - y


def iou(a: Box, b: Box, ignore: Column | None = None) -> Column:
    """Overlap by union, or by a's area where ``ignore`` holds; 0 for empty boxes."""
    w = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    common = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    of = area(a) + area(b) - common
    if ignore is not None:
        of = F.when(ignore, area(a)).otherwise(of)
    return F.when(of > 0, common / of).otherwise(0.0)


def extent(b: Box, degrees: Column, ellipse: bool = False) -> Box:
    """The upright box around ``b`` turned about its centre, or around the ellipse inside it."""
    x, y = centre(b)
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    if ellipse:
        w, h = F.hypot(b[2] * c, b[3] * s), F.hypot(b[2] * s, b[3] * c)
    else:
        w, h = F.abs(b[2] * c) + F.abs(b[3] * s), F.abs(b[2] * s) + F.abs(b[3] * c)
    return x - w / 2, y - h / 2, w, h
