"""Colour conversions of channels in 0..255, as Column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: sRGB primaries to XYZ, D65 white.
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def linear(c: Column) -> Column:
    """A channel in 0..255 without its gamma, in 0..1."""
    c = c / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def rgb_to_xyz(r: Column, g: Column, b: Column) -> list[Column]:
    channels = [linear(c) for c in (r, g, b)]
    return [sum((m * c for m, c in zip(row, channels, strict=True)), F.lit(0.0)) for row in RGB_TO_XYZ]


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    def f(t: Column) -> Column:
        return F.when(t > 0.008856451679035631, F.pow(t, F.lit(1 / 3))).otherwise(t * 7.787037037037037 + 16 / 116)

    channels = [linear(c) for c in (r, g, b)]
    x, y, z = (f(sum((m * c for m, c in zip(row, channels, strict=True)), F.lit(0.0)) / w) for row, w in zip(RGB_TO_XYZ, WHITE, strict=True))
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def grey(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def to_byte(v: Column) -> Column:
    """Clip to [0, 1] and scale to 0..255, rounded."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255).cast("int")


def lab_to_rgb(lightness: Column, a: Column, b: Column) -> tuple[Column, ...]:
    """Channels in 0..255, not rounded; the inverse of ``rgb_to_lab``."""
    y = (lightness + 16) / 116

    def back(t: Column, white: float) -> Column:
        return white * F.when(t > 6 / 29, t * t * t).otherwise((t - 16 / 116) / 7.787037037037037)

    xyz = [back(t, w) for t, w in zip((y + a / 500, y, y - b / 200), WHITE, strict=True)]

    def gamma(c: Column) -> Column:
        return 255 * F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)

    return tuple(gamma(sum((F.lit(float(m)) * c for m, c in zip(row, xyz, strict=True)), F.lit(0.0))) for row in np.linalg.inv(RGB_TO_XYZ))


def rgb_to_luv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    x, y, z = rgb_to_xyz(r, g, b)
    lightness = F.when(y > 0.008856451679035631, 116 * F.pow(y, F.lit(1 / 3)) - 16).otherwise(y * 903.2962962962963)
    of = x + 15 * y + 3 * z
    white = WHITE[0] + 15 * WHITE[1] + 3 * WHITE[2]
    part = lambda n, w: F.when(of == 0, 0.0).otherwise(13 * lightness * (n / of - w / white))
    return lightness, part(4 * x, 4 * WHITE[0]), part(9 * y, 9 * WHITE[1])


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """All in 0..1; hue 0 of greys."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = high - low
    hue = F.when(span == 0, 0.0).when(high == r, (g - b) / span + F.when(g < b, 6).otherwise(0)).when(high == g, (b - r) / span + 2).otherwise((r - g) / span + 4) / 6
    return hue, F.when(high == 0, 0.0).otherwise(span / high), high / 255
