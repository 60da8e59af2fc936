"""Colours for palettes: sRGB and OKLab as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The matrices of the OKLab colour space.
TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))


def inverse(m: tuple) -> list[list[float]]:
    import numpy as np

    return np.linalg.inv(np.array(m)).tolist()


def _times(m, v: list[Column]) -> list[Column]:
    return [sum((F.lit(float(k)) * x for k, x in zip(row[1:], v[1:], strict=True)), F.lit(float(row[0])) * v[0]) for row in m]


def to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def from_linear(c: Column) -> Column:
    c = F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)


def channels(hexadecimal: Column) -> list[Column]:
    """0 to 1 of ``#rrggbb``."""
    return [F.conv(F.substring(hexadecimal, at, 2), 16, 10).cast("double") / 255 for at in (2, 4, 6)]


def to_oklab(hexadecimal: Column) -> list[Column]:
    lms = _times(TO_LMS, [to_linear(c) for c in channels(hexadecimal)])
    return _times(TO_LAB, [F.cbrt(x) for x in lms])


def from_oklab(lab: list[Column]) -> Column:
    lms = [F.pow(x, F.lit(3.0)) for x in _times(inverse(TO_LAB), lab)]
    rgb = [from_linear(c) for c in _times(inverse(TO_LMS), lms)]
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(F.bround(c * 255).cast("long"))), 2, "0") for c in rgb])


def between(a: Column, b: Column, t: Column) -> Column:
    """The colour at ``t`` of the straight way from a to b in OKLab."""
    return from_oklab([x + (y - x) * t for x, y in zip(to_oklab(a), to_oklab(b), strict=True)])
