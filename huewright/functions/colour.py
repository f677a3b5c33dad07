"""sRGB, linear light and OKLab as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The OKLab matrices (Ottosson 2020), from linear RGB to cone responses, from their cube roots to Lab, and back.
TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
FROM_LAB = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
FROM_LMS = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))


def srgb_to_linear(c: Column) -> Column:
    """Linear light of an sRGB value, both 0 to 1."""
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)


def _times(matrix: tuple, x: list[Column]) -> list[Column]:
    return [sum((x[k] * row[k] for k in (1, 2)), x[0] * row[0]) for row in matrix]


def rgb_to_oklab(r: Column, g: Column, b: Column) -> list[Column]:
    """l, a, b of sRGB values from 0 to 255 (fractions allowed)."""
    return _times(TO_LAB, [F.cbrt(x) for x in _times(TO_LMS, [srgb_to_linear(c / 255.0) for c in (r, g, b)])])


def quantise(v: Column) -> Column:
    """0 to 255 of an sRGB value of about 0 to 1: bounded, halves away from zero."""
    scaled = v * 255.0
    return F.when(scaled <= 0, 0).when(scaled >= 255, 255).otherwise(F.floor(scaled + 0.5)).cast("int")


def oklab_to_rgb(l: Column, a: Column, b: Column) -> list[Column]:  # noqa: E741
    """r, g, b from 0 to 255."""
    return [quantise(linear_to_srgb(x)) for x in _times(FROM_LMS, [x * x * x for x in _times(FROM_LAB, [l, a, b])])]
