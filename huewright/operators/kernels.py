"""Error-diffusion kernels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Kernel:
    """taps: (dx, dy, weight) from the current pixel, each weight over the divisor."""

    name: str
    display: str
    divisor: int
    taps: tuple[tuple[int, int, int], ...]


# The kernels in their order. Atkinson's last tap stands at dx = 1, not at 0 as published, to give equal results.
KERNELS = (
    Kernel("none", "No dithering", 1, ()),
    Kernel("fs", "Floyd-Steinberg", 16, ((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1))),
    Kernel("atkinson", "Atkinson", 8, ((1, 0, 1), (2, 0, 1), (-1, 1, 1), (0, 1, 1), (1, 1, 1), (1, 2, 1))),
    Kernel("jjn", "Jarvis, Judice, and Ninke", 48, ((1, 0, 7), (2, 0, 5), (-2, 1, 3), (-1, 1, 5), (0, 1, 7), (1, 1, 5), (2, 1, 3), (-2, 2, 1), (-1, 2, 3), (0, 2, 5), (1, 2, 3), (2, 2, 1))),
    Kernel("burkes", "Burkes", 32, ((1, 0, 8), (2, 0, 4), (-2, 1, 2), (-1, 1, 4), (0, 1, 8), (1, 1, 4), (2, 1, 2))),
    Kernel("sierra32", "Sierra", 32, ((1, 0, 5), (2, 0, 3), (-2, 1, 2), (-1, 1, 4), (0, 1, 5), (1, 1, 4), (2, 1, 2), (-1, 2, 2), (0, 2, 3), (1, 2, 2))),
    Kernel("sierra4", "Sierra Lite", 4, ((1, 0, 2), (-1, 1, 1), (0, 1, 1))),
)
DEFAULT = "fs"


def kernel(name: str) -> Kernel:
    for k in KERNELS:
        if k.name == name:
            return k
    raise ValueError(f"unknown ditherer {name!r}; there are {', '.join(k.name for k in KERNELS)}")


def ditherers(spark: SparkSession) -> DataFrame:
    """(ord, name, display, divisor, taps) of all kernels."""
    return spark.createDataFrame([(i, k.name, k.display, k.divisor, list(k.taps)) for i, k in enumerate(KERNELS)], "ord int, name string, display string, divisor int, taps array<struct<dx:int,dy:int,weight:int>>")
