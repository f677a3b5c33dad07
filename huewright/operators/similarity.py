"""Structural similarity (SSIM) of two versions of an image.

A window of SIZE x SIZE pixels compares the brightness of both versions by their means, variances and covariance. The sums of values, squares and products over all windows come
from summed areas: prefix sums in both directions, of which a window takes four corners. Images are cut into bands of rows, each with the first SIZE - 1 rows of the next one, so one shuffle brings
together what a band's windows need; all sums are whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 8
# The usual constants, for values of 0 to 255.
C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2


def brightness(r: Column, g: Column, b: Column) -> Column:
    """0 to 255, a whole number."""
    return F.floor((299 * r + 587 * g + 114 * b) / 1000).cast("int")


def window_sums(values: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Sums over all whole windows of a grid (h, w): (h - size + 1, w - size + 1)."""
    areas = np.zeros((values.shape[0] + 1, values.shape[1] + 1), np.int64)
    areas[1:, 1:] = values.cumsum(0).cumsum(1)
    return areas[size:, size:] - areas[:-size, size:] - areas[size:, :-size] + areas[:-size, :-size]


def ssim(pairs: DataFrame, *, rows: int = 64) -> DataFrame:
    """(image_id, n_windows, sum_a, sum_b, sum_aa, sum_bb, sum_ab, ssim) of the brightness a and b in (image_id, y, x, a, b): the window sums added up, and the windows' mean similarity.

    Images narrower or lower than SIZE have no window and no row. Missing or repeated pixels raise ValueError.
    """
    band, at = F.floor(F.col("y") / rows).cast("int"), F.col("y") % rows
    if rows < SIZE - 1:
        raise ValueError(f"bands hold {SIZE - 1} rows or more")
    bands = F.array_compact(F.array(band, F.when(at < SIZE - 1, band - 1)))
    names = ("sum_a", "sum_b", "sum_aa", "sum_bb", "sum_ab")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        image, b = key[0].as_py(), key[1].as_py()
        y, x = table["y"].to_numpy(), table["x"].to_numpy()
        order = np.lexsort((x, y))
        y, x = y[order], x[order]
        width, height = int(x.max()) + 1, int(y[-1] - y[0]) + 1
        want = np.arange(len(y))
        if len(y) != width * height or (y != y[0] + want // width).any() or (x != want % width).any():
            raise ValueError(f"image {image} isn't a whole grid of pixels")
        none = pa.table({"image_id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), **{c: pa.array([], pa.int64()) for c in names}, "s": pa.array([], pa.float64())})
        if b < 0 or height < SIZE or width < SIZE:
            return none
        va, vb = (table[c].to_numpy()[order].astype(np.int64).reshape(height, width) for c in ("a", "b"))
        sa, sb, saa, sbb, sab = (window_sums(v)[:rows] for v in (va, vb, va * va, vb * vb, va * vb))
        n = SIZE * SIZE
        ma, mb = sa / n, sb / n
        var, cov = (saa + sbb) / n - ma * ma - mb * mb, sab / n - ma * mb
        s = (2 * ma * mb + C1) * (2 * cov + C2) / ((ma * ma + mb * mb + C1) * (var + C2))
        return pa.table({"image_id": pa.array([image], pa.int64()), "n": pa.array([s.size], pa.int64()), **{c: pa.array([int(v.sum())], pa.int64()) for c, v in zip(names, (sa, sb, saa, sbb, sab), strict=True)}, "s": pa.array([float(s.sum())])})

    dealt = pairs.select("image_id", "y", "x", "a", "b", F.explode(bands).alias("band"))
    parts = dealt.groupBy("image_id", "band").applyInArrow(run, "image_id long, n long, " + ", ".join(f"{c} long" for c in names) + ", s double")
    return parts.groupBy("image_id").agg(F.sum("n").alias("n_windows"), *(F.sum(c).alias(c) for c in names), (F.sum("s") / F.sum("n")).alias("ssim"))
