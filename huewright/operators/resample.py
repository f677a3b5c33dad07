"""Replicating upsampling and tent filters.

Output (x, y) of a tent is (sum of wj * wi * hi[2y - 1 + j][2x - 1 + i] + 32) div 64 with w = 1, 3, 3, 1 and coordinates clamped to the edge.
`tent` works on arrays and `Tents` on rows that come in bands. Exploded images are cut into bands of rows, each with the edge rows of its neighbours: one shuffle brings a band together, which
then goes through both tents, twice for a quarter of the size. The window forms are plain SQL.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHANNELS = ("r", "g", "b", "a")


def tent(images: np.ndarray) -> np.ndarray:
    """Images (n, 2h, 2w, c) to (n, h, w, c)."""
    padded = np.pad(images.astype(np.int32), ((0, 0), (1, 1), (1, 1), (0, 0)), mode="edge")
    n = padded.shape[2]
    rows = padded[:, :, 0 : n - 2 : 2] + 3 * padded[:, :, 1 : n - 1 : 2] + 3 * padded[:, :, 2:n:2]
    rows[:, :, :] += padded[:, :, 3::2]
    m = padded.shape[1]
    return (rows[:, 0 : m - 2 : 2] + 3 * rows[:, 1 : m - 1 : 2] + 3 * rows[:, 2:m:2] + rows[:, 3::2] + 32) // 64


class Tents:
    """tent() for rows that come in bands: the row sums that later rows need are carried."""

    def __init__(self) -> None:
        self.sums: np.ndarray | None = None

    def feed(self, rows: np.ndarray, end: bool) -> np.ndarray:
        """Finished rows (n, k, w, c) after the next rows (n, h, 2w, c) of 0 to 255; `end` says that they are the last."""
        # Weights add up to 64 and values are at most 255, so 16 bits do.
        x = np.pad(rows.astype(np.int16), ((0, 0), (0, 0), (1, 1), (0, 0)), mode="edge")
        sums = x[:, :, 1:-2:2] + x[:, :, 2:-1:2]
        sums *= 3
        sums += x[:, :, 0:-3:2]
        sums += x[:, :, 3::2]
        before = sums[:, :1] if self.sums is None else self.sums
        held = np.concatenate([before, sums, *([sums[:, -1:]] if end and sums.shape[1] else [])], 1)
        if end and not sums.shape[1]:
            held = np.concatenate([held, held[:, -1:]], 1)
        n = max(0, held.shape[1] - 2) // 2
        out = held[:, 1 : 2 * n : 2] + held[:, 2 : 2 * n + 1 : 2]
        out *= 3
        out += held[:, 0 : 2 * n - 1 : 2] if n else 0
        out += held[:, 3 : 2 * n + 2 : 2]
        out += 32
        out >>= 6
        self.sums = held[:, 2 * n :]
        return out


def upsample(pixels: DataFrame, scale: int) -> DataFrame:
    """Each pixel repeated scale times in both directions."""
    steps = F.sequence(F.lit(0), F.lit(scale - 1))
    rows = pixels.withColumn("__j", F.explode(steps)).withColumn("__i", F.explode(steps))
    return rows.withColumns({"y": (F.col("y") * scale + F.col("__j")).cast("int"), "x": (F.col("x") * scale + F.col("__i")).cast("int")}).drop("__j", "__i")


def _taps(channel: str, window) -> Column:
    c = F.col(channel)
    after = F.coalesce(F.lead(c, 1).over(window), c)
    return F.coalesce(F.lag(c, 1).over(window), c) + 3 * c + 3 * after + F.coalesce(F.lead(c, 2).over(window), after)


def tent_horizontal(pixels: DataFrame, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Unnormalised sums over columns 2x - 1 to 2x + 2."""
    window = Window.partitionBy("image_id", "y").orderBy("x")
    sums = pixels.select("image_id", "y", "x", *(_taps(c, window).alias(c) for c in channels))
    return sums.where("x % 2 = 0").withColumn("x", (F.col("x") / 2).cast("int"))


def tent_vertical(sums: DataFrame, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Values from the horizontal sums of rows 2y - 1 to 2y + 2."""
    window = Window.partitionBy("image_id", "x").orderBy("y")
    new = sums.select("image_id", "y", "x", *(F.floor((_taps(c, window) + 32) / 64).cast("int").alias(c) for c in channels))
    return new.where("y % 2 = 0").withColumn("y", (F.col("y") / 2).cast("int"))


def _finished(rows: np.ndarray, first: int, begin: int, end: int, scale: int, last: bool) -> np.ndarray:
    """Rows begin to end of the result from the rows (h, w, c) of a band that starts at row `first` of the image; `last` says that the image ends with it."""
    while scale > 1:
        # Row k of the next size needs rows 2k - 1 to 2k + 2: at the image's edges they are the edge rows again.
        top = 0 if first == 0 else (first + 2) // 2
        from_ = rows[max(0, 2 * top - 1 - first) :]
        if first == 0:
            from_ = np.concatenate([rows[:1], rows])
        if last:
            from_ = np.concatenate([from_, from_[-1:]])
        n = (len(from_) - 2) // 2
        across = np.pad(from_.astype(np.int32), ((0, 0), (1, 1), (0, 0)), mode="edge")
        sums = across[:, 0:-3:2] + 3 * (across[:, 1:-2:2] + across[:, 2:-1:2]) + across[:, 3::2]
        rows = (sums[0 : 2 * n - 1 : 2] + 3 * (sums[1 : 2 * n : 2] + sums[2 : 2 * n + 1 : 2]) + sums[3 : 2 * n + 2 : 2] + 32) // 64
        first, scale = top, scale // 2
    return rows[begin - first : end - first]


def downsample(pixels: DataFrame, channels: tuple[str, ...] = CHANNELS, scale: int = 2, rows: int = 64) -> DataFrame:
    """A half or a quarter of the size by both tents. Bands hold `rows` rows of the result; a band's edge rows go to its neighbours too, scale - 1 at each side: one shuffle.

    Images whose sizes aren't multiples of the scale, or that lack pixels, raise ValueError.
    """
    if scale not in (2, 4):
        raise ValueError("scale is 2 or 4")
    high, edge = rows * scale, scale - 1
    band, at = F.floor(F.col("y") / high).cast("int"), F.col("y") % high
    bands = F.array_compact(F.array(band, F.when(at < edge, band - 1), F.when(at >= high - edge, band + 1)))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        image, b = key[0].as_py(), key[1].as_py()
        y, x = table["y"].to_numpy(), table["x"].to_numpy()
        order = np.lexsort((x, y))
        y, x = y[order], x[order]
        first, last, width = int(y[0]), int(y[-1]), int(x.max()) + 1
        begin, end = b * rows, min((b + 1) * rows, (last + 1) // scale)
        if b < 0 or begin >= end:
            return pa.table({"image_id": pa.array([], pa.int64()), **{c: pa.array([], pa.int32()) for c in ("y", "x", *channels)}})
        height = last - first + 1
        want = np.arange(len(y))
        ends = last < (b + 1) * high + edge - 1  # rows of the next band would follow
        if len(y) != height * width or width % scale or (y != first + want // width).any() or (x != want % width).any() or ends and (last + 1) % scale:
            raise ValueError(f"image {image} isn't a whole grid of pixels whose sizes are multiples of {scale}")
        values = np.stack([table[c].to_numpy()[order] for c in channels], 1).reshape(height, width, len(channels))
        out = _finished(values, first, begin, end, scale, ends)
        n, w = out.shape[:2]
        columns = {c: pa.array(np.ascontiguousarray(out[..., k]).ravel().astype(np.int32)) for k, c in enumerate(channels)}
        return pa.table({"image_id": pa.array(np.full(n * w, image, np.int64)), "y": pa.array(np.repeat(np.arange(begin, begin + n, dtype=np.int32), w)), "x": pa.array(np.tile(np.arange(w, dtype=np.int32), n)), **columns})

    dealt = pixels.select("image_id", "y", "x", *channels, F.explode(bands).alias("band"))
    return dealt.groupBy("image_id", "band").applyInArrow(run, "image_id long, y int, x int, " + ", ".join(f"{c} int" for c in channels))
