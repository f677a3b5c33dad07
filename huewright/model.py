"""Data model: images packed in one row, or exploded to one row for each pixel.

images    image_id long, width int, height int, pixels binary   RGBA, 8 bits each, row by row
pixels    image_id long, y int, x int, r int, g int, b int, a int
palettes  palette_id string, idx int, r int, g int, b int       idx from 0, 256 entries at most
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGES = "image_id long, width int, height int, pixels binary"
PIXELS = "image_id long, y int, x int, r int, g int, b int, a int"
MAX_COLOURS = 256

Colours = list[tuple[int, int, int]]


def check_palette(colours: Colours) -> np.ndarray:
    """The palette as an (n, 3) array; an empty or too large one, or values out of 0 to 255, raise ValueError."""
    array = np.asarray(colours, np.int32).reshape(-1, 3)
    if not 0 < len(array) <= MAX_COLOURS:
        raise ValueError(f"a palette has 1 to {MAX_COLOURS} colours, not {len(array)}")
    if array.min() < 0 or array.max() > 255:
        raise ValueError("colour values are 0 to 255")
    return array


def to_array(width: int, height: int, pixels: bytes) -> np.ndarray:
    """(height, width, 4) array of a packed image; a length that doesn't fit raises ValueError."""
    if len(pixels) != 4 * width * height:
        raise ValueError(f"{width} x {height} pixels need {4 * width * height} bytes, not {len(pixels)}")
    return np.frombuffer(pixels, np.uint8).reshape(height, width, 4)


def explode_pixels(images: DataFrame) -> DataFrame:
    """One row for each pixel of packed images; an image without pixels has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, width, height, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                array = to_array(width, height, raw)
                step = max(1, 1_000_000 // max(1, width))  # bands of rows, so that a large image isn't a single batch
                for top in range(0, height if width else 0, step):
                    band = array[top : top + step]
                    n = band.shape[0] * width
                    y = np.repeat(np.arange(top, top + band.shape[0], dtype=np.int32), width)
                    x = np.tile(np.arange(width, dtype=np.int32), band.shape[0])
                    flat = band.reshape(n, 4).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, image_id, np.int64)), pa.array(y), pa.array(x), *(pa.array(np.ascontiguousarray(flat[:, c])) for c in range(4))], names=["image_id", "y", "x", "r", "g", "b", "a"])

    return images.select("image_id", "width", "height", "pixels").mapInArrow(run, PIXELS)


def pack_pixels(pixels: DataFrame) -> DataFrame:
    """Packed images of exploded ones (alpha 255 if there is no such column). A pixel that is missing or there twice raises an error."""
    rows = pixels if "a" in pixels.columns else pixels.withColumn("a", F.lit(255))

    def run(table: pa.Table) -> pa.Table:
        y, x = table["y"].to_numpy(), table["x"].to_numpy()
        height, width = int(y.max()) + 1, int(x.max()) + 1
        at = y.astype(np.int64) * width + x
        if len(at) != width * height or len(np.unique(at)) != len(at):
            raise ValueError(f"image {table['image_id'][0]} isn't a whole {width} x {height} grid of pixels")
        out = np.empty((len(at), 4), np.uint8)
        for c, name in enumerate("rgba"):
            out[at, c] = table[name].to_numpy()
        return pa.table({"image_id": table["image_id"][:1], "width": pa.array([width], pa.int32()), "height": pa.array([height], pa.int32()), "pixels": [out.tobytes()]})

    return rows.select("image_id", "y", "x", "r", "g", "b", "a").groupBy("image_id").applyInArrow(run, IMAGES)
