"""Error diffusion in raster order, exact and vectorised, in bands of rows.

A pixel's value is its source value plus the errors of its sources, taken in raster order. All pixels on a wavefront x + s * y = t depend on
earlier fronts only, where s is one more than the farthest tap to the left in later rows. So a front is computed at once, for all
images of one size in a batch. A band of rows needs nothing of the rows above it but the errors of the last one or two, so a task holds a band at a time, however
large the image or, in multisampling, its enlarged form is. An image is handled by one task; packed images need no shuffle, exploded ones one, by image, and are read
as a stream of sorted rows.

At scale 1 a value is clamped to 0..255 after every single tap; in multisampling it is clamped once, when the pixel is used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import IMAGES, PIXELS, Colours, check_palette, to_array
from .kernels import Kernel, kernel
from .nearest import Remembered
from .resample import Tents

#: Rows of a band, after enlargement, and pixels that are worked on at once.
ROWS, MOST = 1024, 1 << 22


class Diffusion:
    """Palette indices of n images of one width, band by band from the top; `scale` enlarges each pixel that many times in both directions."""

    def __init__(self, search: Remembered, palette: np.ndarray, k: Kernel, n: int, width: int, *, scale: int = 1, clamp_once: bool = False):
        self.search, self.colours, self.clamp_once, self.scale = search, palette.astype(np.float32), clamp_once, scale
        self.n, self.width = n, width * scale
        self.below = max((dy for _, dy, _ in k.taps), default=0)
        self.slope = 1 + max((-dx for dx, dy, _ in k.taps if dy), default=0)
        self.recent = 1 + max((dx + self.slope * dy for dx, dy, _ in k.taps), default=0)
        self.weights = sorted({weight for _, _, weight in k.taps})
        # Sources in raster order, with the places of their shares.
        self.taps = [(dx, dy, self.weights.index(weight)) for dx, dy, weight in sorted(k.taps, key=lambda tap: (-tap[1], -tap[0]))]
        self.divisor = k.divisor
        self.above = np.zeros((self.below, n, self.width, 3), np.float32)  # errors of the last rows, the very last first

    def _shares(self, errors: np.ndarray, out: np.ndarray) -> None:
        """The errors' shares by weight, cut towards zero: exact, as they are quotients of small whole numbers."""
        exact = self.divisor & (self.divisor - 1) == 0
        for share, weight in zip(out, self.weights, strict=True):
            if exact:
                np.multiply(errors, np.float32(weight / self.divisor), out=share)
            else:
                np.multiply(errors, np.float32(weight), out=share)
                share /= np.float32(self.divisor)
            np.trunc(share, out=share)

    def band(self, source: np.ndarray) -> np.ndarray:
        """Indices (n, height * scale, width * scale) of the next rows (n, height, width, 3)."""
        n, width, below, slope, scale = self.n, self.width, self.below, self.slope, self.scale
        height = source.shape[1] * scale
        flat = source.reshape(n, -1, 3)
        if not self.taps:
            found = self.search.search(flat.reshape(-1, 3)).reshape(n, source.shape[1], -1)
            return found.repeat(scale, 1).repeat(scale, 2)
        # Shares of the errors of the last fronts by weight and row; they are zero where a front has no pixel in a row.
        fronts = np.zeros((self.recent, len(self.weights), n, height + below, 3), np.float32)
        old = np.empty((below, len(self.weights), n, width, 3), np.float32)
        for r in range(below):
            self._shares(self.above[r], old[r])
        last = np.concatenate([np.zeros((min(below, height), n, width, 3), np.float32), self.above])[:below]
        out = np.empty((n, height * width), np.int16)
        rows = np.arange(height)
        lines = rows // scale * (width // scale)
        for t in range(-slope * below, width + slope * (height - 1)):
            front = fronts[t % self.recent]
            front[:] = 0
            for r in range(below):
                x = t + slope * (r + 1)
                if 0 <= x < width:
                    front[:, :, below - 1 - r] = old[r, :, :, x]
            top, end = max(0, -((width - 1 - t) // slope)), min(height - 1, t // slope) + 1
            if top >= end or t < 0:
                continue
            # The front's pixels stand in the image at even distances.
            first, step = t + top * (width - slope), width - slope
            at = slice(first, first + (end - top - 1) * step + 1, step) if step > 0 else first + step * rows[: end - top]
            value = flat[:, at if scale == 1 else lines[top:end] + (t - slope * rows[top:end]) // scale].astype(np.float32)
            for dx, dy, j in self.taps:
                value += fronts[(t - dx - slope * dy) % self.recent, j, :, top - dy + below : end - dy + below]
                if not self.clamp_once:
                    np.maximum(value, 0, out=value)
                    np.minimum(value, 255, out=value)
            if self.clamp_once:
                np.maximum(value, 0, out=value)
                np.minimum(value, 255, out=value)
            best = self.search(value.reshape(-1, 3))
            out[:, at] = best.reshape(n, -1)
            value -= self.colours[best].reshape(value.shape)
            self._shares(value, front[:, :, top + below : end + below])
            for r in range(min(below, height)):
                if top <= height - 1 - r < end:
                    last[r, :, t - slope * (height - 1 - r)] = value[:, height - 1 - r - top]
        self.above = last
        return out.reshape(n, height, width)


def _bands(images: np.ndarray, rows: int) -> Iterator[np.ndarray]:
    for top in range(0, images.shape[1], rows):
        yield images[:, top : top + rows]


def diffuse(images: np.ndarray, palette: np.ndarray, k: Kernel, *, clamp_once: bool = False, search: Remembered | None = None, rows: int = 4 * ROWS) -> np.ndarray:
    """Palette indices (n, height, width) of images (n, height, width, 3)."""
    n, height, width = images.shape[:3]
    if not images.size:
        return np.zeros((n, height, width), np.int16)
    work = Diffusion(search or Remembered(palette), palette, k, n, width, clamp_once=clamp_once)
    return np.concatenate([work.band(b) for b in _bands(images, rows)], 1)


class Multisampler:
    """RGBA images dithered at 2 or 4 times their size and filtered down again by tents, alpha included, band by band.

    The enlarged image never exists: a band carries the errors of its last rows to the next one, each tent its last rows, and `at_once` enlarged rows are in colour at a time.
    """

    def __init__(self, search: Remembered, palette: np.ndarray, k: Kernel, scale: int, *, rows: int = ROWS, at_once: int = 64):
        self.search, self.palette, self.k, self.scale = search, palette, k, scale
        self.rows, self.at_once = max(1, rows // scale), max(1, at_once // scale)
        self.colours = palette.astype(np.int16)
        self.tents = [Tents() for _ in range(scale.bit_length() - 1)]
        self.work: Diffusion | None = None

    def feed(self, images: np.ndarray, last: bool) -> Iterator[np.ndarray]:
        """The rows (n, height, width, 4) that are finished by the next rows of the images."""
        n, height, width = images.shape[:3]
        if self.work is None:
            self.work = Diffusion(self.search, self.palette, self.k, n, width, scale=self.scale, clamp_once=True)
        for top in range(0, height, self.rows):
            band = images[:, top : top + self.rows]
            index = self.work.band(band[..., :3])
            for at in range(0, band.shape[1], self.at_once):
                alpha = band[:, at : at + self.at_once, :, 3:].astype(np.int16).repeat(self.scale, 1).repeat(self.scale, 2)
                large = np.concatenate([self.colours[index[:, at * self.scale : (at + self.at_once) * self.scale]], alpha], -1)
                end = last and top + self.rows >= height and at + self.at_once >= band.shape[1]
                for tent in self.tents:
                    large = tent.feed(large, end)
                yield large.astype(np.uint8)


def multisample(images: np.ndarray, palette: np.ndarray, k: Kernel, scale: int, *, search: Remembered | None = None, rows: int = ROWS) -> np.ndarray:
    """What a Multisampler makes of whole images (n, height, width, 4)."""
    if not images.size:
        return images.copy()
    out, at = np.empty(images.shape, np.uint8), 0
    for band in Multisampler(search or Remembered(palette), palette, k, scale, rows=rows).feed(images, True):
        out[:, at : at + band.shape[1]] = band
        at += band.shape[1]
    return out


def _by_size(batch: pa.RecordBatch, most: int = MOST) -> Iterator[tuple[list[int], np.ndarray]]:
    """Rows of a batch with images of the same size, at most about `most` pixels at once."""
    sizes: dict[tuple[int, int], list[int]] = {}
    widths, heights = batch.column(1).to_pylist(), batch.column(2).to_pylist()
    for row, size in enumerate(zip(widths, heights, strict=True)):
        sizes.setdefault(size, []).append(row)
    for (width, height), rows in sizes.items():
        step = max(1, most // max(1, width * height))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            yield some, np.stack([to_array(width, height, batch.column(3)[r].as_py()) for r in some])


def dither_packed(images: DataFrame, palette: Colours, ditherer: str = "fs", *, indices: bool = False, scale: int = 1) -> DataFrame:
    """Packed images recoloured to the palette. indices: pixels hold one palette index each instead. scale: 1, or 2 or 4 to multisample.

    Multisampled colours lie between those of the palette, so they have no indices. Alpha is untouched at scale 1. Empty images stay empty.
    """
    table, k = check_palette(palette), kernel(ditherer)
    if scale not in (1, 2, 4) or indices and scale > 1:
        raise ValueError("scale is 1, 2 or 4, and indices need scale 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Remembered(table)
        for batch in batches:
            out: list[bytes] = [b""] * batch.num_rows
            for rows, arrays in _by_size(batch, max(1, MOST // scale**2)):
                if scale > 1:
                    new = multisample(arrays, table, k, scale, search=search)
                else:
                    index = diffuse(arrays[..., :3], table, k, search=search)
                    new = index.astype(np.uint8) if indices else np.concatenate([table.astype(np.uint8)[index], arrays[..., 3:]], -1)
                for row, x in zip(rows, new, strict=True):
                    out[row] = x.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["image_id", "width", "height", "pixels"])

    return images.select("image_id", "width", "height", "pixels").mapInArrow(run, IMAGES)


def sorted_rows(pixels: DataFrame) -> DataFrame:
    """Exploded images dealt by image and sorted by row and column within each task (alpha 255 if there is no such column): one shuffle."""
    rows = pixels if "a" in pixels.columns else pixels.withColumn("a", F.lit(255))
    return rows.select("image_id", "y", "x", "r", "g", "b", "a").repartition("image_id").sortWithinPartitions("image_id", "y", "x")


def image_rows(batches: Iterator[pa.RecordBatch], most: int = MOST // 4) -> Iterator[tuple[int, int, np.ndarray, bool]]:
    """(image_id, top, rows (height, width, 4), last) of sorted_rows(): bands of about `most` pixels at most, whole rows each, so a task holds no whole image.

    A pixel that is missing or there twice raises ValueError.
    """
    pieces: list[np.ndarray] = []  # y, x, r, g, b, a of the pixels of an image that aren't given yet
    image, count, width, top = 0, 0, 0, 0

    def grid(rows: np.ndarray) -> np.ndarray:
        height = len(rows) // width
        want = np.arange(len(rows))
        if height * width != len(rows) or (rows[:, 0] != top + want // width).any() or (rows[:, 1] != want % width).any():
            raise ValueError(f"image {image} isn't a whole grid of pixels {width} wide")
        return rows[:, 2:].astype(np.uint8).reshape(height, width, 4)

    def measured(rows: np.ndarray) -> int:
        return int(np.argmax(rows[:, 0] != rows[0, 0])) or len(rows)

    for batch in batches:
        ids = batch.column(0).to_numpy()
        new = np.stack([c.to_numpy() for c in batch.columns[1:]], 1)
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if pieces and ids[a] != image:
                rows = np.concatenate(pieces)
                width = width or measured(rows)
                yield image, top, grid(rows), True
                pieces, count, width, top = [], 0, 0, 0
            image = int(ids[a])
            pieces.append(new[a:b])
            count += b - a
            if count >= most:
                rows = np.concatenate(pieces)
                width = width or (measured(rows) if rows[-1, 0] != rows[0, 0] else 0)
                n = (len(rows) - 1) // width * width if width else 0  # the last row comes with the image's end
                if n:
                    yield image, top, grid(rows[:n]), False
                    top += n // width
                pieces, count = [rows[n:]], len(rows) - n
    if pieces:
        rows = np.concatenate(pieces)
        width = width or measured(rows)
        yield image, top, grid(rows), True


def _stream(batches: Iterator[pa.RecordBatch], one_size, begin, scale: int) -> Iterator[tuple[list[int], int, np.ndarray]]:
    """(image ids, top, result) of rows in order: small images of one size go together to one_size(), larger ones band by band through what begin() gives."""
    ids: list[int] = []
    small: list[np.ndarray] = []
    large = None

    def flush() -> Iterator[tuple[list[int], int, np.ndarray]]:
        if ids:
            yield ids[:], 0, one_size(np.stack(small))
        ids.clear()
        small.clear()

    for image_id, top, rows, last in image_rows(batches):
        if top == 0 and last:
            if small and (small[0].shape != rows.shape or sum(x.size for x in small) > max(1, MOST // scale**2)):
                yield from flush()
            ids.append(image_id)
            small.append(rows)
            continue
        yield from flush()
        large = begin() if large is None else large
        for at, found in large(rows, last):
            yield [image_id], at, found
        large = None if last else large
    yield from flush()


def _pixel_batches(ids: list[int], top: int, found: np.ndarray, names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Rows of (images, height, width, channels) as exploded pixels, an image or some of its rows at a time."""
    n, height, width = found.shape[:3]
    step = max(1, 1_000_000 // max(1, width))
    for k, image_id in enumerate(ids):
        for at in range(0, height, step):
            part = found[k, at : at + step]
            m = part.shape[0] * width
            y = np.repeat(np.arange(top + at, top + at + part.shape[0], dtype=np.int32), width)
            x = np.tile(np.arange(width, dtype=np.int32), part.shape[0])
            flat = part.reshape(m, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, image_id, np.int64)), pa.array(y), pa.array(x), *(pa.array(np.ascontiguousarray(flat[:, c])) for c in range(len(names)))], names=["image_id", "y", "x", *names])


def streamed(batches: Iterator[pa.RecordBatch], table: np.ndarray, k: Kernel, scale: int, indices: bool) -> Iterator[pa.RecordBatch]:
    """Exploded rows of the images whose sorted_rows() come in, dithered."""
    search = Remembered(table)

    def coloured(index: np.ndarray, images: np.ndarray) -> np.ndarray:
        return index[..., None] if indices else np.concatenate([table.astype(np.uint8)[index], images[..., 3:]], -1)

    def one_size(images: np.ndarray) -> np.ndarray:
        return multisample(images, table, k, scale, search=search) if scale > 1 else coloured(diffuse(images[..., :3], table, k, search=search), images)

    def begin():
        work, done = None, 0

        def feed(rows: np.ndarray, last: bool) -> Iterator[tuple[int, np.ndarray]]:
            nonlocal work, done
            work = work or (Multisampler(search, table, k, scale) if scale > 1 else Diffusion(search, table, k, 1, rows.shape[1]))
            for found in work.feed(rows[None], last) if scale > 1 else (coloured(work.band(b[..., :3]), b) for b in _bands(rows[None], ROWS)):
                yield done, found
                done += found.shape[1]

        return feed

    for ids, top, found in _stream(batches, one_size, begin, scale):
        yield from _pixel_batches(ids, top, found, ("idx",) if indices else ("r", "g", "b", "a"))


def _dithered(pixels: DataFrame, palette: Colours, ditherer: str, scale: int, indices: bool) -> DataFrame:
    table, k = check_palette(palette), kernel(ditherer)
    if scale not in (1, 2, 4):
        raise ValueError("scale is 1, 2 or 4")
    return sorted_rows(pixels).mapInArrow(lambda batches: streamed(batches, table, k, scale, indices), "image_id long, y int, x int, idx int" if indices else PIXELS)


def dither(pixels: DataFrame, palette: Colours, ditherer: str = "fs", *, scale: int = 1) -> DataFrame:
    """Exploded images recoloured: image_id, y, x, r, g, b, a. One shuffle brings the rows of an image together, in order; a task holds a band of them at a time."""
    return _dithered(pixels, palette, ditherer, scale, False)


def dither_indices(pixels: DataFrame, palette: Colours, ditherer: str = "fs") -> DataFrame:
    """Exploded images as palette indices: image_id, y, x, idx. Rows are streamed as in dither()."""
    return _dithered(pixels, palette, ditherer, 1, True)
