"""Exact nearest colour: least squared distance in sRGB, the lowest index on ties.

`nearest` runs over Arrow batches and is the default. The other two pack distance and index in one integer, so one minimum finds both: `nearest_unrolled` is one
flat expression for palettes of about a dozen colours; `nearest_of_array` serves rows that carry their own palettes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..model import Colours, check_palette
from ..storage import written


def searcher(palette: np.ndarray, at_once: int = 4096):
    """A function from (n, 3) colours to the indices of their nearest palette colours.

    |p|^2 - 2 v.p orders the palette as the distance does. All terms are whole numbers under 2^24, so single precision is exact, and
    argmin takes the lowest index on ties. Rows are taken in parts that stay in the processor's cache.
    """
    p = palette.astype(np.float32)
    factor, start = np.ascontiguousarray(-2 * p.T), (p * p).sum(1)

    def search(colours: np.ndarray) -> np.ndarray:
        out = np.empty(len(colours), np.int32)
        for at in range(0, len(colours), at_once):
            score = colours[at : at + at_once].astype(np.float32, copy=False) @ factor
            score += start
            out[at : at + at_once] = score.argmin(1)
        return out

    return search


class Remembered:
    """A searcher for whole colours 0 to 255 that looks each colour up once: a table of all 2^24, whose pages come into being as they are used."""

    def __init__(self, palette: np.ndarray):
        self.search = searcher(palette)
        self.table = np.zeros(1 << 24, np.int16)  # index + 1
        self.weights = np.array([65536, 256, 1], np.float32)

    def __call__(self, colours: np.ndarray) -> np.ndarray:
        """Indices of (n, 3) colours in single precision (a key is under 2^24, so it is exact)."""
        key = (colours @ self.weights).astype(np.int32)
        found = self.table[key]
        if not found.all():
            new = np.flatnonzero(found == 0)
            found[new] = self.table[key[new]] = self.search(colours[new]) + 1
        return found - 1


def nearest_indices(colours: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """Index of the nearest palette colour for each row of an (n, 3) array."""
    return searcher(palette)(colours)


def nearest(pixels: DataFrame, palette: Colours, *, column: str = "idx") -> DataFrame:
    """pixels with the index of the nearest palette colour of r, g, b."""
    table = check_palette(palette)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rgb = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in "rgb"], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest_indices(rgb, table), pa.int32())], names=[*batch.schema.names, column])

    if column in pixels.columns:
        raise ValueError(f"there is a column {column} already")
    return pixels.mapInArrow(run, StructType([*pixels.schema.fields, StructField(column, IntegerType())]))


def _packed(r: Column, g: Column, b: Column, pr, pg, pb, k) -> Column:
    return ((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)) * 256 + k


def nearest_unrolled(palette: Colours, r: str = "r", g: str = "g", b: str = "b") -> Column:
    """The index as one expression over literals."""
    keys = [_packed(F.col(r), F.col(g), F.col(b), *map(int, p), k) for k, p in enumerate(check_palette(palette).tolist())]
    return (F.least(*keys) if len(keys) > 1 else keys[0]).bitwiseAND(255)


def nearest_of_array(palette: Column, r: str = "r", g: str = "g", b: str = "b") -> Column:
    """The index for a column that holds each row's palette as array<struct<r,g,b>>; null where that is empty."""
    key = lambda p, k: _packed(F.col(r), F.col(g), F.col(b), p["r"], p["g"], p["b"], k)
    return F.array_min(F.transform(palette, key)).bitwiseAND(255)


#: Tasks that share the cells out: their work is counted in cells and colours, not in bytes.
CELL_TASKS = 64


def _corners(cells: np.ndarray, bits: int) -> np.ndarray:
    """The least r, g and b of cells (upper bits of r, g and b in one number)."""
    return np.stack([cells >> 2 * bits, cells >> bits & (1 << bits) - 1, cells & (1 << bits) - 1], 1).astype(np.int64) << 8 - bits


def _least(low: np.ndarray, side: int, colours: np.ndarray, reach: int = 1) -> np.ndarray:
    """Least squared distance of cells to colours, or to boxes of `reach` values that begin there."""
    return (np.maximum(np.maximum(low - colours - (reach - 1), colours - (low + side - 1)), 0) ** 2).sum(-1)


def _greatest(low: np.ndarray, side: int, colours: np.ndarray, reach: int = 1) -> np.ndarray:
    """Greatest squared distance of cells to colours, or to boxes of `reach` values that begin there."""
    return (np.maximum(np.abs(colours + (reach - 1) - low), np.abs(low + side - 1 - colours)) ** 2).sum(-1)


def _near_cells(filled: np.ndarray, bits: int) -> dict[int, np.ndarray]:
    """For each filled cell the cells for which it can hold a colour that is the nearest of one of their points."""
    side, cells = 1 << 8 - bits, np.arange(1 << 3 * bits)
    low, boxes = _corners(cells, bits), _corners(filled, bits)
    out: list[list[np.ndarray]] = [[] for _ in filled]
    for at in range(0, len(cells), 64):  # 64 times the filled cells at once
        some = low[at : at + 64, None]
        near = _least(some, side, boxes, side) <= _greatest(some, side, boxes, side).min(1)[:, None]
        of, cell = np.nonzero(near.T)
        for k, part in zip(*np.unique(of, return_index=True), strict=True):
            out[k].append(cells[at : at + 64][cell[part : part + np.count_nonzero(near[:, k])]])
    return {int(q): np.concatenate(x) for q, x in zip(filled, out, strict=True) if x}


def nearest_in_cell(low: np.ndarray, side: int, colours: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The index of the nearest colour of each point of a cell, r by g by b; the lowest index on ties.

    Squared distances are sums over the channels, so the least one is found channel by channel: over the colours of equal r and g, then over those of equal r, then over all.
    Distance and index are packed in one integer, so one minimum finds both.
    """
    order = np.lexsort((colours[:, 1], colours[:, 0]))
    colours, key = colours[order], index[order].astype(np.int64) + (1 << 31)
    far = lambda channel: (colours[:, channel, None] - (low[channel] + np.arange(side))) ** 2 << 32
    new_r = np.diff(colours[:, 0], prepend=-1) != 0
    starts = np.flatnonzero(new_r | (np.diff(colours[:, 1], prepend=-1) != 0))
    by_b = np.minimum.reduceat(far(2) + key[:, None], starts, axis=0)
    far_g, firsts = far(1)[starts], np.flatnonzero(new_r[starts])
    far_r = far(0)[starts][firsts]
    best = None
    for row, (a, b) in enumerate(zip(firsts, [*firsts[1:], len(starts)], strict=True)):
        plane = (by_b[a:b, None, :] + far_g[a:b, :, None]).min(0)
        whole = far_r[row][:, None, None] + plane
        best = whole if best is None else np.minimum(best, whole, out=best)
    return ((best & (1 << 32) - 1) - (1 << 31)).astype(np.int32).ravel()


def nearest_many(pixels: DataFrame, palette: DataFrame, *, bits: int = 4, most: int = 1 << 24, column: str = "idx") -> DataFrame:
    """pixels with the index of the nearest colour of a large palette (idx, r, g, b), the lowest index on ties, and n_candidates, the colours that can be the nearest of a point of the pixel's cell.

    RGB space is cut into cells (2^bits to a side; 3 to 6 bits). A colour can't be the nearest of a cell's points if its least distance to the cell is more than another's greatest; the others are sent to the cell,
    which finds the nearest one of each of its points, channel by channel. The palette stays distributed, a cell at a time (its colours are all different, so 2^24 at most in all, which `most` can lower; more raise ValueError,
    as do none); of equal colours the first one counts. What is sent to all tasks is the table of the indices of all points, 64 MB however large palette and pixels are.
    """
    if column in pixels.columns or "n_candidates" in pixels.columns:
        raise ValueError(f"there is a column {column} or n_candidates already")
    if not 3 <= bits <= 6:
        raise ValueError("bits are 3 to 6")
    side, spark = 1 << 8 - bits, pixels.sparkSession
    cell = sum(F.shiftright(F.col(c), 8 - bits) * (1 << k * bits) for k, c in ((1, "g"), (0, "b"))) + F.shiftright("r", 8 - bits) * (1 << 2 * bits)
    first = palette.groupBy("r", "g", "b").agg(F.min("idx").cast("int").alias("idx"))
    colours = written(first.select(cell.cast("int").alias("cell"), *(F.col(c).cast("int").alias(c) for c in ("r", "g", "b", "idx"))).repartition(CELL_TASKS, "cell").sortWithinPartitions("cell"))
    sound = F.col("idx").isNotNull()
    for c in "rgb":
        sound = sound & F.coalesce(F.col(c).between(0, 255), F.lit(False))
    n, odd = colours.agg(F.count(F.lit(1)), F.count_if(~sound)).first()
    if not 0 < n <= most:
        raise ValueError(f"a palette has 1 to {most} different colours")
    if odd:
        raise ValueError("colour values are 0 to 255, indices aren't null")
    near = _near_cells(np.array([r.cell for r in colours.select("cell").distinct().collect()], np.int64), bits)  # 2^(3 bits) cells at most

    def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(some of the cells nearby, colours, indices) of the colours of a cell."""
        for batch in batches:
            x = np.stack([c.to_numpy() for c in batch.columns], 1).astype(np.int64)
            for part in np.split(x, np.flatnonzero(np.diff(x[:, 0])) + 1):
                cells = near.get(int(part[0, 0]), ()) if len(part) else ()
                step = max(1, 200_000 // max(1, len(part)))
                for at in range(0, len(cells), step):
                    yield cells[at : at + step], part[:, 1:4], part[:, 4]

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells, rgb, _ in by_cell(batches):
            bound = _greatest(_corners(cells, bits)[:, None], side, rgb).min(1)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(bound, pa.int64())], names=["cell", "bound"])

    bound = np.zeros(1 << 3 * bits, np.int64)
    for r in colours.mapInArrow(bounds, "cell int, bound long").groupBy("cell").agg(F.min("bound").alias("bound")).collect():  # a number for each cell
        bound[r.cell] = r.bound

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells, rgb, index in by_cell(batches):
            packed = np.concatenate([rgb, index[:, None]], 1).astype(np.int32)
            here = _least(_corners(cells, bits)[:, None], side, rgb) <= bound[cells, None]
            some = here.any(1)
            yield pa.RecordBatch.from_arrays([pa.array(cells[some], pa.int32()), pa.array([packed[k].tobytes() for k in here[some]], pa.binary())], names=["cell", "colours"])

    def search(table: pa.Table) -> pa.Table:
        """The tables of a few cells."""
        table = table.sort_by("cell")
        of, starts = np.unique(table["cell"].to_numpy(), return_index=True)
        found, sizes = [], []
        for low, a, b in zip(_corners(of, bits), starts, [*starts[1:], table.num_rows], strict=True):
            x = np.frombuffer(b"".join(table["colours"].slice(a, b - a).to_pylist()), np.int32).reshape(-1, 4)
            found.append(nearest_in_cell(low, side, x[:, :3].astype(np.int64), x[:, 3]))
            sizes.append(len(x))
        return pa.table({"_cell": pa.array(of, pa.int32()), "_nearest": pa.array(found, pa.list_(pa.int32())), "n_candidates": pa.array(sizes, pa.int32())})

    lists = colours.mapInArrow(deal, "cell int, colours binary").withColumn("few", F.shiftright("cell", 3)).repartition(CELL_TASKS, "few").groupBy("few")
    tables = written(lists.applyInArrow(search, "_cell int, _nearest array<int>, n_candidates int"))
    place = sum((F.col(c) % side * side**k for k, c in ((1, "g"), (0, "b"))), F.col("r") % side * side**2)
    joined = pixels.withColumn("_cell", cell.cast("int")).join(F.broadcast(tables), "_cell")
    return joined.select(*pixels.columns, F.get("_nearest", place.cast("int")).alias(column), "n_candidates")


def lookup(pixels: DataFrame, palette: Colours, *, column: str = "idx") -> DataFrame:
    """pixels with r, g, b set to the palette's colour at the index; other columns, alpha among them, stay."""
    table = check_palette(palette)
    return pixels.withColumns({c: F.element_at(F.lit(table[:, k].tolist()), F.col(column) + 1).cast("int") for k, c in enumerate("rgb")})


def recolour(pixels: DataFrame, palette: Colours) -> DataFrame:
    """pixels with r, g, b replaced by the nearest palette colour, without dithering; alpha is untouched."""
    return lookup(nearest(pixels, palette), palette).drop("idx")


def recolour_distinct(pixels: DataFrame, palette: Colours) -> DataFrame:
    """recolour() for images of few distinct colours: one search for each, joined back."""
    found = nearest(pixels.select("r", "g", "b").distinct(), palette)
    return lookup(pixels.join(found, ["r", "g", "b"]), palette).drop("idx").select(*pixels.columns)


def squared_error(pixels: DataFrame, palette: Colours) -> DataFrame:
    """(image_id, n_pixels, sse): integer squared error of recolouring; PSNR follows from it."""
    found = nearest(pixels, palette)
    new = lookup(found.withColumns({f"{c}0": F.col(c) for c in "rgb"}), palette)
    error = sum(((F.col(c) - F.col(f"{c}0")) * (F.col(c) - F.col(f"{c}0")) for c in "gb"), (F.col("r") - F.col("r0")) * (F.col("r") - F.col("r0")))
    return new.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_pixels"), F.sum(error.cast("long")).alias("sse"))


def psnr(errors: DataFrame) -> DataFrame:
    """errors of squared_error() with psnr in dB, null where there is no error."""
    return errors.withColumn("psnr", F.when(F.col("sse") > 0, 10 * F.log10(255.0 * 255.0 * 3 * F.col("n_pixels") / F.col("sse"))))
