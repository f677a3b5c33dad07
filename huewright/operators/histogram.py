"""Adaptive octree histogram in RGB.

A cell at level L is the L upper bits of each channel. The histogram of an image uses the finest of the levels 0 to 8 with no more
than `threshold` cells that aren't empty. Pixels are first counted by colour, with partial sums in each task, and all else works on those counts.

Colours are keyed by their bits interleaved (Morton order), so a cell of any level is a prefix of the key. The colours are dealt by ranges of (image, key) and sorted: two
neighbours part at the first level whose prefixes differ, and an image has as many cells at a level as there are neighbours parted there or before, and one. One pass so counts the cells of all
levels; the neighbours that ranges part are mended from the ranges' ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.colour import rgb_to_oklab
from ..storage import written

LEVELS = 8
#: Images with 1 / HOT of all colours are sent to all tasks: at most HOT of them.
HOT = 1000
THRESHOLD = 1 << 18


def morton(r: Column, g: Column, b: Column) -> Column:
    """A colour's key of 24 bits: those of r, g and b interleaved."""
    key = F.lit(0)
    for bit in range(LEVELS):
        for shift, c in ((2, r), (1, g), (0, b)):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(c, bit).bitwiseAND(1), 3 * bit + shift))
    return key


def cell_of(key: Column, level: Column) -> Column:
    """Number of the cell of a key at a level."""
    return F.call_function("shiftright", key, (F.lit(3 * LEVELS) - 3 * level).cast("int")).cast("long")


def cell(r: Column, g: Column, b: Column, level: Column) -> Column:
    """Number of a colour's cell: the upper `level` bits of each channel, interleaved."""
    return cell_of(morton(r, g, b), level)


def colour_counts(pixels: DataFrame) -> DataFrame:
    """(image_id, key, r, g, b, n)."""
    counts = pixels.groupBy("image_id", "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("image_id", morton(F.col("r"), F.col("g"), F.col("b")).alias("key"), "r", "g", "b", "n")


def parted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """First level at which the cells of different keys differ."""
    return LEVELS - (np.frexp((a ^ b).astype(np.float64))[1] - 1) // 3


def level_counts(counts: DataFrame) -> DataFrame:
    """(image_id, level, n_cells) for the levels 0 to 8, from colour counts, in one pass over sorted keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(image_id, level, n): neighbours parted at a level; and the ends of the range, without a level, by their keys in n, numbered by range."""
        part = TaskContext.get().partitionId()
        begin = end = None
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(ids):
                continue
            if begin is None:
                begin = (ids[0], keys[0])
            else:
                ids, keys = np.concatenate([[end[0]], ids]), np.concatenate([[end[1]], keys])
            end = (ids[-1], keys[-1])
            same = ids[1:] == ids[:-1]
            at, n = np.unique(np.stack([ids[1:][same], parted(keys[1:][same], keys[:-1][same])]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_pydict({"image_id": pa.array(at[0], pa.int64()), "level": pa.array(at[1], pa.int32()), "n": pa.array(n, pa.int64()), "range": pa.nulls(len(n), pa.int32())})
            first = np.flatnonzero(np.concatenate([[len(ids) == batch.num_rows], ids[1:] != ids[:-1]]))
            # Each image that begins here has one cell at level 0.
            yield pa.RecordBatch.from_pydict({"image_id": pa.array(ids[first], pa.int64()), "level": pa.array([0] * len(first), pa.int32()), "n": pa.array([1] * len(first), pa.int64()), "range": pa.nulls(len(first), pa.int32())})
        if begin is not None:
            yield pa.RecordBatch.from_pydict({"image_id": pa.array([begin[0], end[0]], pa.int64()), "level": pa.nulls(2, pa.int32()), "n": pa.array([begin[1], end[1]], pa.int64()), "range": pa.array([2 * part, 2 * part + 1], pa.int32())})

    keys = counts.select("image_id", "key").repartitionByRange("image_id", "key").sortWithinPartitions("image_id", "key")
    found = written(keys.mapInArrow(run, "image_id long, level int, n long, range int"))
    # Two rows for each range: an image that goes on over a border was begun once too often and is parted there.
    border = Window.partitionBy(F.lit(0)).orderBy("range")
    ends = found.where("range is not null").withColumns({"last_id": F.lag("image_id").over(border), "last_n": F.lag("n").over(border)}).where("range % 2 = 0 and last_id = image_id")
    top = F.floor(F.log2(F.col("n").bitwiseXOR(F.col("last_n")).cast("double"))).cast("int")
    mended = ends.select("image_id", F.explode(F.array(F.struct(F.lit(0).alias("level"), F.lit(-1).cast("long").alias("n")), F.struct((F.lit(LEVELS) - F.floor(top / 3)).cast("int").alias("level"), F.lit(1).cast("long").alias("n")))).alias("x")).select("image_id", "x.level", "x.n")
    steps = found.where("range is null").select("image_id", "level", "n").union(mended)
    per = steps.groupBy("image_id").agg(*(F.coalesce(F.sum(F.when(F.col("level") <= k, F.col("n"))), F.lit(0)).alias(f"c{k}") for k in range(LEVELS + 1)))
    return per.select("image_id", F.posexplode(F.array(*(f"c{k}" for k in range(LEVELS + 1)))).alias("level", "n_cells"))


def histogram(pixels: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(image_id, level, bin, n, sum_r, sum_g, sum_b) at each image's level."""
    counts = written(colour_counts(pixels))
    levels = level_counts(counts).groupBy("image_id").agg(F.max(F.when(F.col("n_cells") <= threshold, F.col("level"))).alias("level"), F.max("n_cells").alias("colours"))
    levels = written(levels.where("level is not null"))
    hot = HOT * F.col("colours") >= F.lit(levels.agg(F.sum("colours")).first()[0] or 0)
    few = F.broadcast(levels.where(hot))
    # An image of many colours would be one key of the join.
    rows = counts.join(few, "image_id").union(counts.join(F.broadcast(levels.where(hot).select("image_id")), "image_id", "left_anti").join(levels.where(~hot), "image_id"))
    rows = rows.withColumn("bin", cell_of(F.col("key"), F.col("level")))
    return rows.groupBy("image_id", "level", "bin").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("long") * F.col("n")).alias(f"sum_{c}") for c in "rgb"))


def oklab_bins(bins: DataFrame) -> DataFrame:
    """(image_id, bin, l, a, b, w): the mean colour of each bin in OKLab and its weight."""
    mean = [F.col(f"sum_{c}") / F.col("n") for c in "rgb"]
    return bins.select("image_id", "bin", *(x.alias(c) for x, c in zip(rgb_to_oklab(*mean), ("l", "a", "b"), strict=True)), F.col("n").cast("double").alias("w"))


def moments(rows: DataFrame, by: list[str], weight: str, axes: tuple[str, str, str]) -> DataFrame:
    """Weighted means and the six scatter sums (not divided by the weight) about them."""
    w = F.col(weight)
    total = F.sum(w)
    sums = {c: F.sum(w * F.col(c)) for c in axes}
    pairs = [(x, y) for k, x in enumerate(axes) for y in axes[k:]]
    found = rows.groupBy(*by).agg(total.alias("w"), *(s.alias(f"s_{c}") for c, s in sums.items()), *(F.sum(w * F.col(x) * F.col(y)).alias(f"s_{x}_{y}") for x, y in pairs))
    means = [F.when(F.col("w") != 0, F.col(f"s_{c}") / F.col("w")).otherwise(0.0).alias(f"mean_{c}") for c in axes]
    scatter = [F.when(F.col("w") != 0, F.col(f"s_{x}_{y}") - F.col(f"s_{x}") * F.col(f"s_{y}") / F.col("w")).otherwise(0.0).alias(f"cov_{x}_{y}") for x, y in pairs]
    return found.select(*by, "w", *means, *scatter)
