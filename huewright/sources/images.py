"""Images from and to files.

The format of an input is told from its content: PNG files are decoded here, others by Spark's own image reader (JPEG, GIF, BMP), whose
bytes are in the order blue, green, red. Files are written by tasks through Spark's binary columns or one by one to a local folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import IMAGES, Colours, check_palette, to_array
from ..operators.dither import dither_packed
from . import png, rasters

#: Encoders of RGB files by the ending of their names.
FORMATS = {"png": png.encode_rgb, "bmp": rasters.encode_bmp, "ppm": rasters.encode_ppm}


def decode_files(files: DataFrame) -> DataFrame:
    """(path, width, height, pixels, error) of rows (path, content) with PNG files; a file that isn't sound has an error and no pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"path": batch.column(0).to_pylist(), "width": [], "height": [], "pixels": [], "error": []}
            for content in batch.column(1).to_pylist():
                try:
                    array, error = png.decode(content or b""), None
                except ValueError as e:
                    array, error = None, str(e)
                out["width"].append(None if array is None else array.shape[1])
                out["height"].append(None if array is None else array.shape[0])
                out["pixels"].append(None if array is None else array.tobytes())
                out["error"].append(error)
            yield pa.RecordBatch.from_arrays([pa.array(out["path"], pa.string()), pa.array(out["width"], pa.int32()), pa.array(out["height"], pa.int32()), pa.array(out["pixels"], pa.binary()), pa.array(out["error"], pa.string())], names=list(out))

    return files.select("path", "content").mapInArrow(run, "path string, width int, height int, pixels binary, error string")


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, image_id, width, height, pixels, error) of all files under a path; image_id is a hash of the path. A file that no reader can decode has an error and nulls.

    Rows are read with Spark's file sources, so any file system works. PNG files, by content, are decoded here, all others by Spark's image reader.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    is_png = F.substring("content", 1, 8) == F.lit(bytearray(png.SIGNATURE))
    own = decode_files(files.where(is_png))
    place = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    known = files.where(is_png).select(place("path").alias("place"))
    other = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(path).select("image.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"path": batch.column(0).to_pylist(), "width": [], "height": [], "pixels": [], "error": []}
            for width, height, channels, raw in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                sound = width > 0 and height > 0 and channels in (1, 3, 4)
                out["width"].append(width if sound else None)
                out["height"].append(height if sound else None)
                out["error"].append(None if sound else "no image that can be read")
                if not sound:
                    out["pixels"].append(None)
                    continue
                array = np.frombuffer(raw, np.uint8).reshape(height, width, channels)
                rgba = np.full((height, width, 4), 255, np.uint8)
                rgba[..., :3] = array[..., [2, 1, 0]] if channels > 1 else array
                if channels == 4:
                    rgba[..., 3] = array[..., 3]
                out["pixels"].append(rgba.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out["path"], pa.string()), pa.array(out["width"], pa.int32()), pa.array(out["height"], pa.int32()), pa.array(out["pixels"], pa.binary()), pa.array(out["error"], pa.string())], names=list(out))

    plain = other.join(known, place("origin") == F.col("place"), "left_anti").select(F.col("origin").alias("path"), "width", "height", "nChannels", "data")
    rest = plain.mapInArrow(run, "path string, width int, height int, pixels binary, error string")
    return own.unionByName(rest).select("path", F.xxhash64("path").alias("image_id"), "width", "height", "pixels", "error")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, image_id, width, height, pixels) of the sound image files under a path; scan_images() tells of the others."""
    return scan_images(spark, path).where("error is null").drop("error")


def encode_images(images: DataFrame, form: str = "png") -> DataFrame:
    """(image_id, and a column named after the form) of packed images as RGB files: png, bmp or ppm; alpha is dropped."""
    if form not in FORMATS:
        raise ValueError(f"no image format {form!r}; there are {', '.join(FORMATS)}")
    encode = FORMATS[form]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [encode(to_array(*x)) for x in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], names=["image_id", form])

    return images.select("image_id", "width", "height", "pixels").mapInArrow(run, f"image_id long, {form} binary")


def encode_indexed_images(indexed: DataFrame, palette: Colours) -> DataFrame:
    """(image_id, png) of images whose pixels hold one palette index each, as indexed files."""
    table = check_palette(palette)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = []
            for width, height, raw in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                files.append(png.encode_indexed(np.frombuffer(raw, np.uint8).reshape(height, width), table))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], names=["image_id", "png"])

    return indexed.select("image_id", "width", "height", "pixels").mapInArrow(run, "image_id long, png binary")


def apply_palette(images: DataFrame, palette: Colours, ditherer: str = "fs", *, scale: int = 1) -> DataFrame:
    """(image_id, png): images recoloured and encoded, indexed at scale 1, as RGB when multisampled (its colours lie between those of the palette)."""
    if scale > 1:
        return encode_images(dither_packed(images, palette, ditherer, scale=scale))
    return encode_indexed_images(dither_packed(images, palette, ditherer, indices=True), palette)


def pack_nibble_rows(indexed: DataFrame) -> DataFrame:
    """(image_id, y, k, byte) of exploded palette indices under 16: two in a byte, the first one in the high half."""
    half = F.col("x") % 2 == 0
    value = F.when(half, F.shiftleft("idx", 4)).otherwise(F.col("idx"))
    return indexed.groupBy("image_id", "y", F.floor(F.col("x") / 2).cast("int").alias("k")).agg(F.bit_or(value).cast("int").alias("byte"))


__all__ = ["IMAGES", "apply_palette", "decode_files", "encode_images", "encode_indexed_images", "pack_nibble_rows", "read_images", "scan_images"]
