"""Palette operators on streams: they handle each image by itself, so a stream needs no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import Colours
from ..sources.images import apply_palette, decode_files


def read_image_stream(spark: SparkSession, path: str, *, files_at_once: int = 64) -> DataFrame:
    """(image_id, width, height, pixels) of PNG files as they arrive in a folder; damaged files are left out."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_at_once).load(path)
    return decode_files(files).where("error is null").select(F.xxhash64("path").alias("image_id"), "width", "height", "pixels")


def apply_stream(images: DataFrame, palette: Colours, out: str, checkpoint: str, ditherer: str = "fs", *, scale: int = 1) -> StreamingQuery:
    """Recolour a stream of images into Parquet files of (image_id, png), until all that is there has been handled."""
    done = apply_palette(images, palette, ditherer, scale=scale)
    return done.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
