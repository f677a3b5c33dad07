"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a temporary one where it is unset, but only in local mode.

    Raises RuntimeError where it is unset on a cluster, whose executors would each write to a disk of their own.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="huewright-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame, compression: str = "snappy", by: str | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage, survives lost executors, gives true sizes to the planner. `by` names the last column, whose values get folders of their own."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/huewright-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)
