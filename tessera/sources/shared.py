"""Where tables go that a job writes for itself: the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A fresh path under ``spark.checkpoint.dir``; under a folder of our own only in local mode, if that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def round_trip(spark: SparkSession, df: DataFrame, form: str, *, partition_by: tuple[str, ...] = (), options: dict | None = None, text_schema: bool = False) -> DataFrame:
    """Writes ``df`` and reads it back."""
    path, options = folder(spark), options or {}
    writer = df.write.format(form).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    reader = spark.read.format(form).options(**options)
    return (reader.schema(df.schema) if text_schema or partition_by else reader).load(path)


def compact(spark: SparkSession, path: str, form: str = "parquet", target_bytes: int = 128 << 20) -> str:
    """Rewrites the files of ``path`` into files of about ``target_bytes``, beside it; gives the new path. Files are merged, not shuffled."""
    files = spark.read.format(form).load(path).select("_metadata.file_path", "_metadata.file_size").distinct()
    size = files.agg(F.coalesce(F.sum("file_size"), F.lit(0))).first()[0]
    out = folder(spark)
    spark.read.format(form).load(path).coalesce(max(1, -(-size // target_bytes))).write.format(form).save(out)
    return out


def sorted_layout(df: DataFrame, keys: list[str], files: int) -> DataFrame:
    """Range-partitioned and sorted rows: readers then skip row groups by the minima and maxima of ``keys``."""
    return df.repartitionByRange(files, *keys).sortWithinPartitions(*keys)
