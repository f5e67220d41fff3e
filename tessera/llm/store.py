"""Tables that cut lineage: Parquet in the folder that the cluster names in ``spark.checkpoint.dir``.

Every executor and the driver must see that folder, so a lost executor costs only the
stage that was running. ``release`` deletes what this session has written.
"""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []
BATCH, _LIMIT = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
PER_CORE = 2


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of bytes in an Arrow batch to ``BATCH``: whole texts vary in length, and a batch stands in memory several times, in the JVM and in Python."""
    now = spark.conf.get(_LIMIT).removesuffix("b")
    if now.isdecimal() and int(now) > BATCH:
        spark.conf.set(_LIMIT, BATCH)


def folder(spark: SparkSession) -> str:
    """The shared folder; a folder of our own only in local mode (tests), if none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def most_files(spark: SparkSession, parts: int = 0) -> int:
    """Tasks enough to write a work table: so many a core, or as many as the corpus has parts."""
    return max(PER_CORE * spark.sparkContext.defaultParallelism, parts)


def materialise(spark: SparkSession, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """``df``, written once and read back; by ``files`` tasks at most, if given, each of which takes several partitions in turn.

    On a local file system an executor starts processes for the modes of every file, and each counts as large as the
    executor until it runs its own program. Few rows in many partitions cost mostly that.
    """
    path = f"{folder(spark)}/tessera-{uuid.uuid4().hex}/{name}"
    if files:
        df = df.coalesce(files)
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.tessera_path = path
    return back


def written() -> int:
    """How many tables there are: what ``drop_since`` starts from."""
    return len(_WRITTEN)


def drop_since(spark: SparkSession, mark: int, keep: tuple[DataFrame, ...] = ()) -> None:
    """Deletes the tables written since ``mark``, but for ``keep``. What is kept was read back from files and needs no other."""
    kept = {df.tessera_path for df in keep}
    gone = [p for p in _WRITTEN[mark:] if p not in kept]
    _WRITTEN[mark:] = [p for p in _WRITTEN[mark:] if p in kept]
    _delete(spark, gone)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        try:
            store, inside = pa.fs.FileSystem.from_uri(path)
            store.delete_dir(inside.rpartition("/")[0])
        except (pa.ArrowInvalid, OSError):  # a store that only Spark reaches: an empty table takes its place
            spark.createDataFrame([], "empty int").write.mode("overwrite").parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all tables that ``materialise`` has written; call it when results have been stored."""
    _delete(spark, _WRITTEN)
    _WRITTEN.clear()
