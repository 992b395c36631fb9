"""Cutting lineage with tables in the shared folder that every executor sees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a fresh folder serves a driver that is its own executor, as in tests; a cluster must name one.
    """
    path = spark.conf.get(KEY, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {KEY} to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-strandweave-", dir="/tmp")
        spark.conf.set(KEY, path)
    return path.rstrip("/")


def _folder(spark: SparkSession, path: str) -> tuple:
    """The file system of ``path`` and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def stage(df: DataFrame, name: str, *used: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The copy outlives any executor, so a later loss never recomputes what stands above it.  The stored tables ``used``
    (results of this function that nothing needs any more) are deleted then; all others when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, at = _folder(spark, path)
    fs.deleteOnExit(at)
    for old in used:
        fs, at = _folder(spark, old.stored_at)
        fs.delete(at, True)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows from here on: a task holds few whole texts at once, in either process."""
    if not 0 < int(spark.conf.get(BATCH_KEY)) <= BATCH_ROWS:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column of ``taken`` has it."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name
