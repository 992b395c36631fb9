"""Tables that a query writes once and reads again, so that what several joins need is not derived for each."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

KEY = "spark.checkpoint.dir"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder that the cluster names in ``spark.checkpoint.dir``, and read back.

    Its size is then known to the planner, and a lost executor recomputes nothing above it.  Without such a folder a
    driver that is its own executor takes a fresh one; a cluster must name one.  The table goes when the session's JVM
    ends.
    """
    spark = df.sparkSession
    folder = spark.conf.get(KEY, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {KEY} to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-strandweave-", dir="/tmp")
        spark.conf.set(KEY, folder)
    path = f"{folder.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out
