"""Sinks that a replayed batch does not change, and marks that tell how far a job has come.

A batch of lines is one folder, named by the batch's number; its lines' numbers follow on from what earlier batches
gave their runs.  The folder of marks, the last number of each run that the batch touched, is written after the lines,
so a batch counts once its marks are there; one that broke off is written again, with the same numbers, since only
earlier batches are asked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MARKS = "run_id bigint, last bigint, batch bigint"
#: Batches after which all runs' last numbers are written anew, so that few folders are read.
COMPACT = 50


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def committed(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the batches that were written whole, in order."""
    fs, path = _path(spark, f"{root}/marks")
    if not fs.exists(path):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [int(n.partition("=")[2]) for n in found if n.startswith("batch=")]
    return sorted(b for b in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/marks/batch={b}/_SUCCESS")))


def last_numbers(spark: SparkSession, root: str, before: int) -> DataFrame:
    """(run_id, last) as of the batches before ``before``, from the newest full set of marks on."""
    done = [b for b in committed(spark, root) if b < before]
    start = max((b for b in done if b % COMPACT == 0), default=0)
    paths = [f"{root}/marks/batch={b}" for b in done if b >= start]
    if not paths:
        return spark.createDataFrame([], "run_id bigint, last bigint")
    return spark.read.schema("run_id bigint, last bigint").parquet(*paths).groupBy("run_id").agg(F.max("last").alias("last"))


def log_sink(root: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: lines (run_id, ...) get ``seq``, one more than the run's last, in ``order`` within a batch."""

    def flush(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = last_numbers(spark, root, number)
        w = Window.partitionBy("run_id").orderBy(*order)
        lines = batch.withColumn("_n", F.row_number().over(w)).join(old, "run_id", "left").withColumn("seq", F.coalesce("last", F.lit(0)) + F.col("_n")).drop("_n", "last")
        lines.write.mode("overwrite").parquet(f"{root}/lines/batch={number}")
        new = spark.read.schema(lines.schema).parquet(f"{root}/lines/batch={number}").groupBy("run_id").agg(F.max("seq").alias("last"))
        if number % COMPACT == 0:
            new = old.unionByName(new).groupBy("run_id").agg(F.max("last").alias("last"))
        new.select("run_id", F.col("last").cast("long").alias("last")).write.mode("overwrite").parquet(f"{root}/marks/batch={number}")

    return flush


def lines(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    """All lines of the batches that count; ``schema`` is that of the lines with ``seq``."""
    paths = [f"{root}/lines/batch={b}" for b in committed(spark, root)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def tail(found: DataFrame, run_id: int, after: int = 0, most: int = 2_000) -> DataFrame:
    """A run's lines after number ``after``, the next ``most``."""
    return found.where((F.col("run_id") == run_id) & (F.col("seq") > after)).orderBy("seq").limit(most)


def high_water(runs: DataFrame, agents: DataFrame, now: Column, window_days: int) -> DataFrame:
    """(agent, since): where each of ``agents`` goes on: the start of its last run that succeeded, else ``now`` less the window."""
    last = runs.where("status = 'succeeded'").groupBy("agent").agg(F.max("started_at").alias("last"))
    return agents.select("agent").distinct().join(last, "agent", "left").select("agent", F.coalesce("last", now - F.expr(f"interval {window_days} days")).alias("since"))
