"""Global positions without a global sort: hash buckets, a bounded table of bucket totals, local running sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_A_BUCKET = 500_000


def buckets_for(rows: int) -> int:
    """A power of two, so that a bucket holds about ``ROWS_A_BUCKET`` rows at most; 64 at least."""
    return max(64, 1 << math.ceil(math.log2(max(1, rows / ROWS_A_BUCKET))))


def positions(df: DataFrame, order: list[str], weight: Column, out: str, buckets: int, bucket: str = "_bucket") -> DataFrame:
    """Add ``out``, the sum of ``weight`` over all rows before this one in a fixed order, and the row's ``bucket``.

    The order is (hash bucket of ``order``, ``order``).  Each bucket is one window group of bounded size; only one
    total a bucket meets in a single task.  Rows that tie on every column of ``order`` get distinct positions.
    """
    df = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")).withColumn("_weight", weight.cast("long"))
    totals = df.groupBy(bucket).agg(F.sum("_weight").alias("_total"))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(bucket, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    local = Window.partitionBy(bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_local", F.coalesce(F.sum("_weight").over(local), F.lit(0)))
        .join(totals, bucket)
        .withColumn(out, F.col("_base") + F.col("_local"))
        .drop("_weight", "_local", "_base")
    )
