"""Which rows teach a classifier, and which are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod`` (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def teaching(labels: DataFrame, label: str, mod: int, held: int) -> DataFrame:
    """(doc_id, label) of the rows that a model may learn from.

    Rows without an id or label, and labels other than 0 and 1, teach nothing; of several labels of one id the
    largest counts.
    """
    x = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("label"))
    x = x.where("doc_id is not null and label in (0, 1)").where(remainder(F.col("doc_id"), mod) != held)
    return x.groupBy("doc_id").agg(F.max("label").alias("label"))
