"""Connected components of a link table by rounds of contraction, all in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``links``; ``component`` is its component's smallest node.

    Each round points every node at its smallest neighbour, shortens the pointers and replaces links by links
    between the roots; the link table shrinks until none is left.  Links are never gathered per node (only a
    ``min`` is kept), so a hub costs no more than its links, and every round's tables lie in the shared folder.
    """
    e = stage(
        links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "links",
    )
    labels: DataFrame | None = None
    while not e.isEmpty():
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        p = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up"))
        p = stage(p, "up")
        top = p.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        p2 = stage(p.join(top, "up", "left").select("node", F.coalesce("upper", "up").alias("up")), "up")
        top = p2.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        p3 = stage(p2.join(top, "up", "left").select("node", F.coalesce("upper", "up").alias("up")), "up")
        to = p3.select(F.col("node").alias("component"), F.col("up").alias("next"))
        if labels is None:
            labels = p3.select("node", F.col("up").alias("component"))
        else:
            labels = labels.join(to, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
        labels = stage(labels, "labels")
        x, y = p3.select(F.col("node").alias("a"), F.col("up").alias("ra")), p3.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        e = e.join(x, "a").join(y, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        e = stage(e, "links")
    return labels if labels is not None else e.select(F.col("a").alias("node"), F.col("b").alias("component"))
