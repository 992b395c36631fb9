"""Edits of many node files as one job, whole files from rows, and both written back to a store."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions import nodefiles as N

#: An edit: its place among those of its file, what to do, and with what.
EDIT = "path string, seq bigint, op string, a string, b string, c string, values array<string>"
_DONE = StructType([StructField("content", StringType()), StructField("changes", LongType()), StructField("error", StringType())])


def edit(path: Column, seq: Column, op: str, a: Column | None = None, b: Column | None = None, c: Column | None = None, values: Column | None = None) -> list[Column]:
    """The columns of :data:`EDIT`."""
    text = lambda x: F.lit(None).cast("string") if x is None else x.cast("string")
    return [path.alias("path"), seq.cast("long").alias("seq"), F.lit(op).alias("op"), text(a).alias("a"), text(b).alias("b"), text(c).alias("c"), (F.lit(None) if values is None else values).cast("array<string>").alias("values")]


def edited(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, content, changes, error) of the files (path, content) that ``edits`` (:data:`EDIT`) name, each with its edits
    applied in order; content is null where the file is not there.  The edits of one file are one row's array."""
    step = F.struct("seq", "op", "a", "b", "c", "values")
    todo = edits.groupBy("path").agg(F.sort_array(F.collect_list(step)).alias("edits"))

    @F.pandas_udf(_DONE)
    def done(texts: pd.Series, steps: pd.Series) -> pd.DataFrame:
        rows = [N.applied(t, list(s)) for t, s in zip(texts, steps, strict=True)]
        return pd.DataFrame(rows, columns=["content", "changes", "error"])

    out = todo.join(files.select("path", "content"), "path", "left").withColumn("done", done("content", "edits"))
    return out.select("path", "done.content", "done.changes", "done.error")


_EDGE = StructType([StructField(k, StringType()) for k in ("rel", "to")])
_NODE = ["id", "type", "title", "body", "created", "source", "source_ref", "plane", "planes", "tags", "occurred", "occurred_end", "interiority", "aliases", "disambig", "edges"]


def rendered(nodes: DataFrame) -> DataFrame:
    """(id, content): whole files of rows with the columns of a node; those a table lacks count as empty.  Edges are
    structs of rel, to and, where they have them, conf, since and until."""
    lists = {"planes": ArrayType(StringType()), "tags": ArrayType(StringType()), "aliases": ArrayType(StringType()), "edges": ArrayType(_EDGE)}
    own = [F.col(c) if c in nodes.columns else F.lit(None).cast(lists.get(c, StringType())).alias(c) for c in _NODE]

    @F.pandas_udf(StringType())
    def text(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([N.rendered(r | {k: None if r[k] is None else list(r[k]) for k in lists}) for r in rows.to_dict("records")])

    return nodes.select(*own).select("id", text(F.struct(*_NODE)).alias("content"))


def add_edges(found: DataFrame, paths: DataFrame, rel: str, target: str = "entity_id", source: str = "node_id") -> DataFrame:
    """Edits that append an edge for each row of ``found``; ``paths`` has (id, path)."""
    at = found.join(paths.select(F.col("id").alias(source), "path"), source)
    return at.select(*edit(F.col("path"), F.xxhash64(target), "append", F.lit(rel), F.col(target)))


def fold_edits(merges: DataFrame, inbound: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edits of merges (loser, survivor): files with an edge to a loser (inbound: src, dst) lead to its survivor, the
    survivor's aliases gain the loser's names, the loser's file becomes a tombstone.  ``nodes`` has (id, type, title,
    aliases, path)."""
    m = merges.select("loser", "survivor")
    path = nodes.select("id", "path")
    move = inbound.select("src", F.col("dst").alias("loser")).distinct().join(m, "loser").join(path.toDF("src", "path"), "src")
    out = move.select(*edit(F.col("path"), F.lit(0), "retarget", F.col("loser"), F.col("survivor")))
    held = nodes.select(F.col("id").alias("loser"), F.filter(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: F.trim(x) != "").alias("names"))
    names = m.join(held, "loser").groupBy(F.col("survivor").alias("id")).agg(F.flatten(F.sort_array(F.collect_list(F.struct("loser", "names"))).getField("names")).alias("names")).join(nodes, "id")
    union = F.array_distinct(F.filter(F.transform(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("title"), "names"), lambda x: F.trim(x)), lambda x: x != ""))
    out = out.union(names.select(*edit(F.col("path"), F.lit(1), "list", F.lit("aliases"), values=union)))
    gone = m.join(nodes.select(F.col("id").alias("loser"), "type", "path"), "loser")
    return out.union(gone.select(*edit(F.col("path"), F.lit(2), "tombstone", F.col("loser"), F.col("type"), F.col("survivor"))))
