"""Node files to tables: reading, metadata, change detection, upserts, pooled vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import markdown as M

IGNORED = [".git", ".obsidian", ".trash", "node_modules"]


def scan(spark: SparkSession, root: str, ignored: list[str] = IGNORED) -> DataFrame:
    """(path, content) of the Markdown files below ``root``, by any path that Spark reads; hidden and ignored folders,
    at any depth, are left out.  ``path`` is relative to ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    base = F.lit(root.rstrip("/").split("://")[-1].lstrip("/"))
    relative = F.regexp_replace(F.expr("path"), "^[a-z]+:/*", "")
    relative = F.substring(relative, F.length(base) + 2, F.length(relative))
    rows = files.select(relative.alias("path"), F.decode("content", "UTF-8").alias("content"))
    return rows.where(~F.exists(F.split("path", "/"), lambda s: s.isin(ignored)))


def metadata(files: DataFrame) -> DataFrame:
    """(path, id, type, title, created, tags, aliases, occurred_start, occurred_end, interiority, merged_into, edges,
    content_hash) of files (path, content), with the fallbacks of a file that lacks a field."""
    rows = files.select("path", M.front(F.col("content")).alias("front"), M.body(F.col("content")).alias("body"), M.content_hash(F.col("content")).alias("content_hash"))
    rows = rows.withColumn("meta", M.parse_front("front")).withColumn("edges", M.parse_edges("front")).withColumn("heading", M.first_heading("body"))
    scalar = lambda k: F.nullif(F.col("meta.scalars").getItem(k), F.lit(""))
    listed = lambda k: F.coalesce(F.col("meta.lists").getItem(k), F.when(scalar(k).isNotNull(), F.array(scalar(k))), F.array().cast("array<string>"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    folder = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1))
    first, last = D.occurred_range(scalar("occurred"), scalar("occurred_end"))
    inner = F.lower(F.trim(scalar("interiority")))
    return rows.select(
        "path",
        F.coalesce(scalar("id"), M.path_id("path")).alias("id"),
        F.coalesce(scalar("type"), folder, F.lit("note")).alias("type"),
        F.coalesce(F.col("heading"), stem).alias("title"),
        F.expr("try_to_timestamp(nullif(meta.scalars['created'], ''))").alias("created"),
        listed("tags").alias("tags"),
        listed("aliases").alias("aliases"),
        first.alias("occurred_start"),
        last.alias("occurred_end"),
        F.when(inner.isin("internal", "external", "mixed"), inner).alias("interiority"),
        scalar("merged_into").alias("merged_into"),
        "edges",
        "content_hash",
    )


def file_edges(nodes: DataFrame) -> DataFrame:
    """(src, dst, rel, conf, since): a file's edges to nodes that exist, the first of each (dst, rel)."""
    rows = nodes.select(F.col("id").alias("src"), F.posexplode("edges").alias("pos", "e"))
    rows = rows.select("src", "pos", F.col("e.to").alias("dst"), F.col("e.rel").alias("rel"), F.expr("try_cast(e.conf as double)").alias("conf"), D.floor_day(D.partial(F.col("e.since"))).alias("since"))
    w = Window.partitionBy("src", "dst", "rel").orderBy("pos")
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "pos")


def actions(scanned: DataFrame, state: DataFrame) -> DataFrame:
    """(id, path, old_path, action) of scanned (id, path, content_hash) against indexed (id, path, content_hash): ``new``,
    ``changed``, ``moved`` (same content elsewhere), ``skipped`` or ``deleted``."""
    old = state.select("id", F.col("path").alias("old_path"), F.col("content_hash").alias("old_hash"))
    both = scanned.select("id", "path", "content_hash").join(old, "id", "full")
    action = F.when(F.col("path").isNull(), "deleted").when(F.col("old_path").isNull(), "new").when(F.col("content_hash") != F.col("old_hash"), "changed").when(F.col("path") != F.col("old_path"), "moved").otherwise("skipped")
    return both.select("id", "path", "old_path", action.alias("action"))


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the rows of ``new`` in place of those with their keys; of several new rows a key keeps one."""
    once = new.select(table.columns).dropDuplicates(keys)
    return table.join(once.select(*keys), keys, "left_anti").unionByName(once)


def insert_new(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` and those rows of ``new`` whose keys it lacks."""
    return table.unionByName(new.select(table.columns).dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"))


def update_where(table: DataFrame, guard: Column, **values: Column) -> DataFrame:
    """``table`` with ``values`` in the rows that pass ``guard`` and a column ``changed`` that tells which did."""
    ok = F.coalesce(guard, F.lit(False))
    return table.select(*[F.when(ok, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns], ok.alias("changed"))


def mean_pool(chunks: DataFrame, dimension: int) -> DataFrame:
    """(node_id, embedding): the mean of a node's chunk vectors, by coordinate."""
    means = F.array(*[F.avg(F.col("embedding")[k].cast("double")) for k in range(dimension)])
    return chunks.where("embedding is not null").groupBy("node_id").agg(means.alias("embedding"))
