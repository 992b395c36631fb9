"""Graph reads: edges of a node, keyset pages, zones, context trees, similarity edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cursor
from ..sources.stage import cut


def live(nodes: DataFrame) -> DataFrame:
    return nodes.where("merged_into is null")


def around(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(center, rel, origin, dir, node_id, since, until): edges of the nodes ``ids`` (column ``center``), both ways."""
    out = edges.join(ids, edges.src == ids.center).select("center", "rel", "origin", F.lit("out").alias("dir"), F.col("dst").alias("node_id"), "since", "until")
    inward = edges.join(ids, edges.dst == ids.center).select("center", "rel", "origin", F.lit("in").alias("dir"), F.col("src").alias("node_id"), "since", "until")
    return out.union(inward)


def neighbors(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """:func:`around` with live other ends only, and their type and title."""
    other = live(nodes).select(F.col("id").alias("node_id"), "type", "title")
    return around(edges, ids).join(other, "node_id")


KEYSET = ["origin", "rel", "dir", "node_id"]


def after(cursor: tuple[str, ...]) -> Column:
    """Rows past the cursor in keyset order."""
    out, equal = F.lit(False), F.lit(True)
    for name, value in zip(KEYSET, cursor, strict=True):
        out, equal = out | equal & (F.col(name) > value), equal & (F.col(name) == value)
    return out


def page(found: DataFrame, size: int, cursor: tuple[str, ...] | None = None) -> DataFrame:
    """One page and one row more, which tells whether there is another."""
    return (found.where(after(cursor)) if cursor else found).orderBy(*KEYSET).limit(size + 1)


def zones(found: DataFrame, cap: int = 8) -> DataFrame:
    """The first ``cap`` neighbours of each relation, with the relation's total; counts and lists are partial in each
    task before a relation's rows meet."""
    keys = ["center", "rel"]
    total = found.groupBy(*keys).agg(F.count("*").alias("total"))
    first = found.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("origin", "dir", "node_id"))).where(F.col("n") <= cap)
    return first.join(total, keys)


def zone_lists(found: DataFrame, cap: int = 8) -> DataFrame:
    """(center, rel, neighbors, total, next_cursor): a relation's first ``cap`` neighbours in one row, and where to read on
    if there are more."""
    row = F.struct("n", "node_id", cursor("origin", "rel", "dir", "node_id").alias("at"))
    lists = zones(found, cap).groupBy("center", "rel", "total").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    more = F.when(F.col("total") > F.size("rows"), F.element_at("rows", -1)["at"])
    return lists.select("center", "rel", F.col("rows.node_id").alias("neighbors"), "total", more.alias("next_cursor"))


def context(ends: DataFrame, ids: DataFrame, fanout: int = 10, depth: int = 2) -> DataFrame:
    """(root, depth, path, leaf, rel, truncated): the tree of neighbours under each of ``ids`` (column ``center``), at most
    ``fanout`` children a node in keyset order.

    A node that is on the path already is listed, but not expanded again.  ``truncated`` tells of a node that was expanded
    that it has more neighbours; the root has a row of its own, at depth 0.  Lists are cut before trees are built, once
    for all paths that lead to a node.
    """
    w = Window.partitionBy("center").orderBy("origin", "rel", "dir", "node_id")

    def listed(centers: DataFrame) -> tuple[DataFrame, DataFrame]:
        held = ends.join(centers.distinct(), "center", "left_semi").select("center", "origin", "rel", "dir", "node_id").distinct()
        held = cut(held.withColumn("n", F.row_number().over(w)).where(F.col("n") <= fanout + 1))
        return held.where(F.col("n") <= fanout), held.where(F.col("n") > fanout).select("center", F.lit(True).alias("more"))

    level = ids.select(F.col("center").alias("root"), F.lit(0).alias("depth"), F.array("center").alias("path"), F.col("center").alias("leaf"), F.lit(None).cast("string").alias("rel"), F.lit(True).alias("open"))
    out = []
    for k in range(depth):
        children, more = listed(level.where("open").select(F.col("leaf").alias("center")))
        flagged = level.join(more.withColumnRenamed("center", "leaf"), "leaf", "left")
        out.append(flagged.select("root", "depth", "path", "leaf", "rel", (F.col("open") & F.coalesce("more", F.lit(False))).alias("truncated")))
        below = level.where("open").select("root", "path", F.col("leaf").alias("center")).join(children, "center")
        below = below.select("root", F.lit(k + 1).alias("depth"), F.concat("path", F.array("node_id")).alias("path"), F.col("node_id").alias("leaf"), "rel", (~F.array_contains("path", F.col("node_id"))).alias("open"))
        level = cut(below) if k + 1 < depth else below
    out.append(level.select("root", "depth", "path", "leaf", "rel", F.lit(False).alias("truncated")))
    both = out[0]
    for more in out[1:]:
        both = both.union(more)
    return both.select("root", "depth", F.array_join("path", ">").alias("path"), "leaf", "rel", "truncated")


def chased(links: DataFrame, rounds: int = 6) -> DataFrame:
    """(node, top, hops) of pointers (node, up): followed to their end by doubling, 2**``rounds`` steps at most.

    Each round joins the pointers with themselves and is written, so that no round runs those before it again.
    """
    at = links.select("node", F.col("up").alias("top"), F.lit(1).alias("hops"))
    for _ in range(rounds):
        at = cut(at)
        on = at.select(F.col("node").alias("top"), F.col("top").alias("next"), F.col("hops").alias("more"))
        if at.join(on, "top", "left_semi").isEmpty():
            break
        at = at.join(on, "top", "left").select("node", F.coalesce("next", "top").alias("top"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"))
    return at


def run_tree(runs: DataFrame, most: int = 32) -> DataFrame:
    """(run_id, root_id, depth) of every run; one whose parent is missing is a root.  ``most`` bounds the depth."""
    known = runs.select("run_id", F.col("parent_run_id").alias("up"))
    there = known.select(F.col("run_id").alias("up"))
    held = known.join(there, "up", "left_semi").select(F.col("run_id").alias("node"), "up")
    top = chased(held, max(1, (most - 1).bit_length() + 1)).select(F.col("node").alias("run_id"), "top", "hops")
    return known.select("run_id").join(top, "run_id", "left").select("run_id", F.coalesce("top", "run_id").alias("root_id"), F.coalesce("hops", F.lit(0)).alias("depth"))


def nested_runs(runs: DataFrame, roots: DataFrame, most: int = 32) -> DataFrame:
    """(root_id, run_id, depth, place): the runs under each of ``roots`` (column ``root_id``) at most ``most`` deep, in the
    order of a printed tree: children after their parent, by start and id.

    A run's place is its path of (started_at, run_id) from the root, built level by level downwards; a level costs one
    join of the runs that have it with their children.
    """
    key = F.concat_ws("/", F.date_format("started_at", "yyyyMMddHHmmssSSSSSS"), F.lpad(F.col("run_id").cast("string"), 20, "0"))
    rows = cut(runs.select("run_id", F.col("parent_run_id").alias("up"), key.alias("key")))
    level = rows.join(roots.select(F.col("root_id").alias("run_id")).distinct(), "run_id", "left_semi").select(F.col("run_id").alias("root_id"), "run_id", F.lit(0).alias("depth"), F.array("key").alias("place"))
    found = [level]
    for depth in range(1, most + 1):
        level = cut(level.select("root_id", F.col("run_id").alias("up"), "place").join(rows, "up").select("root_id", "run_id", F.lit(depth).alias("depth"), F.concat("place", F.array("key")).alias("place")))
        if level.isEmpty():
            break
        found.append(level)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.select("root_id", "run_id", "depth", F.array_join("place", ">").alias("place"))


__all__ = ["after", "around", "chased", "context", "live", "neighbors", "nested_runs", "page", "run_tree", "zone_lists", "zones"]
