"""Profiles, counted findings, run health and bounded logs over the graph's records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .entities import ENTITY_TYPES
from .graph import live


def details(nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """(id, title, degree, tier) of the live entities; one without neighbours has degree 0."""
    hubs = live(nodes).where(F.col("type").isin(ENTITY_TYPES)).select("id", "title")
    degree = F.coalesce("degree", F.lit(0))
    return hubs.join(degrees.select("id", "degree"), "id", "left").select("id", "title", degree.alias("degree"), C.profile_tier(degree).alias("tier"))


def observations(ends: DataFrame) -> DataFrame:
    """(center, rel, title, node_id, since, until), one per canonical edge; ``since`` falls back to the other end's date."""
    return ends.where("origin = 'canonical'").select("center", "rel", "title", "node_id", F.coalesce("since", "occurred_start").alias("since"), "until")


def stubs(observed: DataFrame) -> DataFrame:
    """(center, n, text): a line per observation, by relation, newest first, undated last.

    The text of a hub is one cell, so a hub's lines meet in one row; they are short, sorted inside it, and put into words there.
    """
    undated = F.lit(2**31 - 1)  # sorts behind every date
    row = F.struct("rel", F.coalesce(-F.unix_date("since"), undated).alias("age"), "title", "node_id", "until")
    texts = observed.groupBy("center").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(row)).alias("rows"))

    def line(x: Column) -> Column:
        since, until = F.date_format(F.date_from_unix_date(-x["age"]), "yyyy-MM-dd"), F.date_format(x["until"], "yyyy-MM-dd")
        dated, ended = x["age"] < undated, x["until"].isNotNull()
        stamp = F.when(dated & ended, F.concat(F.lit(" (as of "), since, F.lit(", until "), until, F.lit(")")))
        stamp = stamp.when(dated, F.concat(F.lit(" (as of "), since, F.lit(")"))).when(ended, F.concat(F.lit(" (until "), until, F.lit(")"))).otherwise("")
        return F.concat(F.lit("["), x["rel"], F.lit("] "), x["title"], stamp)

    return texts.select("center", "n", F.array_join(F.transform("rows", line), "\n").alias("text"))


def recent(nodes: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """(id, title, day, excerpt) of the ``most`` newest nodes; only those meet the chunks."""
    day = F.coalesce("occurred_start", "created_on", "indexed_on")
    newest = nodes.select("id", "title", day.alias("day"), "indexed_on").orderBy(F.desc("day"), F.desc("indexed_on"), "id").limit(most)
    held = chunks.join(F.broadcast(newest.select(F.col("id").alias("node_id"))), "node_id", "left_semi")
    first = held.groupBy("node_id").agg(F.min_by("content", "chunk_index").alias("content"))
    return newest.join(first, F.col("id") == F.col("node_id"), "left").select("id", "title", "day", F.substring("content", 1, 160).alias("excerpt"))


def counted_sample(found: DataFrame, most: int) -> DataFrame:
    """(n, id): the first ``most`` ids, with the count of all rows beside each."""
    total = found.agg(F.count("*").alias("n"))
    return found.select("id").orderBy("id").limit(most).join(F.broadcast(total)).select("n", "id")


def deletable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Live entities that no edge touches."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return live(nodes).where(F.col("type").isin(ENTITY_TYPES)).select("id").join(ends, "id", "left_anti")


def run_health(runs: DataFrame, today: str, days: int) -> DataFrame:
    """(agent, latest, healthy): whether the latest run didn't fail and one succeeded in the last ``days`` days."""
    succeeded = F.max(F.when(F.col("status") == "succeeded", F.to_date("started_at")))
    out = runs.groupBy("agent").agg(F.max_by("status", "run_id").alias("latest"), succeeded.alias("succeeded"))
    fresh = F.coalesce(F.datediff(F.to_date(F.lit(today)), "succeeded") <= days, F.lit(False))
    return out.select("agent", "latest", ((F.col("latest") != "failed") & fresh).alias("healthy"))


def bounded_log(lines: DataFrame, most: int) -> DataFrame:
    """(session_id, turn, line): each session's last ``most`` lines, and one marker (turn -1) where older ones went."""
    w = Window.partitionBy("session_id").orderBy(F.desc("at_minute"), F.desc("turn"))
    kept = lines.withColumn("back", F.row_number().over(w)).where(F.col("back") <= most).select("session_id", "turn", F.col("content").alias("line"))
    over = lines.groupBy("session_id").agg((F.count("*") - most).alias("n")).where("n > 0")
    return kept.union(over.select("session_id", F.lit(-1).cast("long"), F.concat(F.lit("… "), F.col("n").cast("string"), F.lit(" lines dropped"))))


def jaccard(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, shared, jaccard) of pairs (a, b, shared): shared neighbours over all of both; the two themselves don't count."""
    n = links.groupBy("id").agg(F.count("*").alias("n"))
    direct = links.select(F.col("id").alias("a"), F.col("other").alias("b"), F.lit(2).alias("own"))
    out = pairs.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b").join(direct, ["a", "b"], "left")
    rest = F.col("na") + F.col("nb") - F.col("shared") - F.coalesce("own", F.lit(0))
    return out.select("a", "b", "shared", F.round(F.col("shared") / rest, 6).alias("jaccard"))


def status_filter(items: DataFrame, status: str | None) -> DataFrame:
    """Items of a status; none, blank or ``all`` is no filter."""
    wanted = (status or "").strip().lower()
    return items if wanted in ("", "all") else items.where(F.col("status") == wanted)


def vocabulary(seeds: dict[str, list[str]], proposals: DataFrame) -> DataFrame:
    """(axis, value, origin, item_id): configured words, approved ones that are no seeds, and pending proposals, each with
    its item; ``proposals`` has (item_id, axis, value, status)."""
    known = proposals.sparkSession.createDataFrame([(a, v) for a, values in seeds.items() for v in values], "axis string, value string")
    none = F.lit(None).cast(proposals.schema["item_id"].dataType).alias("item_id")
    added = proposals.where("status = 'resolved'").select("axis", "value").distinct().join(F.broadcast(known), ["axis", "value"], "left_anti")
    waiting = proposals.where("status = 'pending'").select("axis", "value", F.lit("proposed").alias("origin"), "item_id")
    return known.select("axis", "value", F.lit("seed").alias("origin"), none).union(added.select("axis", "value", F.lit("added"), none)).union(waiting)


def review_page(items: DataFrame, status: str | None, kind: str | None, limit: int | None = None, usual: int = 50, most: int = 200) -> DataFrame:
    """The newest items of a status and kind, each blank or ``all`` for any; ``limit`` is kept between 1 and ``most``."""
    wanted = (kind or "").strip()
    found = status_filter(items, status)
    found = found if wanted.lower() in ("", "all") else found.where(F.col("kind") == wanted)
    return found.orderBy(F.desc("created_at"), F.desc("item_id")).limit(max(1, min(usual if limit is None else limit, most)))
