"""Entities that texts name without a link: aliases as substrings, found by one automaton over all of them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import display_key
from .entities import first_by

#: Bytes of aliases that one automaton takes; more are dealt among several, each over all texts.
MOST_BYTES = 1 << 25


def qualifying(entities: DataFrame, least: int = 4) -> DataFrame:
    """(entity_id, alias, place) of entities (id, title, aliases): names of at least ``least`` letters, the longest first,
    each spelling once whatever its case and blanks."""
    every = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.when(F.coalesce("title", F.lit("")) != "", F.array("title")).otherwise(F.array().cast("array<string>")))
    rows = entities.select(F.col("id").alias("entity_id"), F.posexplode(every).alias("pos", "alias")).withColumn("norm", display_key(F.col("alias"))).where(F.length("norm") >= least)
    rows = first_by(rows, ["entity_id", "norm"], [F.desc(F.length("alias")), "pos"])
    w = Window.partitionBy("entity_id").orderBy(F.desc(F.length("alias")), "pos")
    return rows.select("entity_id", "alias", F.row_number().over(w).alias("place"))


def named_in(texts: DataFrame, aliases: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(node_id, alias): the distinct ``aliases`` (column ``alias``) that stand in each of the texts (node_id, content),
    in any case; every character of an alias is text.

    The automaton is built in the tasks from the aliases' own bytes, whose sum is checked: beyond ``most_bytes`` they
    are dealt by hash into as many parts as needed, so that none is larger than a task can hold.
    """
    kind = texts.schema["node_id"].dataType.simpleString()
    wanted = aliases.select(F.lower("alias").alias("alias")).where("alias <> ''").distinct()
    total = wanted.agg(F.sum(F.octet_length("alias") + 16)).first()[0] or 0
    parts = -(-int(total) // most_bytes)
    out = None

    def searched(words: list[str]):
        def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for word in words:
                automaton.add_word(word, word)
            automaton.make_automaton()
            for pdf in batches:
                rows = [(n, w) for n, t in zip(pdf["node_id"], pdf["content"], strict=True) for w in {w for _, w in automaton.iter(t)}]
                yield pd.DataFrame(rows, columns=["node_id", "alias"])

        return found

    said = texts.where("content is not null and content <> ''").select("node_id", F.lower("content").alias("content"))
    for part in range(parts):
        own = wanted if parts == 1 else wanted.where(F.pmod(F.xxhash64("alias"), F.lit(parts)) == part)
        words = [r.alias for r in own.collect()]
        if not words:
            continue
        met = said.mapInPandas(searched(words), f"node_id {kind}, alias string")
        out = met if out is None else out.union(met)
    if out is None:
        return texts.select("node_id", F.lit("").alias("alias")).where("1 = 0")
    return out.distinct()


def unlinked(texts: DataFrame, entities: DataFrame, edges: DataFrame, least: int = 4, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(node_id, entity_id, alias, place): texts that name an entity by its longest alias found and have no edge to it."""
    aliases = qualifying(entities, least).withColumn("low", F.lower("alias"))
    met = named_in(texts, aliases, most_bytes).withColumnRenamed("alias", "low").join(aliases, "low")
    drawn = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("entity_id"))
    met = met.join(drawn, ["node_id", "entity_id"], "left_anti")
    return first_by(met, ["node_id", "entity_id"], ["place"]).select("node_id", "entity_id", "alias", "place")


def within_budget(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` links, entity by entity, each by its longest aliases first, then by node."""
    return found.orderBy("entity_id", "place", "node_id").limit(most)
