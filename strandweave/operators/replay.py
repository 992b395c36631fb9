"""Stored merge decisions folded again, in order, into a rebuilt graph.

A fold changes what later decisions find: the loser is gone and its names are the survivor's.  So decisions that could
touch are brought together first: decisions and entities that share a name form are linked, the links' connected groups
are labelled by rounds of joins, and every group is folded in order in one task.  Groups don't share a form, so no group
depends on another.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import display_key
from ..sources.stage import cut


def groups(links: DataFrame) -> DataFrame:
    """(node, label) of a link table (a, b): the smallest node of its connected group.

    Labels go to neighbours and then along themselves, which doubles their reach a round; each round is written.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").distinct())
    at = cut(both.groupBy("node").agg(F.least(F.min("node"), F.min("other")).alias("label")))
    while True:
        near = both.join(at.select(F.col("node").alias("other"), F.col("label").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        low = at.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        onward = low.select(F.col("node").alias("label"), F.col("label").alias("further"))
        low = cut(low.join(onward, "label", "left").select("node", "old", F.coalesce("further", "label").alias("label")))
        at = low.select("node", "label")
        if low.where("old <> label").isEmpty():
            return at


def named(nodes: DataFrame) -> DataFrame:
    """(id, type, title, forms): live entities with their normalised title and all their forms."""
    title = display_key(F.coalesce("title", F.lit("")))
    forms = F.filter(F.array_distinct(F.concat(F.array(title), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), display_key))), lambda f: f != "")
    return nodes.where("merged_into is null").select("id", "type", title.alias("title"), forms.alias("forms"))


class Names:
    """Who bears which form, while folds change it."""

    def __init__(self) -> None:
        self.of: dict[str, tuple[str, str, set[str]]] = {}
        self.bearers: dict[str, set[str]] = defaultdict(set)

    def put(self, ident: str, kind: str, title: str, forms: set[str]) -> None:
        self.of[ident] = (kind, title, forms)
        for f in forms:
            self.bearers[f].add(ident)

    def find(self, forms: list[str], kind: str) -> str | None:
        """The entity of ``kind`` with one of ``forms``: by the first as title, by any as title, by the smallest id."""
        near = {x for f in forms for x in self.bearers.get(f, ()) if self.of[x][0] == kind}
        return min(near, key=lambda x: (self.of[x][1] != forms[0], self.of[x][1] not in forms, x), default=None)

    def fold(self, loser: str, survivor: str) -> None:
        _, _, forms = self.of.pop(loser)
        for f in forms:
            self.bearers[f].discard(loser)
        self.put(survivor, self.of[survivor][0], self.of[survivor][1], self.of[survivor][2] | forms)


def folded(decisions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(merge_key, survivor, loser, applied) of decisions (merge_key, created_on, survivor_type, survivor_forms,
    loser_type, loser_forms), oldest first, on ``nodes`` (id, type, title, aliases, merged_into).

    A decision is skipped where a side is not found or both are one entity.  Of a form's bearers only as many can ever
    be asked for as there are decisions, and one more, so a name that a third of all entities bear costs no more.  A
    group of decisions is held in one task; it grows with the decisions that hang together and not with the graph.
    """
    asked = decisions.select(F.concat(F.lit("m:"), "merge_key").alias("a"), F.explode(F.concat("survivor_forms", "loser_forms")).alias("form"))
    forms = asked.select("form").distinct()
    most = decisions.count() + 1
    borne = named(nodes).select("id", "type", "title", F.explode("forms").alias("form")).join(forms, "form")
    w = Window.partitionBy("form", "type", F.col("title") == F.col("form")).orderBy("id")
    kept = borne.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("id").distinct()
    borne = cut(borne.join(kept, "id", "left_semi"))
    links = asked.select("a", F.concat(F.lit("f:"), "form").alias("b")).union(borne.select(F.concat(F.lit("n:"), "id"), F.concat(F.lit("f:"), "form")))
    label = groups(links)
    own = decisions.withColumn("node", F.concat(F.lit("m:"), "merge_key")).join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    people = borne.groupBy("id", "type", "title").agg(F.collect_set("form").alias("forms")).withColumn("node", F.concat(F.lit("n:"), "id")).join(label, "node")
    columns = ["merge_key", "survivor", "loser", "applied"]

    def in_order(made: pd.DataFrame, people: pd.DataFrame) -> pd.DataFrame:
        names, out = Names(), []
        for p in people.itertuples():
            names.put(p.id, p.type, p.title, set(p.forms))
        for d in made.sort_values(["created_on", "merge_key"], kind="stable").itertuples():
            survivor, loser = names.find(list(d.survivor_forms), d.survivor_type) if len(d.survivor_forms) else None, names.find(list(d.loser_forms), d.loser_type) if len(d.loser_forms) else None
            applied = survivor is not None and loser is not None and survivor != loser
            if applied:
                names.fold(loser, survivor)
            out.append((d.merge_key, survivor, loser, applied))
        return pd.DataFrame(out, columns=columns)

    made = own.select("label", "merge_key", "created_on", "survivor_type", "survivor_forms", "loser_type", "loser_forms")
    return made.groupBy("label").cogroup(people.select("label", "id", "type", "title", "forms").groupBy("label")).applyInPandas(in_order, "merge_key string, survivor string, loser string, applied boolean")
