"""Plans to merge tags: a model's reply read, its merges made disjoint, and files rewritten after them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..sources.stage import cut
from .chat import clean_tag, json_object
from .nodefiles import edit, edited


def parsed(replies: DataFrame) -> DataFrame:
    """(plan_id, pos, canonical, variants) of replies (plan_id, reply): merges with a text and a list, of which the texts
    count; a reply that is no such object has none."""
    listed = lambda v, field: F.try_variant_get(v, f"$.{field}", "array<variant>")
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    rows = replies.select("plan_id", F.posexplode(listed(F.try_parse_json(json_object(F.col("reply"))), "merges")).alias("pos", "m"))
    rows = rows.select("plan_id", "pos", F.try_variant_get("m", "$.canonical", "variant").alias("c"), listed(F.col("m"), "variants").alias("v")).where(is_text(F.col("c")) & F.col("v").isNotNull())
    return rows.select("plan_id", "pos", F.try_variant_get("c", "$", "string").alias("canonical"), F.transform(F.filter("v", is_text), lambda v: F.try_variant_get(v, "$", "string")).alias("variants"))


def disjoint(merges: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(plan_id, pos, canonical, variants) of merges (plan_id, pos, canonical, variants) made safe, in order of ``pos``.

    Tags become slugs; those that are empty, not in ``allowed`` (tag, n), or claimed by an earlier merge of the plan that
    stays go, and a merge of fewer than two is dropped.  The canonical is the given one if it is left, else the most
    frequent, the shortest, the first by name.

    A merge is settled once no earlier open merge of its plan holds a tag of it; all such merges are settled in one
    round, whatever their plan, so rounds follow the longest chain of overlaps and not the number of merges.
    """
    own = merges.select("plan_id", "pos", clean_tag(F.col("canonical")).alias("given"), F.posexplode(F.concat(F.array("canonical"), "variants")).alias("idx", "raw"))
    own = own.withColumn("tag", clean_tag(F.col("raw"))).where("tag <> ''").groupBy("plan_id", "pos", "given", "tag").agg(F.min("idx").alias("idx"))
    if allowed is not None:
        own = own.join(allowed.select("tag", "n"), "tag")
    open_, out = cut(own), []
    while not open_.isEmpty():
        first = open_.groupBy("plan_id", "tag").agg(F.min("pos").alias("first"))
        state = open_.join(first, ["plan_id", "tag"]).groupBy("plan_id", "pos").agg(F.bool_and(F.col("first") == F.col("pos")).alias("ready"), F.count("*").alias("held"))
        settled = cut(state.where("ready or held < 2"))  # what has lost its tags can't regain any
        taken = cut(open_.join(settled.where("held >= 2").select("plan_id", "pos"), ["plan_id", "pos"]))
        out.append(taken)
        left = open_.join(settled.select("plan_id", "pos"), ["plan_id", "pos"], "left_anti")
        open_ = cut(left.join(taken.select("plan_id", "tag"), ["plan_id", "tag"], "left_anti"))
    found = own.where("1 = 0")
    for rows in out:
        found = found.unionByName(rows)
    n = F.lit(0).cast("bigint") if allowed is None else F.col("n")
    best = F.struct((F.col("tag") != F.col("given")).alias("other"), (-n).alias("rare"), F.length("tag").alias("length"), "tag")
    whole = found.groupBy("plan_id", "pos").agg(F.min(best)["tag"].alias("canonical"), F.sort_array(F.collect_list(F.struct("idx", "tag")))["tag"].alias("tags"))
    return whole.select("plan_id", "pos", "canonical", F.filter("tags", lambda t: t != F.col("canonical")).alias("variants"))


def mapping(plan: DataFrame) -> DataFrame:
    """(tag, canonical) of a plan's variants."""
    return plan.select(F.explode("variants").alias("tag"), "canonical")


def remapped(rows: DataFrame, names: DataFrame, key: str, tags: str = "tags") -> DataFrame:
    """(``key``, old, new) of rows with a list of tags: each tag by its canonical, in order, once each."""
    each = rows.select(key, F.posexplode(tags).alias("pos", "tag")).join(names, "tag", "left").select(key, "pos", "tag", F.coalesce("canonical", "tag").alias("mapped"))
    lists = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "tag", "mapped"))).alias("x"))
    return lists.select(key, F.col("x.tag").alias("old"), F.array_distinct(F.filter(F.col("x.mapped"), lambda t: t != "")).alias("new"))


def rewritten(files: DataFrame, names: DataFrame) -> DataFrame:
    """(path, content) of the files (path, content) whose ``tags`` change under ``names`` (tag, canonical); only that line does."""
    meta = M.parse_front(M.front(F.col("content")))
    held = files.select("path", meta.alias("f")).select("path", F.coalesce(F.try_element_at("f.lists", F.lit("tags")), F.array_compact(F.array(F.nullif(F.try_element_at("f.scalars", F.lit("tags")), F.lit(""))))).alias("tags"))
    changed = remapped(held, names, "path").where(F.col("old") != F.col("new"))
    done = edited(files, changed.select(*edit(F.col("path"), F.lit(0), "list", F.lit("tags"), values=F.col("new"))))
    return done.select("path", "content")


