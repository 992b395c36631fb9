"""Records as tables: every write is a transition from one table to the next, every read a filter.

Rows are named by keys that follow from their content, so that a job that is run again files nothing twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRIGGERS = ["scheduled", "manual"]


def record_key(*parts: str) -> Column:
    """A key from the columns that name a record."""
    return F.substring(F.sha2(F.concat_ws("\x00", *[F.coalesce(F.col(p).cast("string"), F.lit("\x01")) for p in parts]), 256), 1, 32)


def upserted(table: DataFrame, rows: DataFrame, keys: list[str], newest: list | None = None) -> DataFrame:
    """``table`` with ``rows`` in place of those of the same keys; of several rows of a key the ``newest`` counts."""
    if newest is not None:
        w = Window.partitionBy(*keys).orderBy(*newest)
        rows = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def inserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` and those ``rows`` whose keys it does not hold yet, one a key; columns that one side lacks are null."""
    new = rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(new, allowMissingColumns=True)


def updated(table: DataFrame, changes: DataFrame, key: str, guard: Column | None = None) -> DataFrame:
    """``table`` with the columns of ``changes`` (key, ...; one row a key) set where the key is in it and the row passes ``guard``.

    A change to null sets null; changes of unknown keys do nothing."""
    own = [c for c in changes.columns if c != key]
    new = changes.select(key, F.struct(*own).alias("_set"))
    hit = F.col("_set").isNotNull() & (F.lit(True) if guard is None else F.coalesce(guard, F.lit(False)))
    out = table.join(new, key, "left")
    return out.select(*[F.when(hit, F.col(f"_set.{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in table.columns])


def opened(asked: DataFrame) -> DataFrame:
    """Running rows for what was asked (agent, started_at, parent_run_id, trigger_name); an unknown trigger counts as scheduled."""
    trigger = F.when(F.col("trigger_name").isin(TRIGGERS), F.col("trigger_name")).otherwise(TRIGGERS[0])
    return asked.select(record_key("agent", "started_at").alias("run_key"), "agent", F.lit("running").alias("status"), "started_at", "parent_run_id", trigger.alias("trigger_name"))


def active_draft(captures: DataFrame, owner: str) -> DataFrame:
    """Each owner's newest draft that is not removed."""
    w = Window.partitionBy(owner).orderBy(F.desc("created_at"), F.desc("capture_id"))
    return captures.where("status = 'draft' and not removed").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def step_outcomes(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """(pipeline, position, step, on_fail, status, run_id, halted): what became of a pipeline's steps (pipeline,
    position, step, on_fail, wired).

    A step's status is that of its own run (pipeline, agent equal to the step), never that of runs it started: failed
    unless the run succeeded or was skipped, ``skipped`` without a run, ``missing`` where nothing is wired.  Steps after
    the first failure with ``halt`` do not appear.
    """
    own = runs.select("pipeline", F.col("agent").alias("step"), "run_id", F.col("status").alias("own"))
    own = own.groupBy("pipeline", "step").agg(F.max("run_id").alias("run_id"), F.max_by("own", "run_id").alias("last"), F.bool_or(~F.col("own").isin("succeeded", "skipped")).alias("bad"))
    status = F.when(~F.col("wired"), "missing").when(F.coalesce("bad", F.lit(False)), "failed").when(F.col("last").isNull(), "skipped").otherwise(F.col("last"))
    out = steps.join(own, ["pipeline", "step"], "left").withColumn("status", status)
    halts = F.col("status").isin("failed", "missing") & (F.col("on_fail") == "halt")
    before = Window.partitionBy("pipeline").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("halted", halts).withColumn("over", F.coalesce(F.max("halted").over(before), F.lit(False))).where(~F.col("over"))
    return out.select("pipeline", "position", "step", "on_fail", "status", F.when(F.col("wired"), F.col("run_id")).alias("run_id"), "halted")


def roster(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """(agent, place, pipelines, last_run, last_status): every step once, by its first place, with the pipelines it is in."""
    first = steps.groupBy(F.col("step").alias("agent")).agg(F.min(F.struct("pipeline_no", "position")).alias("place"), F.sort_array(F.collect_set("pipeline")).alias("pipelines"))
    last = runs.groupBy("agent").agg(F.max_by(F.struct("run_id", "status"), F.struct("started_at", "run_id")).alias("last"))
    out = first.join(last, "agent", "left")
    return out.select("agent", (F.col("place.pipeline_no") * 1000 + F.col("place.position")).alias("place"), "pipelines", F.col("last.run_id").alias("last_run"), F.col("last.status").alias("last_status"))


def entity_verdicts(items: DataFrame) -> DataFrame:
    """(item_id, status, link_to, mint, error) of verdicts on items (item_id, candidates, choice, name, type, types).

    A choice is a candidate's id, ``new`` or ``maybe``; a new entity needs a name and a type among ``types``."""
    choice = F.trim(F.coalesce("choice", F.lit("")))
    known = F.array_contains("candidates", choice)
    mintable = (F.trim(F.coalesce("name", F.lit(""))) != "") & F.coalesce(F.array_contains("types", F.trim(F.coalesce("type", F.lit("")))), F.lit(False))
    parked, new = choice == "maybe", choice == "new"
    error = F.when(parked | (new & mintable) | (~new & known), None).when(new, "no usable mention").otherwise("unknown choice")
    status = F.when(error.isNotNull(), "pending").when(parked, "maybe").otherwise("resolved")
    return items.select("item_id", status.alias("status"), F.when(known & ~parked & ~new, choice).alias("link_to"), (new & mintable).alias("mint"), error.alias("error"))


def stance_verdicts(items: DataFrame) -> DataFrame:
    """(item_id, status, captured_at, error) of verdicts on candidates (item_id, verdict, candidate_text, session,
    anchor_at, created_at): an agreed one becomes a capture at its anchor, else at the item's own time."""
    v = F.lower(F.trim(F.coalesce("verdict", F.lit(""))))
    usable = (F.trim(F.coalesce("candidate_text", F.lit(""))) != "") & F.col("session").isNotNull()
    error = F.when(~v.isin("agree", "disagree", "maybe"), "unknown verdict").when((v == "agree") & ~usable, "nothing to capture")
    status = F.when(error.isNotNull(), "pending").when(v == "agree", "resolved").when(v == "disagree", "discarded").otherwise("maybe")
    at = F.coalesce(F.expr("try_cast(anchor_at as timestamp)"), "created_at")
    return items.select("item_id", status.alias("status"), F.when(error.isNull() & (v == "agree"), at).alias("captured_at"), error.alias("error"))


#: Answers that leave a node without a date.
DISMISS = ["dismiss", "no date", "none", "skip", "unknown"]


def date_verdicts(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """(item_id, status, node_id, occurred, error) of answers (item_id, node_id, answer, resolved) on undated nodes: parked,
    dismissed, gone with their node, dated, or refused where the answer is no date."""
    answer = F.lower(F.trim(F.coalesce("answer", F.lit(""))))
    there = nodes.select(F.col("id").alias("node_id"), F.lit(True).alias("there"))
    out = items.join(there, "node_id", "left")
    gone = F.col("there").isNull()
    error = F.when(answer == "", "no answer").when(answer.isin("maybe", *DISMISS) | gone, None).when(F.col("resolved").isNull(), "no date in the answer")
    status = F.when(error.isNotNull(), "pending").when(answer == "maybe", "maybe").when(answer.isin(DISMISS) | gone, "discarded").otherwise("resolved")
    return out.select("item_id", status.alias("status"), "node_id", F.when(status == "resolved", F.col("resolved")).alias("occurred"), error.alias("error"))


def refreshed(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, signature, tier) of the profiles (id, signature, tier) whose signature is not the stored one; the rest need no work."""
    return wanted.join(stored.select("id", "signature"), ["id", "signature"], "left_anti")


def undated(nodes: DataFrame, items: DataFrame, entity_types: list[str], handled: list[str], most: int) -> DataFrame:
    """(id, title, type) of the newest ``most`` live content nodes without a date, out of the inbox, that no item
    (node_id, status) of a ``handled`` status asks about."""
    asked = items.where(F.col("status").isin(handled)).select(F.col("node_id").alias("id"))
    free = nodes.where("merged_into is null and occurred_start is null and store_path not like 'inbox/%'").where(~F.col("type").isin(entity_types))
    return free.join(asked, "id", "left_anti").orderBy(F.desc_nulls_last("created_on"), "id").limit(most).select("id", "title", "type")


def pair_verdicts(items: DataFrame, nodes: DataFrame, linkable: bool) -> DataFrame:
    """(item_id, status, survivor, loser, link_from, link_to, error) of verdicts on pairs (item_id, node_a, node_b, action,
    survivor, default_survivor): merge into the one that is asked for, else the proposed one; keep both; and, if the pair
    is ``linkable`` content, keep both with an edge.  Nodes have (id, merged_into); a pair that is not there, or merged
    already, is refused and stays open."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    a, b, action = text("node_a"), text("node_b"), F.lower(text("action"))
    keep = F.when(text("survivor") != "", text("survivor")).otherwise(text("default_survivor"))
    out = items.select("item_id", a.alias("a"), b.alias("b"), action.alias("act"), keep.alias("keep"))
    own = nodes.select("id", F.col("merged_into").isNotNull().alias("gone"))
    out = out.join(own.toDF("a", "a_gone"), "a", "left").join(own.toDF("b", "b_gone"), "b", "left")
    a, b, act, keep = (F.col(c) for c in ("a", "b", "act", "keep"))
    error = F.when((a == "") | (b == ""), "no pair").when(act == "keep", None)
    if linkable:
        error = error.when((act == "link") & F.col("a_gone").isNull(), "unknown node").when(act == "link", None)
    error = error.when(act != "merge", "unknown action").when((keep != a) & (keep != b), "survivor is not of the pair")
    error = error.when(F.col("a_gone").isNull() | F.col("b_gone").isNull(), "unknown node").when(F.col("a_gone") | F.col("b_gone"), "merged already")
    fine = error.isNull()
    status = F.when(~fine, "pending").when(act == "keep", "discarded").otherwise("resolved")
    merge, link = fine & (act == "merge"), fine & (act == "link")
    return out.select("item_id", status.alias("status"), F.when(merge, keep).alias("survivor"), F.when(merge, F.when(keep == a, b).otherwise(a)).alias("loser"), F.when(link, a).alias("link_from"), F.when(link, b).alias("link_to"), error.alias("error"))


def decisions(verdicts: DataFrame, forms: DataFrame) -> DataFrame:
    """(loser_key, survivor_type, survivor_forms, loser_type, loser_forms) of merged pairs, to be replayed after a rebuild;
    ``forms`` has (id, type, forms), the title's form first."""
    x, y = forms.toDF("survivor", "survivor_type", "survivor_forms"), forms.toDF("loser", "loser_type", "loser_forms")
    met = verdicts.where("survivor is not null").join(x, "survivor").join(y, "loser")
    key = F.concat("loser_type", F.lit("\x00"), F.array_join(F.sort_array("loser_forms"), "\x01"))
    return met.select("item_id", key.alias("loser_key"), "survivor_type", "survivor_forms", "loser_type", "loser_forms")
