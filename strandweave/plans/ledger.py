"""Registered queries: record-level writes and lookups, review verdicts, pipeline steps, replayed merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import markdown as MD
from ..operators import captures as CP
from ..operators import entities as E
from ..operators import graph as G
from ..operators import ledger as L
from .catalog import _SURF, _TYPES, query

_NOW = "2024-12-31 00:00:00"
_SEED_TYPES = ["person", "place", "topic"]


def _now():
    return F.to_timestamp(F.lit(_NOW))


def _id(prefix: str, key) -> F.Column:
    return F.concat(F.lit(f"{prefix}:"), F.lpad(key.cast("string"), 10, "0"))


# runs


@query("select substring(sha256('capture' || chr(0) || cast(ts as varchar)), 1, 32) as run_key, 'capture' as agent, 'running' as status, user_id as parent_run_id, case when event_id % 3 = 0 then 'manual' else 'scheduled' end as trigger_name from events where event_type = 'signup'")
def run_start(m):
    trigger = F.when(F.col("event_id") % 3 == 0, "manual").when(F.col("event_id") % 3 == 1, "odd")
    asked = m.events.where("event_type = 'signup'").select(F.lit("capture").alias("agent"), F.col("ts").alias("started_at"), F.col("user_id").alias("parent_run_id"), trigger.alias("trigger_name"))
    return L.opened(asked).drop("started_at")


@query("select run_id, agent, case when run_id % 2 = 0 then 'partial' else status end as status, case when run_id % 2 = 0 then null else cost end as cost from agent_runs", "agent_runs")
def run_finish(m):
    ends = m.events.where("event_id % 2 = 0").select(F.col("event_id").alias("run_id"), F.lit("partial").alias("status"), F.lit(None).cast("double").alias("cost"))
    return L.updated(m.agent_runs, ends, "run_id").select("run_id", "agent", "status", "cost")


_RUN_IDS = "event_id % 20 = 0"


@query(f"select run_id, agent, status from agent_runs where run_id in (select event_id from events where {_RUN_IDS})", "agent_runs")
def point_lookups(m):
    ids = m.events.where(_RUN_IDS).select(F.col("event_id").alias("run_id"))
    return m.agent_runs.join(ids, "run_id", "left_semi").select("run_id", "agent", "status")


_STEPS = [("nightly", 0, "chat-distiller", "continue"), ("nightly", 1, "reindex", "continue"), ("nightly", 2, "profiles", "continue"), ("nightly", 3, "dedup-sweep", "halt"), ("nightly", 4, "graph-health", "continue"), ("weekly", 0, "graph-health", "halt"), ("weekly", 1, "unwired", "continue"), ("weekly", 2, "reindex", "halt"), ("weekly", 3, "nightly", "continue")]
_STEP_SQL = "steps as (select * from (values " + ", ".join(f"('{p}', {n}, '{s}', '{o}')" for p, n, s, o in _STEPS) + ") as v(kind, position, step, on_fail))"


def _steps(m):
    return m.spark.createDataFrame([(p, n, s, o, s != "unwired") for p, n, s, o in _STEPS], "kind string, position int, step string, on_fail string, wired boolean")


@query(
    f"""+ {_STEP_SQL}, own as (select 'w' || cast(run_id // 100 as varchar) as pipeline, agent, max(run_id) as run_id, max_by(status, run_id) as last, bool_or(status not in ('succeeded', 'skipped')) as bad from agent_runs group by 1, 2),
  p as (select distinct pipeline, 'nightly' as kind from own union all select distinct pipeline, 'weekly' from own),
  o as (select p.pipeline || '/' || p.kind as pipeline, position, step, on_fail, case when step = 'unwired' then 'missing' when bad then 'failed' when last is null then 'skipped' else last end as status, run_id from p join steps using (kind) left join own on own.pipeline = p.pipeline and own.agent = step)
  select pipeline, position, step, status, run_id from o where not exists (select 1 from o e where e.pipeline = o.pipeline and e.position < o.position and e.on_fail = 'halt' and e.status in ('failed', 'missing'))""",
    "agent_runs",
)
def pipeline_run(m):
    """Each hundred runs count as what one start of the nightly and the weekly pipeline opened."""
    runs = m.agent_runs.withColumn("at", F.concat(F.lit("w"), F.floor(F.col("run_id") / 100).cast("string")))
    kinds = m.spark.createDataFrame([("nightly",), ("weekly",)], "kind string")
    own = runs.join(F.broadcast(kinds)).withColumn("pipeline", F.concat("at", F.lit("/"), "kind"))
    steps = own.select("pipeline", "kind").distinct().join(F.broadcast(_steps(m)), "kind").drop("kind")
    return L.step_outcomes(steps, own).select("pipeline", "position", "step", "status", "run_id")


@query(f"+ {_STEP_SQL}, r as (select *, row_number() over (partition by agent order by started_at desc, run_id desc) as k from agent_runs) select step as agent, min(case kind when 'nightly' then 0 else 1 end * 1000 + position) as place, string_agg(distinct kind, ',' order by kind) as pipelines, max(run_id) as last_run, max(status) as last_status from steps left join r on agent = step and k = 1 group by 1", "agent_runs")
def roster(m):
    steps = _steps(m).select(F.when(F.col("kind") == "nightly", 0).otherwise(1).alias("pipeline_no"), F.col("kind").alias("pipeline"), "position", "step")
    return L.roster(steps, m.agent_runs).withColumn("pipelines", F.array_join("pipelines", ","))


# captures, media, conversations


@query(f"select capture_id, kind, status, created_at from captures union all select 20000000 + o_orderkey, 'text', 'organizing', case when o_orderkey % 3 = 0 then timestamp '{_NOW}' else cast(o_orderdate as timestamp) end from orders where o_orderkey % 5 = 0", "captures")
def capture_create(m):
    """New captures, with the present time where none is given; one that is there already stays as it is."""
    at = F.coalesce(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate").cast("timestamp")), _now())
    new = m.orders.where("o_orderkey % 5 = 0").select((F.col("o_orderkey") + 20000000).alias("capture_id"), F.lit("text").alias("kind"), F.lit("organizing").alias("status"), at.alias("created_at"))
    again = m.captures.select("capture_id", F.lit("twice").alias("kind"), "status", "created_at")
    return L.inserted(m.captures.select("capture_id", "kind", "status", "created_at"), new.union(again), ["capture_id"])


_DRAFT = "case when capture_id % 4 = 0 then 'draft' else status end"


@query(f"select user_id, arg_max(capture_id, (created_at, capture_id)) as capture_id from captures where {_DRAFT} = 'draft' and not removed group by 1", "captures")
def capture_draft(m):
    return L.active_draft(m.captures.withColumn("status", F.expr(_DRAFT)), "user_id").select("user_id", "capture_id")


@query("select capture_id, kind, raw_text from captures where capture_id % 20 = 0", "captures")
def capture_get(m):
    ids = m.events.where("event_id % 20 = 0").select(F.col("event_id").alias("capture_id"))
    return m.captures.join(ids, "capture_id", "left_semi").select("capture_id", "kind", "raw_text")


@query("select capture_id, kind from captures where not (kind = 'voice' and status = 'failed')", "captures")
def capture_delete(m):
    gone = m.captures.where("kind = 'voice' and status = 'failed'").select("capture_id")
    return m.captures.join(gone, "capture_id", "left_anti").select("capture_id", "kind")


@query("select media_id, capture_id, kind, status from media union all select 20000000 + doc_id, doc_id, 'photo', 'pending' from documents", "media")
def media_create(m):
    new = m.documents.select((F.col("doc_id") + 20000000).alias("media_id"), F.col("doc_id").alias("capture_id"), F.lit("photo").alias("kind"), F.lit("pending").alias("status"))
    own = m.media.select("media_id", "capture_id", "kind", "status")
    return L.inserted(own, new.union(own), ["media_id"])


@query("select media_id, case when media_id % 3 = 0 and status = 'pending' then 'derived' else status end as status, case when media_id % 3 = 0 and status = 'pending' then 'seen at last' else derived_text end as derived_text from media", "media")
def media_set(m):
    """Only what is pending takes a result; a later one does not overwrite it."""
    found = m.events.where("event_id % 3 = 0").select(F.col("event_id").alias("media_id"), F.lit("derived").alias("status"), F.lit("seen at last").alias("derived_text"))
    return L.updated(m.media, found, "media_id", F.col("status") == "pending").select("media_id", "status", "derived_text")


@query("select media_id, kind, capture_id from media where media_id % 20 = 0", "media")
def media_get(m):
    ids = m.events.where("event_id % 20 = 0").select(F.col("event_id").alias("media_id"))
    return m.media.join(ids, "media_id", "left_semi").select("media_id", "kind", "capture_id")


@query("select media_id from media where capture_id not in (select capture_id from captures where removed)", "media", "captures")
def media_delete(m):
    """A removed capture takes its media along."""
    return m.media.join(m.captures.where("removed").select("capture_id"), "capture_id", "left_anti").select("media_id")


_OUT = "coalesce(trim(derived_text), '')"


@query(f"select media_id, case when kind = 'photo' then case when status = 'derived' and {_OUT} <> '' then '<photo: ' || trim(derived_text) || '>' else '<photo — description unavailable>' end when status = 'derived' and {_OUT} <> '' then trim(derived_text) else '<voice note — transcript unavailable>' end as text from media", "media")
def media_text(m):
    """A photo's description in a fence, a voice note's words as they are, else the placeholder."""
    body, there = CP.part_body(), (F.col("status") == "derived") & (F.trim(F.coalesce("derived_text", F.lit(""))) != "")
    return m.media.select("media_id", F.when((F.col("kind") == "photo") & there, F.concat(F.lit("<photo: "), body, F.lit(">"))).otherwise(body).alias("text"))


@query(f"select session_id, min(at_minute) as created, case when session_id % 2 = 0 then 'Talk ' || cast(session_id as varchar) end as title, case when session_id % 3 = 0 then 'm2' else 'm1' end as last_model from chat_messages group by 1", "chat_messages")
def chat_session_create(m):
    """Sessions as they are opened, then titled and given their last model."""
    new = m.chat_messages.groupBy("session_id").agg(F.min("at_minute").alias("created")).select("session_id", "created", F.lit(None).cast("string").alias("title"), F.lit("m1").alias("last_model"))
    title = new.where("session_id % 2 = 0").select("session_id", F.concat(F.lit("Talk "), F.col("session_id").cast("string")).alias("title"))
    model = new.where("session_id % 3 = 0").select("session_id", F.lit("m2").alias("last_model"))
    return L.updated(L.updated(new, title, "session_id"), model, "session_id")


@query("select session_id, turn, role, content from chat_messages union all select session_id, max(turn) + 1, 'user', 'And then?' from chat_messages group by 1", "chat_messages")
def chat_add_message(m):
    own = m.chat_messages.select("session_id", "turn", "role", "content")
    new = own.groupBy("session_id").agg((F.max("turn") + 1).alias("turn")).select("session_id", "turn", F.lit("user").alias("role"), F.lit("And then?").alias("content"))
    return L.inserted(own, new, ["session_id", "turn"])


@query("select event_id as capture_id, event_id in (select capture_id from captures where kind = 'text') as recorded from events", "captures")
def auto_recorded_is(m):
    known = m.captures.where("kind = 'text'").select("capture_id", F.lit(True).alias("there"))
    rows = m.events.select(F.col("event_id").alias("capture_id")).join(known, "capture_id", "left")
    return rows.select("capture_id", F.coalesce("there", F.lit(False)).alias("recorded"))


@query("select event_id as capture_id, coalesce(not removed, false) as done from events left join captures on capture_id = event_id where event_id % 2 = 0", "captures")
def auto_recorded_tombstone(m):
    """Whether the removal did anything: not for captures that are gone or were removed before."""
    rows = m.events.where("event_id % 2 = 0").select(F.col("event_id").alias("capture_id")).join(m.captures.select("capture_id", "removed"), "capture_id", "left")
    return rows.select("capture_id", F.coalesce(~F.col("removed"), F.lit(False)).alias("done"))


# review


@query("select item_id, kind, status from review_queue union all select 20000000 + doc_id, 'content-dedup', 'pending' from labels where toxic = 1", "review_queue")
def review_enqueue(m):
    """New items join the queue as pending; filing one again changes nothing."""
    own = m.review_queue.select("item_id", "kind", "status")
    new = m.labels.where("toxic = 1").select((F.col("doc_id") + 20000000).alias("item_id"), F.lit("content-dedup").alias("kind"), F.lit("pending").alias("status"))
    return L.inserted(own, new.union(own.withColumn("status", F.lit("pending"))), ["item_id"])


_CHOICE = "case item_id % 5 when 0 then ' a1 ' when 1 then 'new' when 2 then 'maybe' when 3 then 'zz' else 'a2' end"


@query(f"select item_id, case item_id % 5 when 2 then 'maybe' when 3 then 'pending' when 1 then case when item_id % 2 = 0 then 'resolved' else 'pending' end else 'resolved' end as status, case item_id % 5 when 0 then 'a1' when 4 then 'a2' end as link_to, item_id % 10 = 6 as mint, case when item_id % 5 = 3 then 'unknown choice' when item_id % 10 = 1 then 'no usable mention' end as error from review_queue", "review_queue")
def review_entity(m):
    kind = F.when(F.col("item_id") % 2 == 0, "person").otherwise("memory")
    items = m.review_queue.select("item_id", F.expr(_CHOICE).alias("choice"), F.array(F.lit("a1"), F.lit("a2")).alias("candidates"), F.lit("Jo").alias("name"), kind.alias("type"), F.array(*map(F.lit, _SEED_TYPES)).alias("types"))
    return L.entity_verdicts(items)


@query("select item_id, case item_id % 4 when 0 then 'resolved' when 1 then 'discarded' when 2 then 'maybe' else 'pending' end as status, case when item_id % 4 = 0 then case when item_id % 8 = 0 then timestamp '2024-05-01 10:00:00' else created_at end end as captured_at, case when item_id % 4 = 3 then 'unknown verdict' end as error from review_queue", "review_queue")
def review_stance(m):
    verdict = F.expr("case item_id % 4 when 0 then ' Agree' when 1 then 'disagree' when 2 then 'MAYBE' else 'hm' end")
    at = F.when(F.col("item_id") % 8 == 0, "2024-05-01T10:00:00").otherwise("some day")
    items = m.review_queue.select("item_id", verdict.alias("verdict"), F.lit("Likes tea").alias("candidate_text"), F.lit("s1").alias("session"), at.alias("anchor_at"), "created_at")
    return L.stance_verdicts(items)


@query(
    """+ i as (select o_orderkey as item_id, 'o:' || lpad(cast(o_orderkey * 2 as varchar), 10, '0') as node_id, case o_orderkey % 5 when 0 then 'maybe' when 1 then 'dismiss' when 2 then '' else 'May' end as answer, case when o_orderkey % 5 = 3 then date '2024-05-01' end as resolved from orders)
  select item_id, case when answer = '' then 'pending' when answer = 'maybe' then 'maybe' when answer = 'dismiss' or nodes.id is null then 'discarded' when resolved is null then 'pending' else 'resolved' end as status, node_id, case when nodes.id is not null then resolved end as occurred, case when answer = '' then 'no answer' when answer = 'May' and nodes.id is not null and resolved is null then 'no date in the answer' end as error from i left join nodes on nodes.id = node_id""",
    "nodes",
)
def review_occurred(m):
    key = F.col("o_orderkey")
    answer = F.expr("case o_orderkey % 5 when 0 then ' Maybe' when 1 then 'DISMISS' when 2 then ' ' else 'May' end")
    items = m.orders.select(key.alias("item_id"), _id("o", key * 2).alias("node_id"), answer.alias("answer"), F.when(key % 5 == 3, F.to_date(F.lit("2024-05-01"))).alias("resolved"))
    return L.date_verdicts(items, m.nodes)


@query(f"+ i as (select 'd:' || lpad(cast(event_id as varchar), 10, '0') as node_id, case event_id % 3 when 0 then 'pending' when 1 then 'maybe' else 'resolved' end as status from events) select id, title, type from nodes where merged_into is null and occurred_start is null and store_path not like 'inbox/%' and type not in {_TYPES} and id not in (select node_id from i where status in ('pending', 'maybe')) order by created_on desc nulls last, id limit 50", "nodes")
def occurred_enrichment(m):
    status = F.expr("case event_id % 3 when 0 then 'pending' when 1 then 'maybe' else 'resolved' end")
    items = m.events.select(_id("d", F.col("event_id")).alias("node_id"), status.alias("status"))
    return L.undated(m.nodes, items, E.ENTITY_TYPES, ["pending", "maybe", "discarded"], 50)


@query("select src as a, dst as b, cast(substring(src, 3) as int) % 2 = 0 as filed from edges where origin = 'derived'", "edges")
def dedup_refile_guard(m):
    """Whether a pair was filed before, whatever became of it."""
    pairs = m.edges.where("origin = 'derived'").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    filed = m.documents.where("doc_id % 2 = 0").select(_id("d", F.col("doc_id")).alias("a"), _id("d", F.col("doc_id") + 1).alias("b"), F.lit(True).alias("there"))
    return pairs.join(filed, ["a", "b"], "left").select("a", "b", F.coalesce("there", F.lit(False)).alias("filed"))


@query("select a, b from (select c_custkey as a, c_custkey + 1 as b from customer) where (a, b) not in (select (o_custkey, o_custkey + o_orderkey % 3) from orders)")
def entity_review_exists(m):
    """The pairs that no item of any status is about yet."""
    pairs = m.customer.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    return pairs.join(m.orders.select(F.col("o_custkey").alias("a"), (F.col("o_custkey") + F.col("o_orderkey") % 3).alias("b")), ["a", "b"], "left_anti")


# stored merges, decisions to keep, profiles, settings

_MERGES = "md as (select o_orderkey as id, 'supp ' || cast(o_orderkey % 40 as varchar) as loser_key, o_custkey as survivor, cast(o_orderdate as date) as created_on from orders where o_orderkey % 3 = 0), mr as (select * from (select *, row_number() over (partition by loser_key order by created_on desc, id desc) as k from md) where k = 1)"


def _merges(m):
    key = F.concat(F.lit("supp "), (F.col("o_orderkey") % 40).cast("string"))
    rows = m.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), key.alias("loser_key"), F.col("o_custkey").alias("survivor"), F.to_date("o_orderdate").alias("created_on"))
    return L.upserted(rows.limit(0), rows, ["loser_key"], [F.desc("created_on"), F.desc("id")])


@query(f"+ {_MERGES} select loser_key, id, survivor, created_on from mr", "nodes")
def merge_record(m):
    """One decision a loser, the last one made."""
    return _merges(m).select("loser_key", "id", "survivor", "created_on")


@query(f"+ {_MERGES} select loser_key, row_number() over (order by created_on, loser_key) as place from mr", "nodes")
def merge_all(m):
    """The order in which stored merges are replayed; one row a loser that was ever merged by hand."""
    from pyspark.sql import Window

    return _merges(m).select("loser_key", F.row_number().over(Window.orderBy("created_on", "loser_key")).cast("long").alias("place"))


@query(f"+ {_MERGES} select count(*) as n from mr", "nodes")
def merge_count(m):
    return _merges(m).agg(F.count("*").alias("n"))


@query("select c_custkey, c_name as key from customer where c_custkey % 5 = 0")
def keep_all(m):
    """Every stored decision to keep; they are as many as were made by hand."""
    return m.customer.where("c_custkey % 5 = 0").select("c_custkey", F.col("c_name").alias("key"))


@query("select id, case when cast(substring(id, 3) as int) % 2 = 0 then 'full' else 'stub' end as tier, case when cast(substring(id, 3) as int) % 2 = 0 then upper(title) else title end as profile from nodes where type = 'person'", "nodes")
def profile_upsert(m):
    hubs = m.nodes.where("type = 'person'").select("id", F.lit("stub").alias("tier"), F.col("title").alias("profile"))
    new = hubs.where("cast(substring(id, 3) as int) % 2 = 0").select("id", F.lit("full").alias("tier"), F.upper("profile").alias("profile"))
    return L.upserted(hubs, new, ["id"])


@query(f"select id, type, title, merged_into from nodes where type in {_TYPES} and id in (select 'c:' || lpad(cast(event_id as varchar), 10, '0') from events where event_id % 20 = 0)", "nodes")
def entity_get(m):
    ids = m.events.where("event_id % 20 = 0").select(_id("c", F.col("event_id")).alias("id"))
    return m.nodes.where(F.col("type").isin(E.ENTITY_TYPES)).join(ids, "id", "left_semi").select("id", "type", "title", "merged_into")


_BLOB = "case c_custkey % 4 when 0 then '{\"text\": \" Capsule ' || c_name || ' \"}' when 1 then '{\"text\": \"  \"}' when 2 then 'junk' else null end"


@query("select c_custkey, case when c_custkey % 4 = 0 then 'Capsule ' || c_name end as text from customer")
def capsule_get(m):
    """The stored text; junk, blank and missing ones are null."""
    text = F.trim(F.from_json(F.expr(_BLOB), "text string")["text"])
    return m.customer.select("c_custkey", F.when(text != "", text).alias("text"))


@query("select 'identity-capsule' as key, 'C ' || c_name as text from customer order by c_custkey desc limit 1")
def capsule_save(m):
    """One setting, the last text saved."""
    rows = m.customer.select(F.lit("identity-capsule").alias("key"), F.concat(F.lit("C "), "c_name").alias("text"), "c_custkey")
    return L.upserted(rows.limit(0), rows, ["key"], [F.desc("c_custkey")]).select("key", "text")


@query("select c_custkey, case c_custkey % 3 when 0 then 'place,mood' else '' end as added from customer")
def vocab_get(m):
    """The stored additions; what is no list counts as none."""
    blob = F.expr("case c_custkey % 3 when 0 then '{\"types\": [\"place\", \"mood\"]}' when 1 then '{\"types\": 7}' else null end")
    kept = F.from_json(blob, "types array<string>")["types"]
    return m.customer.select("c_custkey", F.array_join(F.coalesce(kept, F.array().cast("array<string>")), ",").alias("added"))


@query("select c_custkey, case when c_custkey % 3 = 0 then 'place,mood' when c_custkey % 3 = 1 then 'place,mood,' || lower(c_mktsegment) else 'place,' || lower(c_mktsegment) end as types from customer")
def vocab_upsert(m):
    """An addition goes to the end of the list unless it is there."""
    k = F.col("c_custkey") % 3
    held = F.when(k == 2, F.array(F.lit("place"))).otherwise(F.array(F.lit("place"), F.lit("mood")))
    new = F.when(k == 0, "mood").otherwise(F.lower("c_mktsegment"))
    return m.customer.select("c_custkey", F.array_join(F.array_union(held, F.array(new)), ",").alias("types"))


# names, texts, lines for prompts


_ASKED = "list_concat(list_concat([upper(title), ' ' || lower(title) || '  ', title || ' x'], list_transform(aliases, lambda a: upper(a))), ['nobody'])"
_KEY = "trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"


@query(f"+ q as (select id, type, title, aliases, unnest(list_distinct({_ASKED})) as asked from nodes where type in ('place', 'person')), k as (select *, {_KEY.format(x='asked')} as key from q) select id, asked, key = {_KEY.format(x='title')} or list_contains(list_transform(aliases, lambda a: {_KEY.format(x='a')}), key) as is_exact, key || '/' || type as mention_key from k", "nodes")
def exact_test(m):
    """Whether a mention is an entity's title or alias in another spelling, and the mention's key."""
    spelled = F.array(F.upper("title"), F.concat(F.lit(" "), F.lower("title"), F.lit("  ")), F.concat("title", F.lit(" x")))
    asked = F.explode(F.array_distinct(F.concat(spelled, F.transform("aliases", lambda a: F.upper(a)), F.array(F.lit("nobody")))))
    rows = m.nodes.where("type in ('place', 'person')").select("id", "type", "title", "aliases", asked.alias("asked")).withColumn("key", C.normalize_alias(F.col("asked")))
    exact = (C.normalize_alias(F.col("title")) == F.col("key")) | F.exists("aliases", lambda a: C.normalize_alias(a) == F.col("key"))
    return rows.select("id", "asked", exact.alias("is_exact"), F.concat("key", F.lit("/"), "type").alias("mention_key"))


@query(rf"select id, strip_accents(title) as title, string_agg(strip_accents(t), ',') as tags from (select id, title, unnest(tags) as t from nodes where type = 'insight') group by 1, 2", "nodes")
def fold_document(m):
    rows = m.nodes.where("type = 'insight'").select("id", "title", F.concat_ws(",", "tags").alias("tags"))
    return rows.select("id", MD.fold_marks("title").alias("title"), MD.fold_marks("tags").alias("tags"))


@query("select 'tag' as part, '- ' || tag || ' (' || cast(count(*) as varchar) || ')' as line from (select unnest(tags) as tag from nodes) group by tag union all select 'edge', '\"' || coalesce(s.title, '(untitled)') || '\" --' || rel || '--> \"' || coalesce(d.title, '(untitled)') || '\"' from edges left join nodes s on s.id = src left join nodes d on d.id = dst", "nodes", "edges")
def prompt_lists(m):
    tags = m.nodes.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    lines = tags.select(F.lit("tag").alias("part"), F.concat(F.lit("- "), "tag", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("line"))
    src, dst = m.nodes.select(F.col("id").alias("src"), F.col("title").alias("s")), m.nodes.select(F.col("id").alias("dst"), F.col("title").alias("d"))
    drawn = m.edges.join(src, "src", "left").join(dst, "dst", "left")
    q = lambda c: F.concat(F.lit('"'), F.coalesce(c, F.lit("(untitled)")), F.lit('"'))
    return lines.union(drawn.select(F.lit("edge"), F.concat(q("s"), F.lit(" --"), "rel", F.lit("--> "), q("d"))))


@query("+ b as (select dst as id, rel || ' <- ' || src as line, row_number() over (partition by dst order by rel, src) as n, count(*) over (partition by dst) as total from edges) select id, string_agg(line, chr(10) order by n) || case when max(total) > 5 then chr(10) || '… ' || cast(max(total) - 5 as varchar) || ' more' else '' end as block from b where n <= 5 group by 1", "edges")
def md_render(m):
    """A node's first five edges as lines, and how many more there are."""
    total = m.edges.groupBy("dst").agg(F.count("*").alias("total"))
    rows = E.first_by(m.edges.select("dst", "rel", "src"), ["dst"], ["rel", "src"], 5).join(total, "dst")
    line = F.struct("rel", "src", F.concat("rel", F.lit(" <- "), "src").alias("line"))
    out = rows.groupBy("dst").agg(F.sort_array(F.collect_list(line)).alias("lines"), F.max("total").alias("total"))
    more = F.when(F.col("total") > 5, F.concat(F.lit("\n… "), (F.col("total") - 5).cast("string"), F.lit(" more"))).otherwise("")
    return out.select(F.col("dst").alias("id"), F.concat(F.array_join("lines.line", "\n"), more).alias("block"))


@query("select src as a, dst as b, '\"' || x.title || '\" and \"' || y.title || '\" look alike (' || rel || ')' as hint from edges join nodes x on x.id = src join nodes y on y.id = dst where origin = 'derived'", "edges", "nodes")
def pair_excerpts(m):
    x, y = m.nodes.select(F.col("id").alias("src"), F.col("title").alias("s")), m.nodes.select(F.col("id").alias("dst"), F.col("title").alias("d"))
    rows = m.edges.where("origin = 'derived'").join(x, "src").join(y, "dst")
    return rows.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.format_string('"%s" and "%s" look alike (%s)', "s", "d", "rel").alias("hint"))


@query("select o_orderkey, case when o_orderkey % 3 = 2 then '' else 'You value ' || o_orderpriority || '.' end as text from orders")
def capsule_clean(m):
    """A reply without its fence and the sentences that only announce it; nothing else left is empty."""
    said = F.expr("case o_orderkey % 3 when 0 then '```text\nYou value ' || o_orderpriority || '.\n```' when 1 then 'Sure! Here is the capsule:\n\nYou value ' || o_orderpriority || '. ' else 'Here is the capsule:' end")
    bare = F.trim(F.regexp_replace(F.trim(said), r"^```\w*\s*|\s*```$", ""))
    return m.orders.select("o_orderkey", F.trim(F.regexp_replace(bare, r"^(?i)(?:(?:sure|certainly|of course|okay)[!.,]\s*|here(?:'s| is)[^:\n]*:\s*)+", "")).alias("text"))


@query("select src, dst, rel, origin from edges where origin = 'canonical' union all select 'd:' || lpad(cast(doc_id as varchar), 10, '0'), 'd:' || lpad(cast(doc_id + 2 as varchar), 10, '0'), 'similar', 'derived' from documents where doc_id % 4 = 0", "edges")
def derived_replace(m):
    """All edges of the derived origin give way to the new ones; canonical ones stay."""
    new = m.documents.where("doc_id % 4 = 0").select(_id("d", F.col("doc_id")).alias("src"), _id("d", F.col("doc_id") + 2).alias("dst"), F.lit("similar").alias("rel"), F.lit("derived").alias("origin"))
    return m.edges.where("origin <> 'derived'").select("src", "dst", "rel", "origin").unionByName(new)


_ACC = "a as (select id, title, aliases, 'Kundin ' || cast(cast(substring(id, 3) as int) as varchar) as surface from nodes where type = 'person' and merged_into is null)"


@query(f"+ {_ACC} select id, surface, len(aliases) + 1 as n from a where cast(substring(id, 3) as int) % 3 <> 0 union all select id, 'Cust ' || cast(cast(substring(id, 3) as int) as varchar), 1 from a where cast(substring(id, 3) as int) % 3 = 0 and len(aliases) = 0 and length('Cust') >= 4", "nodes")
def alias_accrete(m):
    """A linked mention's spelling becomes an alias, unless it says too little or is one already."""
    n = F.expr("cast(substring(id, 3) as int)")
    surface = F.concat(F.when(n % 3 == 0, "Cust ").otherwise("Kundin "), n.cast("string"))
    rows = G.live(m.nodes).where("type = 'person'").select("id", "aliases", surface.alias("surface"))
    new = (F.size(C.significant_tokens(F.col("surface"))) > 0) & ~F.exists("aliases", lambda a: C.normalize_alias(a) == C.normalize_alias(F.col("surface")))
    return rows.where(new).select("id", "surface", (F.size("aliases") + 1).alias("n"))


@query("select id from nodes where merged_into is null and occurred_start <= date '1996-03-31'", "nodes")
def filt_as_of(m):
    from ..operators.search import Params, wanted

    return wanted(m.nodes, Params("2024-12-31", until="1996-03-31")).select("id")
