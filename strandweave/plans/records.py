"""More registered queries: profiles, health findings, review and run records, dates in words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import entities as E
from ..operators import graph as G
from ..operators import records as R
from ..sources.bind import KINDS
from ..sources.clustered import around
from ..streaming import marks as MK
from .catalog import _AROUND, _LINKS, _SURF, _TYPES, ORACLE_SQL, QUERIES, TODAY, _near, query

_LIVE = "nodes where merged_into is null"


@query(f"+ {_LINKS}, deg as (select id, count(*) as degree from links group by 1) select n.id, title, coalesce(degree, 0) as degree, case when degree >= 8 then 'full' when degree >= 3 then 'snapshot' else 'stub' end as tier from nodes n left join deg on deg.id = n.id where merged_into is null and type in {_TYPES}", "nodes", "edges")
def node_detail(m):
    return R.details(m.nodes, m.degrees)


_OBS = f"""hubs as (select id as center from {_LIVE} and type in ('place', 'project')),
ends as (select dst as center, rel, src as node_id, since, until from edges where origin = 'canonical' and dst in (select center from hubs) union all select src, rel, dst, since, until from edges where origin = 'canonical' and src in (select center from hubs)),
obs as (select center, rel, title, node_id, coalesce(since, occurred_start) as since, until from ends join (select * from {_LIVE}) on id = node_id),
lines as (select *, '[' || rel || '] ' || title || case when since is not null and until is not null then ' (as of ' || cast(since as varchar) || ', until ' || cast(until as varchar) || ')' when since is not null then ' (as of ' || cast(since as varchar) || ')' when until is not null then ' (until ' || cast(until as varchar) || ')' else '' end as line from obs),
texts as (select center, count(*) as n, string_agg(line, chr(10) order by rel, since desc nulls last, title, node_id) as text from lines group by 1)"""


def _observations(m):
    hubs = G.live(m.nodes).where(F.col("type").isin("place", "project")).select(F.col("id").alias("center"))
    return R.observations(around(m, hubs, KINDS["place"] + KINDS["project"]))


@query(f"+ {_OBS} select center, rel, title, node_id, since, until from obs", "nodes", "edges")
def profile_observations(m):
    return _observations(m).select("center", "rel", "title", "node_id", "since", "until")


@query(f"+ {_OBS} select center, n, text from texts", "nodes", "edges")
def profile_stub(m):
    return R.stubs(_observations(m))




@query(f"+ {_LINKS} select n.id, title, count(*) as degree from nodes n join links on links.id = n.id where merged_into is null and type in {_TYPES} group by 1, 2 order by degree desc, n.id limit 20", "nodes", "edges")
def capsule_hubs(m):
    hubs = R.details(m.nodes, m.degrees).where("degree > 0")
    return hubs.select("id", "title", "degree").orderBy(F.desc("degree"), "id").limit(20)


@query(
    f"""+ newest as (select id, title, coalesce(occurred_start, created_on, indexed_on) as day, indexed_on from {_LIVE} and interiority = 'internal' order by day desc, indexed_on desc, id limit 15),
  firsts as (select node_id, arg_min(content, chunk_index) as content from chunks group by 1)
  select id, title, day, substring(content, 1, 160) as excerpt from newest left join firsts on node_id = id""",
    "nodes",
    "chunks",
)
def capsule_recent(m):
    return R.recent(G.live(m.nodes).where("interiority = 'internal'"), m.chunks, 15)


@query(f"select id, type, title from {_LIVE} and type in {_TYPES} and indexed_on >= date '2024-12-01'", "nodes")
def entities_touched_since(m):
    hubs = G.live(m.nodes).where(F.col("type").isin(E.ENTITY_TYPES))
    return hubs.where(F.col("indexed_on") >= F.to_date(F.lit("2024-12-01"))).select("id", "type", "title")


_SAMPLE = "select (select count(*) from found) as n, id from (select id from found order by id limit 10)"


@query(f"+ found as (select id from {_LIVE} and store_path like 'inbox/%') {_SAMPLE}", "nodes")
def health_inbox(m):
    return R.counted_sample(G.live(m.nodes).where("store_path like 'inbox/%'"), 10)


@query(f"+ found as (select id from {_LIVE} and type = 'memory' and occurred_start is null) {_SAMPLE}", "nodes")
def health_missing_occurred(m):
    return R.counted_sample(G.live(m.nodes).where("type = 'memory' and occurred_start is null"), 10)


@query(f"+ found as (select id from {_LIVE} and type in {_TYPES} and len(aliases) = 0) {_SAMPLE}", "nodes")
def health_alias_less(m):
    return R.counted_sample(G.live(m.nodes).where(F.col("type").isin(E.ENTITY_TYPES) & (F.size("aliases") == 0)), 10)


@query("select kind, count(*) as n, count(*) filter (where datediff('day', created_on, date '2024-01-31') > 14) as aged, min(created_on) as oldest from review_queue where status in ('pending', 'maybe') group by 1", "review_queue")
def health_review_aging(m):
    aged = F.datediff(F.to_date(F.lit("2024-01-31")), "created_on") > 14
    waiting = m.review_queue.where("status in ('pending', 'maybe')")
    return waiting.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(aged).alias("aged"), F.min("created_on").alias("oldest"))


@query(f"select count(*) as n, max(datediff('day', created_on, date '{TODAY}')) as oldest_days from review_queue where status = 'maybe'", "review_queue")
def maybe_digest(m):
    age = F.datediff(F.to_date(F.lit(TODAY)), "created_on")
    return m.review_queue.where("status = 'maybe'").agg(F.count("*").alias("n"), F.max(age).cast("long").alias("oldest_days"))


@query("(select item_id, kind, status, created_at, 'pending' as listed from review_queue where status = 'pending' order by created_at desc, item_id desc limit 50) union all (select item_id, kind, status, created_at, 'any occurred' from review_queue where kind = 'occurred' order by created_at desc, item_id desc limit 200)", "review_queue")
def review_list(m):
    """Two lists: what waits, and the items of one kind whatever their status, as many as may be asked for."""
    rows = m.review_queue.select("item_id", "kind", "status", "created_at")
    waiting = R.review_page(rows, " Pending ", None).withColumn("listed", F.lit("pending"))
    return waiting.union(R.review_page(rows, "all", "occurred", 9_999).withColumn("listed", F.lit("any occurred")))


@query("+ a as (select distinct agent from agent_runs union select 'backfill') select a.agent, coalesce(max(started_at) filter (where status = 'succeeded'), timestamp '2024-12-31' - interval 30 day) as watermark from a left join agent_runs r on r.agent = a.agent group by 1", "agent_runs")
def dedup_watermark(m):
    """Where each agent goes on; one that never succeeded starts a window back."""
    agents = m.agent_runs.select("agent").union(m.spark.range(1).select(F.lit("backfill")))
    now = F.lit("2024-12-31 00:00:00").cast(m.agent_runs.schema["started_at"].dataType)
    return MK.high_water(m.agent_runs, agents, now, 30).withColumnRenamed("since", "watermark")




@query("""+ numbered as (select *, row_number() over (partition by session_id order by at_minute desc, turn desc) as back from chat_messages),
  dropped as (select session_id, count(*) - 2 as n from chat_messages group by 1 having count(*) > 2)
  select session_id, turn, content as line from numbered where back <= 2 union all select session_id, -1, '… ' || cast(n as varchar) || ' lines dropped' from dropped""", "chat_messages")
def run_log_buffer(m):
    return R.bounded_log(m.chat_messages, 2)


@query("select capture_id, kind, trim(regexp_replace(raw_text, '\\s+', ' ', 'g')) as snippet, array_to_string(string_split(trim(regexp_replace(raw_text, '\\s+', ' ', 'g')), ' ')[1:8], ' ') as title from captures where not removed", "captures")
def inbox_fallback(m):
    flat = C.collapse(F.col("raw_text"))
    return m.captures.where("not removed").select("capture_id", "kind", flat.alias("snippet"), C.first_words(flat, 8).alias("title"))


_MD = "(year(o_orderdate) * 12 + month(o_orderdate) - 1996 * 12 - 1)"
_YD = "(year(o_orderdate) - 1996)"


def _ago(count: str, unit: str, delta: str) -> str:
    words = f"case when {count} = 1 then 'a {unit}' else cast({count} as varchar) || ' {unit}s' end"
    return f"case when {delta} < 0 then {words} || ' ago' else 'in ' || {words} end"


_YEARS = f"cast(floor(abs({_MD}) / 12.0::double + 0.5) as int)"


@query(f"select o_orderkey, case {_MD} when 0 then 'this month' when -1 then 'last month' when 1 then 'next month' else case when abs({_MD}) < 12 then {_ago(f'abs({_MD})', 'month', _MD)} else {_ago(_YEARS, 'year', _MD)} end end as said from orders")
def humanize_month(m):
    return m.orders.select("o_orderkey", C.humanize_months(F.to_date("o_orderdate"), F.to_date(F.lit("1996-01-01"))).alias("said"))


@query(f"select o_orderkey, case {_YD} when 0 then 'this year' when -1 then 'last year' when 1 then 'next year' else {_ago(f'abs({_YD})', 'year', _YD)} end as said from orders")
def humanize_year(m):
    return m.orders.select("o_orderkey", C.humanize_years(F.to_date("o_orderdate"), F.to_date(F.lit("1996-01-01"))).alias("said"))


_A, _O = "cast(o_orderdate as date)", "cast(o_orderkey % 40 - 20 as int)"


@query(f"select o_orderkey, strftime({_A} + {_O}, '%Y-%m-%d') as day, strftime({_A} + {_O} * 7, '%Y-%m-%d') as week, strftime(date_trunc('month', {_A}) + to_months({_O}), '%Y-%m') as month, cast(year({_A}) + {_O} as varchar) as year from orders")
def resolve_relative(m):
    anchor, offset = F.to_date("o_orderdate"), (F.col("o_orderkey") % 40 - 20).cast("int")
    return m.orders.select("o_orderkey", *[C.relative(anchor, offset, unit).alias(unit) for unit in ("day", "week", "month", "year")])


__all__: list[str] = []


@query(f"+ {_OBS} select center, max(since) as newest from obs group by 1 having max(since) < date '2022-01-01'", "nodes", "edges")
def health_stale(m):
    newest = _observations(m).groupBy("center").agg(F.max("since").alias("newest"))  # an undated hub is never stale
    return newest.where(F.col("newest") < F.to_date(F.lit("2022-01-01")))




@query(f"select * from ({ORACLE_SQL['dedup_canonicalize']}) order by score desc, a, b limit 200")
def dedup_cap(m):
    return QUERIES["dedup_canonicalize"](m.spark, m.sf_dir).orderBy(F.desc("score"), "a", "b").limit(200)


@query(
    f"{_AROUND} select center, node_id, rtrim(translate(to_base64(encode(cast(to_json([origin, rel, dir, node_id]) as varchar))), '+/', '-_'), '=') as cursor from near",
    "nodes",
    "edges",
)
def neighbors_cursor(m):
    return _near(m).select("center", "node_id", C.cursor("origin", "rel", "dir", "node_id").alias("cursor"))


_SEEDS = "memory person idea conversation insight place event project topic".split()






@query("select capture_id from captures where status = 'organizing' and created_at < timestamp '2024-01-10'", "captures")
def draft_gc(m):
    return m.captures.where("status = 'organizing' and created_at < timestamp_ntz '2024-01-10 00:00:00'").select("capture_id")


@query("select session_id, max(at_minute) as newest from chat_messages group by 1 order by newest desc, session_id limit 10", "chat_messages")
def sessions_list(m):
    return m.chat_messages.groupBy("session_id").agg(F.max("at_minute").alias("newest")).orderBy(F.desc("newest"), "session_id").limit(10)


