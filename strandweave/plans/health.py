"""Registered queries: tiers, hashes, guards and the health report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import activity as A
from ..operators import entities as E
from ..operators import graph as G
from ..operators import ledger as L
from ..operators import records as R
from ..sources.stage import cut
from .catalog import _LINKS, _TYPES, query
from .records import _OBS, _SEEDS, _observations

_NOW = "date '2024-01-31'"
_HOLES = "holes as (select id, case when id like '%7' then 'gone:' || merged_into else merged_into end as merged_into from nodes where merged_into is not null)"
_ORPHANS = "select id from nodes where merged_into is null and store_path not like 'inbox/%' and id not in (select src from edges where origin = 'canonical' union select dst from edges where origin = 'canonical')"


def _tombstones(m):
    """The graph with some merges into nodes that were deleted since."""
    gone = F.when(F.col("merged_into").isNotNull() & F.col("id").endswith("7"), F.concat(F.lit("gone:"), "merged_into")).otherwise(F.col("merged_into"))
    return m.nodes.withColumn("merged_into", gone)


@query(f"+ {_LINKS} select n.id, count(other) as degree, case when count(other) >= 8 then 'full' when count(other) >= 3 then 'snapshot' else 'stub' end as tier from nodes n left join links on links.id = n.id where merged_into is null group by 1", "nodes", "edges")
def profile_tier(m):
    degree = F.coalesce("degree", F.lit(0))
    rows = G.live(m.nodes).select("id").join(m.degrees, "id", "left")
    return rows.select("id", degree.alias("degree"), C.profile_tier(degree).alias("tier"))


def _signatures(m):
    """(center, tier, signature): the hash of {obs, tier} as JSON with sorted keys."""
    lines = F.replace(F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit('", "'))
    text = F.concat(F.lit('{"obs": ["'), lines, F.lit('"], "tier": "'), C.profile_tier(F.col("n")), F.lit('"}'))
    return R.stubs(_observations(m)).select("center", C.profile_tier(F.col("n")).alias("tier"), F.sha2(text, 256).alias("signature"))


@query(f"+ {_OBS.lstrip().removeprefix('+')} select center, sha256('{{\"obs\": [\"' || replace(replace(replace(text, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), '\", \"') || '\"], \"tier\": \"' || case when n >= 8 then 'full' when n >= 3 then 'snapshot' else 'stub' end || '\"}}') as signature from texts", "nodes", "edges")
def profile_hash(m):
    """The hash of a hub's observations and tier."""
    return _signatures(m).select("center", "signature")


@query(f"+ {_HOLES} select id, merged_into from holes where merged_into not in (select id from nodes)", "nodes")
def health_tombstones(m):
    return A.dangling_tombstones(_tombstones(m))


@query(
    f"""+ {_HOLES}, f as (select 'orphans' as finding, id from ({_ORPHANS})
  union all select 'inbox', id from nodes where merged_into is null and store_path like 'inbox/%'
  union all select 'review-aging', cast(item_id as varchar) from review_queue where status in ('pending', 'maybe') and datediff('day', created_on, {_NOW}) > 14
  union all select 'missing-occurred', id from nodes where merged_into is null and type = 'memory' and occurred_start is null
  union all select 'alias-less', id from nodes where merged_into is null and type in {_TYPES} and len(aliases) = 0
  union all select 'tombstones', id from holes where merged_into not in (select id from nodes)
  union all select 'stale-hubs', center from (select c.id as center, max(coalesce(since, o.occurred_start)) as newest from nodes c join (select src as center, dst as other, since from edges where origin = 'canonical' union all select dst, src, since from edges where origin = 'canonical') e on e.center = c.id join nodes o on o.id = e.other and o.merged_into is null where c.merged_into is null and c.type in {_TYPES} group by 1) where newest < date '2023-01-31')
  select finding, count(f.id) as n, count(f.id) > 0 as flagged from (select unnest(['orphans', 'inbox', 'review-aging', 'missing-occurred', 'alias-less', 'tombstones', 'stale-hubs']) as finding) k left join f using (finding) group by 1""",
    "nodes",
    "edges",
    "review_queue",
)
def health_report(m):
    return A.health(_tombstones(m), m.touched, m.ends, m.review_queue, "2024-01-31")


@query(f"select id, id not in (select src from edges union select dst from edges) and merged_into is null as deletable from nodes where type in {_TYPES}", "nodes", "edges")
def node_delete_guard(m):
    hubs = m.nodes.where(F.col("type").isin(E.ENTITY_TYPES)).select("id")
    return hubs.join(R.deletable(m.nodes, m.edges).withColumn("ok", F.lit(True)), "id", "left").select("id", F.coalesce("ok", F.lit(False)).alias("deletable"))


_STOPPED = "(" + ", ".join(f"'{w}'" for w in C.STOP_WORDS) + ")"


@query(f"select q, len(list_filter(string_split(q, ' '), lambda t: t not in {_STOPPED})) = 0 as suppressed from (select distinct lower(c_mktsegment) as q from customer union all select 'the and for')")
def search_fts_suppress(m):
    """A query of stop words alone has no lexical leg."""
    q = m.customer.select(F.lower("c_mktsegment").alias("q")).distinct().union(m.spark.range(1).select(F.lit("the and for")))
    return q.select("q", (F.size(F.filter(F.split("q", " "), lambda t: ~t.isin(C.STOP_WORDS))) == 0).alias("suppressed"))


_ADDED = "added as (select distinct lower(trim(event_type)) as type from events where event_type in ('purchase', 'signup', 'view'))"


@query(f"+ {_ADDED} select unnest([{', '.join(repr(t) for t in _SEEDS)}]) as type union select type from added", "nodes")
def vocab_effective(m):
    """The configured types and those that were stored as additions."""
    seeds = m.spark.range(1).select(F.explode(F.array(*map(F.lit, _SEEDS))).alias("type"))
    added = m.events.where("event_type in ('purchase', 'signup', 'view')").select(F.lower(F.trim("event_type")))
    return seeds.union(added).distinct()


_AXES = {"node_types": _SEEDS, "edge_rels": ["involves", "about", "at", "part_of"], "entity_like_types": E.ENTITY_TYPES}
_VIEW = " union all ".join(f"select '{axis}' as axis, '{value}' as value, 'seed' as origin, cast(null as bigint) as item_id" for axis, values in _AXES.items() for value in values)


@query(f"+ p as (select item_id, case item_id % 3 when 0 then 'node_types' when 1 then 'edge_rels' else 'entity_like_types' end as axis, case when item_id % 7 = 0 then 'at' else 'kind' || cast(item_id % 50 as varchar) end as value, status from review_queue), seeds as ({_VIEW}) select axis, value, origin, item_id from seeds union all select distinct axis, value, 'added', cast(null as bigint) from p where status = 'resolved' and (axis, value) not in (select (axis, value) from seeds) union all select axis, value, 'proposed', item_id from p where status = 'pending'", "review_queue")
def vocab_types_view(m):
    """The words in force by axis, seeds and approved additions, and the proposals that still wait."""
    k = F.col("item_id") % 3
    axis = F.when(k == 0, "node_types").when(k == 1, "edge_rels").otherwise("entity_like_types")
    value = F.when(F.col("item_id") % 7 == 0, "at").otherwise(F.concat(F.lit("kind"), (F.col("item_id") % 50).cast("string")))
    return R.vocabulary(_AXES, m.review_queue.select("item_id", axis.alias("axis"), value.alias("value"), "status"))


_SIGNED = """s as (select center, case when n >= 8 then 'full' when n >= 3 then 'snapshot' else 'stub' end as tier, sha256('{"obs": ["' || replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), '", "') || '"], "tier": "' || case when n >= 8 then 'full' when n >= 3 then 'snapshot' else 'stub' end || '"}') as signature from texts)"""


@query(f"+ {_OBS.lstrip().removeprefix('+')}, {_SIGNED} select center as id, signature, tier from s where cast(substring(center, 3) as int) % 4 <> 0", "nodes", "edges")
def profile_refresh(m):
    """Hubs whose neighbourhood or tier changed since their profile was written, or that have none."""
    wanted = cut(_signatures(m).select(F.col("center").alias("id"), "signature", "tier"))
    n = F.expr("cast(substring(id, 3) as int)")
    stored = wanted.where(n % 2 == 0).select("id", F.when(n % 4 == 0, F.col("signature")).otherwise("old").alias("signature"))
    return L.refreshed(wanted, stored)


@query(f"select id, greatest(datediff('day', created_on, {_NOW}), 0) as age from nodes", "nodes")
def age_days(m):
    """Whole days, none below 0."""
    seconds = F.unix_timestamp(F.lit("2024-01-31 00:00:00")) - F.unix_timestamp("created_on")
    return m.nodes.select("id", F.greatest(F.floor(seconds / 86400), F.lit(0)).cast("long").alias("age"))
