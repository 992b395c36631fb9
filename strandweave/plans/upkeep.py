"""Registered queries: nightly work over the whole graph - near copies to review, merges replayed, mentions linked, run trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities as E
from ..operators import graph as G
from ..operators import mentions as MT
from ..operators import nearest as NN
from ..operators import replay as R
from .catalog import _COS, _TYPES, query


def _id(prefix: str, key):
    return F.concat(F.lit(f"{prefix}:"), F.lpad(key.cast("string"), 10, "0"))


# near copies of content


@query(
    f"""+ p as (select id, embedding, occurred_start, coalesce(occurred_end, occurred_start) as occurred_end, indexed_on from orders join embeddings on vec_id = o_orderkey join nodes on id = 'o:' || lpad(cast(o_orderkey as varchar), 10, '0') where merged_into is null and embedding is not null),
  s as (select a.id as a, b.id as b, {_COS} as cosine from p a, p b where a.id <> b.id and a.indexed_on >= date '1995-01-01'),
  c as (select s.a, s.b, cosine, x.occurred_start <= y.occurred_end and y.occurred_start <= x.occurred_end as meet from (select *, row_number() over (partition by a order by cosine desc, b) as n from s where cosine >= 0.2) s join p x on x.id = s.a join p y on y.id = s.b where n <= 10),
  h as (select distinct c.a, c.b, e.dst from c join edges e on e.src = c.a and e.origin = 'canonical' join edges f on f.src = c.b and f.dst = e.dst and f.origin = 'canonical' join nodes n on n.id = e.dst and n.merged_into is null and n.type in {_TYPES})
  select c.a, c.b, cosine, coalesce(meet, false) as overlap, string_agg(dst, ',' order by dst) as shared from c join h on h.a = c.a and h.b = c.b where coalesce(meet, true) group by 1, 2, 3, 4""",
    "nodes",
    "edges",
)
def dedup_candidates(m):
    """Recent content beside its nearest neighbours, recent or not, if both link a common live entity and their times
    don't exclude each other."""
    points = m.embeddings.join(m.orders, F.col("vec_id") == F.col("o_orderkey")).select(_id("o", F.col("vec_id")).alias("id"), "embedding")
    return E.content_candidates(points, m.nodes, m.edges, F.to_date(F.lit("1995-01-01")), 10, 0.2).withColumn("shared", F.array_join("shared", ","))


# merges


_DECISIONS = """d as (select s_suppkey as k, s_suppkey // 12 as b, s_suppkey % 12 as i, s_suppkey // 12 * 12 + (s_suppkey * 5 + 3) % 12 as j, row_number() over (partition by s_suppkey // 12 order by (s_suppkey * 7) % 12) as step from supplier),
dj as (select d.*, s.s_suppkey is not null and j % 7 <> 0 as there from d left join supplier s on s.s_suppkey = d.j),
st as (select distinct b, 0 as step, range(0, 12) as roots, cast(null as bigint) as k, cast(null as bigint) as s, cast(null as bigint) as l from d
  union all select st.b, st.step + 1, case when there then list_transform(roots, lambda x: case when x = roots[j % 12 + 1] then roots[i + 1] else x end) else roots end, dj.k, roots[i + 1], case when there then roots[j % 12 + 1] end from st join dj on dj.b = st.b and dj.step = st.step + 1)"""


@query(f"+ {_DECISIONS} select cast(k as varchar) as merge_key, 's:' || lpad(cast(b * 12 + s as varchar), 10, '0') as survivor, 's:' || lpad(cast(b * 12 + l as varchar), 10, '0') as loser, coalesce(s <> l, false) as applied from st where k is not null", "nodes")
def merge_replay(m):
    """Each dozen suppliers' decisions in order of date; a side is found by its title or alias, which an earlier fold may
    have given to another entity."""
    k = F.col("s_suppkey")
    block = F.floor(k / 12) * 12
    names = lambda first, other: F.array(first, F.concat(F.lit("supp "), other.cast("string")))
    stored = m.supplier.select(
        k.cast("string").alias("merge_key"),
        ((k * 7) % 12).alias("created_on"),
        F.lit("project").alias("survivor_type"),
        names(F.concat(F.lit("supplier#"), F.lpad(k.cast("string"), 9, "0")), k).alias("survivor_forms"),
        F.lit("project").alias("loser_type"),
        names(F.concat(F.lit("renamed "), k.cast("string")), block + (k * 5 + 3) % 12).alias("loser_forms"),
    )
    return R.folded(stored, m.nodes)


# mentions


_SAID = "t as (select 'o:' || lpad(cast(o_orderkey as varchar), 10, '0') as node_id, 'Met CUST ' || cast(o_custkey as varchar) || ' of building ' || cast(o_orderkey % 90 as varchar) || ', 100%_sure; ' || o_orderpriority as content from orders)"
_NAMED = """q as (select id as entity_id, unnest(list_concat(aliases, [title])) as alias, unnest(range(0, len(aliases) + 1)) as pos from nodes where merged_into is null and type = 'person'),
q1 as (select *, trim(regexp_replace(lower(alias), '\\s+', ' ', 'g')) as norm from q), q2 as (select * from (select *, row_number() over (partition by entity_id, norm order by length(alias) desc, pos) as k from q1 where length(norm) >= 4) where k = 1),
q3 as (select entity_id, alias, row_number() over (partition by entity_id order by length(alias) desc, pos) as place from q2),
f as (select t.node_id, entity_id, alias, place from t join nodes n on n.id = t.node_id and n.merged_into is null and n.indexed_on >= date '1994-06-01' join q3 on contains(lower(content), lower(alias)) where (t.node_id, entity_id) not in (select (src, dst) from edges)),
u as (select node_id, entity_id, alias, place from (select *, row_number() over (partition by node_id, entity_id order by place) as k from f) where k = 1)"""


def _unlinked(m):
    text = F.concat(F.lit("Met CUST "), F.col("o_custkey").cast("string"), F.lit(" of building "), (F.col("o_orderkey") % 90).cast("string"), F.lit(", 100%_sure; "), "o_orderpriority")
    texts = m.orders.select(_id("o", F.col("o_orderkey")).alias("node_id"), text.alias("content"))
    recent = G.live(m.nodes).where("type = 'memory' and indexed_on >= date '1994-06-01'").select(F.col("id").alias("node_id"))
    return MT.unlinked(texts.join(recent, "node_id", "left_semi"), G.live(m.nodes).where("type = 'person'"), m.edges)


@query(f"+ {_SAID}, {_NAMED} select node_id, entity_id, alias from u", "nodes", "edges")
def backfill_candidates(m):
    """Recent memories that hold an entity's name anywhere in their text and no edge to it."""
    return _unlinked(m).select("node_id", "entity_id", "alias")


@query(f"+ {_SAID}, {_NAMED} select node_id, entity_id, alias from u order by entity_id, place, node_id limit 200", "nodes", "edges")
def backfill_scan(m):
    """What one nightly scan may link: the first 200, each entity by its longest names first."""
    return MT.within_budget(_unlinked(m), 200).select("node_id", "entity_id", "alias")


# runs


_DEEP = "r as (select event_id as run_id, case when event_id % 9 > 0 then cast(floor(event_id / 3) as bigint) end as parent_run_id, ts as started_at from events)"


def _deep_runs(m):
    parent = F.when(F.col("event_id") % 9 > 0, F.floor(F.col("event_id") / 3))
    return m.events.select(F.col("event_id").alias("run_id"), parent.alias("parent_run_id"), F.col("ts").alias("started_at"))


@query(
    f"""+ {_DEEP}, tr as (select run_id as root_id, run_id, 0 as depth, strftime(started_at, '%Y%m%d%H%M%S%f') || '/' || lpad(cast(run_id as varchar), 20, '0') as place from r where run_id % 20 = 0
  union all select root_id, r.run_id, depth + 1, place || '>' || strftime(r.started_at, '%Y%m%d%H%M%S%f') || '/' || lpad(cast(r.run_id as varchar), 20, '0') from tr join r on r.parent_run_id = tr.run_id and r.run_id <> tr.run_id where depth < 32)
  select root_id, run_id, depth, place from tr""",
    "agent_runs",
)
def run_tree_build(m):
    """The trees under every twentieth run, in printing order: a child after its parent, siblings by start."""
    runs = _deep_runs(m).where("run_id <> parent_run_id or parent_run_id is null")
    return G.nested_runs(runs, m.events.where("event_id % 20 = 0").select(F.col("event_id").alias("root_id")))


@query(
    f"""+ {_DEEP}, up as (select run_id, case when parent_run_id in (select run_id from r) and parent_run_id <> run_id then parent_run_id end as parent from r), tr as (select run_id, run_id as root_id, 0 as depth from up where parent is null union all select up.run_id, root_id, depth + 1 from tr join up on up.parent = tr.run_id)
  select run_id, root_id, depth from tr""",
    "agent_runs",
)
def run_tree_roots(m):
    """Every run's root and depth, by doubling pointers; runs whose parent is unknown are roots."""
    return G.run_tree(_deep_runs(m).where("run_id <> parent_run_id or parent_run_id is null").unionByName(_deep_runs(m).where("run_id = parent_run_id").withColumn("parent_run_id", F.lit(None).cast("bigint"))))
