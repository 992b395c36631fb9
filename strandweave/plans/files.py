"""Registered queries: node files, chunks, change detection, pooled vectors, best chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import markdown as M
from ..functions.columns import cosine
from ..operators import files as FI
from .catalog import query

_FRONT = r"regexp_extract(content, '(?s)^---\n(.*?\n)---\n', 1)"


def _field(name: str) -> str:
    return rf"regexp_extract({_FRONT}, '(?m)^{name}: *(.*?)$', 1)"


@query(rf"select path, {_FRONT} as front, regexp_replace(content, '(?s)^---\n.*?\n---\n', '') as body from notes", "notes")
def split_frontmatter(m):
    return m.notes.select("path", M.front(F.col("content")).alias("front"), M.body(F.col("content")).alias("body"))


@query(f"select path, {_field('id')} as id, {_field('type')} as type, {_field('created')} as created, {_field('occurred')} as occurred, lang || ',' || coalesce(source, '') || ', quoted' as tags from notes join documents using (doc_id)", "notes")
def parse_frontmatter(m):
    meta = m.notes.select("path", M.parse_front(M.front(F.col("content"))).alias("f"))
    return meta.select("path", *[F.col("f.scalars").getItem(k).alias(k) for k in ("id", "type", "created", "occurred")], F.array_join(F.col("f.lists").getItem("tags"), ",").alias("tags"))


@query("select path, 'about' as rel, 'n:' || lpad(cast(doc_id % 25 as varchar), 10, '0') as dst, '0.' || cast(doc_id % 10 as varchar) as conf, '2024-0' || cast(1 + doc_id % 9 as varchar) as since from notes", "notes")
def parse_edges(m):
    return m.notes.select("path", F.explode(M.parse_edges(M.front(F.col("content")))).alias("e")).select("path", "e.rel", F.col("e.to").alias("dst"), "e.conf", "e.since")


_META = f"""select path, {_field('id')} as id, 'insight' as type, 'Note ' || cast(doc_id as varchar) as title, 2 as n_tags,
  case doc_id % 4 when 0 then date '2024-01-01' when 1 then date '2024-02-01' when 2 then null else make_date(2024, 3, cast(1 + doc_id % 9 as int)) end as occurred_start,
  case when doc_id % 4 = 2 then null when doc_id % 5 = 0 then date '2024-11-30' else case doc_id % 4 when 0 then date '2024-12-31' when 1 then date '2024-02-29' else make_date(2024, 3, cast(1 + doc_id % 9 as int)) end end as occurred_end,
  case doc_id % 3 when 0 then 'internal' when 2 then 'mixed' end as interiority, sha256(content) as content_hash from notes join documents using (doc_id)"""


@query(_META, "notes")
def node_metadata(m):
    return FI.metadata(m.notes).select("path", "id", "type", "title", F.size("tags").cast("long").alias("n_tags"), "occurred_start", "occurred_end", "interiority", "content_hash")


@query(f"select doc_id, occurred_start, occurred_end from ({_META}) join notes using (path)", "notes")
def expand_occurred(m):
    meta = m.notes.select("doc_id", M.parse_front(M.front(F.col("content"))).alias("f"))
    first, last = D.occurred_range(F.col("f.scalars").getItem("occurred"), F.col("f.scalars").getItem("occurred_end"))
    return meta.select("doc_id", first.alias("occurred_start"), last.alias("occurred_end"))


@query("select 'd:' || lpad(cast(doc_id as varchar), 10, '0') as src, 'n:' || lpad(cast(doc_id % 25 as varchar), 10, '0') as dst, 'about' as rel, (doc_id % 10) / 10.0 as conf, make_date(2024, cast(1 + doc_id % 9 as int), 1) as since from notes", "notes")
def file_edges(m):
    return FI.file_edges(FI.metadata(m.notes))


@query(None)
def chunk_text(m):
    return m.notes.select("path", F.posexplode(M.chunks(M.body(F.col("content")))).alias("chunk_index", "content"))


_STATE = "old as (select case when doc_id % 11 = 0 then 'x/' || path else path end as path, doc_id, case when doc_id % 7 = 0 then 'old' else sha256(content) end as content_hash from notes where doc_id % 5 <> 1 union all select 'insight/gone' || cast(doc_id as varchar) || '.md', -1 - doc_id, 'h' from notes where doc_id % 9 = 0)"
_ACTION = f"+ {_STATE}, acts as (select coalesce(n.doc_id, old.doc_id) as id, n.path, old.path as old_path, case when n.path is null then 'deleted' when old.path is null then 'new' when sha256(n.content) <> content_hash then 'changed' when n.path <> old.path then 'moved' else 'skipped' end as action from notes n full join old on n.doc_id = old.doc_id)"


def _actions(m):
    now = m.notes.select(F.col("doc_id").alias("id"), "path", M.content_hash(F.col("content")).alias("content_hash"))
    moved = F.when(F.col("id") % 11 == 0, F.concat(F.lit("x/"), "path")).otherwise(F.col("path"))
    old = now.where("id % 5 <> 1").select("id", moved.alias("path"), F.when(F.col("id") % 7 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"))
    gone = now.where("id % 9 = 0").select((-1 - F.col("id")).alias("id"), F.concat(F.lit("insight/gone"), F.col("id").cast("string"), F.lit(".md")).alias("path"), F.lit("h").alias("content_hash"))
    return FI.actions(now, old.union(gone))


@query(f"{_ACTION} select id, path, old_path, action from acts", "notes")
def hash_skip(m):
    return _actions(m)


@query(f"{_ACTION} select action, count(*) as n from acts group by 1", "notes")
def index_outcome(m):
    return _actions(m).groupBy("action").agg(F.count("*").alias("n"))


@query(f"{_ACTION} select id, old_path from acts where action = 'deleted'", "notes")
def reconcile_deletes(m):
    return _actions(m).where("action = 'deleted'").select("id", "old_path")


@query(f"{_ACTION} select id, coalesce(path, old_path) as path from acts where action = 'moved'", "notes")
def node_path_update(m):
    return _actions(m).where("action = 'moved'").select("id", "path")


@query("+ n as (select id, 'new ' || title as title from nodes where type = 'person' and id like '%5') select id, title from nodes where id not in (select id from n) union all select id, title from n", "nodes")
def upsert_node(m):
    table = m.nodes.select("id", "title")
    return FI.upsert(table, m.nodes.where("type = 'person' and id like '%5'").select("id", F.concat(F.lit("new "), "title").alias("title")), ["id"])


@query("select node_id, round(avg(cast(embedding[1] as double)), 6) as x1, round(avg(cast(embedding[64] as double)), 6) as x64, count(*) as n from parts group by 1", "parts")
def mean_pool(m):
    pooled = FI.mean_pool(m.parts, 64)
    n = m.parts.groupBy("node_id").agg(F.count("*").alias("n"))
    return pooled.join(n, "node_id").select("node_id", F.round(F.col("embedding")[0], 6).alias("x1"), F.round(F.col("embedding")[63], 6).alias("x64"), "n")


@query(
    """+ d as (select node_id, chunk_index, 1 - round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as dist from parts a, embeddings b where b.vec_id = 0)
  select node_id, chunk_index, round(dist, 6) as dist from (select *, row_number() over (partition by node_id order by dist, chunk_index) as k from d) where k = 1""",
    "parts",
)
def search_best_per_node(m):
    q = m.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))
    d = m.parts.crossJoin(F.broadcast(q)).select("node_id", "chunk_index", F.round(1 - F.round(cosine(F.col("embedding"), F.col("q")), 6), 6).alias("dist"))
    best = d.groupBy("node_id").agg(F.min(F.struct("dist", "chunk_index")).alias("b"))
    return best.select("node_id", "b.chunk_index", "b.dist")
