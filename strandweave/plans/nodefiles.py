"""Registered queries: edits of node files, whole files from rows, and what verdicts of a review do to the store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import nodefiles as NF
from ..operators import replay as R
from .catalog import query


def _id(prefix: str, key):
    return F.concat(F.lit(f"{prefix}:"), F.lpad(key.cast("string"), 10, "0"))


_N = "'n:' || lpad(cast(doc_id % 25 as varchar), 10, '0')"
_C = "'c:' || lpad(cast(doc_id as varchar), 10, '0')"
_BROKEN = "'  - {rel: broken}' || chr(10)"
_DATED = "case doc_id % 4 when 0 then '2024' when 1 then '2024-02' when 2 then '2024-02-30' else '2024-03-0' || cast(1 + doc_id % 9 as varchar) end"
_EDITED = f"""case doc_id % 6
  when 0 then replace(content, {_BROKEN}, {_BROKEN} || '  - {{rel: involves, to: "' || {_C} || '", since: 2024-05}}' || chr(10))
  when 1 then replace(content, 'to: ' || {_N} || ',', 'to: "' || {_C} || '",')
  when 2 then replace(content, '{{rel: about, to: ' || {_N}, '{{rel: part_of, to: ' || {_N})
  when 3 then replace(content, 'edges:' || chr(10) || '  - {{rel', 'aliases: [plain, "two words", "say \\"so\\""]' || chr(10) || 'edges:' || chr(10) || '  - {{rel')
  when 4 then replace(replace(content, 'occurred: ' || {_DATED} || chr(10), 'occurred: 2021-03' || chr(10)), 'occurred_end: 2024-11' || chr(10), '')
  else '---' || chr(10) || 'id: ' || {_C} || chr(10) || 'type: insight' || chr(10) || 'merged_into: "' || {_N} || '"' || chr(10) || '---' || chr(10) || chr(10) || '(merged)' || chr(10) end""".replace("{{", "{").replace("}}", "}")


def _one_of_each(m):
    """An edit of every kind, by the note's number; each sixth note is also asked for what it can't do."""
    k, path = F.col("doc_id"), F.col("path")
    n, c = _id("n", k % 25), _id("c", k)
    rows = [
        NF.edit(path, k, "append", F.lit("involves"), c, F.lit("2024-05")),
        NF.edit(path, k, "retarget", n, c),
        NF.edit(path, k, "retype", n, F.lit("about"), F.lit("part_of")),
        NF.edit(path, k, "list", F.lit("aliases"), values=F.array(F.lit("plain"), F.lit("two words"), F.lit('say "so"'))),
        NF.edit(path, k, "dates", F.lit("2021-03")),
        NF.edit(path, k, "tombstone", c, F.lit("insight"), n),
    ]
    edits = [m.notes.where(k % 6 == kind).select(*row) for kind, row in enumerate(rows)]
    again = m.notes.where(k % 6 == 0).select(*NF.edit(path, k + 1, "append", F.lit("involves"), c, F.lit("2023")))
    return reduce(lambda x, y: x.union(y), [*edits, again, m.notes.where(k % 6 == 1).select(*NF.edit(path, k + 1, "odd"))])


@query(f"select path, sha256({_EDITED}) as content_hash, 1 as changes, case when doc_id % 6 = 1 then 'odd: no such edit: odd' end as error from notes", "notes")
def node_file_edits(m):
    done = NF.edited(m.notes, _one_of_each(m))
    changes = F.when(F.col("error").isNotNull() | (F.col("changes") > 0), F.lit(1)).otherwise(0)
    return done.select("path", F.sha2("content", 256).alias("content_hash"), changes.alias("changes"), "error")


@query(
    """select id, sha256('---' || chr(10) || 'id: ' || id || chr(10) || 'type: memory' || chr(10) || 'created: ' || cast(created_on as varchar) || chr(10)
  || case when occurred_start is not null then 'occurred: ' || cast(occurred_start as varchar) || chr(10) else '' end || case when occurred_end is not null then 'occurred_end: ' || cast(occurred_end as varchar) || chr(10) else '' end
  || case when interiority is not null then 'interiority: ' || interiority || chr(10) else '' end || 'source: capture' || chr(10) || 'planes: [' || planes[1] || ']' || chr(10) || 'tags: [' || tags[1] || ', ' || case when regexp_full_match(tags[2], '[A-Za-z0-9_-]+') then tags[2] else '"' || tags[2] || '"' end || ']' || chr(10)
  || 'organizer_version: v4' || chr(10) || case when dst is null then '' else 'edges:' || chr(10) || '  - {rel: involves, to: "' || dst || '", since: ' || cast(since as varchar) || '}' || chr(10) end || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || 'Bought "things".' || chr(10)) as content_hash
  from nodes left join (select src, dst, since from edges where rel = 'involves' and dst like 'c:%') e on src = id where type = 'memory'""",
    "nodes",
    "edges",
)
def node_render(m):
    day = lambda c: F.col(c).cast("string").alias(c)
    drawn = m.edges.where("rel = 'involves' and dst like 'c:%'").select(F.col("src").alias("id"), F.array(F.struct("rel", F.col("dst").alias("to"), F.col("since").cast("string").alias("since"))).alias("edges"))
    nodes = m.nodes.where("type = 'memory'").select("id", "type", "title", F.lit(' Bought "things". ').alias("body"), F.col("created_on").cast("string").alias("created"), F.lit("capture").alias("source"), "planes", "tags", day("occurred_start"), day("occurred_end"), "interiority")
    nodes = nodes.withColumnRenamed("occurred_start", "occurred").join(drawn, "id", "left")
    return NF.rendered(nodes).select("id", F.sha2("content", 256).alias("content_hash"))


# verdicts


_ITEMS = """i as (select c_custkey as item_id, case c_custkey % 6 when 0 then 'merge' when 1 then 'keep' when 2 then 'Link' when 3 then ' MERGE ' when 4 then 'drop' end as act, case when c_custkey % 17 = 0 then ' ' else 'c:' || lpad(cast(c_custkey as varchar), 10, '0') end as a,
  'c:' || lpad(cast(c_custkey + case when c_custkey % 13 = 0 then 900000 else 1 end as varchar), 10, '0') as b, case c_custkey % 5 when 1 then 'c:' || lpad(cast(c_custkey + 1 as varchar), 10, '0') when 2 then 'x' when 3 then '' end as asked from customer),
j as (select item_id, lower(trim(coalesce(act, ''))) as act, trim(a) as a, b, case when coalesce(asked, '') <> '' then asked else trim(a) end as keep from i),
k as (select j.*, x.id is not null as a_there, y.id is not null as b_there, x.merged_into is not null or y.merged_into is not null as gone from j left join nodes x on x.id = a left join nodes y on y.id = b)"""


def _verdicts(link: bool) -> str:
    linked = "when act = 'link' and not a_there then 'unknown node' when act = 'link' then null" if link else ""
    error = f"case when a = '' then 'no pair' when act = 'keep' then null {linked} when act <> 'merge' then 'unknown action' when keep <> a and keep <> b then 'survivor is not of the pair' when not a_there or not b_there then 'unknown node' when gone then 'merged already' end"
    return f"{_ITEMS}, v as (select *, {error} as error from k), w as (select item_id, case when error is not null then 'pending' when act = 'keep' then 'discarded' else 'resolved' end as status, case when error is null and act = 'merge' then keep end as survivor, case when error is null and act = 'merge' then case when keep = a then b else a end end as loser, case when error is null and act = 'link' then a end as link_from, case when error is null and act = 'link' then b end as link_to, error from v)"


def _items(m):
    k = F.col("c_custkey")
    action = F.when(k % 6 == 0, "merge").when(k % 6 == 1, "keep").when(k % 6 == 2, "Link").when(k % 6 == 3, " MERGE ").when(k % 6 == 4, "drop")
    asked = F.when(k % 5 == 1, _id("c", k + 1)).when(k % 5 == 2, "x").when(k % 5 == 3, "")
    a = F.when(k % 17 == 0, " ").otherwise(_id("c", k))
    return m.customer.select(k.alias("item_id"), action.alias("action"), a.alias("node_a"), _id("c", k + F.when(k % 13 == 0, 900000).otherwise(1)).alias("node_b"), asked.alias("survivor"), a.alias("default_survivor"))


@query(f"+ {_verdicts(True)} select * from w", "nodes")
def review_dedup_actions(m):
    """Verdicts on pairs of near copies: merged, kept apart, or linked as similar."""
    return L.pair_verdicts(_items(m), m.nodes, True)


@query(
    f"+ {_verdicts(False)}, f as (select id, type, list_filter(list_distinct(list_concat([lower(title)], list_transform(aliases, lambda a: lower(a)))), lambda a: a <> '') as forms from nodes where merged_into is null) select w.item_id, status, survivor, loser, error, hex(x.type || chr(0) || array_to_string(list_sort(x.forms), chr(1))) as loser_key from w left join f x on x.id = loser",
    "nodes",
)
def review_entity_dedup(m):
    """Verdicts on pairs of entities, and the key under which a merge is stored to be replayed."""
    found = L.pair_verdicts(_items(m), m.nodes, False)
    stored = L.decisions(found, R.named(m.nodes).select("id", "type", "forms")).select("item_id", F.hex(F.encode("loser_key", "UTF-8")).alias("loser_key"))
    return found.join(stored, "item_id", "left").select("item_id", "status", "survivor", "loser", "error", "loser_key")


@query(f"select path, sha256(replace(content, {_BROKEN}, {_BROKEN} || '  - {{rel: at, to: \"' || {_N} || '\"' || case when doc_id % 2 = 0 then ', since: 2024-01' else '' end || '}}' || chr(10))) as content_hash from notes where doc_id % 3 = 0".replace("{{", "{").replace("}}", "}"), "notes")
def review_materialize(m):
    """Edges that waited for a mention's entity, written into their sources' files; sources that are gone are skipped."""
    k = F.col("doc_id")
    pending = m.documents.where("doc_id % 3 = 0").select(_id("d", F.col("doc_id")).alias("src"), _id("n", k % 25).alias("dst"), F.when(k % 2 == 0, "2024-01").alias("since"))
    pending = pending.union(m.documents.where("doc_id % 3 = 1").select(F.lit("d:gone"), _id("n", k % 25), F.lit(None)))
    paths = m.notes.select(_id("d", k).alias("src"), "path")
    edits = pending.join(paths, "src").select(*NF.edit(F.col("path"), F.xxhash64("dst"), "append", F.lit("at"), F.col("dst"), F.col("since")))
    return NF.edited(m.notes, edits).select("path", F.sha2("content", 256).alias("content_hash"))


@query(
    f"""+ {_verdicts(False)}, mg as (select loser, survivor from w where survivor is not null) select 'person/' || cast(cast(substring(loser, 3) as bigint) as varchar) || '.md' as path, 2 as seq, 'tombstone' as op, loser as a, 'person' as b, survivor as c, null as names from mg
  union all select n.store_path, 0, 'retarget', loser, survivor, null, null from mg join (select distinct src, dst from edges where origin = 'canonical') e on dst = loser join nodes n on n.id = src
  union all select s.store_path, 1, 'list', 'aliases', null, null, array_to_string(list_concat(list_concat(s.aliases, [s.title]), g.names), '|') from (select survivor, flatten(list(list_concat([x.title], x.aliases) order by loser)) as names from mg join nodes x on x.id = loser group by 1) g join nodes s on s.id = g.survivor""",
    "nodes",
    "edges",
)
def fold_edits(m):
    """What merged pairs change in files: edges that lead on, a survivor's further names, a loser's tombstone."""
    merges = L.pair_verdicts(_items(m), m.nodes, False).where("survivor is not null").select("loser", "survivor")
    edits = NF.fold_edits(merges, m.edges.where("origin = 'canonical'").select("src", "dst"), m.nodes.withColumnRenamed("store_path", "path"))
    return edits.select("path", "seq", "op", "a", "b", "c", F.array_join("values", "|").alias("names"))
