"""The registered queries of the graph engine, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import markdown as MD
from ..operators import activity as A
from ..operators import entities as E
from ..operators import graph as G
from ..operators import nearest as NN
from ..operators import search as S
from ..sources.bind import KINDS, Model, duck
from ..sources.clustered import around

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TODAY = "2024-12-31"
TERMS = S.query_terms("the a of that")


def query(sql: str | None, *views: str):
    """Register a query of the bound model with its twin (none where SQL can't say it); ``views`` are what the twin reads."""

    def put(f: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
        if f.__name__ in QUERIES:
            raise ValueError(f"a second query {f.__name__}")
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if sql is None:
            return f
        ORACLE_SQL[f.__name__] = f"{duck(*views)}{',' if views and sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}" if views else sql
        return f

    return put


def _query_vector(m: Model) -> DataFrame:
    return m.embeddings.where("vec_id = 0")


PARAMS = S.Params(today=TODAY, top_k=25, boost=1.2)
_COS = "round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 6)"
_VEC = f"+ vec as (select node_id, chunk_index, 1 - {_COS} as dist from chunks a, embeddings b where b.vec_id = 0 and a.embedding is not null)"
_LEX = """cnt as (select node_id, chunk_index, length(content) as n, regexp_extract_all(lower(content), '[a-z]+') as toks from chunks),
fts as (select node_id, chunk_index, round((len(list_filter(toks, lambda t: t = 'a')) + len(list_filter(toks, lambda t: t = 'of'))) / (1 + ln(n)), 6) as text_rank,
  from cnt where list_contains(toks, 'a') and list_contains(toks, 'of'))"""
_LEGS = f"""{_VEC}, {_LEX},
okn as (select * from nodes where merged_into is null),
v as (select node_id, row_number() over (order by dist, node_id) as vec_rank, dist from (select vec.node_id, min(dist) as dist from vec join okn on okn.id = vec.node_id group by 1) order by dist, node_id limit 60),
t as (select node_id, row_number() over (order by text_rank desc, node_id) as fts_rank, text_rank from (select fts.node_id, max(text_rank) as text_rank from fts join okn on okn.id = fts.node_id group by 1) order by text_rank desc, node_id limit 60),
fused as (select coalesce(v.node_id, t.node_id) as node_id, vec_rank, fts_rank, coalesce(1.0::double / (60 + vec_rank), 0) + coalesce(1.0::double / (60 + fts_rank), 0) as rrf from v full join t on v.node_id = t.node_id)"""


@query(f"{_VEC} select node_id, chunk_index, round(dist, 6) as dist from vec", "chunks")
def search_vec_leg(m):
    return S.vector_scores(m.chunks, _query_vector(m)).select("node_id", "chunk_index", F.round("dist", 6).alias("dist"))




@query(f"{_LEGS} select node_id, vec_rank as rank from v", "chunks", "nodes")
def search_leg_topn(m):
    return S.legs(m.nodes, m.chunks, _query_vector(m), TERMS, PARAMS)[0].select("node_id", F.col("rank").cast("long").alias("rank"))


@query(f"{_LEGS} select node_id, fts_rank as rank, text_rank from t", "chunks", "nodes")
def search_fts_leg(m):
    return S.legs(m.nodes, m.chunks, _query_vector(m), TERMS, PARAMS)[1].select("node_id", F.col("rank").cast("long").alias("rank"), "text_rank")




@query(f"{_LEGS} select node_id, vec_rank, fts_rank, round(rrf, 8) as rrf from fused", "chunks", "nodes")
def search_rrf_fuse(m):
    v, t = S.legs(m.nodes, m.chunks, _query_vector(m), TERMS, PARAMS)
    return S.fuse(v, t, 60).select("node_id", F.col("vec_rank").cast("long").alias("vec_rank"), F.col("fts_rank").cast("long").alias("fts_rank"), F.round("rrf", 8).alias("rrf"))


_AGE = f"greatest(datediff('day', coalesce(occurred_start, created_on), date '{TODAY}'), 0)"
_RECENCY = f"(0.9 + 0.1::double * pow(0.5, {_AGE} / 180.0::double))"


@query(f"select id, round({_RECENCY}, 8) as recency from nodes where merged_into is null", "nodes")
def search_recency(m):
    age = F.datediff(F.to_date(F.lit(TODAY)), F.coalesce("occurred_start", "created_on"))
    return G.live(m.nodes).select("id", F.round(C.recency(age), 8).alias("recency"))


_HYBRID = f"{_LEGS}, scored as (select id as node_id, type, title, round(rrf * {_RECENCY} * case when interiority = 'internal' then {{boost}} else 1.0::double end, 8) as score from nodes join fused on id = node_id)"


@query(_HYBRID.format(boost="1.2::double") + " select * from scored where score >= 0 order by score desc, node_id limit 25", "chunks", "nodes")
def search_hybrid(m):
    return S.hybrid(m.nodes, m.chunks, _query_vector(m), TERMS, PARAMS)


@query(_HYBRID.format(boost="1.5::double") + " select * from scored where score >= 0.01 order by score desc, node_id limit 10", "chunks", "nodes")
def search_min_score_topk(m):
    return S.hybrid(m.nodes, m.chunks, _query_vector(m), TERMS, S.Params(today=TODAY, boost=1.5, min_score=0.01))


@query("select id from nodes where merged_into is null and list_has_any(planes, ['Health', 'Family'])", "nodes")
def filt_planes(m):
    return S.wanted(m.nodes, S.Params(TODAY, planes=["Health", "Family"])).select("id")


@query("select id, type from nodes where merged_into is null and type in ('person', 'topic')", "nodes")
def filt_types(m):
    return S.wanted(m.nodes, S.Params(TODAY, types=["person", "topic"])).select("id", "type")


@query("select id from nodes where merged_into is null and coalesce(occurred_end, occurred_start) >= date '1997-01-01'", "nodes")
def filt_since(m):
    return S.wanted(m.nodes, S.Params(TODAY, since="1997-01-01")).select("id")


@query("select id from nodes where merged_into is null and occurred_start <= date '1995-06-30'", "nodes")
def filt_until(m):
    return S.wanted(m.nodes, S.Params(TODAY, until="1995-06-30")).select("id")


@query("select node_id, case when length(content) > 400 then rtrim(substring(content, 1, 400)) || '…' else content end as snippet from chunks", "chunks")
def search_snippet(m):
    return m.chunks.select("node_id", C.snippet(F.col("content")).alias("snippet"))


@query("select node_id, 'search_document: ' || title || chr(10) || chr(10) || content as input from chunks join nodes on id = node_id", "chunks", "nodes")
def embed_prefixes(m):
    return m.chunks.join(m.nodes.select("id", "title"), F.col("id") == F.col("node_id")).select("node_id", F.concat(F.lit("search_document: "), "title", F.lit("\n\n"), "content").alias("input"))


# graph reads

_CENTERS = "centers as (select distinct id as center from nodes where type = 'person')"
_AROUND = f"""+ {_CENTERS}, around as (select dst as center, rel, origin, 'in' as dir, src as node_id, since, until from edges where dst in (select center from centers)
union all select src, rel, origin, 'out', dst, since, until from edges where src in (select center from centers)),
near as (select around.*, type, title from around join nodes on id = node_id and merged_into is null)"""


def _near(m: Model) -> DataFrame:
    ids = m.nodes.where("type = 'person'").select(F.col("id").alias("center"))
    return around(m, ids, KINDS["person"])


@query(f"{_AROUND} select center, rel, origin, dir, node_id, type from near", "nodes", "edges")
def node_edges(m):
    return _near(m).select("center", "rel", "origin", "dir", "node_id", "type")


@query("+ one as (select 'n:0000000003' as center), around as (select rel, origin, 'in' as dir, src as node_id from edges where dst = 'n:0000000003' union all select rel, origin, 'out', dst from edges where src = 'n:0000000003') select origin, rel, dir, node_id from around join nodes on id = node_id and merged_into is null where (origin, rel, dir, node_id) > ('canonical', 'at', 'in', 'c:0000000100') order by 1, 2, 3, 4 limit 26", "nodes", "edges")
def neighbors_page(m):
    ids = m.nodes.where("id = 'n:0000000003'").select(F.col("id").alias("center"))
    return G.page(G.neighbors(m.nodes, m.edges, ids), 25, ("canonical", "at", "in", "c:0000000100")).select("origin", "rel", "dir", "node_id")


@query(f"{_AROUND} select center, rel, node_id, n, total from (select *, row_number() over (partition by center, rel order by origin, dir, node_id) as n, count(*) over (partition by center, rel) as total from near) where n <= 8", "nodes", "edges")
def neighbor_zones(m):
    return G.zones(_near(m)).select("center", "rel", "node_id", F.col("n").cast("long").alias("n"), "total")


@query(f"{_AROUND}, z as (select *, row_number() over (partition by center, rel order by origin, dir, node_id) as n, count(*) over (partition by center, rel) as total from near) select center, rel, string_agg(node_id, ',' order by n) as neighbors, total, case when total > 8 then max(rtrim(translate(to_base64(encode(cast(to_json([origin, rel, dir, node_id]) as varchar))), '+/', '-_'), '=')) filter (where n = 8) end as next_cursor from z where n <= 8 group by center, rel, total", "nodes", "edges")
def zones_group(m):
    return G.zone_lists(_near(m)).withColumn("neighbors", F.array_join("neighbors", ","))


@query("select id, type, title from nodes where id = 'c:0000000007'", "nodes")
def center_header(m):
    return m.nodes.where("id = 'c:0000000007'").select("id", "type", "title")


@query(
    """+ a1 as (select src as center, rel, origin, 'out' as dir, dst as node_id from edges union all select dst, rel, origin, 'in', src from edges),
  a as (select distinct a1.* from a1 join nodes on id = node_id and merged_into is null),
  top as (select *, row_number() over (partition by center order by origin, rel, dir, node_id) as n from a),
  more as (select distinct center from top where n > 10),
  roots as (select id as root from nodes where type = 'project'),
  l1 as (select root, root || '>' || node_id as path, node_id as leaf, rel from roots join top on center = root where n <= 10),
  l2 as (select root, path || '>' || node_id as path, node_id as leaf, top.rel from l1 join top on center = leaf where n <= 10 and leaf <> root)
  select root, 0 as depth, root as path, root as leaf, null as rel, root in (select center from more) as truncated from roots
  union all select root, 1, path, leaf, rel, leaf <> root and leaf in (select center from more) from l1 union all select root, 2, path, leaf, rel, false from l2""",
    "nodes",
    "edges",
)
def build_context(m):
    ids = m.nodes.where("type = 'project'").select(F.col("id").alias("center"))
    return G.context(m.ends, ids)


@query(
    f"""+ p as (select node_id as id, embedding from chunks join nodes on id = node_id and merged_into is null where embedding is not null),
  s as (select a.id, b.id as other, {_COS} as score from p a, p b where a.id <> b.id)
  select id, other, score from (select *, row_number() over (partition by id order by score desc, other) as n from s where score >= 0.25) where n <= 5""",
    "chunks",
    "nodes",
)
def derived_similar(m):
    ids = G.live(m.nodes).select(F.col("id").alias("node_id"))
    points = m.chunks.where("embedding is not null").join(ids, "node_id", "left_semi").select(F.col("node_id").alias("id"), "embedding")
    return NN.similar(points, 5, 0.25)


@query("select n.id, coalesce(s.id, n.id) as shown, s.id is not null as redirected from nodes n left join nodes s on s.id = n.merged_into", "nodes")
def tombstone_resolve(m):
    s = m.nodes.select(F.col("id").alias("shown"))
    return m.nodes.select("id", "merged_into").join(s, F.col("merged_into") == F.col("shown"), "left").select("id", F.coalesce("shown", "id").alias("shown"), F.col("shown").isNotNull().alias("redirected"))


# indexing


@query("select doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) as content_hash from documents")
def content_hash(m):
    return m.documents.select("doc_id", F.sha2(F.replace("text", F.lit("\r\n"), F.lit("\n")), 256).alias("content_hash"))


@query("select doc_id, unnest(range(0, greatest(cast(ceil((length(text) - 1200) / 1000.0) as bigint), 0) + 1)) as chunk_index, substring(text, unnest(range(0, greatest(cast(ceil((length(text) - 1200) / 1000.0) as bigint), 0) + 1)) * 1000 + 1, 1200) as content from documents where text <> ''")
def hard_split(m):
    return m.documents.select("doc_id", F.posexplode(C.hard_split(F.col("text"))).alias("chunk_index", "content")).withColumn("chunk_index", F.col("chunk_index").cast("long"))




@query("select distinct src, dst, rel from edges where origin = 'canonical' and dst in (select id from nodes) and src in (select id from nodes)", "edges", "nodes")
def canonical_edges(m):
    ids = m.nodes.select("id")
    canon = m.edges.where("origin = 'canonical'")
    return canon.join(ids, canon.dst == ids.id, "left_semi").join(ids, F.col("src") == ids.id, "left_semi").select("src", "dst", "rel").distinct()




@query("select id, case when interiority in ('internal', 'external', 'mixed') then interiority end as interiority from nodes", "nodes")
def interiority_clean(m):
    return m.nodes.select("id", F.when(F.col("interiority").isin("internal", "external", "mixed"), F.col("interiority")).alias("interiority"))


_FOLD = "lower(strip_accents({x}))"


@query("select doc_id, strip_accents(text) as folded from documents")
def fold_diacritics(m):
    return m.documents.select("doc_id", MD.fold_marks("text").alias("folded"))


@query(rf"select id, trim(regexp_replace({_FOLD.format(x='title')}, '\s+', ' ', 'g')) as form from nodes", "nodes")
def normalize_alias(m):
    return m.nodes.select("id", C.normalize_alias(F.col("title")).alias("form"))


@query(f"select id, replace(trim(regexp_replace({_FOLD.format(x='title')}, '[^a-z0-9]+', ' ', 'g')), ' ', '-') as slug from nodes", "nodes")
def slugify(m):
    return m.nodes.select("id", F.replace(C.slug(F.col("title")), F.lit(" "), F.lit("-")).alias("slug"))


# entities

_DISP = r"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"
_TYPES = "('person', 'place', 'topic', 'event', 'project')"
_STOP = "(" + ", ".join(f"'{w}'" for w in C.STOP_WORDS) + ")"
_SURF = f"""+ surf as (select distinct id, type, {_DISP.format(x='form')} as form from (select id, type, unnest(list_concat([title], aliases)) as form from nodes where merged_into is null and type in {_TYPES}) where {_DISP.format(x='form')} <> ''),
ment as (select distinct * from (select 'Cust ' || cast(c_custkey as varchar) as mention, 'person' as type from customer union all select p_name, 'topic' from part union all select 'Nobody ' || n_name, 'person' from nation)),
exact as (select distinct mention, ment.type, id from ment join surf on surf.type = ment.type and surf.form = {_DISP.format(x='mention')}),
stok as (select distinct id, type, token from (select id, type, unnest(string_split(form, ' ')) as token from surf) where length(token) >= 4 and token not in {_STOP}),
mtok as (select distinct mention, type, token from (select mention, type, unnest(string_split({_DISP.format(x='mention')}, ' ')) as token from ment) where length(token) >= 4 and token not in {_STOP}),
tok0 as (select distinct mention, mtok.type, stok.id, (mention, mtok.type, stok.id) in (select (mention, type, id) from exact) as is_exact from mtok join stok on stok.type = mtok.type and stok.token = mtok.token union select mention, type, id, true from exact),
tok as (select mention, type, id, is_exact, n from (select tok0.*, row_number() over (partition by mention, tok0.type order by is_exact desc, title, tok0.id) as n from tok0 join nodes on nodes.id = tok0.id) where n <= 100)"""


def _mentions(m: Model) -> DataFrame:
    c = m.customer.select(F.concat(F.lit("Cust "), F.col("c_custkey").cast("string")).alias("mention"), F.lit("person").alias("type"))
    p = m.part.select("p_name", F.lit("topic"))
    n = m.nation.select(F.concat(F.lit("Nobody "), "n_name"), F.lit("person"))
    return c.union(p).union(n).distinct()


@query(f"{_SURF} select mention, type, id from exact", "nodes")
def alias_exact(m):
    return E.exact_matches(m.nodes, _mentions(m))


@query(f"{_SURF} select mention, type, id, is_exact, n from tok", "nodes")
def alias_token_overlap(m):
    return E.token_matches(m.nodes, _mentions(m))


@query(f"{_SURF} select distinct id, token from stok", "nodes")
def significant_tokens(m):
    return E.surfaces(m.nodes).select("id", F.explode(C.significant_tokens(F.col("form"))).alias("token")).distinct()


@query(
    f"""{_SURF}, c as (select mention, type, count(*) as candidates from (select mention, type, id from exact union select mention, type, id from tok) group by 1, 2),
  e as (select mention, type, count(*) as exact, min(id) as only_id from exact group by 1, 2)
  select ment.mention, ment.type, coalesce(candidates, 0) as candidates, coalesce(exact, 0) as exact, case when coalesce(candidates, 0) = 0 then 'mint' when coalesce(exact, 0) = 1 then 'link:' || only_id else 'review' end as outcome
  from ment left join c on c.mention = ment.mention and c.type = ment.type left join e on e.mention = ment.mention and e.type = ment.type""",
    "nodes",
)
def resolve_decide(m):
    return E.decide(m.nodes_of("".join(KINDS[t] for t in E.ENTITY_TYPES if t in KINDS)), _mentions(m))


@query(f"select type, form, min(id) as id from (select id, type, {_DISP.format(x='title')} as form from nodes where type in {_TYPES}) where form <> '' group by 1, 2", "nodes")
def mention_dedup(m):
    forms = m.nodes.where(F.col("type").isin(E.ENTITY_TYPES)).select("id", "type", C.display_key(F.col("title")).alias("form")).where("form <> ''")
    return E.first_by(forms, ["type", "form"], ["id"]).select("type", "form", "id")


@query(f"{_SURF} select id, count(*) as n, min(form) as low, max(form) as high from surf group by 1", "nodes")
def surface_forms(m):
    return E.surfaces(m.nodes).groupBy("id").agg(F.count("*").alias("n"), F.min("form").alias("low"), F.max("form").alias("high"))








_LINKS = "links as (select distinct id, other from (select src as id, dst as other from edges where origin = 'canonical' union all select dst, src from edges where origin = 'canonical') where other in (select id from nodes where merged_into is null))"


@query(f"+ {_LINKS} select id, other from links", "nodes", "edges")
def neighborhood(m):
    return m.links


@query(f"select id, type, title from nodes where merged_into is null and type in {_TYPES}", "nodes")
def entities_list(m):
    return G.live(m.nodes).where(F.col("type").isin(E.ENTITY_TYPES)).select("id", "type", "title")


_NORM = r"trim(regexp_replace(" + _FOLD.format(x="{x}") + r", '\s+', ' ', 'g'))"


@query(
    f"""select id, type, title, tier from (select id, type, title, case when t = 'cust 12' then 0 when starts_with(t, 'cust 12') then 1 when list_contains(al, 'cust 12') then 2 when contains(t, 'cust 12') then 3 when len(list_filter(al, lambda a: contains(a, 'cust 12'))) > 0 then 4 end as tier
  from (select id, type, title, {_NORM.format(x='title')} as t, list_transform(aliases, lambda a: {_NORM.format(x='a')}) as al from nodes where merged_into is null and type in {_TYPES})) where tier is not null""",
    "nodes",
)
def entity_browse(m):
    return E.browse(m.nodes, "Cust  12")




@query(f"+ {_LINKS} select n.id, n.type, count(other) as neighbors from nodes n left join links on links.id = n.id where merged_into is null and type in {_TYPES} group by 1, 2", "nodes", "edges")
def entity_dedup_hubs(m):
    hubs = G.live(m.nodes).where(F.col("type").isin(E.ENTITY_TYPES)).select("id", "type")
    return hubs.join(m.links, "id", "left").groupBy("id", "type").agg(F.count("other").alias("neighbors"))


# content duplicates

_PAIRS = f"p as (select node_id as id, embedding from chunks where embedding is not null), s as (select a.id, b.id as other, {_COS} as score from p a, p b where a.id <> b.id), near as (select least(id, other) as a, greatest(id, other) as b, max(score) as score from (select *, row_number() over (partition by id order by score desc, other) as n from s where score >= 0.3) where n <= 10 group by 1, 2)"


def _near_pairs(m: Model) -> DataFrame:
    points = m.chunks.where("embedding is not null").select(F.col("node_id").alias("id"), "embedding")
    return E.canonical_pairs(NN.similar(points, 10, 0.3))


@query(f"+ {_PAIRS} select a, b, score from near", "chunks")
def dedup_canonicalize(m):
    return _near_pairs(m)


@query(
    f"+ {_PAIRS}, {_LINKS}, dg as (select id, count(*) as degree from links group by 1), n as (select nodes.id, coalesce(degree, 0) as degree, created_on from nodes left join dg on dg.id = nodes.id) select near.a, near.b, case when x.degree <> y.degree then case when x.degree > y.degree then near.a else near.b end when x.created_on <> y.created_on then case when x.created_on < y.created_on then near.a else near.b end else near.a end as survivor from near join n x on x.id = near.a join n y on y.id = near.b",
    "chunks",
    "nodes",
    "edges",
)
def dedup_survivor(m):
    return E.survivors(_near_pairs(m).select("a", "b"), m.nodes, m.degrees)


@query(
    f"+ {_PAIRS} select near.a, near.b, score, x.occurred_start is not null and y.occurred_start is not null as overlap from near join nodes x on x.id = near.a join nodes y on y.id = near.b where x.occurred_start is null or y.occurred_start is null or (x.occurred_start <= coalesce(y.occurred_end, y.occurred_start) and y.occurred_start <= coalesce(x.occurred_end, x.occurred_start))",
    "chunks",
    "nodes",
)
def dedup_overlap_flag(m):
    d = m.nodes.select("id", "occurred_start", F.coalesce("occurred_end", "occurred_start").alias("occurred_end"))
    x, y = d.toDF("a", "xs", "xe"), d.toDF("b", "ys", "ye")
    both = F.col("xs").isNotNull() & F.col("ys").isNotNull()
    meet = (F.col("xs") <= F.col("ye")) & (F.col("ys") <= F.col("xe"))
    return _near_pairs(m).join(x, "a").join(y, "b").where(~both | meet).select("a", "b", "score", both.alias("overlap"))


# tags


@query("select tag, count(*) as n from (select unnest(tags) as tag from nodes) group by 1 order by n desc, tag limit 50", "nodes")
def tag_counts(m):
    return m.nodes.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(50)


@query("select id from nodes where list_has_any(tags, ['de', 'BUILDING', '1-URGENT'])", "nodes")
def nodes_with_any_tag(m):
    return m.nodes.where(F.arrays_overlap("tags", F.array(F.lit("de"), F.lit("BUILDING"), F.lit("1-URGENT")))).select("id")


@query("+ r as (select id, list_transform(tags, lambda t: case when t in ('F', 'P', '1-URGENT') then 'O' else t end) as tags from nodes where type = 'memory') select id, array_to_string(list_filter(tags, lambda t, i: list_position(tags, t) = i), ',') as tags from r", "nodes")
def tag_remap(m):
    """Tags by their canonical ones; what is equal then counts once."""
    to = F.create_map(*[F.lit(x) for t in ("F", "P", "1-URGENT") for x in (t, "O")])
    return m.nodes.where("type = 'memory'").select("id", F.array_join(F.array_distinct(F.transform("tags", lambda t: F.coalesce(to[t], t))), ",").alias("tags"))


@query("select e.src, s.title as src_title, e.rel, e.dst, d.title as dst_title, b.body as excerpt from edges e join nodes s on s.id = e.src and s.merged_into is null join nodes d on d.id = e.dst and d.merged_into is null left join bodies b on b.node_id = e.src where origin = 'canonical' and rel <> 'about' order by s.created_on desc nulls last, e.src, e.rel, e.dst limit 500", "edges", "nodes", "bodies")
def edge_inventory(m):
    """The newest nodes' edges of other relations than one, with both titles and the first words of the source."""
    first = m.bodies.select("node_id", F.lit(0).alias("chunk_index"), F.col("body").alias("content"))
    return E.edge_inventory(m.nodes, m.edges, first, "about", 500)


@query("select distinct src, dst, case when rel = 'at' and src like 's:%' then 'part_of' else rel end as rel from edges", "edges")
def edge_retype(m):
    return m.edges.select("src", "dst", F.when((F.col("rel") == "at") & F.col("src").like("s:%"), "part_of").otherwise(F.col("rel")).alias("rel")).distinct()


# health and review


@query("select id, type from nodes where merged_into is null and store_path not like 'inbox/%' and id not in (select src from edges where origin = 'canonical' union select dst from edges where origin = 'canonical')", "nodes", "edges")
def health_orphans(m):
    return A.orphans(m.nodes, m.edges)




@query("select kind, count(*) as n, min(created_on) as oldest, max(datediff('day', created_on, date '2024-12-31')) as age from review_queue where status = 'maybe' group by 1", "review_queue")
def maybe_stats(m):
    age = F.max(F.datediff(F.to_date(F.lit(TODAY)), "created_on")).cast("long")
    return m.review_queue.where("status = 'maybe'").groupBy("kind").agg(F.count("*").alias("n"), F.min("created_on").alias("oldest"), age.alias("age"))


@query("select item_id, kind, case when status in ('pending', 'maybe') then case when kind = 'entity' then 'resolved' else 'discarded' end else status end as status, status in ('pending', 'maybe') as changed from review_queue", "review_queue")
def review_resolve(m):
    open_ = F.col("status").isin("pending", "maybe")
    return m.review_queue.select("item_id", "kind", F.when(open_, F.when(F.col("kind") == "entity", "resolved").otherwise("discarded")).otherwise(F.col("status")).alias("status"), open_.alias("changed"))


# activity

_FEED = """+ feed as (select cast(run_id as varchar) as id, case when trigger_name = 'manual' then 'manual_actions' else 'agents_jobs' end as category, 'agent_run' as kind, started_at as ts, agent as title, substring(repeat(agent || ' ', 40), 1, 280) as snippet, cast(run_id as varchar) as ref, cast(null as varchar) as parent_ref, status, cast(null as varchar) as source from agent_runs where parent_run_id is null
union all select cast(capture_id as varchar), 'captures', 'capture', created_at, null, substring(raw_text, 1, 280), case when kind = 'text' then cast(user_id as varchar) end, null, status, case when kind = 'text' then 'chat' else kind end from captures where not removed
union all select cast(item_id as varchar), 'manual_actions', 'review_verdict', created_at, kind, substring(payload, 1, 280), cast(item_id as varchar), null, status, null from review_queue where status in ('resolved', 'discarded'))"""


def _feed(m):
    runs = m.agent_runs.withColumn("summary", F.repeat(F.concat("agent", F.lit(" ")), 40))
    chat = F.col("kind") == "text"
    captures = m.captures.withColumn("source", F.when(chat, "chat")).withColumn("source_ref", F.when(chat, F.col("user_id")))
    settled = F.when(F.col("status").isin("resolved", "discarded"), F.col("created_at"))
    return A.feed(runs, captures, m.review_queue.withColumn("resolved_at", settled).withColumn("excerpt", F.col("payload")))


@query(f"{_FEED} select * from feed", "agent_runs", "captures", "review_queue")
def feed_union(m):
    return _feed(m)


@query(f"{_FEED} select id, category from feed where (ts, id) < (timestamp '2024-01-15 00:00:00', '5') order by ts desc, id desc limit 51", "agent_runs", "captures", "review_queue")
def feed_keyset(m):
    return A.feed_page(_feed(m), 50, ("2024-01-15 00:00:00", "5")).select("id", "category")


@query(
    "+ tree as (select r.run_id, r.run_id as root_id, 0 as depth from agent_runs r where parent_run_id is null or parent_run_id not in (select run_id from agent_runs) union all select r.run_id, root_id, depth + 1 from agent_runs r join tree t on r.parent_run_id = t.run_id where depth < 32) select run_id, root_id, depth from tree",
    "agent_runs",
)
def run_tree(m):
    return G.run_tree(m.agent_runs)






@query("select capture_id, case when status in ('indexed', 'failed') then status else 'failed' end as status from captures", "captures")
def sweep_orphans(m):
    return m.captures.select("capture_id", F.when(F.col("status").isin("indexed", "failed"), F.col("status")).otherwise("failed").alias("status"))




# conversations

_MARKS = "+ marks as (select session_id, min(at_minute) as mark from chat_messages where session_id % 3 = 0 group by 1)"


def _marks(m: Model) -> DataFrame:
    return m.chat_messages.where("session_id % 3 = 0").groupBy("session_id").agg(F.min("at_minute").alias("mark"))


@query("select session_id, turn, role, back from (select *, row_number() over (partition by session_id order by at_minute desc, turn desc) as back from chat_messages) where back <= 3", "chat_messages")
def session_last_n(m):
    return A.last_n(m.chat_messages, 3).select("session_id", "turn", "role", F.col("back").cast("long").alias("back"))


@query(f"{_MARKS} select m.session_id, max(at_minute) as newest from chat_messages m left join marks on marks.session_id = m.session_id group by 1, mark having max(at_minute) < 5000 and (mark is null or max(at_minute) > mark)", "chat_messages")
def distillable_sessions(m):
    return A.distillable(m.chat_messages, _marks(m), 5000)


_DELTA = f"{_MARKS}, delta as (select * from (select m.*, row_number() over (partition by m.session_id order by at_minute, turn) as n from chat_messages m left join marks on marks.session_id = m.session_id where mark is null or at_minute > mark) where n <= 4)"


@query(f"{_DELTA} select session_id, turn, n from delta", "chat_messages")
def delta_messages(m):
    return A.delta(m.chat_messages, _marks(m), 4).select("session_id", "turn", F.col("n").cast("long").alias("n"))


@query(f"{_DELTA} select d.session_id, max(at_minute) as mark, max(newest) as newest, count(*) >= 4 and max(at_minute) < max(newest) as truncated from delta d join (select session_id, max(at_minute) as newest from chat_messages group by 1) s on s.session_id = d.session_id group by 1", "chat_messages")
def watermark_advance(m):
    newest = m.chat_messages.groupBy("session_id").agg(F.max("at_minute").alias("newest"))
    done = A.delta(m.chat_messages, _marks(m), 4).groupBy("session_id").agg(F.max("at_minute").alias("mark"), F.count("*").alias("n"))
    return done.join(newest, "session_id").select("session_id", "mark", "newest", ((F.col("n") >= 4) & (F.col("mark") < F.col("newest"))).alias("truncated"))


@query(f"{_DELTA} select session_id, count(*) as n, string_agg(case when role = 'user' then 'User: ' else 'Assistant: ' end || content, chr(10) order by at_minute, turn) as transcript from delta group by 1", "chat_messages")
def distill_transcript(m):
    return A.transcripts(A.delta(m.chat_messages, _marks(m), 4))


# temporal references

_D = "cast(o_orderdate as date)"
_WD = f"cast(isodow({_D}) - 1 as int)"


@query(f"select o_orderkey, {_D} + (2 - {_WD}) as this_wed, {_D} + case when (2 - {_WD} + 7) % 7 = 0 then 7 else (2 - {_WD} + 7) % 7 end as next_wed, {_D} - case when (2 - {_WD} + 7) % 7 = 0 then 7 else 7 - (2 - {_WD} + 7) % 7 end as last_wed from orders")
def resolve_weekday(m):
    d = F.to_date("o_orderdate")
    return m.orders.select("o_orderkey", *[A.weekday_of(d, 2, w).alias(f"{w}_wed") for w in ("this", "next", "last")])


_EPOCH = "date '1996-01-01'"


def _far(day: str, now: str) -> str:
    """How far a day lies from another, in words."""
    days = f"datediff('day', {now}, {day})"
    n = f"abs({days})"
    count = f"cast(case when {n} <= 27 then {n} when {n} < 330 then greatest(floor({n} / 30.0::double + 0.5), 1) when {n} < 400 then 1 else floor({n} / 365.0::double + 0.5) end as int)"
    unit = f"case when {n} <= 27 then 'day' when {n} < 330 then 'month' else 'year' end"
    words = f"case when {count} = 1 then 'a ' || {unit} else cast({count} as varchar) || ' ' || {unit} || 's' end"
    return f"case when {days} = 0 then 'today' when {days} = -1 then 'yesterday' when {days} = 1 then 'tomorrow' when {days} < 0 then {words} || ' ago' else 'in ' || {words} end"


@query(f"select o_orderkey, {_far(_D, _EPOCH)} as said from orders")
def humanize_day(m):
    return m.orders.select("o_orderkey", C.humanize_days(F.datediff(F.to_date("o_orderdate"), F.to_date(F.lit("1996-01-01")))).alias("said"))


__all__ = ["ORACLE_SQL", "QUERIES"]
