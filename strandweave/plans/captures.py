"""Registered queries: captures, media, runs and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import captures as CA
from ..operators import entities as E
from ..operators import files as FI
from ..operators import graph as G
from .catalog import _TYPES, query

_ORD = "order by part_ordinal nulls last, created_at, media_id"
_BODY = "case when status = 'derived' and trim(coalesce(derived_text, '')) <> '' then trim(derived_text) when kind = 'photo' then '<photo — description unavailable>' when kind = 'voice' then '<voice note — transcript unavailable>' else '<media — unavailable>' end"


@query(
    """select run_id, cast(json_extract_string(details, '$.capture_id') as bigint) as capture_id, json_extract_string(details, '$.kind') as kind, json_extract_string(details, '$.stt.provider') as stt_provider,
  cast(json_extract_string(details, '$.stt.fallback_used') as boolean) as stt_fallback, json_extract_string(details, '$.organize.model') as organize_model, cast(json_extract_string(details, '$.organize.inbox_fallback') as boolean) as inbox_fallback,
  fallback_used, status, cast(null as varchar) as error, started_at, cast(json_extract_string(details, '$.timings_ms.total') as int) as duration_ms from capture_runs where agent = 'capture'""",
    "capture_runs",
)
def capture_interactions(m):
    at = lambda path, kind="string": F.get_json_object("details", f"$.{path}").cast(kind)
    return m.capture_runs.where("agent = 'capture'").select(
        "run_id", at("capture_id", "long").alias("capture_id"), at("kind").alias("kind"), at("stt.provider").alias("stt_provider"), at("stt.fallback_used", "boolean").alias("stt_fallback"), at("organize.model").alias("organize_model"),
        at("organize.inbox_fallback", "boolean").alias("inbox_fallback"), "fallback_used", "status", F.lit(None).cast("string").alias("error"), "started_at", at("timings_ms.total", "int").alias("duration_ms"),
    )


@query(
    f"+ newest as (select capture_id, created_at from captures where not removed order by created_at desc, capture_id desc limit 50) select capture_id, created_at, coalesce((select string_agg(id, ',' order by pos) from capture_nodes c join nodes on store_path = path where c.capture_id = newest.capture_id), '') as node_ids, coalesce((select string_agg(cast(media_id as varchar), ',' {_ORD}) from media where media.capture_id = newest.capture_id), '') as media_ids from newest",
    "captures", "capture_nodes", "nodes", "media",
)
def captures_list(m):
    out = CA.listed(m.captures, m.capture_nodes, m.nodes, m.media, 50)
    return out.select("capture_id", "created_at", F.array_join("node_ids", ",").alias("node_ids"), F.array_join(F.transform("media_ids", lambda x: x.cast("string")), ",").alias("media_ids"))


@query("select distinct capture_id from capture_nodes where path like 'inbox/%'", "capture_nodes")
def inbox_materialized(m):
    return m.capture_nodes.where(F.col("path").startswith("inbox/")).select("capture_id").distinct()


@query("+ b as (select capture_id, bool_or(path like 'inbox/%') as inbox, count(*) as n from capture_nodes group by 1) select count(*) as found, count(*) filter (where inbox and n > 1) as reorganized, count(*) filter (where not inbox) as resolved, count(*) filter (where inbox) as still from b", "capture_nodes")
def inbox_drain_outcome(m):
    each = m.capture_nodes.groupBy("capture_id").agg(F.bool_or(F.col("path").startswith("inbox/")).alias("inbox"), F.count("*").alias("n"))
    return each.agg(F.count("*").alias("found"), F.count_if(F.col("inbox") & (F.col("n") > 1)).alias("reorganized"), F.count_if(~F.col("inbox")).alias("resolved"), F.count_if("inbox").alias("still"))


@query(f"+ first as (select capture_id, n.title, row_number() over (partition by capture_id order by pos) as k from capture_nodes join nodes n on n.store_path = path and n.type not in {_TYPES}) select c.capture_id, f.title from captures c left join first f on f.capture_id = c.capture_id and k = 1 where c.kind = 'text'", "captures", "capture_nodes", "nodes")
def auto_recorded_list(m):
    titles = m.capture_nodes.join(m.nodes.where(~F.col("type").isin(E.ENTITY_TYPES)).select(F.col("store_path").alias("path"), "title"), "path")
    first = titles.groupBy("capture_id").agg(F.min_by("title", "pos").alias("title"))
    return m.captures.where("kind = 'text'").select("capture_id").join(first, "capture_id", "left").select("capture_id", "title")


@query("+ kept as (select capture_id from media where media_id % 4 <> 1) select capture_id, raw_text, 'audio/' || cast(capture_id as varchar) || '.ogg' as audio_path from captures where kind = 'voice' and not removed and capture_id % 5 <> 0 and capture_id not in (select capture_id from kept where capture_id is not null and capture_id % 2 = 0)", "captures", "media")
def legacy_voice(m):
    """Voice captures with a sound file and no medium of their own; half of the media are from before."""
    kept = m.media.where("media_id % 4 <> 1 and capture_id % 2 = 0").select("capture_id")
    path = F.when(F.col("capture_id") % 5 != 0, F.concat(F.lit("audio/"), F.col("capture_id").cast("string"), F.lit(".ogg")))
    return CA.legacy_voice(m.captures.withColumn("audio_path", path), kept)


@query("+ p as (select distinct path from capture_nodes) select id from nodes where merged_into is null and type not in " + _TYPES + " and store_path in (select path from p)", "nodes", "capture_nodes")
def content_node_ids(m):
    live = G.live(m.nodes).where(~F.col("type").isin(E.ENTITY_TYPES))
    return live.join(m.capture_nodes.select(F.col("path").alias("store_path")), "store_path", "left_semi").select("id")


@query(f"select capture_id, media_id, row_number() over (partition by capture_id {_ORD}) as place from media where status = 'derived'", "media")
def media_by_capture(m):
    from pyspark.sql import Window

    w = Window.partitionBy("capture_id").orderBy(F.asc_nulls_last("part_ordinal"), "created_at", "media_id")
    return m.media.where("status = 'derived'").select("capture_id", "media_id", F.row_number().over(w).cast("long").alias("place"))


@query("+ t as (select *, status = 'pending' as p, trim(coalesce(derived_text, '')) <> '' as good from media) select media_id, case when p and good then 'derived' when p and attempts + 1 >= 3 then 'unavailable' else status end as status, case when p and not good then attempts + 1 else attempts end as attempts from t", "media")
def media_state(m):
    return CA.derive(m.media)


@query("+ n as (select capture_id, pos, id as node_id from capture_nodes join nodes on store_path = path) select distinct node_id, media_id from n join media using (capture_id) where part_ordinal is null or part_ordinal = pos", "capture_nodes", "nodes", "media")
def node_media_rebuild(m):
    return CA.attributed(m.capture_nodes, m.nodes, m.media)


@query(f"""+ ranked as (select *, row_number() over (partition by capture_id {_ORD}) as k from media), parts as (select capture_id, string_agg('[[part ' || k || ' · ' || kind || ']] ' || {_BODY}, chr(10) || chr(10) order by k) as t from ranked group by 1)
  select capture_id, concat_ws(chr(10) || chr(10), nullif(trim(coalesce(raw_text, '')), ''), t) as text from captures left join parts using (capture_id)""", "captures", "media")  # fmt: skip
def compose_raw_text(m):
    return CA.composed(m.captures, m.media)


@query(
    """select 'links-without-node' as "check", count(*) filter (where n.id is null) as n from node_media l left join nodes n on n.id = l.node_id union all select 'links-on-tombstones', count(*) from node_media l join nodes n on n.id = l.node_id and merged_into is not null
  union all select 'links-without-media', count(*) from node_media where media_id not in (select media_id from media) union all select 'media-without-node', count(*) from media where media_id not in (select media_id from node_media) union all select 'media-without-capture', count(*) from media where capture_id not in (select capture_id from captures)""",
    "node_media", "nodes", "media", "captures",
)
def media_join_checks(m):
    return CA.join_checks(m.media, m.node_media, m.nodes, m.captures)


@query("select node_id, string_agg(distinct kind, ',' order by kind) as kinds, max(created_at) as newest from node_media join media using (media_id) group by 1", "node_media", "media")
def media_kinds_by_node(m):
    rows = m.node_media.join(m.media, "media_id").groupBy("node_id").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"), F.max("created_at").alias("newest"))
    return rows


@query("select node_id, media_id, kind, row_number() over (partition by node_id order by created_at desc, media_id) as place from node_media join media using (media_id)", "node_media", "media")
def node_media_strip(m):
    from pyspark.sql import Window

    w = Window.partitionBy("node_id").orderBy(F.desc("created_at"), "media_id")
    return m.node_media.join(m.media, "media_id").select("node_id", "media_id", "kind", F.row_number().over(w).cast("long").alias("place"))


@query("select node_id, string_agg(distinct kind, ',' order by kind) as kinds from node_media join media using (media_id) where node_id in (select id from nodes where type = 'memory' and merged_into is null) group by 1", "node_media", "media", "nodes")
def search_media_kinds(m):
    live = G.live(m.nodes).where("type = 'memory'").select(F.col("id").alias("node_id"))
    return m.node_media.join(live, "node_id", "left_semi").join(m.media, "media_id").groupBy("node_id").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))


@query("select kind, count(*) as n, min(created_at) as oldest from captures where not removed group by 1", "captures")
def reprocess_counts(m):
    return m.captures.where("not removed").groupBy("kind").agg(F.count("*").alias("n"), F.min("created_at").alias("oldest"))


@query(None)
def rate_limit(m):
    events = m.events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us")).withColumn("at", F.col("us") / 1e6).drop("us")
    return CA.allowed(events, "user_id", "at", 2, 86400.0)


@query("select agent, status, run_id, started_at from (select *, row_number() over (partition by agent, status order by started_at desc, run_id desc) as k from agent_runs) where k = 1", "agent_runs")
def run_latest(m):
    return CA.latest(m.agent_runs, "agent", "status").select("agent", "status", "run_id", "started_at")


@query("+ l as (select agent, status from (select *, row_number() over (partition by agent order by started_at desc, run_id desc) as k from agent_runs) where k = 1), s as (select agent, max(started_at) filter (where status = 'succeeded') as good from agent_runs group by 1) select agent, status as latest, status <> 'failed' and coalesce(datediff('day', cast(good as date), date '2024-01-31') <= 10, false) as healthy from l join s using (agent)", "agent_runs")
def drill_health(m):
    good = m.agent_runs.where("status = 'succeeded'").groupBy("agent").agg(F.to_date(F.max("started_at")).alias("good"))
    fresh = F.coalesce(F.datediff(F.to_date(F.lit("2024-01-31")), "good") <= 10, F.lit(False))
    rows = CA.latest(m.agent_runs, "agent").select("agent", F.col("status").alias("latest")).join(good, "agent", "left")
    return rows.select("agent", "latest", ((F.col("latest") != "failed") & fresh).alias("healthy"))


@query("select run_id, seq, min(line) as line from run_logs group by 1, 2", "run_logs")
def run_log_insert(m):
    """Lines of a (run_id, seq) that is there are ignored; of equal new ones the smallest stays."""
    return m.run_logs.groupBy("run_id", "seq").agg(F.min("line").alias("line"))


@query("select run_id, seq, line from (select *, row_number() over (partition by run_id order by seq, line) as k from (select distinct * from run_logs) where seq > 2) where k <= 3", "run_logs")
def run_logs_tail(m):
    return E.first_by(m.run_logs.distinct().where("seq > 2"), ["run_id"], ["seq", "line"], 3).select("run_id", "seq", "line")


@query("select capture_id, case when not removed and kind = 'image' then 'indexed' else status end as status, not removed and kind = 'image' as changed from captures", "captures")
def capture_set(m):
    return FI.update_where(m.captures, ~F.col("removed") & (F.col("kind") == "image"), status=F.lit("indexed")).select("capture_id", "status", "changed")


@query("select capture_id, removed or status = 'failed' as removed, not removed and status = 'failed' as changed from captures", "captures")
def capture_tombstone(m):
    return FI.update_where(m.captures, ~F.col("removed") & (F.col("status") == "failed"), removed=F.lit(True)).select("capture_id", "removed", "changed")


@query("select capture_id, media_id from (select *, row_number() over (partition by capture_id order by created_at, media_id) as k from media) where k = 1", "media")
def media_first_by_capture(m):
    return m.media.groupBy("capture_id").agg(F.min_by("media_id", F.struct("created_at", "media_id")).alias("media_id"))


@query("select media_id, case when pick then 'pending' else status end as status, case when pick then 0 else attempts end as attempts from (select *, status = 'unavailable' and row_number() over (partition by status order by created_at, media_id) <= 40 as pick from media)", "media")
def rederive_backlog(m):
    old = m.media.where("status = 'unavailable'").select("media_id", "created_at").orderBy("created_at", "media_id").limit(40).select("media_id", F.lit(True).alias("pick"))
    rows = m.media.join(old, "media_id", "left").withColumn("pick", F.coalesce("pick", F.lit(False)))
    return rows.select("media_id", F.when(F.col("pick"), "pending").otherwise(F.col("status")).alias("status"), F.when(F.col("pick"), 0).otherwise(F.col("attempts")).alias("attempts"))


@query(f"select media_id, {_BODY} as body from media", "media")
def placeholder(m):
    return m.media.select("media_id", CA.part_body().alias("body"))


@query(f"select capture_id, string_agg(path, ',' order by pos) as paths from capture_nodes where string_split(path, '/')[1] not in {_TYPES} group by 1", "capture_nodes")
def capture_content_paths(m):
    rows = m.capture_nodes.where(~F.substring_index("path", "/", 1).isin(E.ENTITY_TYPES)).groupBy("capture_id").agg(F.sort_array(F.collect_list(F.struct("pos", "path"))).alias("p"))
    return rows.select("capture_id", F.array_join("p.path", ",").alias("paths"))
