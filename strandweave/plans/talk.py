"""Registered queries: distilled candidates, citations, cleaned replies, review verdicts, small cleaners."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import chat as CH
from ..operators import entities as E
from ..operators import graph as G
from .catalog import _TYPES, query

_CAND = """+ c0 as (select session_id, cast(i as int) as pos, json_extract(reply, '$.candidates[' || i || ']') as c from replies, (select unnest([0, 1, 2]) as i)),
c as (select session_id, pos, trim(json_extract_string(c, '$.candidate_text')) as text, lower(trim(coalesce(json_extract_string(c, '$.stance'), ''))) as st, lower(trim(coalesce(json_extract_string(c, '$.salience'), ''))) as sa, trim(coalesce(json_extract_string(c, '$.evidence_excerpt'), '')) as excerpt from c0 where trim(coalesce(json_extract_string(c, '$.candidate_text'), '')) <> ''),
cand as (select session_id, pos, text, case when st in ('endorsed', 'unclear', 'rejected') then st else 'unclear' end as stance, case when sa in ('high', 'low') then sa else 'med' end as salience, excerpt, 1 as dropped from c)"""
_HEDGED = " or ".join(f"contains(lower(text || chr(10) || excerpt), '{h.replace(chr(39), chr(39) * 2)}')" for h in CH.HEDGES)
_FORM = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
_GATED = f"{_CAND}, gated as (select session_id, pos, text, excerpt, case when stance = 'endorsed' and ({_HEDGED}) then 'unclear' else stance end as route from (select *, row_number() over (partition by session_id, {_FORM.format(x='text')} order by pos) as k from cand) where k = 1)"


@query(f"{_CAND} select * from cand", "replies")
def candidate_parse(m):
    return CH.candidates(m.replies)


@query(f"{_GATED} select session_id, pos, text, route from gated", "replies")
def stance_gate(m):
    return CH.gated(CH.candidates(m.replies)).select("session_id", "pos", "text", "route")


@query(f"{_GATED} select session_id, pos, coalesce(min(at_minute) filter (where probe <> '' and contains({_FORM.format(x='content')}, probe)), max(at_minute) filter (where role = 'user'), max(at_minute)) as anchor from (select *, substring({_FORM.format(x='excerpt')}, 1, 60) as probe from gated) left join chat_messages using (session_id) group by 1, 2", "replies", "chat_messages")
def anchor_time(m):
    return CH.anchored(CH.gated(CH.candidates(m.replies)), m.chat_messages)


@query(f"{_GATED} select session_id, pos, sha256(cast(session_id as varchar) || chr(10) || {_FORM.format(x='text')}) as capture_key from gated where route = 'endorsed'", "replies")
def chat_capture_id(m):
    """The key of a conversation's capture, from session and text, so that a replay files nothing twice."""
    rows = CH.gated(CH.candidates(m.replies)).where("route = 'endorsed'")
    return rows.select("session_id", "pos", F.sha2(F.concat(F.col("session_id").cast("string"), F.lit("\n"), CH.match_form(F.col("text"))), 256).alias("capture_key"))


_ANSWER = "'See [' || (o_orderkey % 4 + 1) || '] and [9] or [' || (o_orderkey % 3 + 1) || '][' || (o_orderkey % 4 + 1) || ']'"


@query(f"select o_orderkey, 'See [1] and  or [' || case when o_orderkey % 4 = o_orderkey % 3 then 1 else 2 end || '][1]' as answer, o_orderkey % 4 + 1 || case when o_orderkey % 4 = o_orderkey % 3 then '' else ',' || (o_orderkey % 3 + 1) end as cited from orders")
def citations(m):
    n = lambda k: ((F.col("o_orderkey") % k) + 1).cast("string")
    said = F.concat(F.lit("See ["), n(4), F.lit("] and [9] or ["), n(3), F.lit("]["), n(4), F.lit("]"))
    rows = m.orders.select("o_orderkey", said.alias("said"))
    return rows.select("o_orderkey", CH.renumbered("said", F.lit(5)).alias("answer"), F.array_join(F.transform(CH.cited(F.col("said"), 5), lambda x: x.cast("string")), ",").alias("cited"))


@query("+ w as (select session_id, max(at_minute) - 120 as mark from chat_messages where session_id % 2 = 0 group by 1) select c.session_id, max(mark) as mark, max(at_minute) as newest from chat_messages c left join w on w.session_id = c.session_id group by 1", "chat_messages")
def session_state(m):
    marks = m.chat_messages.where("session_id % 2 = 0").groupBy("session_id").agg((F.max("at_minute") - 120).alias("mark"))
    return m.chat_messages.groupBy("session_id").agg(F.max("at_minute").alias("newest")).join(marks, "session_id", "left").select("session_id", "mark", "newest")


@query("select session_id, 'Messages of one session, quoted as they are:' || chr(10) || '<<<' || chr(10) || string_agg(case when role = 'user' then 'User: ' else 'Assistant: ' end || content, chr(10) order by at_minute, turn) || chr(10) || '>>>' as prompt from chat_messages group by 1", "chat_messages")
def render_transcript(m):
    return CH.transcript(m.chat_messages)


@query("select session_id, json_extract_string(reply, '$.candidates[0].stance') as stance from replies", "replies")
def json_tolerant(m):
    """A reply in fences with words around it."""
    wrapped = F.concat(F.lit("Sure!\n```json\n"), "reply", F.lit("\n```\nDone."))
    return m.replies.select("session_id", F.get_json_object(CH.json_object(wrapped), "$.candidates[0].stance").alias("stance"))


_TAG = r"regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(trim(lower(strip_accents({x}))), '^#+', '')), '[^a-z0-9_/-]+', '-', 'g'), '-{{2,}}', '-', 'g'), '^[-/_]+|[-/_]+$', '', 'g')"


@query(f"select c_custkey, case when regexp_matches({_TAG.format(x='t')}, '[a-z]') then {_TAG.format(x='t')} else '' end as tag from (select c_custkey, case when c_custkey % 3 = 0 then '# ' || c_mktsegment || '  Été!' when c_custkey % 3 = 1 then cast(c_custkey as varchar) else '-' || c_name || '/' end as t from customer)")
def slugify_tag(m):
    k = F.col("c_custkey") % 3
    t = F.when(k == 0, F.concat(F.lit("# "), "c_mktsegment", F.lit("  Été!"))).when(k == 1, F.col("c_custkey").cast("string")).otherwise(F.concat(F.lit("-"), "c_name", F.lit("/")))
    return m.customer.select("c_custkey", CH.clean_tag(t).alias("tag"))


_RAW_TAGS = "list_concat(list_concat(tags, case when len(tags) > 0 then ['# ' || tags[1] || '!'] else [] end), list_concat(list_concat(aliases, string_split(title, ' ')), ['9', 'été', 'A/b', 'a/B', 'x--y', '-z_']))"


@query(f"+ r as (select id, {_RAW_TAGS} as raw from nodes), f as (select id, list_filter(list_transform(raw, lambda t: {_TAG.format(x='t')}), lambda t: regexp_matches(t, '[a-z]')) as kept from r) select id, coalesce(array_to_string(list_slice(list_filter(kept, lambda t, i: list_position(kept, t) = i), 1, 8), ','), '') as tags from f", "nodes")
def clean_tags(m):
    """The first eight distinct tags of a node's raw ones; many nodes have more, some repeat and some say nothing."""
    some = F.array(*[F.lit(t) for t in ("9", "été", "A/b", "a/B", "x--y", "-z_")])
    marked = F.transform(F.slice("tags", 1, 1), lambda t: F.concat(F.lit("# "), t, F.lit("!")))
    return m.nodes.select("id", F.array_join(CH.clean_tags(F.concat("tags", marked, "aliases", F.split("title", " "), some)), ",").alias("tags"))


_PLANES = ["Professional", "Personal", "Family", "Friends", "Health", "Ideas"]


@query("select id, array_to_string(list_filter(list_transform(list_concat(planes, ['none']), lambda p: case lower(trim(' ' || upper(p) || ' ')) " + " ".join(f"when '{p.lower()}' then '{p}'" for p in _PLANES) + " end), lambda p: p is not null), ',') as planes from nodes", "nodes")
def plane_canonical(m):
    """Every plane of a node in its configured spelling; unknown ones go."""
    names = F.create_map(*[F.lit(x) for p in _PLANES for x in (p.lower(), p)])
    raw = F.transform(F.concat("planes", F.array(F.lit("none"))), lambda p: F.concat(F.lit(" "), F.upper(p), F.lit(" ")))
    known = F.filter(F.transform(raw, lambda p: F.try_element_at(names, F.lower(F.trim(p)))), lambda p: p.isNotNull())
    return m.nodes.select("id", F.array_join(known, ",").alias("planes"))


@query("select id, coalesce(interiority, 'external') as interiority from nodes", "nodes")
def interiority_default(m):
    return m.nodes.select("id", F.coalesce("interiority", F.lit("external")).alias("interiority"))


@query("select o_orderkey, case o_orderkey % 4 when 0 then 'link' when 1 then 'new' when 2 then 'review' else 'review' end as outcome, case o_orderkey % 4 when 2 then 1.0 when 3 then 0.0 else 0.9 end as conf from orders")
def resolver_reply(m):
    """A reply {choice, conf} with the confidence clamped to [0, 1]; what can't be read is no choice at 0."""
    k = F.col("o_orderkey") % 4
    reply = F.when(k == 0, '{"choice": "n:1", "conf": 0.9}').when(k == 1, '{"choice": "new", "conf": 0.9}').when(k == 2, '{"choice": null, "conf": 7}').otherwise("no json")
    rows = m.orders.select("o_orderkey", F.from_json(CH.json_object(reply), "choice string, conf double").alias("r"))
    conf = F.least(F.greatest(F.coalesce("r.conf", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    sure = conf >= 0.8
    return rows.select("o_orderkey", F.when(sure & (F.col("r.choice") == "new"), "new").when(sure & F.col("r.choice").isNotNull(), "link").otherwise("review").alias("outcome"), conf.alias("conf"))


_VERDICT = "case item_id % 3 when 0 then 'agree' when 1 then 'maybe' else 'dismiss' end"


@query(f"select item_id, case when status not in ('pending', 'maybe') then status when v = 'maybe' then 'maybe' when kind in ('occurred', 'stance-candidate') and v = 'dismiss' then 'discarded' when kind = 'content-dedup' and v = 'dismiss' then 'resolved' when v = 'dismiss' then 'discarded' else 'resolved' end as status, case when status not in ('pending', 'maybe') then 'closed' end as error from (select *, {_VERDICT} as v from review_queue)", "review_queue")
def review_dispatch(m):
    """One verdict for each item: closed ones are refused, a doubtful one is parked, a kept pair counts as settled."""
    k = F.col("item_id") % 3
    v = F.when(k == 0, "agree").when(k == 1, "maybe").otherwise("dismiss")
    open_ = F.col("status").isin("pending", "maybe")
    new = F.when(~open_, F.col("status")).when(v == "maybe", "maybe").when((v == "dismiss") & (F.col("kind") != "content-dedup"), "discarded").otherwise("resolved")
    return m.review_queue.select("item_id", new.alias("status"), F.when(~open_, "closed").alias("error"))


@query("+ ask as (select event_id as item_id, 'discard' as action from events where event_id % 2 = 0) select a.item_id, case when r.item_id is null then 'missing' when r.status not in ('pending', 'maybe') then 'closed' end as error, case when r.status in ('pending', 'maybe') then 'discarded' else r.status end as status from ask a left join review_queue r on r.item_id = a.item_id", "review_queue")
def review_batch(m):
    asked = m.events.where("event_id % 2 = 0").select(F.col("event_id").alias("item_id"))
    rows = asked.join(m.review_queue.select("item_id", "status"), "item_id", "left")
    open_ = F.col("status").isin("pending", "maybe")
    return rows.select("item_id", F.when(F.col("status").isNull(), "missing").when(~open_, "closed").alias("error"), F.when(open_, "discarded").otherwise(F.col("status")).alias("status"))


@query("select item_id, kind from review_queue where coalesce(nullif(nullif(trim(' all '), ''), 'all'), status) = status", "review_queue")
def review_filter(m):
    """``all`` or blank is no filter."""
    from ..operators.records import status_filter

    return status_filter(m.review_queue, " all ").select("item_id", "kind")


@query("select src, string_agg(rel || '>' || dst, ',' order by rel, dst) as edges from (select distinct src, rel, dst from edges where rel = 'involves') group by 1", "edges")
def pending_edges_map(m):
    rows = m.edges.where("rel = 'involves'").select("src", F.concat("rel", F.lit(">"), "dst").alias("e"), "rel", "dst").distinct()
    return rows.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rel", "dst", "e"))).alias("x")).select("src", F.array_join("x.e", ",").alias("edges"))


@query("select src, dst, rel, coalesce(since, occurred_start, created_on) as since from edges join nodes on id = src where rel = 'involves'", "edges", "nodes")
def edges_since(m):
    own = m.nodes.select(F.col("id").alias("src"), F.coalesce("occurred_start", "created_on").alias("day"))
    return m.edges.where("rel = 'involves'").join(own, "src").select("src", "dst", "rel", F.coalesce("since", "day").alias("since"))


@query(f"select id, store_path from nodes where merged_into is null and type in {_TYPES} and id in (select dst from edges where rel = 'involves')", "nodes", "edges")
def store_paths_for(m):
    ids = m.edges.where("rel = 'involves'").select(F.col("dst").alias("id"))
    return G.live(m.nodes).where(F.col("type").isin(E.ENTITY_TYPES)).join(ids, "id", "left_semi").select("id", "store_path")


_QUOTED = """case conv_id % 5 when 0 then '"' || text || '"' when 1 then chr(10) || ' ''' || string_split(text, ' ')[1] || ' it''s '' ' when 2 then '"' || text when 3 then ' "' || string_split(text, ' ')[1] || '" ' || chr(10) || 'more' else '  ' end"""


@query(f"""+ s as (select conv_id, trim(string_split(trim({_QUOTED}, ' ' || chr(10)), chr(10))[1]) as line from conversations where turn = 0) select conv_id, trim(substring(case when length(line) >= 2 and line[1] in ('"', chr(39)) and line[1] = line[-1] then trim(substring(line, 2, length(line) - 2)) else line end, 1, 80)) as title from s""", "nodes")
def title_clean(m):
    """The first line without one pair of quotes around it, of 80 characters at most."""
    k, word = F.col("conv_id") % 5, F.split("text", " ")[0]
    said = F.when(k == 0, F.concat(F.lit('"'), "text", F.lit('"'))).when(k == 1, F.concat(F.lit("\n '"), word, F.lit(" it's ' "))).when(k == 2, F.concat(F.lit('"'), "text")).when(k == 3, F.concat(F.lit(' "'), word, F.lit('" \nmore'))).otherwise("  ")
    return m.conversations.where("turn = 0").select("conv_id", CH.clean_title(said, 80).alias("title"))


@query(r"+ t as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from documents) select doc_id, case when length(t) > 160 then rtrim(substring(t, 1, 160)) || '…' else t end as preview from t", "nodes")
def auto_snippet(m):
    """A preview of 160 characters, without a blank before its mark."""
    return m.documents.select("doc_id", C.snippet(C.collapse(F.col("text")), 160).alias("preview"))


@query("select id, replace(replace(replace(title, chr(92), chr(92) || chr(92)), '%', chr(92) || '%'), '_', chr(92) || '_') as pattern from nodes where type in ('person', 'place')", "nodes")
def like_escape(m):
    return m.nodes.where("type in ('person', 'place')").select("id", F.regexp_replace("title", r"([\\%_])", r"\\$1").alias("pattern"))


@query("with w as (select unnest(range(0, 31)) as d) select cast(date '2024-01-01' + cast(d as int) as date) as day, event_type, count(*) as n, round(sum(value), 4) as total from events, w where cast(ts as date) = date '2024-01-01' + cast(d as int) group by 1, 2")
def tumbling_windows(m):
    rows = m.events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.to_date("w.start").alias("day"), "event_type", "n", "total")


@query("select user_id, count(*) as sessions from (select user_id, case when lag(ts) over (partition by user_id order by ts) is null or ts - lag(ts) over (partition by user_id order by ts) >= interval 12 hour then 1 end as s from events) where s = 1 group by 1")
def idle_sessions(m):
    """Sessions that a gap of twelve hours ends."""
    w = F.session_window(F.col("ts").cast("timestamp"), "12 hours")
    return m.events.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"))

