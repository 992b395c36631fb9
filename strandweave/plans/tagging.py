"""Registered queries: plans to merge tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tagplans as TP
from .catalog import query

_PLAN = "o_orderkey % 600"
_POS = "cast(floor(o_orderkey / 600) as int)"
_TAGS = "'T' || cast(o_custkey % 40 as varchar) || 'x'", "'# t' || cast(o_orderkey % 37 as varchar) || 'X'", "'t' || cast(o_custkey % 23 as varchar) || '-x!'", "'t' || cast(o_orderkey % 31 as varchar) || 'x'", "'99'"
_SLUGS = "'t' || cast(o_custkey % 40 as varchar) || 'x'", "'t' || cast(o_orderkey % 37 as varchar) || 'x'", "'t' || cast(o_custkey % 23 as varchar) || '-x'", "'t' || cast(o_orderkey % 31 as varchar) || 'x'"
_MERGES = f"g as (select {_PLAN} as plan_id, row_number() over (partition by {_PLAN} order by o_orderkey) as step, {_POS} as pos, {_SLUGS[0]} as given, [{', '.join(_SLUGS)}] as raw from orders), gd as (select *, list_filter(raw, lambda t, i: list_position(raw, t) = i) as tags from g)"
_GREEDY = f"""{_MERGES}, st as (select distinct plan_id, cast(0 as bigint) as step, cast(null as int) as pos, cast(null as varchar) as given, cast([] as varchar[]) as seen, cast([] as varchar[]) as kept from gd
  union all select st.plan_id, gd.step, gd.pos, gd.given, case when len(list_filter(tags, lambda t: not list_contains(seen, t))) >= 2 then list_concat(seen, list_filter(tags, lambda t: not list_contains(seen, t))) else seen end, list_filter(tags, lambda t: not list_contains(seen, t)) from st join gd on gd.plan_id = st.plan_id and gd.step = st.step + 1),
kept as (select plan_id, pos, kept, case when list_contains(kept, given) then given else list_sort(list_transform(kept, lambda t: lpad(cast(length(t) as varchar), 3, '0') || t))[1][4:] end as canonical from st where len(kept) >= 2)"""


def _merges(m):
    tags = [F.expr(t.replace("varchar", "string")) for t in _TAGS]
    return m.orders.select(F.expr(_PLAN).alias("plan_id"), F.expr(_POS).alias("pos"), tags[0].alias("canonical"), F.array(*tags[1:]).alias("variants"))


@query(f"+ {_GREEDY} select plan_id, pos, canonical, array_to_string(list_filter(kept, lambda t: t <> canonical), ',') as variants from kept", "nodes")
def tag_merge_plan(m):
    """Merges of several plans made disjoint: of those that want a tag the first that stays has it."""
    return TP.disjoint(_merges(m)).withColumn("variants", F.array_join("variants", ","))


_REPLY = """case o_orderkey % 4 when 0 then 'no plan' when 1 then '{"merges": 4}' else 'Here:
```json
{"merges": [{"canonical": "a' || cast(o_orderkey % 9 as string) || '", "variants": ["b", 3, "c d"]}, {"canonical": 7, "variants": []}, "x", {"canonical": "e", "variants": "f"}, {"canonical": "e", "variants": []}]}
```' end"""


@query("select o_orderkey as plan_id, 0 as pos, 'a' || cast(o_orderkey % 9 as varchar) as canonical, 'b,c d' as variants from orders where o_orderkey % 4 > 1 union all select o_orderkey, 4, 'e', '' from orders where o_orderkey % 4 > 1")
def plan_parse(m):
    replies = m.orders.select(F.col("o_orderkey").alias("plan_id"), F.expr(_REPLY).alias("reply"))
    return TP.parsed(replies).withColumn("variants", F.array_join("variants", ","))


_NAMES = [("en", "english"), ("fr", "english"), ("web", "quoted"), ("de", "web, too"), ("none", "x")]
_NEW = "list_transform([lang, coalesce(source, '') || ', quoted'], lambda t: case t " + " ".join(f"when '{a}' then '{b}'" for a, b in _NAMES) + " else t end)"


@query(
    f"+ t as (select path, content, lang, coalesce(source, '') as source, {_NEW} as new from notes join documents using (doc_id)) select path, sha256(replace(content, 'tags: [' || lang || ', \"' || source || ', quoted\"]', 'tags: [' || list_transform(new, lambda t: case when regexp_full_match(t, '[A-Za-z0-9_-]+') then t else '\"' || t || '\"' end)[1] || ', \"' || new[2] || '\"]')) as content_hash from t where new[1] <> lang",
    "notes",
)
def tags_rewrite(m):
    """Files whose tags change under a plan's mapping; nothing else in them does."""
    names = m.spark.createDataFrame(_NAMES, "tag string, canonical string")
    return TP.rewritten(m.notes, names).select("path", F.sha2("content", 256).alias("content_hash"))
