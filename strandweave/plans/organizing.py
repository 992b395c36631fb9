"""Registered queries: a model's reply to a capture checked and taken apart, and times by kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import symbolic as SY
from ..operators import organizer as O
from .catalog import _far, query
from .records import _ago
from .times import _ENDS, _SAID

_VOCABULARY = O.Vocabulary(["memory", "idea", "insight", "conversation", "person", "place", "topic"], ["involves", "about", "at"], ["person", "place", "topic"], ["Health", "Ideas", "Family"], most_edges=2)
#: A reply in which a node may lack its title, types may be unknown or an entity's, and lists hold what they should not.
_REPLY = """'```json
{"nodes": [{"title": "' || case when event_id % 4 = 0 then ' ' else ' Day ' || cast(event_id as string) || ' ' end || '", "body": "It was yesterday, then 3 weeks ago; once.", "type": "' || case event_id % 3 when 0 then 'Insight' when 1 then 'PERSON' else 'alien' || cast(event_id % 5 as string) end
|| '", "plane": " HEALTH ", "planes": ["ideas", "none", 7, "Health"], "tags": ["# Big Day", "big-day", "9", 4, "Calm/x"], "interiority": "Mixed", "parts": [1, "2", 5, true, 1], "time_refs": [{"kind": "relative", "unit": "day", "offset": -1, "phrase": "yesterday", "event": true}, {"kind": "relative", "unit": "week", "offset": "-3", "phrase": "3 weeks ago"}, {"kind": "never", "phrase": "once"}, {"kind": "relative", "unit": "day", "offset": 0, "phrase": "once", "odd": 1}],
"entities": [{"name": " Ann ' || cast(event_id % 9 as string) || ' ", "type": "Person", "rel": "Involves", "disambig": " kin "}, {"name": "Mars", "type": "planet", "rel": "at"}, {"name": "Bob", "type": "person", "rel": "hates"}, {"name": "", "type": "person", "rel": "at"}, {"name": "Oslo", "type": "place", "rel": "at", "disambig": 3}, {"name": "Late", "type": "late", "rel": "at"}]},
{"title": "Feeling", "body": " low ", "interiority": "internal", "arose_from": 0}, {"title": 5, "body": "x"}, {"title": "Self", "body": "c", "type": "", "arose_from": "3", "tags": "none"}]}
```'"""
_CAPTURED = "c as (select event_id, cast(ts as date) as day from events where event_type in ('signup', 'purchase'))"


def _validated(m):
    replies = m.events.where("event_type in ('signup', 'purchase')").select(F.col("event_id").alias("capture_id"), F.expr(_REPLY).alias("reply"), F.to_date("ts").alias("anchor"), F.lit(2).alias("n_parts"))
    return O.validated(replies, _VOCABULARY)


@query(
    f"""+ {_CAPTURED} select event_id as capture_id, 0 as pos, 'Day ' || cast(event_id as varchar) as title, case when event_id % 3 = 0 then 'insight' else 'memory' end as type, event_id % 3 = 1 as coerced, 'Health' as plane, 'Health,Ideas' as planes, 'big-day,calm/x' as tags,
  'It was [[t:' || cast(day - 1 as varchar) || ']], then [[t:' || cast(day - 21 as varchar) || ']]; once.' as body, cast(day - 1 as varchar) as occurred, null as occurred_end, 'mixed' as interiority, '1,2' as parts, null as arose_from from c where event_id % 4 <> 0
  union all select event_id, case when event_id % 4 = 0 then 0 else 1 end, 'Feeling', 'memory', false, null, '', '', 'low', null, null, 'internal', '', case when event_id % 4 <> 0 then 0 end from c
  union all select event_id, case when event_id % 4 = 0 then 1 else 2 end, 'Self', 'memory', false, null, '', '', 'c', null, null, 'external', '', null from c""",
    "captures",
)
def organizer_validate(m):
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return _validated(m)[0].select("capture_id", "pos", "title", "type", "coerced", "plane", joined("planes"), joined("tags"), "body", "occurred", "occurred_end", "interiority", joined("parts"), "arose_from")


@query(f"+ {_CAPTURED} select event_id as capture_id, 0 as pos, 0 as place, 'Ann ' || cast(event_id % 9 as varchar) as name, 'person' as type, 'involves' as rel, 'kin' as disambig from c where event_id % 4 <> 0 union all select event_id, 0, 1, 'Oslo', 'place', 'at', null from c where event_id % 4 <> 0", "captures")
def organizer_mentions(m):
    return _validated(m)[1]


@query(f"+ {_CAPTURED} select event_id as capture_id, unnest(['entity_type', 'edge_rel']) as vocab, unnest(['planet', 'hates']) as value from c where event_id % 4 <> 0 union all select event_id, 'node_type', 'alien' || cast(event_id % 5 as varchar) from c where event_id % 4 <> 0 and event_id % 3 = 2", "captures")
def organizer_proposals(m):
    return _validated(m)[2]


_DAY = "cast(o_orderdate as date)"
_M = "cast(o_orderkey % 12 + 1 as int)"
_W = "cast(o_orderkey % 7 as int)"
_REF = """case o_orderkey % 8 when 0 then '{"kind": "relative", "unit": "month", "offset": -' || cast(o_orderkey % 30 as string) || ', "phrase": "p"}'
  when 1 then '{"kind": "weekday", "weekday": "' || elt(cast(o_orderkey % 7 as int) + 1, 'Monday', 'tues', 'wed', 'Thurs', 'fri', 'saturday', 'sun') || '", "phrase": "p"}' when 2 then '{"kind": "month", "month": "' || cast(o_orderkey % 12 + 1 as string) || '", "direction": "next", "phrase": "p"}'
  when 3 then '{"kind": "season", "season": "Fall", "year_offset": -1, "phrase": "p"}' when 4 then '{"kind": "explicit", "year": ' || cast(1990 + o_orderkey % 20 as string) || ', "month": 2, "day": 29, "hour": 7, "phrase": "p"}'
  when 5 then '{"kind": "weekday", "weekday": "mon", "direction": null, "phrase": "p"}' when 6 then '{"kind": "relative", "unit": "day", "offset": 1, "phrase": "p", "extra": 1}' else '{"kind": "explicit", "month": ' || cast(o_orderkey % 12 + 1 as string) || ', "phrase": "p"}' end"""


@query(
    f"""select o_orderkey, case k when 0 then strftime(date_trunc('month', {_DAY}) - to_months(cast(o_orderkey % 30 as int)), '%Y-%m') when 1 then strftime({_DAY} - cast((isodow({_DAY}) - 1 - {_W} + 6) % 7 + 1 as int), '%Y-%m-%d')
  when 2 then cast(year({_DAY}) + case when {_M} > month({_DAY}) then 0 else 1 end as varchar) || '-' || lpad(cast({_M} as varchar), 2, '0') when 3 then cast(year({_DAY}) - 1 as varchar) || '-09' when 4 then case when (1990 + o_orderkey % 20) % 4 = 0 then cast(1990 + o_orderkey % 20 as varchar) || '-02-29' end
  when 7 then cast(year({_DAY}) - case when {_M} <= month({_DAY}) then 0 else 1 end as varchar) || '-' || lpad(cast({_M} as varchar), 2, '0') end as start, case when k = 3 then cast(year({_DAY}) - 1 as varchar) || '-11' end as end, case when k = 3 then 'autumn ' || cast(year({_DAY}) - 1 as varchar) end as label, k not in (5, 6) as valid
  from (select *, o_orderkey % 8 as k from orders)"""
)
def symbolic_validate(m):
    """References of every kind against the order's day; those with a null direction or an unknown key are refused."""
    found = m.orders.select("o_orderkey", SY.resolve(F.expr(_REF), F.to_date("o_orderdate")).alias("r"))
    return found.select("o_orderkey", "r.start", "r.end", "r.label", "r.valid")


_NOW = "date '2024-12-31'"
_MONTHS = f"((year(first) * 12 + month(first)) - (year({_NOW}) * 12 + month({_NOW})))"
_YEARS = f"(year(first) - year({_NOW}))"
_FAR = f"""case when length(a) = 4 then case {_YEARS} when 0 then 'this year' when -1 then 'last year' when 1 then 'next year' else {_ago(f'abs({_YEARS})', 'year', _YEARS)} end
  when length(a) = 7 then case {_MONTHS} when 0 then 'this month' when -1 then 'last month' when 1 then 'next month' else case when abs({_MONTHS}) < 12 then {_ago(f'abs({_MONTHS})', 'month', _MONTHS)} else {_ago(f'cast(floor(abs({_MONTHS}) / 12.0::double + 0.5) as int)', 'year', _MONTHS)} end end else {_far('first', _NOW)} end"""


def _body(said: str) -> str:
    shown = f"{_ENDS}, said as (select node_id, k, case when label is not null or b is not null then {_SAID} else {said} end as said from good union all select node_id, k, coalesce(label, x) from parsed where first is null or b is not null and bfirst is null)"
    return f"{shown} select node_id, 'Met ' || max(said) filter (where k = 1) || ' then ' || max(said) filter (where k = 2) || ', ' || max(said) filter (where k = 3) || ' end' as body from said group by 1"


@query(_body(_FAR), "bodies")
def render_relative(m):
    """Bodies as they are shown: points of time as they lie from today."""
    now = F.to_date(F.lit("2024-12-31"))
    return m.bodies.select("node_id", D.expand(F.col("body"), lambda t: D.relative_text(t, now)).alias("body"))


@query(_body(f"{_SAID} || ' (' || {_FAR} || ')'"), "bodies")
def expand_body_llm(m):
    """Bodies as a model reads them: absolute words, points with how far they lie back."""
    now = F.to_date(F.lit("2024-12-31"))
    return m.bodies.select("node_id", D.expand(F.col("body"), lambda t: D.dated_text(t, now)).alias("body"))
