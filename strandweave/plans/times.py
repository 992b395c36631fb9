"""Registered queries: partial dates, time tokens in text, references to dates, headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import dates as D
from ..operators import activity as A
from .catalog import _far, query

_MONTH = "['" + "', '".join(D.MONTHS) + "']"
_TODAY = "date '2024-12-31'"
_TOKS = r"+ toks as (select node_id, k, regexp_extract_all(body, '\[\[t:(.*?)\]\]', 1)[k] as x from bodies, (select unnest([1, 2, 3]) as k)), split as (select node_id, k, x, string_split(x, '|')[1] as dates, nullif(trim(string_split(x, '|')[2]), '') as label from toks)"
_PART = r"try_cast(case when length({x}) = 4 then {x} || '-01-01' when length({x}) = 7 then {x} || '-01' else substring({x}, 1, 10) end as date)"
_ENDS = f"""{_TOKS}, ends as (select *, string_split(dates, '/')[1] as a, case when dates like '%/%' then string_split(dates, '/')[2] end as b from split),
parsed as (select *, {_PART.format(x='a')} as first, {_PART.format(x='b')} as bfirst from ends), good as (select * from parsed where first is not null and (b is null or bfirst is not null))"""
_CEIL = "case when length({x}) = 4 then cast(substring({x}, 1, 4) || '-12-31' as date) when length({x}) = 7 then last_day({d}) else {d} end"


def _words(x: str, d: str) -> str:
    month = f"{_MONTH}[month({d})] || ' ' || year({d})"
    return f"case when length({x}) = 4 then cast(year({d}) as varchar) when length({x}) = 7 then {month} else day({d}) || ' ' || {month} || case when length({x}) = 16 then ', ' || substring({x}, 12, 5) else '' end end"


_SAID = f"case when label is not null then label when b is not null then {_words('a', 'first')} || ' – ' || {_words('b', 'bfirst')} else {_words('a', 'first')} end"


def _tokens(m):
    found = F.regexp_extract_all("body", F.lit(D.TOKEN), F.lit(1))
    rows = m.bodies.select("node_id", F.posexplode(found).alias("k", "x"))
    return rows.select("node_id", (F.col("k") + 1).alias("k"), "x", D.inner(F.col("x")).alias("t"))


@query(f"{_ENDS} select node_id, k, a as starts, b as ends, label from good", "bodies")
def token_parse(m):
    t = _tokens(m).where("t is not null")
    return t.select("node_id", "k", D.iso(F.col("t.start")).alias("starts"), F.when(F.col("t.end").isNotNull(), D.iso(F.col("t.end"))).alias("ends"), "t.label")


@query(f"{_ENDS} select node_id, k, first, case when b is not null then {_CEIL.format(x='b', d='bfirst')} when length(a) <= 7 then {_CEIL.format(x='a', d='first')} end as last from good", "bodies")
def occurred_from_token(m):
    first, last = D.occurred(F.col("t"))
    return _tokens(m).where("t is not null").select("node_id", "k", first.alias("first"), last.alias("last"))


@query(f"{_ENDS} select node_id, k, first as floor_day, {_CEIL.format(x='a', d='first')} as ceil_day from good", "bodies")
def partial_parse(m):
    p = D.partial(F.substring_index(F.substring_index("x", "|", 1), "/", 1))
    return _tokens(m).where("t is not null").select("node_id", "k", D.floor_day(p).alias("floor_day"), D.ceil_day(p).alias("ceil_day"))


@query(f"{_ENDS} select node_id, k, {_SAID} as said from good", "bodies")
def render_absolute(m):
    return _tokens(m).where("t is not null").select("node_id", "k", D.token_text(F.col("t")).alias("said"))


_SHOWN = f"{_ENDS}, said as (select node_id, k, {_SAID} as said from good union all select node_id, k, coalesce(label, x) from parsed where first is null or b is not null and bfirst is null)"


@query(f"{_SHOWN} select node_id, 'Met ' || max(said) filter (where k = 1) || ' then ' || max(said) filter (where k = 2) || ', ' || max(said) filter (where k = 3) || ' end' as body from said group by 1", "bodies")
def expand_body(m):
    return m.bodies.select("node_id", D.expand(F.col("body"), D.token_text).alias("body"))


def _spelled(d: str) -> str:
    return f"day({d}) || ' ' || {_MONTH}[month({d})] || ' ' || year({d})"


@query(f"select id, 'recorded ' || {_spelled('created_on')} || ' (' || {_far('created_on', _TODAY)} || ') · occurred ' || case when occurred_start is null then 'unknown' when occurred_end is not null and occurred_end <> occurred_start then {_spelled('occurred_start')} || ' – ' || {_spelled('occurred_end')} else {_spelled('occurred_start')} end as header from nodes", "nodes")
def temporal_header(m):
    """When a node was recorded, how long ago that is, and when it occurred."""
    ago = C.humanize_days(F.datediff("created_on", F.to_date(F.lit("2024-12-31"))))
    return m.nodes.select("id", F.concat(F.lit("recorded "), D.spelled(F.col("created_on")), F.lit(" ("), ago, F.lit(") · occurred "), D.span(F.col("occurred_start"), F.col("occurred_end"))).alias("header"))


_KEY = "o_orderkey % 12 + 1"


@query(f"select o_orderkey, max(try_cast(y || '-' || lpad(cast({_KEY} as varchar), 2, '0') || '-' || lpad(cast(o_orderkey % 31 + 1 as varchar), 2, '0') as date)) as day from orders, (select unnest(range(0, 9)) as back), lateral (select cast(year(o_orderdate) - back as varchar) as y) where try_cast(y || '-' || lpad(cast({_KEY} as varchar), 2, '0') || '-' || lpad(cast(o_orderkey % 31 + 1 as varchar), 2, '0') as date) <= cast(o_orderdate as date) group by 1")
def resolve_explicit(m):
    d = F.to_date("o_orderdate")
    day = A.explicit_day(d, (F.col("o_orderkey") % 12 + 1).cast("int"), (F.col("o_orderkey") % 31 + 1).cast("int"))
    return m.orders.select("o_orderkey", day.alias("day")).where("day is not null")


@query(f"select o_orderkey, year(o_orderdate) - case when {_KEY} <= month(o_orderdate) then 0 else 1 end as last_year, year(o_orderdate) + case when {_KEY} > month(o_orderdate) then 0 else 1 end as next_year, make_date(year(o_orderdate), cast({_KEY} as int), 1) as this_month from orders")
def resolve_month(m):
    d, k = F.to_date("o_orderdate"), (F.col("o_orderkey") % 12 + 1).cast("int")
    return m.orders.select("o_orderkey", *[F.year(A.month_named(d, k, w)).cast("long").alias(f"{w}_year") for w in ("last", "next")], A.month_named(d, k, "this").alias("this_month"))


@query(f"select o_orderkey, o as offset_years, make_date(cast(year(o_orderdate) + o as int), cast(o_orderkey % 4 * 3 + 3 as int), 1) as first, last_day(cast(make_date(cast(year(o_orderdate) + o as int), cast(o_orderkey % 4 * 3 + 3 as int), 1) + interval 2 month as date)) as last, case o_orderkey % 4 when 0 then 'spring' when 1 then 'summer' when 2 then 'autumn' else 'winter' end || ' ' || (year(o_orderdate) + o) as label from orders, (select unnest([-1, 0, 1]) as o)")
def resolve_season(m):
    """A season of last, this or next year; winter ends in the year after its own."""
    rows = m.orders.withColumn("offset_years", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    year, k = F.year(F.to_date("o_orderdate")) + F.col("offset_years"), (F.col("o_orderkey") % 4).cast("int")
    first, last = A.season_named(year, k)
    return rows.select("o_orderkey", "offset_years", first.alias("first"), last.alias("last"), F.concat(F.element_at(F.array(*map(F.lit, A.SEASONS)), k + 1), F.lit(" "), year.cast("string")).alias("label"))


@query(f"{_ENDS} select body.node_id, replace(body, '[[t:' || x || ']]', '[[t:2020-01-01]]') as body, a = cast(recorded as varchar) as moves from good join bodies body on body.node_id = good.node_id where k = 1", "bodies")
def date_token_edit(m):
    """The first token replaced; the event's date moves with it where the token was that date."""
    token = F.regexp_extract("body", D.TOKEN, 1)
    edited = F.replace("body", F.concat(F.lit("[[t:"), token, F.lit("]]")), F.lit("[[t:2020-01-01]]"))
    return m.bodies.select("node_id", edited.alias("body"), (F.substring_index(F.substring_index(token, "|", 1), "/", 1) == F.col("recorded").cast("string")).alias("moves"))


@query(r"+ spans as (select node_id, strpos(body, 'Met') as p, strpos(body, 'then') as q, body from bodies) select node_id, replace(replace(body, 'Met ', '[[t:2024-01-01|Met]] '), ' then ', ' [[t:2024-01-02|then]] ') as body from spans", "bodies")
def splice_tokens(m):
    phrases = {"Met": "2024-01-01", "then": "2024-01-02", "hen": "2024-01-03", "absent": "2024-01-04"}
    return m.bodies.select("node_id", A.splice(F.col("body"), phrases).alias("body"))
