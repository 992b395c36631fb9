"""Graph health, review items, the activity feed, conversations and temporal references."""

from __future__ import annotations

import base64
import datetime as dt
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .entities import ENTITY_TYPES, endpoints
from .graph import live


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Live nodes outside the inbox that no canonical edge touches."""
    canon = edges.where("origin = 'canonical'")
    touched = canon.select(F.col("src").alias("id")).union(canon.select("dst"))
    return live(nodes).where("store_path not like 'inbox/%'").join(touched, "id", "left_anti").select("id", "type")


def dangling_tombstones(nodes: DataFrame) -> DataFrame:
    """Nodes that were merged into one that isn't there."""
    there = nodes.select(F.col("id").alias("merged_into"))
    return nodes.where("merged_into is not null").join(there, "merged_into", "left_anti").select("id", "merged_into")


FINDINGS = ["orphans", "inbox", "review-aging", "missing-occurred", "alias-less", "tombstones", "stale-hubs"]


def health(nodes: DataFrame, touched: DataFrame, ends: DataFrame, review: DataFrame, today: str, aging_days: int = 14, stale_days: int = 365) -> DataFrame:
    """(finding, n, flagged): one row a finding, also where nothing was found.

    A hub is stale if the newest date of its canonical edges to live nodes (the edge's, else the other end's) lies more than
    ``stale_days`` back; one without any date is not.  Nodes are read once: that something touches them (``touched``: id, once each) and their newest date join
    them, and every rule is a condition on the row.
    """
    touch = touched.select("id", F.lit(True).alias("touched"))
    newest = ends.where("origin = 'canonical'").groupBy(F.col("center").alias("id")).agg(F.max(F.coalesce("since", "occurred_start")).alias("newest"))
    rows = nodes.join(touch, "id", "left").join(newest, "id", "left")
    alive, inbox, hub = F.col("merged_into").isNull(), F.col("store_path").startswith("inbox/"), F.col("type").isin(ENTITY_TYPES)
    rules = {
        "orphans": alive & ~inbox & F.col("touched").isNull(),
        "inbox": alive & inbox,
        "missing-occurred": alive & (F.col("type") == "memory") & F.col("occurred_start").isNull(),
        "alias-less": alive & hub & (F.size("aliases") == 0),
        "stale-hubs": alive & hub & (F.col("newest") < F.date_sub(F.to_date(F.lit(today)), stale_days)),
    }
    counts = rows.agg(*[F.count_if(c).alias(k) for k, c in rules.items()])
    old = F.datediff(F.to_date(F.lit(today)), F.col("created_on")) > aging_days
    aging = review.agg(F.count_if(F.col("status").isin("pending", "maybe") & old).alias("review-aging"))
    lost = dangling_tombstones(nodes).agg(F.count("*").alias("tombstones"))
    one = counts.crossJoin(aging).crossJoin(lost)  # one row each
    listed = F.explode(F.array(*[F.struct(F.lit(k).alias("finding"), F.col(f"`{k}`").alias("n")) for k in FINDINGS])).alias("f")
    return one.select(listed).select("f.finding", "f.n", (F.col("f.n") > 0).alias("flagged"))


#: Categories and kinds of what happened, letters of a preview, rows of a page.
CATEGORIES = {"agents": "agents_jobs", "manual": "manual_actions", "captures": "captures"}
KINDS = {"run": "agent_run", "capture": "capture", "review": "review_verdict"}
PREVIEW, PAGE, MOST_PAGE = 280, 50, 100


class BadCursor(ValueError):
    """No cursor of this feed."""


def feed(runs: DataFrame, captures: DataFrame, review: DataFrame) -> DataFrame:
    """(id, category, kind, ts, title, snippet, ref, parent_ref, status, source): parentless runs (run_id, trigger_name,
    started_at, agent, summary, status), captures that remain (capture_id, created_at, raw_text, source_ref, status, source,
    kind), settled review items (item_id, resolved_at, kind, excerpt, status)."""
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    short = lambda c: F.substring(c, 1, PREVIEW)
    category = F.when(F.col("trigger_name") == "manual", CATEGORIES["manual"]).otherwise(CATEGORIES["agents"])
    names = ["id", "category", "kind", "ts", "title", "snippet", "ref", "parent_ref", "status", "source"]
    r = runs.where("parent_run_id is null").select(text("run_id"), category, F.lit(KINDS["run"]), "started_at", "agent", short("summary"), text("run_id"), none, "status", none).toDF(*names)
    c = captures.where("not removed").select(text("capture_id"), F.lit(CATEGORIES["captures"]), F.lit(KINDS["capture"]), "created_at", none, short("raw_text"), text("source_ref"), none, "status", F.coalesce("source", "kind"))
    v = review.where("resolved_at is not null").select(text("item_id"), F.lit(CATEGORIES["manual"]), F.lit(KINDS["review"]), "resolved_at", "kind", short("excerpt"), text("item_id"), none, "status", none)
    return r.union(c).union(v)


def feed_page(rows: DataFrame, size: int, cursor: tuple[str, str] | None = None) -> DataFrame:
    """Newest first, and one row more; the cursor is the last row's (ts, id)."""
    if cursor:
        ts = F.lit(cursor[0]).cast(rows.schema["ts"].dataType)
        rows = rows.where((F.col("ts") < ts) | (F.col("ts") == ts) & (F.col("id") < cursor[1]))
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(size + 1)


def encoded(ts: dt.datetime, ident: str) -> str:
    return base64.urlsafe_b64encode(json.dumps([ts.isoformat(), ident], separators=(",", ":")).encode()).decode("ascii")


def decoded(cursor: str) -> tuple[str, str]:
    """(ts, id) of a cursor; raises :class:`BadCursor` for any other text."""
    try:
        ts, ident = json.loads(base64.urlsafe_b64decode(cursor.encode("ascii")))
        if not isinstance(ident, str):
            raise BadCursor(cursor)
        return dt.datetime.fromisoformat(ts).isoformat(sep=" "), ident
    except (ValueError, TypeError, UnicodeError) as error:
        raise BadCursor(cursor) from error


def read_feed(rows: DataFrame, category: str | None = None, before: str | None = None, limit: int | None = None) -> tuple[list, str | None]:
    """(rows of a page, cursor of the next or null): of one category or all, ``limit`` clamped to 1 to ``MOST_PAGE``.  A page
    is what one reader sees, so its rows come to the driver."""
    size = PAGE if limit is None else max(1, min(limit, MOST_PAGE))
    if category is not None:
        rows = rows.where(F.col("category") == category)
    found = feed_page(rows, size, None if before is None else decoded(before)).collect()
    page = found[:size]
    return page, encoded(page[-1].ts, page[-1].id) if len(found) > size else None


def distillable(messages: DataFrame, marks: DataFrame, before: int) -> DataFrame:
    """(session_id, newest): sessions idle since ``before`` with something newer than their watermark."""
    newest = messages.groupBy("session_id").agg(F.max("at_minute").alias("newest")).where(F.col("newest") < before)
    return newest.join(marks, "session_id", "left").where("mark is null or newest > mark").select("session_id", "newest")


def delta(messages: DataFrame, marks: DataFrame, most: int) -> DataFrame:
    """A session's oldest ``most`` messages strictly after its watermark."""
    new = messages.join(marks, "session_id", "left").where("mark is null or at_minute > mark")
    w = Window.partitionBy("session_id").orderBy("at_minute", "turn")
    return new.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("mark")


def transcripts(rows: DataFrame) -> DataFrame:
    """(session_id, n, transcript) of delta messages in order."""
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.col("content"))
    packed = rows.groupBy("session_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("at_minute", "turn", line.alias("line")))).alias("lines"))
    return packed.select("session_id", "n", F.array_join("lines.line", "\n").alias("transcript"))


def last_n(messages: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy(F.desc("at_minute"), F.desc("turn"))
    return messages.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


# temporal references: (anchor date, offset or name) to days


def weekday_of(anchor: Column, weekday: int, which: str) -> Column:
    """Last (strictly before), next (strictly after) or this week's (Monday first) ``weekday`` (Monday: 0)."""
    ahead = F.pmod(F.lit(weekday) - F.weekday(anchor), F.lit(7))
    if which == "this":
        return F.date_add(anchor, (F.lit(weekday) - F.weekday(anchor)).cast("int"))
    if which == "next":
        return F.date_add(anchor, F.when(ahead == 0, 7).otherwise(ahead).cast("int"))
    return F.date_sub(anchor, F.when(ahead == 0, 7).otherwise(7 - ahead).cast("int"))


SEASONS = {"spring": 3, "summer": 6, "autumn": 9, "winter": 12}  #: first month of each season


def season_named(year: Column, place: Column) -> tuple[Column, Column]:
    """(first, last) day of a year's season, by its place in :data:`SEASONS`."""
    first = F.make_date(year, place * 3 + 3, F.lit(1))
    return first, F.last_day(F.add_months(first, 2))


def explicit_day(anchor: Column, month: Column, day: Column, back: int = 8) -> Column:
    """The latest real ``day`` of ``month`` at or before ``anchor``, within ``back`` years; else null."""
    years = F.sequence(F.year(anchor) - back, F.year(anchor))
    real = F.filter(F.transform(years, lambda y: F.when(day <= F.day(F.last_day(F.make_date(y, month, F.lit(1)))), F.date_add(F.make_date(y, month, F.lit(1)), day - 1))), lambda d: d.isNotNull() & (d <= anchor))
    return F.when(F.size(real) > 0, F.array_max(real))


def month_named(anchor: Column, month: Column, which: str) -> Column:
    """First day of last (this one included), this year's or next ``month``."""
    shift = {"last": F.when(month <= F.month(anchor), 0).otherwise(-1), "next": F.when(month > F.month(anchor), 0).otherwise(1), "this": F.lit(0)}[which]
    return F.make_date(F.year(anchor) + shift, month, F.lit(1))


def splice(body: Column, phrases: dict[str, str]) -> Column:
    """``body`` with the first occurrence of each phrase as a token; where phrases overlap the longest stays."""
    longest = sorted(phrases, key=lambda p: (-len(p), p))

    def spliced(text: str | None) -> str | None:
        if text is None:
            return None
        taken: list[tuple[int, int, str]] = []
        for p in longest:
            at = text.find(p)
            while at >= 0 and any(s < at + len(p) and at < e for s, e, _ in taken):
                at = text.find(p, at + 1)
            if at >= 0:
                taken.append((at, at + len(p), p))
        for s, e, p in sorted(taken, reverse=True):
            text = f"{text[:s]}[[t:{phrases[p]}|{p}]]{text[e:]}"
        return text

    @F.pandas_udf(StringType())
    def put(texts: pd.Series) -> pd.Series:
        return texts.map(spliced)

    return put(body)
