"""Partial dates (year, month, day or minute) and time tokens in text, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import humanize_days, humanize_months, humanize_years

#: How partial dates and tokens are written in files.
PARTIAL = r"^(\d{4})(?:-(\d{2})(?:-(\d{2})(?:T(\d{2}):(\d{2}))?)?)?$"
TOKEN = r"\[\[t:(.*?)\]\]"
MONTHS = "January February March April May June July August September October November December".split()


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _part(x: Column, k: int) -> Column:
    return F.nullif(F.regexp_extract(F.trim(x), PARTIAL, k), F.lit("")).cast("int")


def partial(x: Column) -> Column:
    """(year, month, day, hour, minute) of a partial ISO date; null if it is malformed or no real date."""

    def checked(p: Column) -> Column:
        first = F.make_date(F.greatest(p["year"], F.lit(1)), F.coalesce(F.when(p["month"].between(1, 12), p["month"]), F.lit(1)), F.lit(1))
        real = [p["month"].isNull() | p["month"].between(1, 12), p["day"].isNull() | p["day"].between(1, F.day(F.last_day(first))), p["hour"].isNull() | p["hour"].between(0, 23), p["minute"].isNull() | p["minute"].between(0, 59)]
        return F.when((p["year"] >= 1) & real[0] & real[1] & real[2] & real[3], p)

    return let(F.struct(*[_part(x, k).alias(n) for k, n in enumerate(("year", "month", "day", "hour", "minute"), 1)]), checked)


def floor_day(p: Column) -> Column:
    return F.when(p.isNotNull(), F.make_date(p["year"], F.coalesce(p["month"], F.lit(1)), F.coalesce(p["day"], F.lit(1))))


def ceil_day(p: Column) -> Column:
    day = floor_day(p)
    return F.when(p["day"].isNotNull(), day).when(p["month"].isNotNull(), F.last_day(day)).otherwise(F.make_date(p["year"], F.lit(12), F.lit(31)))


def iso(p: Column) -> Column:
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    day = F.concat_ws("-", F.lpad(p["year"].cast("string"), 4, "0"), two(p["month"]), two(p["day"]))
    return F.when(p["hour"].isNotNull() & p["minute"].isNotNull(), F.concat(day, F.lit("T"), two(p["hour"]), F.lit(":"), two(p["minute"]))).otherwise(day)


def absolute(p: Column) -> Column:
    """In words: 2025, July 2025, 7 July 2025, or that with the time."""
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.coalesce(p["month"], F.lit(1)))
    day = F.concat_ws(" ", p["day"].cast("string"), F.when(p["month"].isNotNull(), month), p["year"].cast("string"))
    time = F.concat(day, F.lit(", "), F.lpad(p["hour"].cast("string"), 2, "0"), F.lit(":"), F.lpad(p["minute"].cast("string"), 2, "0"))
    return F.when(p["minute"].isNotNull(), time).otherwise(day)


def spelled(day: Column) -> Column:
    return F.concat_ws(" ", F.day(day).cast("string"), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day)), F.year(day).cast("string"))


def span(start: Column, end: Column) -> Column:
    both = end.isNotNull() & (end != start)
    return F.when(start.isNull(), "unknown").when(both, F.concat(spelled(start), F.lit(" – "), spelled(end))).otherwise(spelled(start))


def inner(x: Column) -> Column:
    """(start, end, label) of a token's inside; null where the start, or an end that is announced, is no date."""
    dates = F.substring_index(x, "|", 1)
    label = F.when(F.contains(x, F.lit("|")), F.nullif(F.trim(F.regexp_replace(x, r"(?s)^[^|]*\|", "")), F.lit("")))
    ranged = F.contains(dates, F.lit("/"))
    end = F.when(ranged, partial(F.regexp_replace(dates, r"(?s)^[^/]*/", "")))
    parts = F.struct(partial(F.substring_index(dates, "/", 1)).alias("start"), end.alias("end"), label.alias("label"))
    return let(parts, lambda t: F.when(t["start"].isNotNull() & (~ranged | t["end"].isNotNull()), t))


def token_text(t: Column) -> Column:
    """A token's absolute words: its label, its range, or its date."""
    return F.when(t.isNull(), F.lit(None)).when(t["label"].isNotNull(), t["label"]).when(t["end"].isNotNull(), F.concat(absolute(t["start"]), F.lit(" – "), absolute(t["end"]))).otherwise(absolute(t["start"]))


def occurred(t: Column) -> tuple[Column, Column]:
    """First and last day of a resolved token; a single day or minute has no last."""
    last = F.when(t["end"].isNotNull(), ceil_day(t["end"])).when(t["start"]["day"].isNull(), ceil_day(t["start"]))
    return floor_day(t["start"]), last


def expand(body: Column, say) -> Column:
    """``body`` with every token as ``say(token)``; a malformed one as its label, else as what stands inside."""

    def shown(x: Column) -> Column:
        bare = F.when(F.contains(x, F.lit("|")), F.nullif(F.trim(F.regexp_replace(x, r"(?s)^[^|]*\|", "")), F.lit("")))
        return F.coalesce(let(inner(x), say), bare, x)

    said = F.transform(F.regexp_extract_all(body, F.lit(TOKEN), F.lit(1)), shown)
    plain = F.split(body, TOKEN, -1)
    return F.array_join(F.zip_with(plain, said, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")


def occurred_range(value: Column, end: Column) -> tuple[Column, Column]:
    """First and last day of a frontmatter date, an explicit end overriding the last one."""
    p, q = partial(value), partial(end)
    return floor_day(p), F.when(p.isNotNull(), F.coalesce(ceil_day(q), ceil_day(p)))


def relative_text(t: Column, now: Column) -> Column:
    """A token as it is said on the day ``now``: how far a point lies from it; a labelled one or a range in absolute words."""
    start = t["start"]
    point = F.when(start["day"].isNotNull(), humanize_days(F.datediff(floor_day(start), now))).when(start["month"].isNotNull(), humanize_months(floor_day(start), now)).otherwise(humanize_years(floor_day(start), now))
    return F.when(t["label"].isNotNull() | t["end"].isNotNull(), token_text(t)).otherwise(point)


def dated_text(t: Column, now: Column) -> Column:
    """A token in absolute words, a point with how far it lies from the day ``now``."""
    point = t["label"].isNull() & t["end"].isNull()
    return F.when(point, F.concat(token_text(t), F.lit(" ("), relative_text(t, now), F.lit(")"))).otherwise(token_text(t))
