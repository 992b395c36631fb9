"""Column functions of the graph engine."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing of an entity.
STOP_WORDS = "the and for with from this that have was were are not but you his her its our their".split()


def _plain_letters() -> tuple[str, str]:
    """Marked Latin letters and their plain forms, then the combining marks, which have none."""
    marked, bare = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            marked.append(chr(code))
            bare.append(base)
    return "".join(marked) + "".join(map(chr, range(0x300, 0x370))), "".join(bare)


ACCENTED, PLAIN = _plain_letters()


def double(x: Column) -> Column:
    return x.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(double(a), double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null for a zero vector."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def fold(x: Column) -> Column:
    """Lower case without the marks of Latin letters."""
    return F.lower(F.translate(x, ACCENTED, PLAIN))


def display_key(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def normalize_alias(x: Column) -> Column:
    return F.trim(F.regexp_replace(fold(x), r"\s+", " "))


def slug(x: Column) -> Column:
    return F.trim(F.regexp_replace(fold(x), "[^a-z0-9]+", " ")).alias("slug")


def significant_tokens(x: Column, least: int = 4) -> Column:
    return F.filter(F.split(display_key(x), " "), lambda t: (F.length(t) >= least) & ~t.isin(STOP_WORDS))


def snippet(x: Column, most: int = 400) -> Column:
    return F.when(F.length(x) > most, F.concat(F.rtrim(F.substring(x, 1, most)), F.lit("…"))).otherwise(x)


def hard_split(x: Column, size: int = 1200, overlap: int = 200) -> Column:
    """Windows of ``size`` code points that overlap; the last one ends with the text."""
    step = size - overlap if overlap < size else size
    last = F.greatest(F.ceil((F.length(x) - size) / F.lit(step)), F.lit(0)).cast("int")
    return F.when(F.length(x) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(x, i * step + 1, F.lit(size))))


def recency(age_days: Column, half_life: float = 180.0, floor: float = 0.9) -> Column:
    return F.lit(floor) + F.lit(1 - floor) * F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0)) / F.lit(half_life))


def profile_tier(degree: Column) -> Column:
    return F.when(degree >= 8, "full").when(degree >= 3, "snapshot").otherwise("stub")


def humanize_days(days: Column) -> Column:
    """How far a day lies from today, in words; halves round up."""
    n = F.abs(days)
    count = F.when(n <= 27, n).when(n < 330, F.greatest(F.floor(n / 30 + 0.5), F.lit(1))).when(n < 400, F.lit(1)).otherwise(F.floor(n / 365 + 0.5))
    unit = F.when(n <= 27, "day").when(n < 330, "month").otherwise("year")
    return F.when(days == 0, "today").when(days == -1, "yesterday").when(days == 1, "tomorrow").otherwise(ago(count, unit, days < 0))


def ago(count: Column, unit: Column | str, past: Column) -> Column:
    """"a month ago", "in 3 years"."""
    unit = F.lit(unit) if isinstance(unit, str) else unit
    words = F.when(count == 1, F.concat(F.lit("a "), unit)).otherwise(F.concat(count.cast("int").cast("string"), F.lit(" "), unit, F.lit("s")))
    return F.when(past, F.concat(words, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), words))


def humanize_months(month: Column, now: Column) -> Column:
    """How far a month lies from the present one; a year and more in years, halves up."""
    d = F.year(month) * 12 + F.month(month) - F.year(now) * 12 - F.month(now)
    far = F.when(F.abs(d) < 12, ago(F.abs(d), "month", d < 0)).otherwise(ago(F.floor(F.abs(d) / 12 + 0.5), "year", d < 0))
    return F.when(d == 0, "this month").when(d == -1, "last month").when(d == 1, "next month").otherwise(far)


def humanize_years(year: Column, now: Column) -> Column:
    d = F.year(year) - F.year(now)
    return F.when(d == 0, "this year").when(d == -1, "last year").when(d == 1, "next year").otherwise(ago(F.abs(d), "year", d < 0))


def relative(anchor: Column, offset: Column, unit: str) -> Column:
    """The date ``offset`` units from ``anchor``, as precise as the unit: a day, a month or a year."""
    if unit in ("day", "week"):
        return F.date_format(F.date_add(anchor, offset * (7 if unit == "week" else 1)), "yyyy-MM-dd")
    if unit == "month":
        return F.date_format(F.add_months(F.trunc(anchor, "month"), offset), "yyyy-MM")
    year = F.year(anchor) + offset
    return F.when(year.between(1, 9999), year.cast("string"))


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def first_words(x: Column, most: int) -> Column:
    return F.array_join(F.slice(F.split(x, " "), 1, most), " ")


def cursor(*keys: str) -> Column:
    """A page's place as text: the compact JSON list of its keys in unpadded base64 for addresses."""
    return F.rtrim(F.translate(F.base64(F.encode(F.to_json(F.array(*keys)), "UTF-8")), "+/", "-_"), F.lit("="))
