"""What a conversation's distilled candidates become, citations, and cleaned model replies."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that make an endorsement doubtful, stances, and other names of saliences.
HEDGES = ["maybe", "might", "perhaps", "i think", "i guess", "probably", "not sure", "unsure", "possibly", "i wonder", "kind of", "sort of", "we'll see", "tbd", "idk", "i'm not sure"]
STANCES = ["endorsed", "unclear", "rejected"]
SALIENCES = {"high": "high", "med": "med", "low": "low", "medium": "med", "moderate": "med", "mid": "med"}
REPLY = "candidates array<struct<candidate_text: string, stance: string, salience: string, evidence_excerpt: string, why_unclear: string>>"


def json_object(reply: Column) -> Column:
    """The JSON object in a model's reply: without code fences, from the first brace to the last."""
    bare = F.trim(F.regexp_replace(reply, r"(?m)^[ \t]*```[a-zA-Z]*[ \t]*$", ""))
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def match_form(x: Column) -> Column:
    """Letters and digits in lower case with single blanks."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def candidates(replies: DataFrame, most: int = 20) -> DataFrame:
    """(session_id, pos, text, stance, salience, excerpt, dropped): a reply's usable candidates, ``most`` at most, and how
    many were left out beside each.  Unknown stances are unclear, unknown saliences medium."""
    parsed = replies.select("session_id", F.from_json(json_object(F.col("reply")), REPLY)["candidates"].alias("c"))
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    good = F.filter("c", lambda c: clean(c["candidate_text"]) != "")
    rows = parsed.select("session_id", F.size("c").alias("all"), good.alias("good")).where("all >= 0")
    kept = F.slice("good", 1, most)
    rows = rows.select("session_id", (F.col("all") - F.size(kept)).alias("dropped"), F.posexplode(kept).alias("pos", "c"))
    stance, salience = F.lower(clean(F.col("c.stance"))), F.lower(clean(F.col("c.salience")))
    names = F.create_map(*[F.lit(x) for pair in SALIENCES.items() for x in pair])
    return rows.select("session_id", "pos", F.trim("c.candidate_text").alias("text"), F.when(stance.isin(STANCES), stance).otherwise("unclear").alias("stance"), F.coalesce(F.try_element_at(names, salience), F.lit("med")).alias("salience"), clean(F.col("c.evidence_excerpt")).alias("excerpt"), "dropped")


def gated(found: DataFrame) -> DataFrame:
    """(session_id, pos, text, excerpt, route): of equal candidates of a session the first; endorsed ones that hedge are
    unclear."""
    w = Window.partitionBy("session_id", match_form(F.col("text"))).orderBy("pos")
    first = found.withColumn("k", F.row_number().over(w)).where("k = 1")
    blob = F.lower(F.concat("text", F.lit("\n"), "excerpt"))
    hedged = F.lit(False)
    for h in HEDGES:
        hedged = hedged | F.contains(blob, F.lit(h))
    route = F.when((F.col("stance") == "endorsed") & hedged, "unclear").otherwise(F.col("stance"))
    return first.select("session_id", "pos", "text", "excerpt", route.alias("route"))


def anchored(found: DataFrame, messages: DataFrame) -> DataFrame:
    """(session_id, pos, anchor): the time of the first message that holds the excerpt (its first 60 characters), else of
    the last user message, else of the newest message.  Candidates of a session are few."""
    probe = F.substring(match_form(F.col("excerpt")), 1, 60)
    rows = found.select("session_id", "pos", probe.alias("probe")).join(messages.select("session_id", "at_minute", "role", match_form(F.col("content")).alias("said")), "session_id", "left")
    hit = F.min(F.when((F.col("probe") != "") & F.contains("said", F.col("probe")), F.col("at_minute")))
    out = rows.groupBy("session_id", "pos").agg(hit.alias("hit"), F.max(F.when(F.col("role") == "user", F.col("at_minute"))).alias("user"), F.max("at_minute").alias("newest"))
    return out.select("session_id", "pos", F.coalesce("hit", "user", "newest").alias("anchor"))


@F.pandas_udf(StringType())
def renumbered(text: pd.Series, hits: pd.Series) -> pd.Series:
    """Markers ``[n]`` of 1..hits renumbered by first appearance; others are dropped."""

    def one(t: str, k: int) -> str:
        order: dict[int, int] = {}
        return re.sub(r"\[(\d+)\]", lambda m: f"[{order.setdefault(int(m[1]), len(order) + 1)}]" if 1 <= int(m[1]) <= k else "", t)

    return pd.Series([None if t is None else one(t, int(k)) for t, k in zip(text, hits, strict=True)], dtype=object)


def cited(text: Column, hits: int) -> Column:
    """The cited numbers of 1..hits, in order of first appearance."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: F.when(F.length(x) < 10, x.cast("int")))
    return F.array_distinct(F.filter(numbers, lambda n: n.between(1, hits)))


def clean_tag(x: Column) -> Column:
    """A tag's slug; empty where no letter is left."""
    from ..functions.columns import fold

    slug = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(F.trim(fold(x)), "^#+", "")), "[^a-z0-9_/-]+", "-"), "-{2,}", "-")
    slug = F.regexp_replace(slug, "^[-/_]+|[-/_]+$", "")
    return F.when(slug.rlike("[a-z]"), slug).otherwise("")


def clean_tags(tags: Column, most: int = 8) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(tags, clean_tag), lambda t: t != "")), 1, most)


def transcript(rows: DataFrame) -> DataFrame:
    """(session_id, prompt): a delta's lines between fences, marked as data."""
    from .activity import transcripts

    return transcripts(rows).select("session_id", F.concat(F.lit("Messages of one session, quoted as they are:\n<<<\n"), "transcript", F.lit("\n>>>")).alias("prompt"))


def clean_title(said: Column, most: int) -> Column:
    """A model's title: the first line, without one matching pair of quotes around it, ``most`` characters at most."""
    line = F.trim(F.regexp_extract(F.regexp_replace(said, r"^\s+|\s+$", ""), r"^[^\r\n]*", 0))
    mark = F.substring(line, 1, 1)
    paired = (F.length(line) >= 2) & mark.isin('"', "'") & (F.substring(line, -1, 1) == mark)
    return F.trim(F.substring(F.when(paired, F.trim(F.substring(line, F.lit(2), F.length(line) - 2))).otherwise(line), 1, most))
