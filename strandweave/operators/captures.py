"""Captures, their media and the nodes made of them; runs and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What stands for a medium that could not be read.
PLACEHOLDERS = {"photo": "<photo — description unavailable>", "voice": "<voice note — transcript unavailable>", "video": "<video — summary unavailable>"}
OTHER_MEDIA = "<media — unavailable>"
MOST_ATTEMPTS = 3


def placeholder(kind: Column) -> Column:
    out = F.lit(OTHER_MEDIA)
    for k, text in PLACEHOLDERS.items():
        out = F.when(kind == k, text).otherwise(out)
    return out


def part_body() -> Column:
    """A medium's derived text, trimmed, or its placeholder."""
    text = F.trim(F.coalesce("derived_text", F.lit("")))
    return F.when((F.col("status") == "derived") & (text != ""), text).otherwise(placeholder(F.col("kind")))


def _order() -> list:
    """A capture's media by part, unnumbered ones last."""
    return [F.coalesce("part_ordinal", F.lit(2**31 - 1)).alias("o"), "created_at", "media_id"]


def composed(captures: DataFrame, media: DataFrame) -> DataFrame:
    """(capture_id, text): the own text, then every part behind its numbered mark, divided by blank lines."""
    part = F.struct(*_order(), "kind", part_body().alias("body"))
    parts = media.groupBy("capture_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    marked = F.transform("parts", lambda p, i: F.concat(F.lit("[[part "), (i + 1).cast("string"), F.lit(" · "), p["kind"], F.lit("]] "), p["body"]))
    own = F.trim(F.coalesce("raw_text", F.lit("")))
    both = F.concat(F.when(own != "", F.array(own)).otherwise(F.array().cast("array<string>")), F.coalesce(marked, F.array().cast("array<string>")))
    return captures.select("capture_id", "raw_text").join(parts, "capture_id", "left").select("capture_id", F.array_join(both, "\n\n").alias("text"))


def listed(captures: DataFrame, paths: DataFrame, nodes: DataFrame, media: DataFrame, most: int) -> DataFrame:
    """(capture_id, created_at, node_ids, media_ids) of the newest ``most`` captures, their nodes in path order and
    their media by part; only those captures meet the other tables."""
    newest = captures.where("not removed").select("capture_id", "created_at").orderBy(F.desc("created_at"), F.desc("capture_id")).limit(most)
    held = paths.join(newest.select("capture_id"), "capture_id", "left_semi").join(nodes.select(F.col("store_path").alias("path"), "id"), "path")
    refs = held.groupBy("capture_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("n"))
    own = media.join(newest.select("capture_id"), "capture_id", "left_semi").groupBy("capture_id").agg(F.sort_array(F.collect_list(F.struct(*_order()))).alias("m"))
    out = newest.join(refs, "capture_id", "left").join(own, "capture_id", "left")
    empty = lambda c, t: F.coalesce(c, F.array().cast(t))
    return out.select("capture_id", "created_at", empty(F.col("n.id"), "array<string>").alias("node_ids"), empty(F.col("m.media_id"), "array<bigint>").alias("media_ids"))


def derive(media: DataFrame) -> DataFrame:
    """(media_id, status, attempts) after one round: what has text is derived, what has none fails once more, and for
    good at ``MOST_ATTEMPTS``."""
    pending = F.col("status") == "pending"
    good = F.trim(F.coalesce("derived_text", F.lit(""))) != ""
    tried = F.col("attempts") + 1
    status = F.when(pending & good, "derived").when(pending & (tried >= MOST_ATTEMPTS), "unavailable").otherwise(F.col("status"))
    return media.select("media_id", status.alias("status"), F.when(pending & ~good, tried).otherwise(F.col("attempts")).alias("attempts"))


def attributed(paths: DataFrame, nodes: DataFrame, media: DataFrame) -> DataFrame:
    """(node_id, media_id): a medium belongs to the node of its part's position in its capture, without a part to all of
    the capture's nodes."""
    made = paths.join(nodes.select(F.col("store_path").alias("path"), F.col("id").alias("node_id")), "path").select("capture_id", "pos", "node_id")
    own = media.select("capture_id", "media_id", "part_ordinal")
    return made.join(own, "capture_id").where("part_ordinal is null or part_ordinal = pos").select("node_id", "media_id").distinct()


def join_checks(media: DataFrame, links: DataFrame, nodes: DataFrame, captures: DataFrame) -> DataFrame:
    """(check, n): links to nothing, links on merged nodes, media without node or capture."""
    node = nodes.select(F.col("id").alias("node_id"), F.col("merged_into").isNotNull().alias("merged"), F.lit(True).alias("node"))
    every = links.join(node, "node_id", "left").join(media.select("media_id", F.lit(True).alias("medium")), "media_id", "left")
    a = every.agg(F.count_if(F.col("node").isNull()).alias("links-without-node"), F.count_if(F.coalesce("merged", F.lit(False))).alias("links-on-tombstones"), F.count_if(F.col("medium").isNull()).alias("links-without-media"))
    b = media.join(links.select("media_id"), "media_id", "left_anti").agg(F.count("*").alias("media-without-node"))
    c = media.join(captures.select("capture_id"), "capture_id", "left_anti").agg(F.count("*").alias("media-without-capture"))
    one = a.crossJoin(b).crossJoin(c)  # one row each
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(f"`{k}`").alias("n")) for k in one.columns])).alias("x")).select("x.check", "x.n")


def allowed(events: DataFrame, key: str, at: str, most: int, seconds: float) -> DataFrame:
    """``events`` with ``allowed``: at most ``most`` accepted ones of a key in any ``seconds``; refused ones don't count.

    A refusal depends on the ones before it, so a key's events are gone through in order; only the last ``most``
    accepted times are held."""
    import pandas as pd

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields) + ", allowed boolean"

    def ruled(batches):
        held, recent = None, []
        for pdf in batches:
            flags = []
            for k, t in zip(pdf[key], pd.to_datetime(pdf[at]).astype("int64") / 1e9 if pdf[at].dtype.kind == "M" else pdf[at], strict=True):
                if k != held:
                    held, recent = k, []
                recent = [x for x in recent if x > t - seconds]
                flags.append(len(recent) < most)
                if flags[-1]:
                    recent.append(t)
            yield pdf.assign(allowed=flags)

    return events.repartition(key).sortWithinPartitions(key, at).mapInPandas(ruled, schema)


def latest(runs: DataFrame, *keys: str) -> DataFrame:
    """The newest run of each key, with its columns."""
    w = Window.partitionBy(*keys).orderBy(F.desc("started_at"), F.desc("run_id"))
    return runs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def legacy_voice(captures: DataFrame, media: DataFrame) -> DataFrame:
    """(capture_id, raw_text, audio_path) of the voice captures that remain, have a sound file and no medium."""
    voice = captures.where("kind = 'voice' and audio_path is not null and not removed")
    return voice.join(media.select("capture_id"), "capture_id", "left_anti").select("capture_id", "raw_text", "audio_path")
