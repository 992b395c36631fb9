"""What a model makes of a capture, checked against the vocabulary and turned into nodes, mentions and proposals.

Replies are variants: every field is read by its own type, and one of another type counts as missing.  Nodes are rows
from the start, so that what a node drops, keeps or proposes is columns; only the phrases of time in its body are placed
by a small function.  A capture's nodes and a node's mentions are few.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.symbolic import with_tokens
from .chat import clean_tag, json_object

INNER = ["internal", "external", "mixed"]


@dataclass(frozen=True)
class Vocabulary:
    node_types: list[str]
    edge_rels: list[str]
    entity_types: list[str]
    planes: list[str]
    most_nodes: int = 8
    most_tags: int = 8
    most_edges: int = 12


def _text(node: Column, field: str) -> Column:
    """A field that is text, trimmed; null if it is of another type."""
    whole = F.try_variant_get(node, f"$.{field}", "variant")
    return F.when(F.schema_of_variant(whole) == "STRING", F.trim(F.regexp_replace(F.try_variant_get(node, f"$.{field}", "string"), r"^\s+|\s+$", "")))


def _list(node: Column, field: str) -> Column:
    return F.try_variant_get(node, f"$.{field}", "array<variant>")


def _texts(values: Column) -> Column:
    """Those of a list's values that are text."""
    return F.transform(F.filter(values, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))


def _number(value: Column) -> Column:
    """A whole number, or digits as text; null for anything else."""
    kind = F.schema_of_variant(value)
    digits = F.trim(F.try_variant_get(value, "$", "string"))
    return F.when(kind == "BIGINT", F.try_variant_get(value, "$", "bigint")).when((kind == "STRING") & digits.rlike(r"^\d+$"), digits.try_cast("bigint"))


def _known(words: list[str]) -> Column:
    return F.create_map(*[F.lit(x) for w in words for x in (w.strip().lower(), w)])


def _spelled(words: Column, value: Column) -> Column:
    return F.try_element_at(words, F.lower(F.trim(value)))


def proposals_of(*found: DataFrame) -> DataFrame:
    """(capture_id, vocab, value), once each."""
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def validated(replies: DataFrame, v: Vocabulary) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, mentions, proposals) of replies (capture_id, reply, anchor, n_parts).

    nodes: (capture_id, pos, title, type, coerced, plane, planes, tags, body, occurred, occurred_end, interiority, parts,
    arose_from).  A node without title or body goes; at most ``most_nodes`` stay.  An unknown type becomes a memory and a
    proposal, an entity's type a memory (``coerced``); planes are spelled as configured; ``arose_from`` is the place of
    another node that stayed; parts lie within those that the capture has.
    mentions: (capture_id, pos, place, name, type, rel, disambig), of known types and relations, the first
    ``most_edges`` of a node; what is unknown before these are full is proposed.
    A capture without usable nodes has no row: the caller keeps its text in the inbox.
    """
    parsed = replies.select("capture_id", "anchor", "n_parts", _list(F.try_parse_json(json_object(F.col("reply"))), "nodes").alias("nodes"))
    raw = parsed.select("capture_id", "anchor", "n_parts", F.posexplode("nodes").alias("raw_pos", "node"))
    raw = raw.select("*", _text(F.col("node"), "title").alias("title"), _text(F.col("node"), "body").alias("body")).where("title <> '' and body <> ''")
    w = Window.partitionBy("capture_id").orderBy("raw_pos")
    raw = raw.withColumn("pos", F.row_number().over(w) - 1).where(F.col("pos") < v.most_nodes)

    types, entity_words, planes = _known(v.node_types), _known(v.entity_types), _known(v.planes)
    entities = [t.strip().lower() for t in v.entity_types]
    asked = _text(F.col("node"), "type")
    canon = _spelled(types, asked)
    is_entity = F.coalesce(F.lower(canon).isin(entities), F.lit(False))
    node_type = F.when(canon.isNotNull() & ~is_entity, canon).otherwise("memory")
    primary = _spelled(planes, _text(F.col("node"), "plane"))
    listed = F.transform(_texts(F.coalesce(_list(F.col("node"), "planes"), F.array().cast("array<variant>"))), lambda p: _spelled(planes, p))
    membership = F.array_distinct(F.filter(F.concat(F.array(primary), listed), lambda p: p.isNotNull()))
    tags = F.transform(_texts(F.coalesce(_list(F.col("node"), "tags"), F.array().cast("array<variant>"))), lambda t: clean_tag(t))
    tags = F.slice(F.array_distinct(F.filter(tags, lambda t: t != "")), 1, v.most_tags)
    inner = F.lower(_text(F.col("node"), "interiority"))
    parts = F.transform(F.coalesce(_list(F.col("node"), "parts"), F.array().cast("array<variant>")), _number)
    parts = F.array_distinct(F.filter(parts, lambda p: (p >= 1) & (p <= F.col("n_parts"))))
    refs = F.transform(F.filter(F.coalesce(_list(F.col("node"), "time_refs"), F.array().cast("array<variant>")), lambda r: F.schema_of_variant(r).startswith("OBJECT")), lambda r: F.to_json(r))
    arose = _number(F.try_variant_get("node", "$.arose_from", "variant"))
    nodes = raw.select(
        "capture_id",
        "pos",
        "raw_pos",
        "title",
        node_type.alias("type"),
        is_entity.alias("coerced"),
        F.when(canon.isNull() & (asked != ""), asked).alias("unknown_type"),
        primary.alias("plane"),
        membership.alias("planes"),
        tags.alias("tags"),
        with_tokens("body", refs, "anchor").alias("dated"),
        F.when(inner.isin(INNER), inner).otherwise("external").alias("interiority"),
        parts.alias("parts"),
        F.when(arose >= 0, arose).alias("arose_raw"),
        "node",
    )
    to = nodes.select("capture_id", F.col("raw_pos").cast("bigint").alias("arose_raw"), F.col("pos").alias("arose_pos"))
    nodes = nodes.join(to, ["capture_id", "arose_raw"], "left").withColumn("arose_from", F.when(F.col("arose_pos") != F.col("pos"), F.col("arose_pos")))

    each = nodes.select("capture_id", "pos", F.posexplode(F.coalesce(_list(F.col("node"), "entities"), F.array().cast("array<variant>"))).alias("place", "e"))
    said = each.select("capture_id", "pos", "place", _text(F.col("e"), "name").alias("name"), _text(F.col("e"), "type").alias("kind"), _text(F.col("e"), "rel").alias("said_rel"), F.nullif(_text(F.col("e"), "disambig"), F.lit("")).alias("disambig"))
    said = said.where("name <> '' and kind is not null and said_rel is not null")
    said = said.withColumn("type", _spelled(entity_words, F.col("kind"))).withColumn("rel", _spelled(_known(v.edge_rels), F.col("said_rel")))
    good = F.col("type").isNotNull() & F.col("rel").isNotNull()
    before = F.count_if(good).over(Window.partitionBy("capture_id", "pos").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    said = said.withColumn("before", before).where(F.col("before") < v.most_edges)
    mentions = said.where(good).select("capture_id", "pos", F.col("before").cast("int").alias("place"), "name", "type", "rel", "disambig")

    odd_type = said.where("type is null").select("capture_id", F.lit("entity_type").alias("vocab"), F.col("kind").alias("value"))
    odd_rel = said.where("type is not null and rel is null").select("capture_id", F.lit("edge_rel"), "said_rel")
    odd_node = nodes.where("unknown_type is not null").select("capture_id", F.lit("node_type"), "unknown_type")
    kept = ["capture_id", "pos", "title", "type", "coerced", "plane", "planes", "tags", F.col("dated.body").alias("body"), "dated.occurred", "dated.occurred_end", "interiority", "parts", "arose_from"]
    return nodes.select(*kept), mentions, proposals_of(odd_type, odd_rel, odd_node)
