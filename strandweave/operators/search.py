"""Hybrid retrieval: a vector leg and a lexical leg fused by reciprocal rank, with a recency prior."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import STOP_WORDS, cosine, recency


@dataclass(frozen=True)
class Params:
    """What a search asks for; ``today`` is always given, so results do not depend on the clock."""

    today: str
    top_k: int = 10
    candidates: int = 60
    rrf_k: int = 60
    half_life: float = 180.0
    floor: float = 0.9
    boost: float = 1.0
    min_score: float = 0.0
    planes: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    since: str | None = None
    until: str | None = None

    def clamped(self, most: int = 50) -> Params:
        k = min(max(self.top_k, 1), most)
        return Params(**{**self.__dict__, "top_k": k, "candidates": max(self.candidates, k)})


def wanted(nodes: DataFrame, p: Params) -> DataFrame:
    """Live nodes that pass the filters; empty lists and missing dates filter nothing."""
    out = nodes.where("merged_into is null")
    if p.planes:
        out = out.where(F.arrays_overlap("planes", F.array(*map(F.lit, p.planes))))
    if p.types:
        out = out.where(F.col("type").isin(p.types))
    if p.since:
        out = out.where(F.coalesce("occurred_end", "occurred_start") >= F.to_date(F.lit(p.since)))
    if p.until:
        out = out.where(F.col("occurred_start") <= F.to_date(F.lit(p.until)))
    return out


def best_per_node(scored: DataFrame, by: Column) -> DataFrame:
    """Each node's best chunk."""
    w = Window.partitionBy("node_id").orderBy(by, "chunk_index")
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top(scored: DataFrame, by: Column, n: int) -> DataFrame:
    """The ``n`` best nodes with their ``rank``; only those meet in one task."""
    best = scored.orderBy(by, "node_id").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(by, "node_id")))


def vector_scores(chunks: DataFrame, query: DataFrame) -> DataFrame:
    """(node_id, chunk_index, dist): cosine distance of every chunk to the one vector of ``query``."""
    one = F.broadcast(query.select(F.col("embedding").alias("q")).limit(1))
    similar = F.round(cosine(F.col("embedding"), F.col("q")), 6)
    return chunks.where("embedding is not null").join(one).select("node_id", "chunk_index", (1 - similar).alias("dist")).where("dist is not null")


def query_terms(text: str) -> list[str]:
    """Distinct words of a query, without stop words; none suppresses the lexical leg."""
    import re

    return sorted({t for t in re.split(r"[^\w]+", text.lower()) if t and t not in STOP_WORDS})


def lexical_scores(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """(node_id, chunk_index, text_rank) of chunks that hold every term: summed counts, damped by length."""
    if not terms:
        return chunks.select("node_id", "chunk_index", F.lit(0.0).alias("text_rank")).where(F.lit(False))
    low = chunks.select("node_id", "chunk_index", F.lower("content").alias("low"), F.length("content").alias("n"))
    for w in terms:  # a plain search leaves most texts out before any is matched word by word
        low = low.where(F.contains("low", F.lit(w)))

    def count(word: str) -> Column:
        return F.regexp_count("low", F.lit(f"(?<![a-z]){word}(?![a-z])")) if word.isascii() and word.isalpha() else F.lit(0)

    out = low.select("node_id", "chunk_index", "n", *[count(w).alias(f"c{k}") for k, w in enumerate(terms)])
    for k in range(len(terms)):
        out = out.where(F.col(f"c{k}") > 0)
    total = sum(F.col(f"c{k}") for k in range(len(terms)))
    return out.select("node_id", "chunk_index", F.round(total / (1 + F.log(F.col("n"))), 6).alias("text_rank"))


def fuse(vector: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """Reciprocal-rank fusion; a node that a leg lacks gets nothing from it."""
    v = vector.select("node_id", F.col("rank").alias("vec_rank"))
    t = lexical.select("node_id", F.col("rank").alias("fts_rank"))
    score = F.coalesce(1.0 / (k + F.col("vec_rank")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("fts_rank")), F.lit(0.0))
    return v.join(t, "node_id", "full_outer").select("node_id", "vec_rank", "fts_rank", score.alias("rrf"))


def legs(nodes: DataFrame, chunks: DataFrame, query: DataFrame, terms: list[str], p: Params, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The two legs' best nodes; ``texts`` (node_id, chunk_index, text_rank), say of a full-text search, stand in for the plain terms."""
    own = chunks.join(wanted(nodes, p).select(F.col("id").alias("node_id")), "node_id", "left_semi")
    vector = top(best_per_node(vector_scores(own, query), F.col("dist")), F.col("dist"), p.candidates)
    found = lexical_scores(own, terms) if texts is None else texts.join(own.select("node_id").distinct(), "node_id", "left_semi")
    lexical = top(best_per_node(found, F.desc("text_rank")), F.desc("text_rank"), p.candidates)
    return vector, lexical


def hybrid(nodes: DataFrame, chunks: DataFrame, query: DataFrame, terms: list[str], p: Params, texts: DataFrame | None = None) -> DataFrame:
    """(node_id, type, title, score) of the best ``top_k`` nodes."""
    p = p.clamped()
    vector, lexical = legs(nodes, chunks, query, terms, p, texts)
    fused = F.broadcast(fuse(vector, lexical, p.rrf_k))  # at most twice ``candidates`` rows
    today = F.to_date(F.lit(p.today))
    age = F.datediff(today, F.coalesce("occurred_start", "created_on"))
    boost = F.when(F.col("interiority") == "internal", p.boost).otherwise(1.0)
    score = F.round(F.col("rrf") * recency(age, p.half_life, p.floor) * boost, 8)
    out = nodes.join(fused, F.col("id") == F.col("node_id")).select("node_id", "type", "title", score.alias("score"))
    return out.where(F.col("score") >= p.min_score).orderBy(F.desc("score"), "node_id").limit(p.top_k)
