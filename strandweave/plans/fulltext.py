"""Registered queries: full text with stems, phrases, alternatives and exclusions, which SQL has no words for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fulltext as T
from ..operators import search as S
from .catalog import PARAMS, _query_vector, query

ASKED = 'thinged hables or "ther thing" -stedly'


def _profiles(m):
    """Titles stand in for profiles, as a text of their own behind a node's chunks."""
    return m.nodes.select(F.col("id").alias("node_id"), F.lit(-1).alias("chunk_index"), F.col("title").alias("content"))


def _scores(m, text):
    texts = m.chunks.select("node_id", "chunk_index", "content").union(_profiles(m))
    asked = T.question(text)
    return T.scores(T.postings(texts, T.lexemes(asked)), asked)


@query(None)
def search_fts_websearch(m):
    return _scores(m, ASKED)


@query(None)
def search_fts_profiles(m):
    """The best text of each node, chunk or profile, as the lexical leg ranks them."""
    return S.top(S.best_per_node(_scores(m, "cold or widgets"), F.desc("text_rank")), F.desc("text_rank"), 60).select("node_id", "chunk_index", "text_rank", "rank")


@query(None)
def search_hybrid_websearch(m):
    return S.hybrid(m.nodes, m.chunks, _query_vector(m), [], PARAMS, _scores(m, ASKED))


@query(None)
def fts_lexemes(m):
    """The full-text column as rows, one a text and lexeme."""
    return T.postings(m.chunks)
