"""Full text: stored lexemes with positions, searches with phrases, alternatives and exclusions, and their rank.

Every text's lexemes are made once (:func:`postings`) and may be stored by lexeme (:func:`store`); a search then reads
the partitions and rows of its own few lexemes, and only those meet by text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stems import TEXT_STOP_WORDS, stem

KEYS = ["node_id", "chunk_index"]
BUCKETS, SALTS = 64, 8
#: The weight of a plain position, the limit of the sum of inverse squares, the reach of a neighbour.
WEIGHT, SQUARES, REACH = 0.1, 1.64493406685, 100


@dataclass(frozen=True)
class Term:
    """Lexemes at fixed distances from the first one; a plain word is one lexeme."""

    lexemes: tuple[tuple[int, str], ...]
    excluded: bool = False


def question(text: str) -> list[list[Term]]:
    """Alternatives of terms that must all hold: words, ``"phrases"``, ``-exclusions``, alternatives divided by ``or``.

    Stop words count for distances only; a search of nothing else is empty and finds nothing."""
    groups: list[list[Term]] = [[]]
    for token in re.findall(r'-?"[^"]*"|[^\s"]+', text.lower()):
        if token == "or":
            groups.append([])
            continue
        words = re.findall(r"[^\W_]+", token)
        kept = [(i, stem(w)) for i, w in enumerate(words) if w not in TEXT_STOP_WORDS]
        if kept:
            groups[-1].append(Term(tuple((i - kept[0][0], x) for i, x in kept), token.startswith("-")))
    return [g for g in groups if g]


def lexemes(groups: list[list[Term]]) -> list[str]:
    return sorted({x for g in groups for t in g for _, x in t.lexemes})


def stem_start(lexeme: str) -> str:
    """What every word of a lexeme begins with: stemming changes or adds two letters at most and never the first."""
    return lexeme[: max(1, len(lexeme) - 2)]


def postings(texts: DataFrame, asked: list[str] | None = None) -> DataFrame:
    """(node_id, chunk_index, lexeme, positions) of texts (node_id, chunk_index, content), without a shuffle; words are
    runs of letters and digits, counted from 1; a null or empty text has none.

    With ``asked`` lexemes only theirs are sure to be made: texts without a word that begins as one of them are not taken apart."""
    words = F.regexp_extract_all(F.lower("content"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    starts = None if asked is None else tuple(sorted({stem_start(x) for x in asked}))
    if starts is not None:
        begins = r"(?:^|[^\p{L}\p{N}])(?:" + "|".join(rf"\Q{x}\E" for x in starts) + ")"
        texts = texts.where(F.lower("content").rlike(begins) if starts else F.lit(False))
    rows = texts.where("content is not null").select(*KEYS, words.alias("words"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*KEYS).schema.fields) + ", lexeme string, positions array<int>"

    def spread(batches):
        for pdf in batches:
            flat = pd.DataFrame({"row": np.repeat(np.arange(len(pdf)), pdf["words"].map(len)), "word": [w for ws in pdf["words"] for w in ws]})
            flat["at"] = flat.groupby("row").cumcount() + 1
            if starts is not None:
                flat = flat[flat["word"].isin([w for w in flat["word"].unique() if w.startswith(starts)])]
            flat = flat[~flat["word"].isin(TEXT_STOP_WORDS)]
            if flat.empty:
                continue
            flat["lexeme"] = flat["word"].map({w: stem(w) for w in flat["word"].unique()})
            out = flat.groupby(["row", "lexeme"], sort=False)["at"].agg(list).rename("positions").reset_index()
            yield pdf[KEYS].iloc[out["row"]].reset_index(drop=True).assign(lexeme=out["lexeme"], positions=out["positions"])

    return rows.mapInPandas(spread, schema)


def _bucket(x: Column) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int")


def store(made: DataFrame, path: str) -> None:
    """Write postings by bucket of their lexeme, sorted by it; a frequent lexeme is spread over ``SALTS`` files."""
    rows = made.withColumn("bucket", _bucket(F.col("lexeme")))
    rows = rows.repartition("bucket", F.pmod(F.xxhash64(*KEYS), F.lit(SALTS))).sortWithinPartitions("bucket", "lexeme")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(path)


def stored(spark: SparkSession, path: str, groups: list[list[Term]]) -> DataFrame:
    """The stored postings of a search's lexemes: its buckets are partitions, its lexemes a filter of the scan."""
    asked = lexemes(groups)
    rows = spark.read.parquet(path)
    if not asked:
        return rows.where(F.lit(False)).drop("bucket")
    buckets = [r[0] for r in spark.createDataFrame([(x,) for x in asked], "lexeme string").select(_bucket(F.col("lexeme"))).collect()]
    return rows.where(F.col("bucket").isin(buckets) & F.col("lexeme").isin(asked)).drop("bucket")


def _starts(term: Term, at: dict[str, np.ndarray]) -> np.ndarray:
    """Where a term begins: each lexeme's positions, moved back by its distance, have these in common."""
    found = None
    for distance, x in term.lexemes:
        here = at.get(x, np.empty(0, int)) - distance
        found = here if found is None else np.intersect1d(found, here)
    return found


def _near(xs: np.ndarray, ys: np.ndarray) -> float:
    """The share that two lexemes' positions leave of a miss: the product over all pairs of one less their nearness."""
    left = 1.0
    for part in np.array_split(xs, max(1, len(xs) * len(ys) // 1_000_000)):
        apart = np.abs(part[:, None] - ys[None, :]).astype(float)
        apart = apart[apart > 0]
        weight = np.where(apart > REACH, 1e-30, 1 / (1.005 + 0.05 * np.exp(np.minimum(apart, REACH) / 1.5 - 2)))
        left *= float(np.prod(1 - WEIGHT * np.sqrt(weight)))
    return left


def rank(groups: list[list[Term]], at: dict[str, np.ndarray]) -> float:
    """The rank of a text with a search's lexemes ``at`` positions: of one alternative with several lexemes by the
    nearness of each two, else by the counts of each, a further one counting less."""
    asked = lexemes(groups)
    held = [np.sort(at[x]) for x in asked if x in at]
    if len(groups) == 1 and len(asked) > 1:
        left = 1.0
        for i, xs in enumerate(held):
            for ys in held[:i]:
                left *= _near(xs, ys)
        return max(1 - left, 1e-20)
    return sum(float(np.sum(WEIGHT / np.arange(1, len(p) + 1) ** 2)) for p in held) / SQUARES / len(asked)


def scores(made: DataFrame, groups: list[list[Term]], every: DataFrame | None = None) -> DataFrame:
    """(node_id, chunk_index, text_rank) of the texts that a search finds in postings.

    An alternative of exclusions alone finds texts that hold none of its lexemes; it needs ``every`` text's keys."""
    asked = lexemes(groups)
    hits = made.where(F.col("lexeme").isin(asked) if asked else F.lit(False))
    held = hits.groupBy(*KEYS).agg(F.collect_list(F.struct("lexeme", "positions")).alias("held"))
    if any(all(t.excluded for t in g) for g in groups):
        if every is None:
            raise ValueError("a search of exclusions alone needs the keys of every text")
        held = every.select(*KEYS).distinct().join(held, KEYS, "left")

    @F.pandas_udf("double")
    def judged(names: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for xs, ps in zip(names, places, strict=True):
            at = {} if xs is None else {x: np.asarray(p, int) for x, p in zip(xs, ps, strict=True)}
            found = any(all((len(_starts(t, at)) > 0) != t.excluded for t in g) for g in groups)
            out.append(rank(groups, at) if found else None)
        return pd.Series(out, dtype="float64")

    out = held.select(*KEYS, judged("held.lexeme", "held.positions").alias("text_rank"))
    return out.where("text_rank is not null").select(*KEYS, F.round("text_rank", 6).alias("text_rank"))
