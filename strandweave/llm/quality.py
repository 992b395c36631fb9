"""Quality: regularised quadratic discriminant analysis over transformed document statistics.

Statistics of the whole text (lengths, shares of letters, capitals, digits, symbols, repeated words and shingles)
are log-transformed.  Each class gets its mean and a covariance shrunk towards its own diagonal and the pooled
one; a score is the posterior from the difference of the two log densities, read off Mahalanobis distances with
Cholesky factors that are computed once.  All teaching rows count, gathered as sums of moments.

Null text counts as empty.  Repeated rows get equal scores.  With fewer than two teaching rows of either class
every score is the smoothed share of good teaching rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import remainder, teaching
from .store import stage
from .textkit import runs, shingles, slices, strings, tidy, words

THRESHOLD = 0.3
MOD, HELD = 5, 0
SHRINK, POOL, RIDGE = 0.1, 0.1, 1e-3
NAMES = ("chars", "words", "word_length", "word_spread", "upper", "digits", "stops", "symbols", "shouts", "bars", "lines", "distinct", "repeats", "short", "bare_ends", "wide")
_CLASS = np.zeros(256, np.int64)  # 0: other ASCII
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[ord(c) for c in ".,;:'\"?-()"]] = 4
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 5
_CLASS[ord("!")] = 6
_CLASS[ord("|")] = 7
_CLASS[10] = 8
_CLASS[0xC0:] = 9  # first byte of a longer code point
_CLASS[0x80:0xC0] = 10  # its other bytes


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of ``NAMES`` for every text."""
    w = words(texts)
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(w.offsets))
    kind = _CLASS[w.raw]
    c = np.bincount(doc * 11 + kind, minlength=11 * n).reshape(n, 11).astype(float)
    chars = c.sum(1) - c[:, 10]
    count = np.diff(w.first).astype(float)
    size = (w.end - w.start).astype(float)
    total = np.bincount(w.doc, weights=size, minlength=n)
    square = np.bincount(w.doc, weights=size * size, minlength=n)
    mean = total / np.maximum(count, 1)
    spread = np.sqrt(np.maximum(square / np.maximum(count, 1) - mean * mean, 0))

    def distinct(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
        key = np.sort((hashes >> np.uint64(24)) | (of.astype(np.uint64) << np.uint64(40)))
        at, _ = runs(key)
        return np.bincount((key[at] >> np.uint64(40)).astype(np.int64), minlength=n).astype(float)

    s, of, _ = shingles(w, 3)
    many = np.bincount(of, minlength=n) - distinct(s, of)
    short = np.bincount(w.doc[size <= 3], minlength=n)
    bare = np.bincount(w.doc[np.isin(kind[w.end - 1], (5, 6, 7))], minlength=n) if len(size) else np.zeros(n)
    letters = c[:, 1] + c[:, 2] + c[:, 9]
    share = lambda k, of: np.log((k + 0.5) / (of + 10))
    return np.stack(
        [np.log1p(chars), np.log1p(count), np.log1p(mean), np.log1p(spread), share(c[:, 2], letters), share(c[:, 3], chars), share(c[:, 4], chars), share(c[:, 5], chars), share(c[:, 6], chars), share(c[:, 7], chars), share(c[:, 8], count)]
        + [np.log((distinct(w.hash, w.doc) + 1) / (count + 1)), share(many, count), share(short, count), share(bare, count), share(c[:, 9], letters)],
        axis=1,
    )


def with_statistics(documents: DataFrame) -> DataFrame:
    """``documents`` without its text, with the column ``_stats``."""
    rest = [f for f in documents.schema.fields if f.name not in ("text", "_stats")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "_stats array<double>"])

    @tidy
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(batch.schema.get_field_index("text")))
            rows = [statistics(part) for _, part in slices(texts)]
            flat = np.concatenate(rows) if rows else np.zeros((0, len(NAMES)))
            stats = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, len(NAMES), dtype=np.int32), flat.ravel())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), stats], [*(f.name for f in rest), "_stats"])

    return documents.select(*[f"`{f.name}`" for f in rest], "text").mapInArrow(measured, schema)


@dataclass
class Discriminant:
    """Means and inverse Cholesky factors of the two classes; ``means`` is empty for a constant score."""

    odds: float
    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_dets: list[float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        d = np.full(len(x), self.odds)
        if self.means:
            log = [-0.5 * (((x - m) @ f.T) ** 2).sum(1) - 0.5 * k for m, f, k in zip(self.means, self.factors, self.log_dets, strict=True)]
            d = d + log[1] - log[0]
        return 1 / (1 + np.exp(-np.clip(d, -700, 700)))


def discriminant(counts: list[float], sums: list[np.ndarray], squares: list[np.ndarray]) -> Discriminant:
    """From the number, sum and sum of outer products of each class's statistics."""
    odds = float(np.log((counts[1] + 0.5) / (counts[0] + 0.5)))
    if min(counts) < 2:
        return Discriminant(odds, [], [], [])
    means = [s / n for n, s in zip(counts, sums, strict=True)]
    own = [q / n - np.outer(m, m) for n, m, q in zip(counts, means, squares, strict=True)]
    pooled = sum(n * c for n, c in zip(counts, own, strict=True)) / sum(counts)
    factors, dets = [], []
    for c in own:
        c = (1 - POOL) * c + POOL * pooled
        c = (1 - SHRINK) * c + SHRINK * np.diag(np.diag(c)) + RIDGE * np.eye(len(c))
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        dets.append(2 * float(np.log(np.diag(low)).sum()))
    return Discriminant(odds, means, factors, dets)


def train(measured: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """Moments of every teaching row, summed by Spark; the driver gets one number a class and moment."""
    known = teaching(labels, label, MOD, HELD)
    rows = measured.select("doc_id", "_stats").join(known, "doc_id").select("label", "_stats")
    k = len(NAMES)

    @tidy
    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 + k + k * k))
        for pdf in batches:
            if len(pdf):
                x, y = np.stack(pdf["_stats"].to_numpy()), pdf["label"].to_numpy()
                for c in (0, 1):
                    part = x[y == c]
                    total[c] += np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel()])
        yield pd.DataFrame({"label": np.repeat([0, 1], total.shape[1]), "place": np.tile(np.arange(total.shape[1]), 2), "value": total.ravel()})

    found = np.zeros((2, 1 + k + k * k))
    for r in rows.mapInPandas(moments, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value")).collect():
        found[r["label"], r["place"]] = r["value"]
    return discriminant(list(found[:, 0]), list(found[:, 1 : 1 + k]), [q.reshape(k, k) for q in found[:, 1 + k :]])


def score(measured: DataFrame, model: Discriminant) -> DataFrame:
    """``measured`` (of :func:`with_statistics`) with ``score`` for ``_stats``."""

    @F.pandas_udf("double")
    def scores(stats: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(stats.to_numpy())) if len(stats) else np.zeros(0))

    return measured.withColumn("score", scores("_stats")).drop("_stats")


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``documents``."""
    measured = stage(with_statistics(documents.select("doc_id", "text")), "statistics")
    held = F.coalesce(remainder(F.col("doc_id"), MOD) == HELD, F.lit(False))
    return score(measured, train(measured, labels)).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose text isn't scored as poor, with their columns."""
    measured = stage(with_statistics(documents.select("doc_id", "text")), "statistics")
    model = train(measured, labels)
    cols = [f for f in documents.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols)

    @tidy
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(batch.schema.get_field_index("text")))
            rows = [model.scores(statistics(part)) for _, part in slices(texts)]
            good = np.concatenate(rows) >= THRESHOLD if rows else np.zeros(0, bool)
            yield batch.filter(pa.array(good))

    return documents.mapInArrow(kept, schema)
