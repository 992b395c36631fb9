"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct character n-grams (4 to 6 code points, lower case, white space as one blank,
a blank before and after) of the whole text, hashed into ``2**BITS`` bins.  Each selected bin's presence is scaled
by the log ratio of its smoothed rates in toxic and other texts, and a logistic model is fitted on the scaled
presences.  ``MAX_PER_CLASS`` labelled rows of each class at most, taken in hash order of their ids, are used for
fitting; every row is scored.

Null text counts as empty.  An empty text has only the model's intercept.  Repeated rows get equal scores.  With
no teaching rows of both classes every score is the smoothed share of toxic teaching rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import remainder, teaching
from .textkit import slices, strings, tidy

ORDERS = (4, 5, 6)
BITS = 20
MAX_PER_CLASS = 3000
MAX_FEATURES = 4096
LEAST_Z = 4.0
THRESHOLD = 0.7
MOD, HELD = 3, 1
_MUL, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def ngram_bins(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bin) pairs, by text and bin; only bins of the mask ``wanted``, if given."""
    padded = [f" {t} " for t in texts.to_pylist()]
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    points[points <= 32] = 32
    doc = np.repeat(np.arange(len(padded)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(points))
    keys = []
    with np.errstate(over="ignore"):
        h = points.copy()
        for n in range(2, max(ORDERS) + 1):
            h = h[:-1] * _STEP + points[n - 1 :]
            if n in ORDERS and len(h):
                bins = (((h ^ (h >> np.uint64(29))) * _MUL) >> np.uint64(64 - BITS)).astype(np.int64)
                ok = left[: len(h)] >= n
                if wanted is not None:
                    ok &= wanted[bins]
                keys.append((doc[: len(h)][ok] << BITS) | bins[ok])
    found = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return found >> BITS, found & ((1 << BITS) - 1)


def _sampled(texts: list[pa.Array], wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bin) pairs of all columns, a slice at a time, so that memory follows the slice and not the sample."""
    base = 0
    for column in texts:
        for first, part in slices(column):
            doc, bins = ngram_bins(part, wanted)
            yield doc + base + first, bins
        base += len(column)


def fit(texts: list[pa.Array], labels: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(bins, their weights, intercept) from the sampled texts; ``prior`` is the share of label 1 before sampling."""
    y = labels == 1
    n1, n0 = int(y.sum()), int((~y).sum())
    in1, in0 = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for doc, bins in _sampled(texts):  # counts first; features are read again once they are chosen
        in1 += np.bincount(bins[y[doc]], minlength=1 << BITS)
        in0 += np.bincount(bins[~y[doc]], minlength=1 << BITS)
    ratio = np.log((in1 + 0.5) / (n1 + 1)) - np.log((in0 + 0.5) / (n0 + 1))
    z = np.abs(ratio) / np.sqrt(1 / (in1 + 0.5) + 1 / (in0 + 0.5))
    z[(in1 + in0 < 5) | (z < LEAST_Z)] = 0
    kept = np.sort(np.argsort(-z, kind="stable")[: min(MAX_FEATURES, int((z > 0).sum()))])
    odds = float(np.log(prior / (1 - prior)))
    if not len(kept):
        return kept, np.zeros(0), odds
    place = np.full(1 << BITS, -1)
    place[kept] = np.arange(len(kept))
    x = np.zeros((len(y), len(kept)), np.float32)
    for doc, bins in _sampled(texts, place >= 0):
        x[doc, place[bins]] = ratio[bins]
    weight = np.where(y, prior / n1, (1 - prior) / n0)
    w, b, m, v = np.zeros(len(kept)), odds, np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for step in range(1, 301):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + b, -40, 40)))
        e = weight * (p - y)
        g = np.append(x.T @ e.astype(np.float32) + 2e-4 * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return kept, w * ratio[kept], float(b)


class Model:
    """Bins, weights and intercept; scores Arrow string columns."""

    def __init__(self, bins: np.ndarray, weights: np.ndarray, bias: float):
        self.bins, self.weights, self.bias = bins, weights, bias

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        full = np.zeros(1 << BITS)
        full[self.bins] = self.weights
        return full, full != 0

    def scores(self, texts: pa.Array, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        full, wanted = table
        out = np.full(len(texts), self.bias)
        for first, part in slices(texts):
            doc, bins = ngram_bins(part, wanted)
            out[first : first + len(part)] += np.bincount(doc, weights=full[bins], minlength=len(part))
        return 1 / (1 + np.exp(-np.clip(out, -700, 700)))


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Fit on the bounded sample, inside one task; only the bounded weights come to the driver."""
    known = teaching(labels, label, MOD, HELD)
    count = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(count.values())
    prior = (count.get(1, 0) + 0.5) / (total + 1)
    if len(count) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    order = F.xxhash64("doc_id")
    part = [known.where(F.col("label") == c).orderBy(order, "doc_id").limit(MAX_PER_CLASS) for c in (0, 1)]
    chosen = part[0].union(part[1])  # 2 * MAX_PER_CLASS rows at most
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).select("text", "label")  # one text an id

    @tidy
    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for batch in batches:
            texts.append(strings(batch.column(0), lower=True))
            y.append(batch.column(1).to_numpy(zero_copy_only=False))
        known = np.concatenate(y) if y else np.zeros(0, np.int32)
        both = len(set(known.tolist())) == 2
        bins, w, b = fit(texts, known, prior) if both else (np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
        yield pa.RecordBatch.from_pydict({"bins": [bins.tolist()], "weights": [w.tolist()], "bias": [b]})

    found = rows.repartition(1).mapInArrow(fitted, "bins array<bigint>, weights array<double>, bias double").first()
    if found is None:  # no teaching row has a document
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    return Model(np.array(found["bins"], np.int64), np.array(found["weights"], float), found["bias"])


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with ``score``; every text is read whole, and no column but ``text`` is looked at."""
    rest = [f for f in documents.schema.fields if f.name != "score"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", score double"

    @tidy
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            s = model.scores(strings(batch.column(batch.schema.get_field_index("text")), lower=True), table)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], [*batch.schema.names, "score"])

    return documents.select(*[f"`{f.name}`" for f in rest]).mapInArrow(scored, schema)


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``documents``."""
    slim = score(documents.select("doc_id", "text"), train(documents, labels)).select("doc_id", "score")
    held = F.coalesce(remainder(F.col("doc_id"), MOD) == HELD, F.lit(False))
    return slim.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose text isn't scored as toxic, with their columns."""
    model = train(documents, labels)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)

    @tidy
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            s = model.scores(strings(batch.column(batch.schema.get_field_index("text")), lower=True), table)
            yield batch.filter(pa.array(s < THRESHOLD))

    return documents.mapInArrow(kept, schema)


def brute_scores(texts: list[str], model: Model) -> list[float]:
    """One text at a time with plain sets, for tests."""
    full = dict(zip(model.bins.tolist(), model.weights.tolist(), strict=True))
    out = []
    for t in texts:
        t = "".join(" " if ord(c) <= 32 else c for c in f" {t} ")
        bins = set()
        for n in ORDERS:
            for i in range(len(t) - n + 1):
                h = 0
                for c in t[i : i + n]:
                    h = (h * int(_STEP) + ord(c)) % 2**64
                bins.add((((h ^ (h >> 29)) * int(_MUL)) % 2**64) >> (64 - BITS))
        out.append(1 / (1 + np.exp(-(model.bias + sum(full.get(b, 0.0) for b in bins)))))
    return out


__all__ = ["Model", "brute_scores", "drop_toxic", "fit", "ngram_bins", "score", "toxicity", "train"]
