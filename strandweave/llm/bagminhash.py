"""Near-duplicate documents: BagMinHash signatures, banding, verified multiset overlap.

A document is the multiset of its runs of ``SHINGLE`` lower-case words (fewer words: one run of them all).  An
element of weight w (its multiplicity) owns Poisson processes over discretised weight: one for each dyadic level
block (0,1], (1,2], (2,4], (4,8], ... that starts below w, with a rate of the block's width for every signature
place; points of the topmost block above w are thinned away.  A signature place keeps the earliest point that falls
on it, so two documents agree on a place with the probability of their weighted Jaccard similarity.  Processes are
generated for all elements of many documents at once, up to a time by which nearly every place is filled; documents
with an empty place go on to a later time.

Documents with equal word sequences are one class.  Classes that share a band of their signatures meet, and every
link is verified on the whole texts (sum of minima over sum of maxima at least ``SIMILARITY``): first each class
of a band's bucket with the bucket's smallest one, then, in buckets that still hold several components, all others
in blocks of bounded size.  Only links leave a task, at most one a class, so a bucket is never expanded to pairs.

Null text counts as empty; documents without words link with nothing.  A null doc_id is a document of its own.
Rows equal in doc_id and text are one document and get one row each with the same class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import free_name, stage
from .textkit import mix, runs, shingles, slices, strings, tidy, unit, words

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
PLACES = BANDS * ROWS
BLOCK = 128  #: classes in one part of a bucket
_ROUND = np.uint64(0xA0761D6478BD642F)


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, multiplicity) by text and hash, and a 64-bit key of each text's word sequence (0: no words)."""
    w = words(texts)
    n = len(texts)
    h, doc, _ = shingles(w, SHINGLE)
    bits = np.uint64(max(1, int(n).bit_length()))
    packed = np.sort((doc.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits))
    at, count = runs(packed)
    packed = packed[at]
    which = (packed >> (np.uint64(64) - bits)).astype(np.int64)
    with np.errstate(over="ignore"):
        low = packed & ((np.uint64(1) << (np.uint64(64) - bits)) - np.uint64(1))
        place = np.arange(len(w.hash)) - w.first[:-1][w.doc] if len(w.hash) else np.zeros(0, np.int64)
        each = mix(w.hash + place.astype(np.uint64) * _ROUND)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each)])
        key = mix(total[w.first[1:]] - total[w.first[:-1]] + np.diff(w.first).astype(np.uint64))
    key[np.diff(w.first) == 0] = 0
    # hashes must not depend on how many texts share a slice: the lowest 40 bits of any slice's share
    return which, low >> np.uint64(max(0, 64 - int(bits) - 40)), count, key


def signatures(which: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """BagMinHash signatures (n rows of PLACES 32-bit values); texts without elements keep zeros."""
    out = np.zeros((n, PLACES), np.uint32)
    total = np.bincount(which, weights=weight, minlength=n)
    todo = total > 0
    slack = 4.0
    with np.errstate(over="ignore", divide="ignore"):
        while todo.any():
            limit = np.where(todo, (np.log(PLACES) + slack) / np.maximum(total, 1), 0.0)
            own = todo[which]
            doc, seed, most = which[own], mix(shingle[own] ^ np.uint64(0x5851F42D4C957F2D)), weight[own]
            low, width = np.zeros(len(doc)), np.ones(len(doc))
            times, places, docs = [], [], []
            level = 0
            while len(doc):  # one level block at a time
                d, s, t, w = doc, mix(seed + np.uint64(level + 1) * _ROUND), np.zeros(len(doc)), most
                step = np.uint64(0)
                while len(d):  # the next point of every process that may still come early enough
                    step += np.uint64(1)
                    r = mix(s + step * np.uint64(0x9E3779B97F4A7C15))
                    t = t - np.log(unit(r)) / (width[0] * PLACES)
                    early = t < limit[d]
                    d, s, t, w, r = d[early], s[early], t[early], w[early], r[early]
                    r2 = mix(r ^ np.uint64(0xE7037ED1A0B428DB))
                    inside = low[0] + width[0] * unit(r2 * np.uint64(0x8EBC6AF09C88C6E3)) <= w
                    times.append(t[inside])
                    places.append((r2 >> np.uint64(32)) % np.uint64(PLACES))
                    places[-1] = places[-1][inside].astype(np.int64)
                    docs.append(d[inside])
                bottom = low[0] + width[0]
                on = most > bottom
                doc, seed, most = doc[on], seed[on], most[on]
                low, width = np.full(len(doc), bottom), np.full(len(doc), bottom)
                level += 1
            t, at = np.concatenate(times), np.concatenate(docs) * PLACES + np.concatenate(places)
            first = np.full(n * PLACES, np.inf)
            np.minimum.at(first, at, t)
            first = first.reshape(n, PLACES)
            full = todo & ~np.isinf(first).any(1)
            out[full] = (mix(first[full].view(np.uint64)) >> np.uint64(32)).astype(np.uint32)
            todo &= ~full
            slack = 3 * slack + 4
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """BANDS 64-bit keys a row."""
    with np.errstate(over="ignore"):
        key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None], len(signature), 0) * _ROUND
        parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
        for k in range(ROWS):
            key = mix(key + parts[:, :, k])
    return key.view(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima of two bags (sorted hashes, multiplicities)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / max(1, a[1].sum() + b[1].sum() - both))


def text_bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    column = strings(pa.array(texts, pa.large_string()), lower=True)
    out = []
    for _, part in slices(column):
        which, h, count, _ = bags(part)
        at = np.searchsorted(which, np.arange(len(part) + 1))
        out += [(h[s:e], count[s:e]) for s, e in zip(at, at[1:], strict=False)]
    return out


def signed(documents: DataFrame) -> DataFrame:
    """(doc_id, mark, key, bands) of every row of ``documents`` (doc_id, text, mark); ``key``, of the word sequence, is 0
    and ``bands`` empty without words."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    @tidy
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(strings(batch.column(1), lower=True)):
                which, h, count, key = bags(part)
                keys = band_keys(signatures(which, h, count, len(part)))
                size = np.where(key == 0, 0, BANDS)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), keys[key != 0].ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(2).slice(at, len(part)), pa.array(key.view(np.int64)), lists], ["doc_id", "mark", "key", "bands"])

    return documents.select("doc_id", "text", "mark").mapInArrow(made, f"doc_id {kind}, mark bigint, key bigint, bands array<bigint>")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts overlap enough."""
    x = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    y = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))

    @tidy
    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                first, where = np.unique(part["a"], return_index=True)
                left = dict(zip(first.tolist(), text_bags(part["text_a"].iloc[where].tolist()), strict=True))
                right = text_bags(part["text_b"].tolist())
                ok = [overlap(left[a], b) >= SIMILARITY for a, b in zip(part["a"].tolist(), right, strict=True)]
                yield part.loc[ok, ["a", "b"]]

    return pairs.join(x, "a").join(y, "b").select("a", "b", "text_a", "text_b").mapInPandas(kept, "a bigint, b bigint")


def forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links that join different components among the classes of one block (columns key, component, part, text).

    Classes of two parts are compared across parts, those of one part among themselves; a pair is compared only
    while its components are apart.
    """
    pdf = pdf.drop_duplicates("key").sort_values("key")
    keys, label, part = pdf["key"].tolist(), pdf["component"].tolist(), pdf["part"].tolist()
    own = text_bags(pdf["text"].tolist())
    total = [int(c.sum()) for _, c in own]
    parent: dict[int, int] = {}

    def root(k: int) -> int:
        while parent.setdefault(k, k) != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    two = len(set(part)) > 1
    links = []
    for i in range(len(keys)):
        for j in range(i):
            if two and part[i] == part[j] or min(total[i], total[j]) < SIMILARITY * max(total[i], total[j]):
                continue
            a, b = root(label[i]), root(label[j])
            if a != b and overlap(own[i], own[j]) >= SIMILARITY:
                parent[a] = b
                links.append((keys[i], keys[j]))
    return pd.DataFrame(links, columns=["a", "b"])


def _rest(mixed: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between classes of the buckets that still hold several components."""
    seats = mixed.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    sizes = seats.groupBy("band").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"), F.sum(F.col("key").cast("decimal(38,0)")).alias("sum"))
    sizes = sizes.where("low <> high").groupBy("size", "low", "high", "sum").agg(F.min("band").alias("band"))  # equal buckets once
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    seats = seats.join(sizes.select("band", "size"), "band").select("band", "key", "component", parts.alias("parts"), F.pmod(F.xxhash64("key", "band"), parts).cast("int").alias("part"))
    seats = seats.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    seats = seats.select("band", "key", "component", "part", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))
    rows = seats.join(texts.select("key", "text"), "key").repartition("band", "x", "y").sortWithinPartitions("band", "x", "y", "key")

    @tidy
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            mark = pdf[["band", "x", "y"]].to_numpy()
            at = np.flatnonzero(np.concatenate([[True], (mark[1:] != mark[:-1]).any(1)])) if len(mark) else np.zeros(0, int)
            for s, e in zip(at[:-1], at[1:], strict=True):
                yield forest(pdf.iloc[s:e])
            held = pdf.iloc[at[-1] :] if len(at) else None
        if held is not None and len(held):
            yield forest(held)

    return rows.select("band", "x", "y", "key", "component", "part", "text").mapInPandas(found, "a bigint, b bigint")


def _mark() -> Column:
    """A hash of a row's text: doc_id and mark name a document, also where a doc_id comes with several texts."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _classes(documents: DataFrame) -> DataFrame:
    """(doc_id, mark, key, class_id, kept) of every row of ``documents``."""
    docs = documents.select("doc_id", "text", _mark().alias("mark"))
    rows = stage(signed(docs), "signed")
    known = rows.where("key <> 0 and doc_id is not null")
    reps = known.groupBy("key").agg(F.min(F.struct("doc_id", "mark", "bands")).alias("r"))
    reps = stage(reps.select("key", F.col("r.doc_id").alias("doc_id"), F.col("r.mark").alias("mark"), F.col("r.bands").alias("bands")), "classes")
    bands = reps.select("key", F.explode("bands").alias("band"))
    buckets = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("key").alias("pivot")).where("n > 1")
    seats = stage(bands.join(buckets.select("band", "pivot"), "band"), "seats")
    pairs = stage(seats.where("key <> pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct(), "pairs")
    wanted = seats.select("key").distinct().join(reps.select("key", "doc_id", "mark"), "key")
    texts = stage(docs.join(wanted, ["doc_id", "mark"]).groupBy("key").agg(F.min("text").alias("text")), "texts")
    links = stage(_verified(pairs, texts), "star", pairs)
    labels = components(links)
    more = stage(_rest(seats.select("band", "key"), labels, texts), "rest", seats, texts)
    labels = components(links.union(more))
    named = reps.select("key", "doc_id").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    smallest = named.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("s"))
    classes = stage(named.join(smallest, "component").select("key", F.col("s.doc_id").alias("class_id"), F.col("s.key").alias("class_key")), "class", reps)
    own = rows.where("doc_id is not null and key <> 0").join(classes, "key")
    own = own.select("doc_id", "mark", "key", "class_id", (F.col("key").eqNullSafe(F.col("class_key")) & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))
    rest = rows.where("doc_id is null or key = 0").select("doc_id", "mark", "key", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return stage(own.union(rest), "named", rows, classes)


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id, kept) of every row: ``class_id`` is the smallest doc_id of its near-duplicate class.

    A row without words or id is its own class (``class_id`` is its doc_id) and is kept; of other classes the rows
    of the smallest doc_id are kept, and of those the ones with one word sequence.
    """
    return _classes(documents).select("doc_id", "class_id", "kept")


def keep_one(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that stay, one of each class, with their columns; of rows equal in doc_id and words one
    stays, and rows without id all do.  A doc_id with several texts keeps those that stand for a class."""
    found = _classes(documents)
    some = found.where("doc_id is not null and kept").groupBy("doc_id", "key").agg(F.min("mark").alias("low"), F.max("mark").alias("high"), F.count("*").alias("n")).where("n > 1")
    some = stage(some, "again")
    gone = found.where("not kept").select("doc_id", "mark")
    again = not some.isEmpty()
    if again:  # copies under one doc_id
        gone = gone.union(found.where("kept").join(some.where("low <> high"), ["doc_id", "key"]).where("mark <> low").select("doc_id", "mark"))
    own = free_name("_mark", documents.columns)
    gone = stage(gone.distinct().withColumnRenamed("mark", own), "gone", found)
    kept = documents.withColumn(own, _mark()).join(gone, ["doc_id", own], "left_anti")
    if again:
        once = kept.join(some.select("doc_id", F.col("low").alias(own)), ["doc_id", own]).dropDuplicates(["doc_id", own])
        kept = kept.join(some.select("doc_id", F.col("low").alias(own)), ["doc_id", own], "left_anti").unionByName(once)
    return kept.select(*[f"`{c}`" for c in documents.columns])
