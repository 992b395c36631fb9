"""Target-distribution importance resampling over hashed word features, counted and scored in partition-local tries.

A feature is a run of 1 to ``longest`` consecutive words, joined by one blank; words are runs of digits, letters and
bytes above ASCII, A-Z lower-cased.  Every task builds a trie whose nodes are features: a node holds its count and
the CRC state of its bytes, so that a child's CRC goes on from its parent's.  Only totals of buckets leave a task;
their sums over corpus and target give each bucket's gain, and a second pass walks the tries again with gains
attached.  The draw is Gumbel top-k: score is weight plus noise that is fixed by seed and id, and the documents of
highest score are taken, ranked by a range partition with local numbers and one total a partition.

Null text has no features.  Repeated rows get equal scores and ranks of their own.  Null ids take part with the
noise of an empty id and come first among ties.  With an empty target the gains follow the corpus alone; an empty
corpus gives an empty result.  A trie of over ``MOST_NODES`` nodes is summed up and begun anew, so memory does not
grow with the vocabulary.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stage
from .textkit import buffers, slices, strings, tidy

LONGEST, BUCKETS, SEED = 1, 10_000, 2024
LEAST_WORDS, PERCENT = 20, 10
MOST_NODES = 1_000_000
_WORD = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes(c if c in _WORD else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


class _Children(dict):
    """Node numbers by (parent, word), new ones in the order of first sight."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Trie:
    """Features as nodes with count and CRC state; ``gains`` (by bucket), where given, is what a node adds to a weight."""

    def __init__(self, longest: int, buckets: int, gains: np.ndarray | None = None):
        self.longest, self.buckets, self.gains = longest, buckets, gains
        self.words = _Children()
        self.names: list[bytes] = []
        self.levels = [_Children() for _ in range(longest - 1)]
        self.state = [np.zeros(0, np.int64) for _ in range(longest)]
        self.count = [np.zeros(0, np.int64) for _ in range(longest)]

    @property
    def size(self) -> int:
        return len(self.words) + sum(map(len, self.levels))

    def _add(self, level: int, states: list[int]) -> None:
        self.state[level] = np.concatenate([self.state[level], np.array(states, np.int64)])
        self.count[level] = np.concatenate([self.count[level], np.zeros(len(states), np.int64)])

    def _paths(self, texts: list[list[bytes]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(level, text, node) of every feature, level by level from the root."""
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        look = self.words.__getitem__
        word = np.fromiter((n for t in texts for n in map(look, t)), np.int64, int(counts.sum()))
        if self.words.new:
            new, self.words.new = self.words.new, []
            self.names += new
            self._add(0, [zlib.crc32(w) for w in new])
        doc = np.repeat(np.arange(len(texts)), counts)
        node = word
        yield 0, doc, node
        left = np.repeat(np.cumsum(counts), counts) - np.arange(len(word))  # words from here to the end
        for level, children in enumerate(self.levels, 1):
            at = np.flatnonzero(left > level)
            key, which = np.unique((node[at] << 32) | word[at + level], return_inverse=True)
            found = np.fromiter(map(children.__getitem__, key.tolist()), np.int64, len(key))
            if children.new:
                new, children.new = children.new, []
                self._add(level, [zlib.crc32(b" " + self.names[k & 0xFFFFFFFF], int(self.state[level - 1][k >> 32])) for k in new])
            step = found[which]
            yield level, doc[at], step
            node = np.zeros(len(word), np.int64)
            node[at] = step

    def add(self, texts: list[list[bytes]]) -> None:
        """Count the features of ``texts``."""
        for level, _, node in self._paths(texts):
            self.count[level] += np.bincount(node, minlength=len(self.count[level]))

    def totals(self) -> np.ndarray:
        """Counts by bucket."""
        out = np.zeros(self.buckets, np.int64)
        for state, count in zip(self.state, self.count, strict=True):
            np.add.at(out, state % self.buckets, count)
        return out

    def weights(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(number of features, sum of gains) of each text."""
        n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for level, doc, node in self._paths(texts):
            n += np.bincount(doc, minlength=len(texts))
            np.add.at(total, doc, self.gains[self.state[level] % self.buckets][node])
        return n, total


def words(texts: pa.Array) -> list[list[bytes]]:
    """The words of every text (from :func:`strings`)."""
    raw, offsets = buffers(texts)
    data, at = raw.tobytes().translate(_FOLD), offsets.tolist()
    return [data[a:b].split() for a, b in zip(at, at[1:], strict=False)]


def bucket_totals(documents: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket; at most ``buckets`` rows leave a task."""

    @tidy
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, trie = np.zeros(buckets, np.int64), Trie(longest, buckets)
        for batch in batches:
            for _, part in slices(strings(batch.column(0))):
                trie.add(words(part))
                if trie.size > MOST_NODES:
                    out += trie.totals()
                    trie = Trie(longest, buckets)
        out += trie.totals()
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(out[at], pa.int64())], ["bucket", "n"])

    rows = documents.select("text").mapInArrow(counted, "bucket bigint, n bigint")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket: thousandths of the log ratio of smoothed shares, rounded down.

    ``buckets`` totals a side reach the driver, whatever the size of the tables.
    """
    sums = []
    for side in (corpus, target):
        n = np.zeros(buckets, np.int64)
        for r in bucket_totals(side, longest, buckets).collect():
            n[r.bucket] = r.n
        sums.append(n)
    (s, t), (all_s, all_t) = sums, (float(x.sum()) for x in sums)
    ratio = (t + 1.0) * (all_s + buckets) / ((s + 1.0) * (all_t + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weighed(documents: DataFrame, gain: np.ndarray, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row of ``documents``."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    @tidy
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(longest, buckets, gain)
        for batch in batches:
            for at, part in slices(strings(batch.column(1))):
                texts = words(part)
                n, weight = trie.weights(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(map(len, texts), pa.int64()), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])
                if trie.size > MOST_NODES:
                    trie = Trie(longest, buckets, gain)

    return documents.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id, seed: int = SEED):
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of the hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``documents``; rank is null for those not drawn.

    ``percent`` of the documents with at least ``least_words`` words are drawn, by highest score, then smallest id.
    """
    spark = documents.sparkSession
    gain = gains(documents, target, longest, buckets)
    scored = weighed(documents, gain, longest, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = stage(scored.withColumn("able", F.col("n_words") >= least_words), "scored")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("able"), F.desc("score"), F.asc("doc_id")]
    # The number of a row is its partition times 2**33 plus its place there; once written, it can't change.
    placed = scored.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = stage(placed, "placed", scored).withColumn("part", F.shiftright("place", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.count_if("able").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy()).alias("all"))
    at = F.col("base") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    drawn = F.col("able") & (at <= F.floor(F.lit(percent) * F.col("all") / 100))
    return placed.join(F.broadcast(totals), "part").select("doc_id", "n_words", "n_features", "weight", "score", F.when(drawn, at).alias("rank"))


def sample(documents: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The drawn rows of ``documents``, whole.  Rows of one id with several texts go by the id's best rank, all together."""
    drawn = resample(documents, target, **options).where("rank is not null").select(F.col("doc_id").alias("drawn_id")).distinct()
    return documents.join(drawn, documents["doc_id"].eqNullSafe(F.col("drawn_id")), "left_semi")
