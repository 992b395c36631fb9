"""Packing documents into sequences of at most ``capacity`` tokens by minimum bin slack.

A document's ids (and the end id) are cut into full windows and one rest; full windows fill sequences alone.  The
rests differ only by their length, so the whole corpus is described by a histogram of at most ``capacity - 1``
counts.  From it a plan is made: the longest rest opens a window, a bitset of reachable sums over the remaining
multiset finds the filling with least slack, its counts are read back, and the filling is used as often as the
counts allow.  A rest then finds its place from its length and its rank among rests of that length, both computed
with bucketed running sums, so nothing but the histogram leaves the executors.

Null text counts as empty: such a document is its end id alone.  Repeated and null doc_ids are separate documents.
An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import default_path, encoder
from .ranks import buckets_for, positions
from .store import stage
from .textkit import slices, strings, tidy

CAPACITY, END_ID = 1024, 0
PIECES = "array<struct<start: bigint, length: bigint, ids_crc32: bigint>>"


def cut(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The columns of ``documents`` but ``text``, with ``doc_tokens`` and the cut ``pieces``."""
    rest = [f for f in documents.schema.fields if f.name not in ("text", "doc_tokens", "pieces")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"doc_tokens bigint, pieces {PIECES}"])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    @tidy
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            count, start, length, crc, edges = [], [], [], [], [0]
            for _, part in slices(strings(batch.column(batch.schema.get_field_index("text"))), 1 << 22):
                ids, sizes = enc.encode(part.to_pylist())
                at = 0
                for n in sizes.tolist():
                    whole = np.append(ids[at : at + n], END_ID).astype("<u4")
                    at += n
                    count.append(n + 1)
                    for s in range(0, n + 1, capacity):
                        piece = whole[s : s + capacity]
                        start.append(s)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece))
                    edges.append(len(start))
            inner = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], fields=list(kind.value_type))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(count, pa.int64()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), inner)], [*(f.name for f in rest), "doc_tokens", "pieces"])

    return documents.select(*[f"`{f.name}`" for f in rest], "text").mapInArrow(pieces, schema)


def fillings(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """The plan: ([(length, how many in a window)], how many such windows), until no rest is left.

    Every filling uses up at least one length, so there are at most as many fillings as lengths.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    plan = []
    while left:
        top = max(left)
        room = capacity - top
        stock = dict(left)
        stock[top] -= 1
        # bitset of reachable sums, one step a length; stop once the window can be filled exactly
        bits, steps, mask = 1, [], (1 << room + 1) - 1
        for n in sorted((n for n, c in stock.items() if c and n <= room), reverse=True):
            before = bits
            for _ in range(min(stock[n], room // n)):
                grown = (bits | bits << n) & mask
                if grown == bits:
                    break
                bits = grown
            steps.append((n, before))
            if bits >> room & 1:
                break
        total = bits.bit_length() - 1
        used: dict[int, int] = {top: 1}
        for n, before in reversed(steps):
            k = 0
            while not before >> total & 1:  # the fewest copies of n that lead back to a sum reached without it
                total -= n
                k += 1
            if k:
                used[n] = used.get(n, 0) + k
        times = min(left[n] // k for n, k in used.items())
        plan.append((sorted(used.items(), reverse=True), times))
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return plan


def pack(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    spark = documents.sparkSession
    docs = stage(cut(documents.select("doc_id", "text"), path or default_path(), capacity), "cut")
    buckets = buckets_for(docs.count())
    # a rest's rank among rests of its length, and a full window's rank among full windows
    docs = docs.withColumns({"_rest": F.col("doc_tokens") % capacity, "_full": F.floor(F.col("doc_tokens") / capacity), "_tie": F.col("pieces")[0]["ids_crc32"]})
    docs = positions(docs, ["doc_id", "doc_tokens", "_tie"], F.col("_full"), "_full_rank", buckets)
    docs = docs.withColumn("_local", F.row_number().over(Window.partitionBy("_bucket", "_rest").orderBy("doc_id", "doc_tokens", "_tie")) - 1)
    docs = stage(docs, "ranked")
    by_bucket = docs.groupBy("_rest", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_rest").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = by_bucket.select("_rest", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    histogram = {r["_rest"]: r["n"] for r in docs.groupBy("_rest").agg(F.count("*").alias("n")).collect() if r["_rest"]}  # at most capacity - 1 rows
    plan = fillings(histogram, capacity)

    intervals: dict[int, list[tuple[int, int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for filling, times in plan:
        offset = 0
        for n, k in filling:
            low = taken.get(n, 0)
            intervals.setdefault(n, []).append((low, low + k * times, base, k, offset))
            taken[n] = low + k * times
            offset += n * k
        base += times
    schema = "_rest bigint, _places array<struct<low: bigint, high: bigint, base: bigint, k: bigint, offset: bigint>>"
    places = F.broadcast(spark.createDataFrame([(n, v) for n, v in intervals.items()], schema))  # at most capacity - 1 rows, a few intervals each

    placed = docs.join(by_bucket, ["_rest", "_bucket"]).join(places, "_rest", "left")
    placed = placed.withColumn("_rank", F.col("_base") + F.col("_local"))
    placed = placed.withColumn("_at", F.expr("filter(_places, x -> _rank >= x.low and _rank < x.high)[0]"))
    rows = placed.select("doc_id", "doc_tokens", "_full_rank", "_rank", "_at", F.posexplode("pieces").alias("_n", "_piece"))
    full = F.col("_piece.length") == capacity
    nth = F.col("_rank") - F.col("_at.low")
    return rows.select(
        "doc_id",
        F.col("_piece.start").alias("start"),
        F.col("_piece.length").alias("length"),
        F.col("_piece.ids_crc32").alias("ids_crc32"),
        "doc_tokens",
        F.when(full, F.lit(base) + F.col("_full_rank") + F.col("_n")).otherwise(F.col("_at.base") + F.floor(nth / F.col("_at.k"))).alias("sequence_id"),
        F.when(full, F.lit(0)).otherwise(F.col("_at.offset") + nth % F.col("_at.k") * F.col("_piece.length")).cast("long").alias("offset"),
    )
