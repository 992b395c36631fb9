"""Token shards in training order.

Every document's ids (and the end id) are cut into sequences of ``length`` ids, padded with the end id.  With N
sequences in all, a keyed Feistel network over the next even power of two, walked until it lands below N, is a
permutation of 0..N-1 and names each sequence's global slot.  Rows are dealt by slot range, and each shard is one
run of fixed-stride records (16-bit little-endian ids behind a 24-byte head), so a reader finds slot s at byte
``(s % slots) * stride`` of shard ``s // slots`` and can resume anywhere.

Null text counts as empty: one sequence with the end id alone.  Repeated and null doc_ids are separate documents.
An empty table gives no shards; a vocabulary whose ids do not fit in 16 bits raises an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_path, encoder
from .packing import END_ID
from .store import stage
from .textkit import slices, strings

LENGTH, SLOTS, KEY, ROUNDS = 512, 256, 0x5EED_2024, 6
TASK_BYTES = 32 << 20  #: of records in a writing task, about
HEAD = "<qqii"  #: doc_id (-1: null), start, ids that are not padding, 1 if the document has an id


def stride(length: int = LENGTH) -> int:
    return struct.calcsize(HEAD) + 2 * length


def feistel(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The keyed permutation of 0..n-1 at ``index``."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = np.array(index, np.uint64)
    todo = np.ones(len(out), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            x = out[todo]
            left, right = x >> np.uint64(half), x & mask
            for r in range(ROUNDS):
                f = (right + np.uint64(key + 0x9E3779B9 * (r + 1))) * np.uint64(0xBF58476D1CE4E5B9)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ (f >> np.uint64(32)) & mask
            out[todo] = left << np.uint64(half) | right
            todo &= out >= np.uint64(n)
    return out.astype(np.int64)


def sequences(documents: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """(doc_id, n, tokens, part, before): a document's number of sequences and 16-bit ids, end id included, the
    partition that it was read in and the number of sequences before it there."""
    path = path or default_path()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part_id, before = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            n, tokens = [], []
            for _, part in slices(strings(batch.column(1)), 1 << 22):
                ids, sizes = enc.encode(part.to_pylist())
                at = 0
                for size in sizes.tolist():
                    if size and ids[at : at + size].max() > 0xFFFF:
                        raise ValueError("the vocabulary has ids above 65,535, which do not fit in 16 bits")
                    tokens.append(np.append(ids[at : at + size], END_ID).astype("<u2").tobytes())
                    n.append(-(-(size + 1) // length))
                    at += size
            n = np.array(n, np.int64)
            first = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(tokens, pa.binary()), pa.array(np.full(len(n), part_id)), pa.array(first)], ["doc_id", "n", "tokens", "part", "before"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(made, f"doc_id {kind}, n bigint, tokens binary, part bigint, before bigint")


def materialise(documents: DataFrame, path: str | None = None, length: int = LENGTH, slots: int = SLOTS, key: int = KEY) -> DataFrame:
    """One row a shard: (shard_id, first_slot, n_slots, stride, doc_ids, payload, crc32).

    The ids are written to the shared folder once; from then on every sequence's place is fixed.  Only one number
    a partition (its sequences) comes to the driver.
    """
    docs = stage(sequences(documents, path, length), "tokens")
    sums = {r["part"]: r["n"] for r in docs.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    bases, total = {}, 0
    for part in sorted(sums):
        bases[part], total = total, total + sums[part]
    shards = -(-total // slots)
    tasks = max(1, min(shards, -(-total * stride(length) // TASK_BYTES)))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at : at + 1024]
                n = part["n"].to_numpy()
                ends = np.cumsum(n)
                j = np.arange(ends[-1]) - np.repeat(ends - n, n)
                slot = feistel(np.repeat(part["part"].map(bases).to_numpy() + part["before"].to_numpy(), n) + j, total, key)
                records, place = [], 0
                for doc_id, tokens in zip(part["doc_id"], part["tokens"], strict=True):
                    known = doc_id is not None and doc_id == doc_id
                    for start in range(0, len(tokens) // 2, length):
                        ids = tokens[2 * start : 2 * (start + length)]
                        records.append(struct.pack(HEAD, int(doc_id) if known else -1, start, len(ids) // 2, int(known)) + ids.ljust(2 * length, END_ID.to_bytes()))
                        place += 1
                yield pd.DataFrame({"slot": slot, "task": slot // slots * tasks // shards, "record": records})

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted records to whole shards; a shard's records all lie in this task."""
        shard, records = None, []

        def row() -> pd.DataFrame:
            payload = b"".join(records)
            ids = [x[0] if x[3] else None for x in (struct.unpack_from(HEAD, r) for r in records)]
            return pd.DataFrame({"shard_id": [shard], "first_slot": [shard * slots], "n_slots": [len(records)], "stride": [stride(length)], "doc_ids": [ids], "payload": [payload], "crc32": [zlib.crc32(payload)]})

        for pdf in batches:
            for own, record in zip((pdf["slot"] // slots).tolist(), pdf["record"], strict=True):
                if own != shard:
                    if records:
                        yield row()
                    shard, records = own, []
                records.append(record)
        if records:
            yield row()

    rows = docs.mapInPandas(placed, "slot bigint, task int, record binary").repartitionById(tasks, F.col("task"))
    return rows.sortWithinPartitions("slot").select("slot", "record").mapInPandas(joined, "shard_id bigint, first_slot bigint, n_slots int, stride int, doc_ids array<bigint>, payload binary, crc32 bigint")


def read_slots(shards: DataFrame, first: int, count: int, slots: int = SLOTS) -> DataFrame:
    """(slot, doc_id, start, n_ids, ids) of slots first .. first + count - 1: only their shards are read."""
    wanted = shards.where(F.col("shard_id").between(first // slots, (first + count - 1) // slots))

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                rows = []
                for k in range(max(0, first - r.first_slot), min(r.n_slots, first + count - r.first_slot)):
                    doc_id, start, n, known = struct.unpack_from(HEAD, r.payload, k * r.stride)
                    ids = np.frombuffer(r.payload, "<u2", n, k * r.stride + struct.calcsize(HEAD))
                    rows.append((r.first_slot + k, doc_id if known else None, start, n, ids.astype(np.int32).tolist()))
                yield pd.DataFrame(rows, columns=["slot", "doc_id", "start", "n_ids", "ids"])

    return wanted.mapInPandas(unpacked, "slot bigint, doc_id bigint, start bigint, n_ids int, ids array<int>")
