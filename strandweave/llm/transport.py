"""Media columns as MPEG transport streams (ISO/IEC 13818-1).

``mux`` stores a payload in 188-byte packets: a program association and a program map table, then one private
elementary stream whose access units carry a presentation timestamp, a clock reference and, on every
``RANDOM_EVERY``-th unit, the random access mark.  ``demux`` reads such a stream back: it parses the tables (with
their checksums), checks the continuity counters, reassembles the elementary packets and lists timestamps and
random-access points.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import slices, strings, tidy

PACKET, UNIT, PTS_STEP, RANDOM_EVERY = 188, 16384, 3600, 8
PID_PAT, PID_PMT, PID_ES, STREAM_TYPE, STREAM_ID = 0, 0x1000, 0x100, 0x06, 0xBD
BLOCK = 64


@lru_cache(maxsize=64)
def section_crc(data: bytes) -> int:
    """CRC-32 of a table section (polynomial 0x04C11DB7, most significant bit first)."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | (len(body) + 9), ident, 0xC1, 0, 0) + body
    return head + struct.pack(">I", section_crc(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10) + b"\0" + section).ljust(PACKET, b"\xff")


@lru_cache(maxsize=1)
def _tables() -> bytes:
    pat = _section(0, 1, struct.pack(">HH", 1, 0xE000 | PID_PMT))
    pmt = _section(2, 1, struct.pack(">HH", 0xE000 | PID_ES, 0xF000) + struct.pack(">BHH", STREAM_TYPE, 0xE000 | PID_ES, 0xF000))
    return _table_packet(PID_PAT, pat) + _table_packet(PID_PMT, pmt)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def mux(payload: bytes) -> bytes:
    """The transport stream of ``payload`` (at least one byte)."""
    out, counter = [_tables()], 0
    for n, at in enumerate(range(0, max(len(payload), 1), UNIT)):
        chunk = payload[at : at + UNIT]
        pts = n * PTS_STEP & (1 << 33) - 1
        pes = b"\0\0\1" + bytes([STREAM_ID]) + struct.pack(">H", len(chunk) + 8) + b"\x84\x80\x05" + _stamp(pts) + chunk
        # the first packet: adaptation field with marks and the clock reference, stuffed if the unit is tiny
        room = PACKET - 4 - 8
        pad = max(0, room - len(pes))
        marks = 0x10 | (0x40 if n % RANDOM_EVERY == 0 else 0)
        clock = struct.pack(">IH", pts >> 1, (pts & 1) << 15 | 0x7E00)
        out.append(struct.pack(">BHBBB", 0x47, 0x4000 | PID_ES, 0x30 | counter, 7 + pad, marks) + clock + b"\xff" * pad + pes[:room])
        counter = counter + 1 & 15
        rest = pes[room:]
        whole = len(rest) // 184
        if whole:
            body = np.empty((whole, PACKET), np.uint8)
            body[:, 0], body[:, 1], body[:, 2] = 0x47, PID_ES >> 8, PID_ES & 255
            body[:, 3] = 0x10 | (counter + np.arange(whole)) % 16
            body[:, 4:] = np.frombuffer(rest, np.uint8, whole * 184).reshape(whole, 184)
            out.append(body.tobytes())
            counter = (counter + whole) % 16
        if tail := rest[whole * 184 :]:
            fill = 184 - len(tail)
            field = b"\0" if fill == 1 else bytes([fill - 1, 0]) + b"\xff" * (fill - 2)
            out.append(struct.pack(">BHB", 0x47, PID_ES, 0x30 | counter) + field + tail)
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    payload: bytes
    programs: dict[int, int]  #: program number: PID of its map
    streams: dict[int, int]  #: PID: stream type
    units: int
    stamps: list[int]
    random_access: list[int]  #: units that a reader may start at
    counter_errors: int  #: gaps in the continuity counters, and a stream that does not begin with a start
    packets: int
    damaged: list[int]  #: units whose length is not the announced one


def _parse_section(packet: np.ndarray) -> bytes:
    raw = packet.tobytes()
    start = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
    start += 1 + raw[start]
    size = 3 + (struct.unpack(">H", raw[start + 1 : start + 3])[0] & 0xFFF)
    section = raw[start : start + size]
    if section_crc(section[:-4]) != struct.unpack(">I", section[-4:])[0]:
        raise ValueError("a table's checksum is wrong")
    return section[8:-4]


def demux(media: bytes) -> Stream:
    """Parse a transport stream.

    Lost packets show in ``counter_errors`` and ``damaged``; a packet that is sent twice counts once.  Lost sync, wrong
    checksums and missing start codes raise ValueError.
    """
    if not media or len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != 0x47).any():
        raise ValueError("a packet's sync byte is missing")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    begins = (p[:, 1] & 0x40) > 0
    programs: dict[int, int] = {}
    streams: dict[int, int] = {}
    for row in p[(pid == PID_PAT) & begins]:
        body = _parse_section(row)
        programs |= {n: m & 0x1FFF for n, m in struct.iter_unpack(">HH", body) if n}
    for at in programs.values():
        for row in p[(pid == at) & begins]:
            body = _parse_section(row)
            place = 4 + (struct.unpack(">H", body[2:4])[0] & 0xFFF)
            while place < len(body):
                kind, es, info = struct.unpack(">BHH", body[place : place + 5])
                streams[es & 0x1FFF] = kind
                place += 5 + (info & 0xFFF)
    payload, stamps, access, errors, units, damaged = [], [], [], 0, 0, []
    for es in streams:
        own = p[pid == es]
        has = (own[:, 3] & 0x10) > 0
        same = np.zeros(len(own), bool)  # a packet may be sent twice in a row
        same[1:] = (own[1:] == own[:-1]).all(1) & has[1:]
        same[2:] &= ~same[1:-1]
        own, has = own[~same], has[~same]
        first = (own[:, 1] & 0x40) > 0
        counter = (own[:, 3] & 15).astype(np.int32)[has]
        errors += int(((np.diff(counter) - 1) % 16 != 0).sum())
        lost = int(first.argmax()) if first.any() else len(own)  # packets before the first start belong to no unit
        errors += lost > 0
        own, first, has = own[lost:], first[lost:], has[lost:]
        adaptation = (own[:, 3] & 0x20) > 0
        start = np.where(adaptation, 5 + own[:, 4].astype(np.int32), 4)
        start[~has] = PACKET
        marks = np.where(adaptation & (own[:, 4] > 0), own[:, 5], 0)
        size = PACKET - start
        data = own[np.arange(PACKET) >= start[:, None]].tobytes()
        at = np.append((np.cumsum(size) - size)[first], len(data))
        for k, marked in enumerate(marks[first]):
            pes = memoryview(data)[at[k] : at[k + 1]]
            if pes[:3] != b"\0\0\1":
                raise ValueError("an elementary packet's start code is missing")
            if len(pes) != 6 + struct.unpack(">H", pes[4:6])[0]:
                damaged.append(units)
            if pes[7] & 0x80:
                stamps.append((pes[9] >> 1 & 7) << 30 | pes[10] << 22 | (pes[11] >> 1) << 15 | pes[12] << 7 | pes[13] >> 1)
            if marked & 0x40:
                access.append(units)
            payload.append(bytes(pes[9 + pes[8] :]))
            units += 1
    return Stream(b"".join(payload), programs, streams, units, stamps, access, errors, len(p), damaged)


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with zeros up to a positive multiple of 64, and the length before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b"\0"), len(raw)


def encode_media(documents: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``documents`` but ``text``, with ``n_bytes`` and the transport stream ``media``.

    Null text counts as empty; an empty text is one block of zeros.  Rows are independent, so repeated rows give
    equal streams.  Columns named ``n_bytes`` or ``media`` are replaced.
    """
    rest = [f for f in documents.schema.fields if f.name not in (text, "n_bytes", "media")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "n_bytes bigint, media binary"])

    @tidy
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(strings(batch.column(0)), 1 << 24):
                stored = [padded(t) for t in part.to_pylist()]
                own = [c.slice(at, len(part)) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*own, pa.array([n for _, n in stored], pa.int64()), pa.array([mux(b) for b, _ in stored], pa.binary())], [*(f.name for f in rest), "n_bytes", "media"])

    return documents.select(f"`{text}`", *[f"`{f.name}`" for f in rest]).mapInArrow(made, schema)


def features(stream: Stream) -> str:
    """What the stored form says of itself, in a fixed order."""
    counts = np.bincount(np.frombuffer(stream.payload, np.uint8), minlength=256)
    share = counts[counts > 0] / max(1, counts.sum())
    entropy = float(-(share * np.log2(share)).sum())
    return f"packets={stream.packets};units={stream.units};random={len(stream.random_access)};pts={stream.stamps[0] if stream.stamps else ''}-{stream.stamps[-1] if stream.stamps else ''};errors={stream.counter_errors};type={','.join(map(str, stream.streams.values()))};entropy={entropy:.6f}"


FOUND = {"payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string", "units": "int", "random_access": "array<int>", "first_pts": "bigint", "last_pts": "bigint", "counter_errors": "int", "damaged": "array<int>"}


def read_media(media: DataFrame) -> DataFrame:
    """Digests and features of the column ``media``, from the bytes that its streams give back.

    Other columns stay, but for those that have a name of ``FOUND``; null media counts as no bytes and raises.
    """
    rest = [f for f in media.schema.fields if f.name != "media" and f.name not in FOUND]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), *(f"{n} {t}" for n, t in FOUND.items())])

    def row(m: bytes) -> tuple:
        x = demux(m)
        ends = (x.stamps[0], x.stamps[-1]) if x.stamps else (None, None)
        return len(x.payload), hashlib.sha256(x.payload).hexdigest(), zlib.crc32(x.payload[-BLOCK:]), len(m), hashlib.sha256(m).hexdigest(), features(x), x.units, x.random_access, *ends, x.counter_errors, x.damaged

    kinds = [{"bigint": pa.int64(), "string": pa.string(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}[t] for t in FOUND.values()]

    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(m.as_py()) for m in batch.column(0)]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*(f.name for f in rest), *FOUND])

    return media.select("media", *[f"`{f.name}`" for f in rest]).mapInArrow(read, schema)
