"""Ogg media columns: bytes kept as 8-bit samples in multiplexed logical streams, and a reader for such containers.

The reader verifies each page's checksum, reassembles packets from lacing values (also across pages), demultiplexes
the logical streams by serial number, and derives timestamps from granule positions.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Bytes in a packet, samples a second, and logical streams; packet i belongs to stream i mod STREAMS.
PACKET, RATE, STREAMS = 576, 8000, 2
MAGIC = b"\x01raw8"
_PAGE = struct.Struct("<4sBBqIIIB")
_HEAD = struct.Struct("<5sBBIQI")  # magic, stream, streams, rate, payload bytes, bytes in a packet
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
CONTINUED, FIRST, LAST = 1, 2, 4
#: A granule position of -1: no packet ends on the page.
NO_PACKET = -1


def crc(page: bytes) -> int:
    """The container's checksum: polynomial 0x04c11db7, most significant bit first, from zero and without a final xor.

    zlib's has the same polynomial with mirrored bits, other start and end values.
    """
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = lambda check: _PAGE.pack(b"OggS", 0, flags, granule, serial, number, check, len(lacing)) + lacing
    return head(crc(head(0) + body)) + body


def laced(n: int) -> bytes:
    """The lacing values of a packet of n bytes."""
    return b"\xff" * (n // 255) + bytes([n % 255])


def pages(packets: list[bytes], serial: int, granules: list[int]) -> list[bytes]:
    """One logical stream: the first packet on a page of its own, the others packed into pages of up to 255 segments.

    A packet that doesn't fit goes on in the next page. granules: the position at the end of each packet.
    """
    out: list[bytes] = []
    lacing, body, granule, flags = bytearray(), bytearray(), NO_PACKET, FIRST

    def close(last: int = 0) -> None:
        out.append(page(flags | last, granule, serial, len(out), bytes(lacing), bytes(body)))

    for i, packet in enumerate(packets):
        values, at = laced(len(packet)), 0
        while True:
            room = min(255 - len(lacing), len(values))
            taken = sum(values[:room])
            lacing += values[:room]
            body += packet[at : at + taken]
            at += taken
            values = values[room:]
            if not values:
                granule = granules[i]
            more = i + 1 < len(packets)
            if values or (more and (i == 0 or len(lacing) == 255)):
                close()
                lacing, body, granule, flags = bytearray(), bytearray(), NO_PACKET, CONTINUED if values else 0
            if not values:
                break
    close(LAST)
    return out


def write(payload: bytes, packet: int = PACKET, streams: int = STREAMS, rate: int = RATE) -> bytes:
    """payload as 8-bit samples, packet by packet in turn over the logical streams; first all header pages, then the others in turn."""
    parts = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    each = []
    for s in range(streams):
        own = parts[s::streams]
        ends = np.cumsum([0, *map(len, own)]).tolist()
        each.append(pages([_HEAD.pack(MAGIC, s, streams, rate, len(payload), packet), *own], s + 1, ends))
    longest = max(map(len, each))
    return b"".join(p[k] for k in range(longest) for p in each if k < len(p))


class Damaged(ValueError):
    """A container whose bytes break the format's rules."""


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: Granule position of the page on which a packet ends, as the last packet to end there; otherwise None.
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    _open: bytearray | None = None


def scan(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, memoryview]]:
    """(flags, granule, serial, number, lacing, body) of each page, checksums verified."""
    view, at = memoryview(media), 0
    while at < len(view):
        if len(view) - at < _PAGE.size:
            raise Damaged(f"cut short at byte {at}")
        mark, version, flags, granule, serial, number, check, n = _PAGE.unpack_from(view, at)
        if mark != b"OggS" or version:
            raise Damaged(f"no page at byte {at}")
        body = at + _PAGE.size + n
        lacing = bytes(view[at + _PAGE.size : body])
        end = body + sum(lacing)
        if len(lacing) < n or end > len(view):
            raise Damaged(f"cut short in the page at byte {at}")
        if crc(b"".join((view[at : at + 22], b"\0\0\0\0", view[at + 26 : end]))) != check:
            raise Damaged(f"wrong checksum of the page at byte {at}")
        yield flags, granule, serial, number, lacing, view[body:end]
        at = end


def demultiplex(media: bytes) -> dict[int, Stream]:
    """Logical streams by serial number, in order of their first pages."""
    found: dict[int, Stream] = {}
    for flags, granule, serial, number, lacing, body in scan(media):
        if flags & FIRST:
            if serial in found:
                raise Damaged(f"stream {serial} begins twice")
            found[serial] = Stream(serial)
        s = found.get(serial)
        if s is None or s.ended or number != s.pages or bool(flags & CONTINUED) != (s._open is not None):
            raise Damaged(f"page {number} of stream {serial} is out of order")
        s.pages += 1
        at, packet, before = 0, s._open if s._open is not None else bytearray(), len(s.packets)
        run = 0
        for v in lacing:
            run += v
            if v < 255:
                packet += body[at : at + run]
                s.packets.append(bytes(packet))
                s.granules.append(None)
                at, run, packet = at + run, 0, bytearray()
        if run or (lacing and lacing[-1] == 255):
            packet += body[at : at + run]
            s._open = packet
        else:
            s._open = None
        if len(s.packets) > before:
            s.granules[-1] = granule
        s.ended = bool(flags & LAST)
    if any(not s.ended or s._open is not None for s in found.values()):
        raise Damaged("a stream has no end")
    return found


def times(s: Stream, rate: int) -> list[float]:
    """The end of each packet in seconds: granule positions where pages give them, sample counts between."""
    out, at = [], 0
    for packet, granule in zip(s.packets[1:], s.granules[1:], strict=True):
        at = at + len(packet) if granule is None else granule
        out.append(at / rate)
    return out


def read(media: bytes) -> tuple[bytes, dict]:
    """(payload, facts about the container and its samples)."""
    streams = demultiplex(media)
    heads = {}
    for s in streams.values():
        magic, index, n, rate, size, _ = _HEAD.unpack(s.packets[0])
        if magic != MAGIC or n != len(streams) or index in heads:
            raise Damaged("unknown mapping of the streams")
        heads[index] = s
    turns = [heads[i].packets[1:] for i in range(len(heads))]
    payload = b"".join(p[k] for k in range(max(map(len, turns), default=0)) for p in turns if k < len(p))
    if len(payload) != size:
        raise Damaged(f"{len(payload)} samples; the header says {size}")
    ends = [t for s in heads.values() for t in times(s, rate)[-1:]]
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / max(len(x), 1)
    facts = {
        "streams": len(streams),
        "pages": sum(s.pages for s in streams.values()),
        "packets": sum(map(len, turns)),
        "seconds": round(sum(ends), 6),
        "mean": round(float(x.mean()), 4) if len(x) else 0.0,
        "crossings": int(np.count_nonzero(np.diff(x > 127))) if len(x) else 0,
        "entropy": round(float(-(p * np.log2(p)).sum()), 4) + 0.0,
    }
    return payload, facts


FACTS = "streams int, pages int, packets int, seconds double, mean double, crossings int, entropy double"
_FACTS = pa.struct([("streams", pa.int32()), ("pages", pa.int32()), ("packets", pa.int32()), ("seconds", pa.float64()), ("mean", pa.float64()), ("crossings", pa.int32()), ("entropy", pa.float64())])
#: Bytes of media after which a batch is handed on.
FLUSH = 16 << 20


def padded(data: bytes, unit: int = PACKET) -> bytes:
    """data and as many bytes 255 as make its length a positive multiple of unit."""
    return data + b"\xff" * (unit - len(data) % unit if len(data) % unit or not data else 0)


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text as UTF-8, padded, in a container of its own.

    Null counts as empty, and an empty text is one packet of padding. Equal texts give equal media; repeated rows stay.
    Other columns are dropped.
    """
    bounded_batches(df.sparkSession)
    out = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows, held = [], 0
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = (t.as_py() or "").encode()
                rows.append((k, len(data), write(padded(data))))
                held += len(rows[-1][2])
                if held >= FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    made = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(batches, "id long, n_bytes long, media binary")
    return made.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "n_bytes", "media")


def decode_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df with ``payload`` and ``facts`` from its media column, other columns kept.

    A null container gives nulls; a damaged one raises. Columns of these names in df are replaced. An empty table gives none.
    """
    bounded_batches(df.sparkSession)

    @F.arrow_udf(f"payload binary, facts struct<{FACTS.replace(' ', ': ').replace(',:', ',')}>")
    def decoded(media: pa.Array) -> pa.Array:
        rows = [(None, None) if m is None else read(m) for m in media.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], _FACTS)], names=["payload", "facts"])

    return df.withColumn("__decoded", decoded(F.col(media_col))).select(*(c for c in df.columns if c not in ("payload", "facts")), "__decoded.payload", "__decoded.facts")
