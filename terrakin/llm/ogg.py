"""Media columns in Ogg: write and read pages, packets and logical streams.

Writing: a payload becomes an Ogg file of two multiplexed logical streams, each begun by a
page of its own: unsigned 8-bit PCM samples (header packet ``PCM     ``, then packets of
``PACKET`` samples whose pages carry the sample count as granule position) and a comment
stream (header ``TKMETA``, then one packet with the unpadded size and the payload's CRC-32).

Reading: every page's checksum is verified and its sequence number checked, packets are
reassembled from the lacing values over page borders, pages are dealt to their logical
streams by serial number, and timestamps of all sample pages come from the granule positions,
which must be the samples so far, and the rate in the header packet. Anything else raises ``OggError``.

Defined results: null and empty texts give ``ALIGN`` zero bytes; very long texts are one file
of as many pages as they need (a file has to fit into one binary value); equal texts give equal
files (serial numbers come from the payload); repeated rows stay repeated; a null id keeps
its row; extra columns are ignored; an empty table gives an empty result; a null media
value reads as nulls.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

ALIGN, PACKET, RATE = 64, 4_000, 8_000
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
BOS, EOS, CONTINUED = 2, 4, 1


class OggError(ValueError):
    """A damaged or unknown file."""


def checksum(data: bytes) -> int:
    """Ogg's CRC-32 (polynomial 0x04C11DB7, bits not reflected, start and final xor 0),
    through zlib's reflected one on bit-reversed bytes."""
    crc = zlib.crc32(data.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(REVERSED), "big")


def _page(flags: int, granule: int, serial: int, seq: int, lacing: bytes, data: bytes) -> bytes:
    head = struct.pack("<4sBBqIII", b"OggS", 0, flags, granule, serial, seq, 0)
    crc = checksum(b"".join((head, bytes([len(lacing)]), lacing, data)))
    return b"".join((head[:22], struct.pack("<I", crc), bytes([len(lacing)]), lacing, data))


def _pages(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """The pages of one logical stream: (packet, granule position at its end). The first
    packet has a page of its own, as the format asks for."""
    out, seq = [], 0
    for group in (packets[:1], packets[1:]):
        lacing = bytearray()
        ends: dict[int, int] = {}  # segments so far -> granule
        for data, granule in group:
            lacing += b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
            ends[len(lacing)] = granule
        body, at, marks = b"".join(p for p, _ in group), 0, sorted(ends)
        for a in range(0, len(lacing), 255):
            part = bytes(lacing[a : a + 255])
            b, size = a + len(part), sum(part)
            last = marks[max(0, bisect_right(marks, b) - 1)]  # the last packet's end up to here
            granule = ends[last] if a < last <= b else -1
            flags = (BOS if seq == 0 else 0) | (CONTINUED if a and lacing[a - 1] == 255 else 0) | (EOS if seq and b == len(lacing) else 0)
            out.append(_page(flags, granule, serial, seq, part, body[at : at + size]))
            at, seq = at + size, seq + 1
    return out


def pack(payload: bytes, n_bytes: int) -> bytes:
    """An Ogg file of this payload."""
    crc = zlib.crc32(payload)
    pcm = [(struct.pack(">8sHHIIBBH", b"PCM     ", 0, 0, 1, RATE, 8, 1, 0), 0)]
    pcm += [(payload[a : a + PACKET], min(a + PACKET, len(payload))) for a in range(0, len(payload), PACKET)]
    meta = [(b"TKMETA\0\0", 0), (struct.pack("<QI", n_bytes, crc), 0)]
    a, b = _pages(pcm, crc), _pages(meta, crc ^ 0xFFFFFFFF)
    half = 1 + (len(a) - 1) // 2
    return b"".join([a[0], b[0], *a[1:half], *b[1:], *a[half:]])


@dataclass
class Stream:
    """A logical stream: whole packets, (granule, packets so far) of each page, pages."""

    packets: list[bytes] = field(default_factory=list)
    marks: list[tuple[int, int]] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    open: list[bytes] = field(default_factory=list)


def demultiplex(data: bytes) -> dict[int, Stream]:
    """The logical streams of a file by serial number."""
    streams: dict[int, Stream] = {}
    at, view = 0, memoryview(data)
    while at < len(data):
        if len(data) - at < 27:
            raise OggError("cut page")
        magic, version, flags, granule, serial, seq, crc, n = struct.unpack_from("<4sBBqIIIB", data, at)
        if magic != b"OggS" or version:
            raise OggError("no page where one should begin")
        lacing = data[at + 27 : at + 27 + n]
        body, end = at + 27 + n, at + 27 + n + sum(lacing)
        if end > len(data) or len(lacing) < n:
            raise OggError("cut page")
        if checksum(b"".join((view[at : at + 22], b"\0\0\0\0", view[at + 26 : end]))) != crc:
            raise OggError("wrong page checksum")
        if flags & BOS:
            if serial in streams:
                raise OggError("a stream begins twice")
            streams[serial] = Stream()
        s = streams.get(serial)
        if s is None or s.ended or seq != s.pages or bool(flags & CONTINUED) != bool(s.open):
            raise OggError("page out of order")
        whole = len(s.packets)
        for size in lacing:
            s.open.append(data[body : body + size])
            body += size
            if size < 255:
                s.packets.append(b"".join(s.open))
                s.open = []
        s.pages += 1
        if (granule >= 0) != (len(s.packets) > whole):
            raise OggError("granule position of a page without a packet's end, or none with one")
        if granule >= 0:
            s.marks.append((granule, len(s.packets)))
        s.ended = bool(flags & EOS)
        at = end
    if not all(s.ended and not s.open for s in streams.values()):
        raise OggError("a stream does not end")
    return streams


def unpack(data: bytes) -> tuple[bytes, int, float, str]:
    """Payload, unpadded size, seconds and a feature string of a file that ``pack`` wrote."""
    streams = demultiplex(data)
    kinds = {s.packets[0][:8]: s for s in streams.values()}
    pcm, meta = kinds.get(b"PCM     "), kinds.get(b"TKMETA\0\0")
    if pcm is None or meta is None:
        raise OggError("a stream is missing")
    rate = struct.unpack_from(">I", pcm.packets[0], 16)[0]
    payload = b"".join(pcm.packets[1:])
    n_bytes, crc = struct.unpack("<QI", meta.packets[1])
    last = pcm.marks[-1][0]
    samples = np.cumsum([0] + [len(p) for p in pcm.packets[1:]])
    if any(g != samples[k - 1] for g, k in pcm.marks):
        raise OggError("a granule position is not the samples so far")
    if last != len(payload) or zlib.crc32(payload) != crc:
        raise OggError("samples are missing")
    wave = np.frombuffer(payload, np.uint8)
    centred = wave.astype(np.int16) - 128
    crossings = int(np.count_nonzero((centred[1:] < 0) != (centred[:-1] < 0)))
    feature = {
        "streams": len(streams),
        "pages": sum(s.pages for s in streams.values()),
        "packets": sum(len(s.packets) for s in streams.values()),
        "ms": last * 1000 // rate,
        "page_ms": [g * 1000 // rate for g, _ in pcm.marks[1:]],
        "sum": int(wave.sum(dtype=np.int64)),
        "energy": int((centred.astype(np.int64) ** 2).sum()),
        "crossings": crossings,
        "peak": int(wave.max()),
    }
    return payload, n_bytes, last / rate, json.dumps(feature, separators=(",", ":"))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each whole text as an Ogg file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                out.append(pack(raw + bytes(-len(raw) % ALIGN if raw else ALIGN), len(raw)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "media"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, StructType([rows.schema["id"], StructField("media", BinaryType())]))


def from_media(stored: DataFrame) -> DataFrame:
    """(id, media, payload, n_bytes, seconds, feature) of (id, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1_000):
                part = batch.slice(a, 1_000)
                got = [(None,) * 4 if m.as_py() is None else unpack(m.as_py()) for m in part.column(1)]
                columns = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.float64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], ["id", "media", "payload", "n_bytes", "seconds", "feature"])

    rows = stored.select("id", "media")
    more = [StructField("payload", BinaryType()), StructField("n_bytes", LongType()), StructField("seconds", DoubleType()), StructField("feature", StringType())]
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *more]))


def digests(media: DataFrame) -> DataFrame:
    """The digest columns of media that were read back."""
    return media.select(
        "id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -ALIGN, ALIGN)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "seconds",
    )
