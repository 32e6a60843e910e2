"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with
separate control bytes, decoded by numpy table lookup.

A shard file holds consecutive documents in ascending id order. Its header has the shard's
ids by falling frequency (rank 0 is the most frequent; ties to the smaller id), then the
documents' ids and token counts. Every id is written as its rank in one to four
little-endian bytes; the lengths minus one stand apart, two bits each, four to a control
byte. Decoding looks up four lengths for each control byte in a 256-row table, gathers the
bytes at the running offsets and looks the ranks up in the header.

Layout, little-endian: magic ``TKIDS001``; u64 ids in the table, documents, tokens, data
bytes; u32 table; i64 document ids; u8 1 where the document id is null; u64 token counts;
control bytes; data bytes.

Shards are written to the cluster's shared folder by the task that encodes them, each under
a name of its own; only names that a finished task returns are in the manifest, so a lost
executor leaves at most files that nothing refers to.

Shards are written through pyarrow's file systems (``s3a`` is read as ``s3``); a folder that
only Spark can write to raises an error before any work.

Defined results: null and empty texts have only the end id; very long texts are encoded whole
and are never cut between shards; a null document id sorts first; rows with equal ids follow
each other in the order of their texts' first 64 characters, then of a hash, then of the whole
text; repeated rows stay repeated; extra columns are ignored; an empty table makes no shard and
an empty result.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from terrakin.llm.arrays import bytes_of, slices
from terrakin.llm.common import materialize, scratch
from terrakin.llm.pretoken import Ids, Units, byte_letters, specials, spread

MAGIC = b"TKIDS001"
LENGTHS = np.array([[1 + (c >> 2 * k & 3) for k in range(4)] for c in range(256)], np.uint8)
CHUNK = 1 << 20  # ids coded or decoded at once; a multiple of 4
SLICE = 8 << 20  # bytes of text cut together
MANIFEST = "pid int, seq int, path string, n_docs long, n_tokens long"


def _chunks(ids: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The same ids in arrays of CHUNK, but for the last."""
    held, size = [], 0
    for one in ids:
        while size + len(one) >= CHUNK:
            held.append(one[: CHUNK - size])
            one = one[CHUNK - size :]
            yield np.concatenate(held)
            held, size = [], 0
        held.append(one)
        size += len(one)
    if size:
        yield np.concatenate(held)


def coded(doc_ids: list[int | None], counts: np.ndarray, ids: list[np.ndarray]) -> list[bytes]:
    """One shard, in parts, of these documents' token counts and ids (one after the other)."""
    n = int(counts.sum())
    freq = np.zeros(0, np.int64)
    for some in _chunks(ids):
        more = np.bincount(some, minlength=len(freq))
        more[: len(freq)] += freq
        freq = more
    used = np.flatnonzero(freq)
    table = used[np.argsort(-freq[used], kind="stable")].astype("<u4")
    rank = np.zeros(len(freq), "<u4")
    rank[table] = np.arange(len(table), dtype="<u4")
    control, data = [], []
    for some in _chunks(ids):
        code = rank[some]
        extra = (code > 0xFF).astype(np.uint8) + (code > 0xFFFF) + (code > 0xFFFFFF)
        data.append(code.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]].tobytes())
        quads = np.pad(extra, (0, -len(extra) % 4)).reshape(-1, 4)
        control.append((quads << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes())
    head = struct.pack("<4Q", len(table), len(doc_ids), n, sum(map(len, data)))
    names = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + bytes(x is None for x in doc_ids)
    return [MAGIC, head, table.tobytes(), names, counts.astype("<u8").tobytes(), *control, *data]


def pack(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """One shard of these documents' ids (little-endian unsigned 32-bit)."""
    return b"".join(coded(doc_ids, np.array([len(x) // 4 for x in ids], np.int64), [np.frombuffer(x, "<u4") for x in ids]))


def unpack(shard: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, token counts and all ids (unsigned 32-bit) of a shard."""
    if shard[:8] != MAGIC:
        raise ValueError("not a token-id shard")
    n_table, n_docs, n, n_data = struct.unpack_from("<4Q", shard, 8)
    at = 40

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(shard, kind, count, at)
        at += got.nbytes
        return got

    table, names, null, counts = take("<u4", n_table), take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
    control, data = take("u1", -(-n // 4)), take("u1", n_data)
    out, done = np.empty(n, "<u4"), 0
    for a in range(0, n, CHUNK):
        size = LENGTHS[control[a // 4 : (a + CHUNK) // 4]].reshape(-1)[: min(CHUNK, n - a)]
        ends = np.cumsum(size, dtype=np.int64)
        starts, part = ends - size, data[done : done + int(ends[-1])]
        code = part[starts].astype("<u4")
        for k in range(1, int(size.max())):
            more = np.flatnonzero(size > k)
            code[more] |= part[starts[more] + k].astype("<u4") << np.uint32(8 * k)
        out[a : a + len(code)] = table[code]
        done += int(ends[-1])
    return [None if z else x for x, z in zip(names.tolist(), null.tolist())], counts.astype(np.int64), out


class Library:
    """The tokenizers library's BPE model behind the exact cutter. The model is called on
    pieces, which costs a fraction of the whole tokenizer's call."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.model, self.special = Tokenizer.from_str(spec).model, specials(json.loads(spec))
        self.letters = "".join(map(byte_letters().__getitem__, range(256)))
        self.units = Units(self.encode_pieces, self.special)

    def encode_pieces(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after the other, and how many each has."""
        data, offsets = bytes_of(found)
        text, tokenize, at = data.tobytes().decode("latin-1").translate(self.letters), self.model.tokenize, offsets.tolist()
        flat: list[int] = []
        ends = [len(flat)]
        for a, b in zip(at, at[1:]):
            flat += [t.id for t in tokenize(text[a:b])]
            ends.append(len(flat))
        return np.array(flat, "<u4"), np.diff(ends)

    def encode_texts(self, texts: pa.Array) -> Ids:
        return spread(texts, self.special, self.units)


@lru_cache(maxsize=2)
def _library(spec: str) -> Library:
    """One for each vocabulary in a worker process."""
    return Library(spec)


def filesystem(uri: str) -> tuple[FileSystem, str]:
    """The file system of a folder or file that Spark names, and its path there."""
    scheme, sep, rest = uri.partition("://")
    return FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + sep + rest if sep else uri)


def write(docs: DataFrame, vocabulary: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shard_tokens: int = 1 << 24) -> DataFrame:
    """Encode and write all documents; the manifest of shards, with ``start``, the number of
    ids before the shard. A shard is closed at the document that fills it."""
    folder = folder or scratch(docs.sparkSession, "token-ids")
    filesystem(folder)  # raises here, before any work, where only Spark can write
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, pid, seq = _library(spec.value), TaskContext.get().partitionId(), 0
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        names: list[int | None] = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            path = f"{pid:07d}-{seq:05d}-{uuid.uuid4().hex}.tkids"
            with fs.open_output_stream(f"{base}/{path}") as out:
                for part in coded(names, np.concatenate(counts), ids):
                    out.write(part)
            return pa.RecordBatch.from_pylist([{"pid": pid, "seq": seq, "path": path, "n_docs": len(names), "n_tokens": size}], pa.schema([("pid", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in batches:
            for some in slices(batch, 1, SLICE):
                got, own = library.encode_texts(some.column(1)), some.column(0).to_pylist()
                flat = np.insert(got.flat, got.offsets[1:], end_id)
                ends, at = got.offsets[1:] + np.arange(1, len(own) + 1), 0
                while at < len(own):
                    begin = int(ends[at - 1]) if at else 0
                    upto = min(len(own), 1 + int(np.searchsorted(ends, begin + shard_tokens - size)))
                    names += own[at:upto]
                    counts.append(np.diff(ends[at:upto], prepend=begin))
                    ids.append(flat[begin : ends[upto - 1]].copy())
                    size, at = size + len(ids[-1]), upto
                    if size >= shard_tokens:
                        yield flush()
                        names, counts, ids, size, seq = [], [], [], 0, seq + 1
        if names:
            yield flush()

    # Many rows may share an id (or have none): the order goes on with the text's first
    # characters and its hash, so that such rows are many tasks' work.
    order = ["id", "lead", "tie"]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("t"))
    rows = rows.withColumns({"lead": F.substring("t", 1, 64), "tie": F.xxhash64("t")})
    made = rows.repartitionByRange(*order).sortWithinPartitions(*order, "t").select("id", "t").mapInArrow(run, MANIFEST)
    manifest = materialize(made, "token-manifest")
    tasks = manifest.groupBy("pid").agg(F.sum("n_tokens").alias("all")).withColumn("before", F.sum("all").over(Window.orderBy("pid")) - F.col("all"))
    within = F.sum("n_tokens").over(Window.partitionBy("pid").orderBy("seq")) - F.col("n_tokens")
    full = manifest.withColumn("within", within).join(tasks.select("pid", "before"), "pid")
    return full.select("pid", "seq", F.concat(F.lit(folder.rstrip("/") + "/"), "path").alias("path"), "n_docs", "n_tokens", (F.col("before") + F.col("within")).alias("start"))


def read(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, ids): every document, from the shards' bytes; ids are
    little-endian unsigned 32-bit integers (null unless ``with_ids``)."""
    shards = manifest.select("path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, name = filesystem(path)
                with fs.open_input_stream(name) as f:
                    docs, counts, ids = unpack(f.read())
                ends = np.cumsum(counts)
                raw = memoryview(ids.view(np.uint8)) if len(ids) else memoryview(b"")
                for a in range(0, len(docs), 2000):
                    b = min(a + 2000, len(docs))
                    cut = [raw[4 * (ends[k] - counts[k]) : 4 * ends[k]] for k in range(a, b)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[a:b], pa.int64()), pa.array(start + ends[a:b] - counts[a:b]), pa.array(counts[a:b]), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array([x.tobytes() for x in cut], pa.binary()) if with_ids else pa.nulls(b - a, pa.binary())],
                        ["id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    n = max(1, shards.count())
    return shards.repartition(n, "path").mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long, ids binary")
