"""Exact byte-pair encoding by backtracking, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary gives the longest token that starts at each
byte of a piece. The encoder walks forward with longest tokens; a token may follow another
only if the pair is compatible, that is, if merging the two tokens' bytes would never have
taken a merge across their border. An incompatible token is replaced by its next shorter
prefix token, and when none is left the encoder steps back one token; an end position is
given up at most once, so the work is linear. The accepted sequence is the one that
applying the merges in rank order gives. (The method is the published one of the open-source
``bpe`` crate for Rust and its accompanying article on linear-time encoding.)

The distinct pieces of some megabytes of text are encoded together: automaton, backtracking
and compatibility checks advance by one step for all pieces at once, in arrays. Pieces of more
than ``LONG`` bytes, which would keep such steps waiting, are encoded one by one.

Defined results: null and empty texts have no ids and decode to the empty text; very long
texts are encoded whole; repeated rows stay repeated; there are no ties, since the ids of a
text are unique; a null id column value is kept; extra columns are ignored; an empty table
gives an empty result. Special tokens named in the vocabulary file are recognised in texts,
as the tokenizers library does. Ids that spell no UTF-8 decode with U+FFFD in their place.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from terrakin.llm.arrays import Table, binary, bytes_of, ranges, slices, thrifty
from terrakin.llm.pretoken import Ids, Units, as_ids, byte_letters, specials, spelled, spread

SLICE = 4 << 20  # bytes of text encoded together
LONG = 128
PAIRS = 1 << 19  # compatibility answers that are kept


class OffsetTable:
    """The decoder: all tokens' bytes in one array, with starts and lengths by id."""

    def __init__(self, spec: str):
        full, letters = json.loads(spec), {c: b for b, c in byte_letters().items()}
        text = {v: bytes(letters[c] for c in t) for t, v in full["model"]["vocab"].items()}
        text |= {t["id"]: t["content"].encode() for t in full.get("added_tokens") or []}
        self.lengths = np.zeros(max(text) + 1, np.int64)
        for v, t in text.items():
            self.lengths[v] = len(t)
        blob = np.frombuffer(b"".join(text[v] for v in sorted(text)), np.uint8)
        self.tokens = binary(blob, np.concatenate(([0], np.cumsum(self.lengths))))

    def texts(self, ids: Ids) -> pa.Array:
        """What the ids of each text spell; bytes that are no UTF-8 become U+FFFD."""
        raw = binary(*spelled(self.tokens, pa.array(ids.flat), ids.offsets))
        try:
            return raw.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([r.as_py().decode("utf-8", "replace") for r in raw], pa.string())

    def decode(self, ids: bytes) -> str:
        flat = np.frombuffer(ids, "<u4")
        return self.texts(Ids(flat, np.array([0, len(flat)])))[0].as_py()


class Automaton:
    """Aho-Corasick over tokens, as arrays: states are prefixes of tokens, 0 the empty one."""

    def __init__(self, tokens: list[bytes]):
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        wide = int(sizes.max())
        order = np.array(sorted(range(len(tokens)), key=tokens.__getitem__))
        flat = np.frombuffer(b"".join(tokens[k].ljust(wide, b"\0") for k in order), np.uint8).reshape(-1, wide)
        size = sizes[order]
        at = np.arange(wide)
        # A token shares with the one before as many bytes as are equal from the start.
        same = np.zeros(len(tokens), np.int64)
        same[1:] = np.minimum(np.where((d := flat[1:] != flat[:-1]).any(axis=1), d.argmax(axis=1), wide), size[:-1])
        new = (at >= same[:, None]) & (at < size[:, None])
        name = np.zeros(new.shape, np.int32)
        name[new] = 1 + np.arange(np.count_nonzero(new))
        name = np.maximum.accumulate(name, axis=0)  # the state of each prefix
        above = np.concatenate((np.zeros((len(tokens), 1), np.int32), name[:, :-1]), axis=1)
        state, parent, byte, deep = name[new], above[new].astype(np.int64), flat[new], (np.nonzero(new)[1])
        n = len(state) + 1
        self.go = Table(parent << 8 | byte, state)
        self.token = np.full(n, -1, np.int32)
        self.token[name[np.arange(len(tokens)), size - 1]] = order
        self.fail, self.below = np.zeros(n, np.int32), np.zeros(n, np.int32)
        for d in range(1, wide):  # by depth: the longest proper suffix that is a state
            some = np.flatnonzero(deep == d)
            self.fail[state[some]] = self.step(self.fail[parent[some]], byte[some])
            up = self.fail[state[some]]
            self.below[state[some]] = np.where(self.token[up] >= 0, up, self.below[up])
        self.sizes = sizes

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after one more byte each. Every byte is a token."""
        out, todo, now = np.zeros(len(state), np.int32), np.arange(len(state)), state
        while len(todo):
            to, hit = self.go.get(now.astype(np.int64) << 8 | byte[todo])
            out[todo[hit]] = to[hit]
            miss = ~hit & (now != 0)
            todo, now = todo[miss], self.fail[now[miss]]
        return out

    def longest(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The longest token that starts at each byte and ends within its piece. Pieces come
        by falling size."""
        out = np.zeros(len(data), np.int32)
        state = np.zeros(len(starts), np.int32)
        for p in range(int(sizes[0]) if len(sizes) else 0):
            m = int(np.searchsorted(-sizes, -p, side="left"))  # pieces longer than p
            at = starts[:m] + p
            state[:m] = self.step(state[:m], data[at])
            seen = state[:m]
            seen = np.where(self.token[seen] >= 0, seen, self.below[seen])
            while True:  # tokens that end here, by falling size; later ends overwrite
                some = np.flatnonzero(seen)
                if not len(some):
                    break
                at, seen = at[some], seen[some]
                found = self.token[seen]
                out[at + 1 - self.sizes[found]] = found
                seen = self.below[seen]
        return out


class Bpe:
    """A vocabulary file of the tokenizers library (byte-level BPE), as an encoder."""

    def __init__(self, spec: str):
        full = json.loads(spec)
        letters = {c: b for b, c in byte_letters().items()}
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = specials(full)
        # Tokens are numbered by rank: bytes first, then merges in order.
        tokens = [bytes([b]) for b in range(256)]
        number = {t: k for k, t in enumerate(tokens)}
        halves, pair = [(k, k) for k in range(256)], {}
        for merge in full["model"]["merges"]:
            a, b = map(raw, merge.split(" ") if isinstance(merge, str) else merge)
            if a + b not in number:
                number[a + b] = len(tokens)
                tokens.append(a + b)
                halves.append((number[a], number[b]))
            pair.setdefault(number[a] << 32 | number[b], number[a + b])
        shown = {raw(t): v for t, v in full["model"]["vocab"].items() if t.encode() not in self.special}
        self.ids = np.array([shown[t] for t in tokens], "<u4")
        self.halves = np.array(halves, np.int64)
        self.merged = Table(np.fromiter(pair, np.int64, len(pair)), np.fromiter(pair.values(), np.int64, len(pair)))
        self.shorter = np.array([next((number[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in number), -1) for t in tokens], np.int32)
        self.machine = Automaton(tokens)
        self.sizes = self.machine.sizes
        self.fits = Table(np.zeros(0, np.int64), np.zeros(0, bool))
        self.units = Units(self.encode_pieces, self.special)

    def _work_out(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether ``left, right`` stay two tokens: undo merges from the latest rank down and
        look for a merge across the border that would have come earlier."""
        out, todo = np.ones(len(left), bool), np.arange(len(left))
        limit = np.full(len(left), len(self.ids))
        while len(todo):
            rank, there = self.merged.get(left << 32 | right)
            across = there & (rank < limit)
            out[todo[across]] = False
            undo_left = left > right  # the later of the two is undone first
            inner, outer = self.halves[left, 1], self.halves[right, 0]
            byte_right = outer == right
            as_left = undo_left | byte_right
            ends = ~across & as_left & (inner == left)  # nothing left to undo
            limit = np.where(undo_left, left, np.where(byte_right, left, right + 1))
            left, right = np.where(as_left, inner, left), np.where(as_left, right, outer)
            on = ~across & ~ends
            todo, left, right, limit = todo[on], left[on], right[on], limit[on]
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        out, known = self.fits.get(key)
        if not known.all():
            if self.fits.size > PAIRS:
                self.fits = Table(np.zeros(0, np.int64), np.zeros(0, bool))
            ask, at = np.unique(key[~known], return_inverse=True)
            found = self._work_out(ask >> 32, ask & 0xFFFFFFFF)
            _, there = self.fits.get(ask)
            self.fits.add(ask[~there], found[~there])
            out[~known] = found[at]
        return out

    def _walk(self, longest: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all pieces, each piece's at its bytes' places, and their numbers."""
        n = len(starts)
        out, count = np.zeros(len(longest), np.int64), np.zeros(n, np.int64)
        shut = np.zeros(len(longest) + 1, bool)  # given up: the end after this byte
        todo, pos = np.arange(n), np.zeros(n, np.int64)
        token = longest[starts].astype(np.int64)
        while len(todo):
            at = starts[todo]
            end = pos + self.sizes[token]
            ok = ~shut[at + end - 1]
            ask = np.flatnonzero(ok & (count[todo] > 0))
            ok[ask] = self.compatible(out[at[ask] + count[todo[ask]] - 1], token[ask])
            took = np.flatnonzero(ok)
            out[at[took] + count[todo[took]]] = token[took]
            count[todo[took]] += 1
            pos[took] = end[took]
            done = ok & (pos == sizes[todo])
            on = np.flatnonzero(ok & ~done)
            token[on] = longest[at[on] + pos[on]]
            bad = np.flatnonzero(~ok)
            short = self.shorter[token[bad]]
            token[bad] = short
            back = bad[short < 0]
            shut[at[back] + pos[back] - 1] = True
            last = todo[back]
            count[last] -= 1
            token[back] = out[at[back] + count[last]]
            pos[back] -= self.sizes[token[back]]
            if done.any():
                todo, pos, token = todo[~done], pos[~done], token[~done]
        return out, count

    def _one(self, longest: np.ndarray) -> list[int]:
        """The tokens of one piece, step by step."""
        at, sizes, shorter, n = longest.tolist(), self.sizes, self.shorter, len(longest)
        open_, out = bytearray(b"\1") * (n + 1), []
        pos, token, known = 0, at[0], {}
        while True:
            size = int(sizes[token])
            ok = open_[pos + size]
            if ok and out:
                key = out[-1], token
                if key not in known:
                    known[key] = bool(self.compatible(np.array([out[-1]]), np.array([token]))[0])
                ok = known[key]
            if ok:
                out.append(token)
                pos += size
                if pos == n:
                    return out
                token = at[pos]
            elif (short := int(shorter[token])) >= 0:
                token = short
            else:
                open_[pos] = 0
                token = out.pop()
                pos -= int(sizes[token])

    def encode_pieces(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after the other, and how many each has."""
        data, offsets = bytes_of(found)
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        starts, size = offsets[:-1][order], sizes[order]
        longest = self.machine.longest(data, starts, size)
        count, tokens = np.zeros(len(sizes), np.int64), np.zeros(len(data), np.int64)
        whole = self.sizes[longest[starts]] == size  # a piece that is a token
        tokens[starts[whole]] = longest[starts[whole]]
        count[order[whole]] = 1
        some = np.flatnonzero(~whole & (size <= LONG))
        out, n = self._walk(longest, starts[some], size[some])
        count[order[some]] = n
        filled = ranges(starts[some], n)
        tokens[filled] = out[filled]
        for k in np.flatnonzero(~whole & (size > LONG)):
            one = self._one(longest[starts[k] : starts[k] + size[k]])
            tokens[starts[k] : starts[k] + len(one)] = one
            count[order[k]] = len(one)
        return self.ids[tokens[ranges(offsets[:-1], count)]], count

    def encode_texts(self, texts: pa.Array) -> Ids:
        """The ids of whole texts."""
        return spread(texts, self.special, self.units)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_texts(pa.array([text or ""])).flat.astype("<u4").tobytes()


@lru_cache(maxsize=2)
def loaded(spec: str) -> Bpe:
    """One encoder for each vocabulary in a worker process."""
    return Bpe(spec)


@lru_cache(maxsize=2)
def table(spec: str) -> OffsetTable:
    """One decoder for each vocabulary in a worker process."""
    return OffsetTable(spec)


def _vocabulary(df: DataFrame, path: str):
    """The vocabulary file (its size is fixed) as a broadcast of the driver's copy."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def packed(ids: Ids) -> pa.Array:
    """Each text's ids as little-endian unsigned 32-bit integers."""
    return binary(np.ascontiguousarray(ids.flat, "<u4").view(np.uint8), ids.offsets * 4).cast(pa.binary())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of each whole text as little-endian unsigned 32-bit integers."""
    spec = _vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for batch in batches:
            for some in slices(batch, 1, SLICE):
                yield pa.RecordBatch.from_arrays([some.column(0), packed(bpe.encode_texts(some.column(1)))], ["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, StructType([StructField("id", docs.schema[id_col].dataType), StructField("ids", BinaryType())]))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(id, ids, text): what the ids decode to."""
    spec = _vocabulary(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = table(spec.value)
        for batch in batches:
            for some in slices(batch, 1, SLICE):
                data, at = bytes_of(some.column(1))
                text = decoder.texts(Ids(as_ids(data), at // 4))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), text], ["id", "ids", "text"])

    rows = encoded.select("id", "ids")
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("text", StringType())]))


def coded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, text): the ids of each whole text and what they decode to, in one pass; the
    rows of ``decode(encode(docs))`` with half the workers."""
    spec = _vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, decoder = loaded(spec.value), table(spec.value)
        for batch in batches:
            for some in slices(batch, 1, SLICE):
                ids = bpe.encode_texts(some.column(1))
                raw = packed(ids)
                read = Ids(as_ids(bytes_of(raw)[0]), ids.offsets)
                yield pa.RecordBatch.from_arrays([some.column(0), raw, decoder.texts(read)], ["id", "ids", "text"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(thrifty(run), StructType([rows.schema["id"], StructField("ids", BinaryType()), StructField("text", StringType())]))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the real ids and texts."""
    return coded(docs, path, id_col, text_col).select(
        "id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )
