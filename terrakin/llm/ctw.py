"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions, from its highest bit; each of the 255 decision nodes has
a context tree of its own over the preceding bytes. Every tree node holds the zeros and ones
seen in its context in the training texts, its Krichevsky-Trofimov estimate, and the weighted
probability that mixes, half and half, this estimate with the product of its children's
weighted probabilities. The probability of the next decision is the quotient of weighted
probabilities with and without it: along the path of contexts it mixes the KT estimates of
all depths with the posterior weights of the training data. A text's score is log10 of the
product over all its bytes and an end symbol (byte 0xFF), with line ends before its start;
``bits_per_byte`` is the same as a code length, in bits for each of these symbols.

Contexts are the last ``DEEP`` bytes, exact, and all shorter ones. What is counted is a table
that grows with the corpus and is never in one place:

1. Texts are dealt into blocks of about ``BLOCK`` bytes. A block's task counts the block's
   distinct (context, byte) keys and words and sends them, packed, to ``SLOTS`` slots (by the
   three nearest bytes, or by the word).
2. A slot merges what blocks send, and grows the subtrees below three bytes of context. Only
   the nodes of at most ``TOP`` bytes of context (2**16 contexts at most) meet on the driver,
   after sums by node; below depth TOP a decision's probability is ``mix + weight * inner``
   with mix and weight of its depth-TOP node and inner of the subtree alone.
3. Slots answer every block: the log10 probability of each key it sent (a 32-bit float), the
   count of each word. Answers and texts of a block meet, and its texts are scored.

So a key moves once for each block, not for each byte, and a task holds one block or one
slot, whatever the corpus. With more than ``FAN`` blocks, slots are merged in two steps and
each answers in several tasks.

The unigram base adds log10((c + 1) / (N + V + 1)) over words and the end.

Defined results: null and empty texts have no word and one end; a very long text is worked off
in chunks, with the same result; equal texts have equal scores up to rounding; repeated rows
are learned from and scored each; rows where the training condition is null (such as a null id
under a hash of it) are not learned from; extra columns are ignored; an empty table gives an
empty result; without training rows all counts are 0 and every decision has probability one
half.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from terrakin.llm.arrays import Table, ranges, slices
from terrakin.llm.common import materialize

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
END_WORD = b""  # no word is empty
DEEP, TOP = 6, 2  # bytes of context (7 at most), and those of the nodes on the driver
CHUNK, HELD = 1 << 20, 3_000_000  # bytes of text scored at once; keys that are held before a merge
COUNTED = 4 << 20  # bytes of text counted at once
BLOCK, SLOTS, FAN = 32 << 20, 512, 1_024
KEYS, WORDS, TEXT, TOPS = 0, 1, 2, 3  # kinds of rows


def deep_keys(data: np.ndarray) -> np.ndarray:
    """The DEEP bytes before, the nearest highest, then the byte itself, for each byte after
    the first DEEP of ``data``."""
    pad, eight = np.zeros(7 - DEEP, np.uint8), np.uint64(8)
    last = np.ndarray((len(data) - DEEP,), "<u8", np.concatenate((pad, data)), strides=(1,))  # the 8 bytes up to each
    before = last << eight >> np.uint64(8 * (8 - DEEP)) << eight
    return (before | last >> np.uint64(56)).view(np.int64)


def pieces(texts: Iterable[bytes], chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of about ``chunk`` bytes of all texts with their end symbol: (data with DEEP
    bytes of context before each piece, starts of the pieces in it, text number of each)."""
    parts: list[bytes] = []
    starts: list[int] = []
    owner: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        full = text + b"\xff"
        for a in range(0, len(full), chunk):
            before = full[max(0, a - DEEP) : a].rjust(DEEP, b"\n")
            starts.append(size)
            owner.append(k)
            parts += [before, full[a : a + chunk]]
            size += DEEP + len(parts[-1])
            if size >= chunk:
                yield np.frombuffer(b"".join(parts), np.uint8), np.array(starts), np.array(owner)
                parts, starts, owner, size = [], [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.array(starts), np.array(owner)


def _context(n: int, starts: np.ndarray) -> np.ndarray:
    """Which keys of n bytes are those of the context before a piece."""
    at = (starts[1:, None] - DEEP + np.arange(DEEP)).ravel()
    mask = np.zeros(n - DEEP, bool)
    mask[at] = True
    return mask


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where new keys begin among ascending ones."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))


class Counts:
    """Distinct keys and how often they occurred, from many additions."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.limit = 0, HELD

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        """Ascending keys and their counts."""
        self.held.append((keys, n))
        self.size += len(keys)
        if self.size > self.limit:
            self.limit = max(HELD, 2 * len(self.merged()[0]))

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys, ascending, and their counts."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.held) > 1:
            k, n = (np.concatenate(x) for x in zip(*self.held))
            order = np.argsort(k, kind="stable")  # a merge of ascending runs
            k, n = k[order], n[order]
            first = _runs(k)
            self.held = [(k[first], np.add.reduceat(n, first) if len(n) else n)]
            self.size = len(first)
        return self.held[0]


def count(texts: Iterable[bytes], counts: Counts, train: bool) -> None:
    """Add the texts' keys, counted only if they are training texts."""
    for data, starts, _ in pieces(texts, COUNTED):
        keys = deep_keys(data)
        keys = keys[~_context(len(data), starts)]
        keys.sort()
        first = _runs(keys)
        n = np.diff(np.append(first, len(keys))) if train else np.zeros(len(first), np.int64)
        counts.add(keys[first], n)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0: Stirling's series at x + 8."""
    low = np.log(x)
    for k in range(1, 8):
        low += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) - low


SMALL = np.arange(1 << 16, dtype=float)
LOG_HALVES, LOG_WHOLES = _lgamma(SMALL + 0.5), _lgamma(SMALL + 1)


def _log_gamma_of(counts: np.ndarray, table: np.ndarray, plus: float) -> np.ndarray:
    out = table[np.minimum(counts, len(table) - 1).astype(np.int64)]
    large = counts >= len(table)
    if large.any():
        out[large] = _lgamma(counts[large] + plus)
    return out


def _node(zeros: np.ndarray, ones: np.ndarray, kids: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """KT probability of a one, log weighted probability, posterior weight of the own estimate."""
    est = _log_gamma_of(zeros, LOG_HALVES, 0.5) + _log_gamma_of(ones, LOG_HALVES, 0.5) - _log_gamma_of(zeros + ones, LOG_WHOLES, 1) - np.log(np.pi)
    kt = (ones + 0.5) / (zeros + ones + 1)
    if kids is None:
        return kt, est, np.ones_like(est)
    return kt, np.logaddexp(est, kids) - np.log(2), 1 / (1 + np.exp(np.clip(kids - est, -700, 700)))


def _up(names: np.ndarray) -> np.ndarray:
    """Nodes (context * 256 + decision) without the farthest byte of context."""
    return names >> 16 << 8 | names & 255


def _at(key: np.ndarray, depth: int, j: int) -> np.ndarray:
    """The node of depth ``depth`` that decides on bit j of each key's byte."""
    return key >> (8 * (DEEP + 1 - depth)) << 8 | 1 << j | (key & 255) >> (8 - j)


def _find(names: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted in the ascending names, and which are there."""
    if not len(names):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    return at, names[at] == wanted


def subtrees(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """From ascending keys with all that share their TOP + 1 nearest bytes, and training
    counts: the inner probability of a one at each key's eight decisions (NaN where depth
    TOP + 1 has no node), and (names, zeros, ones, kids) of what the depth-TOP nodes gain."""
    k, c = key[n > 0], n[n > 0].astype(float)
    bits = np.concatenate([k >> (7 - j) & 1 for j in range(8)])
    names, at = np.unique(np.concatenate([_at(k, DEEP, j) for j in range(8)]), return_inverse=True)
    ones = np.bincount(at, np.tile(c, 8) * bits, len(names))
    zeros = np.bincount(at, np.tile(c, 8), len(names)) - ones
    used, kids, levels = at, None, []
    for _ in range(DEEP, TOP, -1):
        kt, lw, own = _node(zeros, ones, kids)
        up, at = np.unique(_up(names), return_inverse=True)
        levels.append((names, kt, own, at))
        names, zeros, ones, kids = up, np.bincount(at, zeros, len(up)), np.bincount(at, ones, len(up)), np.bincount(at, lw, len(up))
    top, mix, weight, inner = (names, zeros, ones, kids), np.zeros(len(names)), np.ones(len(names)), []
    for names, kt, own, at in reversed(levels):
        mix, weight = mix[at] + weight[at] * own * kt, weight[at] * (1 - own)
        inner.append((names, mix + weight * 0.5))  # at depth DEEP the weight is 0
    out = np.full((len(key), 8), np.nan)
    out[n > 0] = inner[-1][1][used].reshape(8, -1).T
    other = np.flatnonzero(n == 0)
    for j in range(8):
        todo = other
        for d in range(DEEP, TOP, -1):
            where, hit = _find(inner[d - TOP - 1][0], _at(key[todo], d, j))
            out[todo[hit], j] = inner[d - TOP - 1][1][where[hit]]
            todo = todo[~hit]
    return out, top


class Upper:
    """The tree's nodes of depth TOP and less."""

    def __init__(self, names: np.ndarray, zeros: np.ndarray, ones: np.ndarray, kids: np.ndarray):
        """From the depth-TOP nodes, ascending, with the sums of what ``subtrees`` gave."""
        levels = []
        for d in range(TOP, -1, -1):
            kt, lw, own = _node(zeros, ones, kids)
            up, at = np.unique(_up(names), return_inverse=True) if d else (names[:0], None)
            levels.append((names, kt, own, at))
            if d:
                names, zeros, ones, kids = up, np.bincount(at, zeros, len(up)), np.bincount(at, ones, len(up)), np.bincount(at, lw, len(up))
        self.levels = []  # (names, mix, weight) from depth 0
        for names, kt, own, at in reversed(levels):
            mix, weight = (self.levels[-1][1][at], self.levels[-1][2][at]) if self.levels else (np.zeros(len(names)), np.ones(len(names)))
            self.levels.append((names, mix + weight * own * kt, weight * (1 - own)))

    def logs(self, key: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """log10 probability of each key's byte in its context."""
        out = np.zeros(len(key))
        for j in range(8):
            one = np.full(len(key), 0.5)
            for d, (names, mix, weight) in enumerate(self.levels):
                at, hit = _find(names, _at(key, d, j))
                some = inner[hit, j] if d == TOP else 0.5
                one[hit] = mix[at[hit]] + weight[at[hit]] * np.where(np.isnan(some), 0.5, some)
            out += np.log10(np.where(key >> (7 - j) & 1, one, 1 - one))
        return out


def packed(values: np.ndarray) -> bytes:
    """Values of 4 or 8 bytes, compressed by byte planes; ascending keys as differences."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=0))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, "<i8"))


def packed_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b" ".join(words))


def unpacked_words(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b" ")


def _rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch of these columns; the others are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _bytes(column: pa.Array) -> list[bytes]:
    return [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in column]


SENT = "kind int, block long, slot int, keys binary, n binary"


def _arrow(fields: str, **more: pa.DataType) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(name, more.get(name) or kinds[kind]) for name, kind in (f.split() for f in fields.split(", "))])


def blocks(rows: DataFrame) -> DataFrame:
    """(kind, block, slot, keys, n, id, t, train): every text in its block, and what the
    blocks send. ``rows`` has id, t (text) and train."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, at = None, TaskContext.get().partitionId() << 32
        keys, words, size = Counts(), Counter(), 0

        def sent() -> Iterator[pa.RecordBatch]:
            k, n = keys.merged()
            three = k >> 8 * (DEEP - 2)
            first = _runs(three)
            slot = slots_of(three[first])
            order = np.argsort(slot, kind="stable")
            sizes = np.diff(np.append(first, len(k)))[order]
            at_key = ranges(first[order], sizes)
            k, n = k[at_key], n[at_key]
            ends, of = np.cumsum(sizes), slot[order]
            begin = _runs(of)
            cuts = np.append(np.concatenate(([0], ends))[begin], len(k))
            for x, a, b in zip(of[begin].tolist(), cuts, cuts[1:]):
                yield _rows(schema, kind=[KEYS], block=[at], slot=[x], keys=[packed_keys(k[a:b])], n=[packed(n[a:b])])
            dealt: dict[int, list[bytes]] = {}
            for w in words:
                dealt.setdefault(zlib.crc32(w) % SLOTS, []).append(w)
            for x, some in dealt.items():
                yield _rows(schema, kind=[WORDS], block=[at], slot=[x], keys=[packed_words(some)], n=[packed(np.array([words[w] for w in some], np.int64))])

        for batch in batches:
            schema = schema or _arrow(f"{SENT}, id {kind}, t string, train boolean", id=batch.schema.field(0).type)
            for part in slices(batch, 1, COUNTED):
                texts, train = _bytes(part.column(1)), part.column(2).to_pylist()
                yield _rows(schema, kind=[TEXT] * len(texts), block=[at] * len(texts), id=part.column(0), t=part.column(1), train=part.column(2))
                for side in (True, False):
                    count((t for t, use in zip(texts, train) if use == side), keys, side)
                for t, use in zip(texts, train):
                    own = t.translate(LOWER).split()
                    own.append(END_WORD)
                    words.update(own if use else dict.fromkeys(own, 0))
                size += sum(map(len, texts))
                if size >= BLOCK:
                    yield from sent()
                    at, keys, words, size = at + 1, Counts(), Counter(), 0
        if words:
            yield from sent()

    return rows.select("id", "t", "train").mapInArrow(run, f"{SENT}, id {kind}, t string, train boolean")


def slots_of(names: np.ndarray) -> np.ndarray:
    """The slot of each three-byte context."""
    return (names.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).view(np.int64) % SLOTS


GROWN = "kind int, slot int, keys binary, n binary, k long, z double, o double, kids double"


def grown(sent: DataFrame, last: bool) -> DataFrame:
    """(kind, slot, keys, n, k, z, o, kids): what the rows of each (kind, slot, share) of
    ``sent`` add up to. In the ``last`` step contexts also give what their subtrees add to
    the depth-TOP nodes (kind TOPS), words their number in training and the distinct of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(GROWN)
        now, keys, words = None, Counts(), Counter()

        def done() -> Iterator[pa.RecordBatch]:
            kind, slot = now[:2]
            if kind == WORDS:
                n = np.fromiter(words.values(), np.int64, len(words))
                yield _rows(schema, kind=[kind], slot=[slot], keys=[packed_words(list(words))], n=[packed(n)], z=[float(n.sum())], o=[float(np.count_nonzero(n))])
                return
            k, n = keys.merged()
            yield _rows(schema, kind=[kind], slot=[slot], keys=[packed_keys(k)], n=[packed(n)])
            if last:
                for a, b in _spans(k):
                    names, zeros, ones, kids = subtrees(k[a:b], n[a:b])[1]
                    yield _rows(schema, kind=np.full(len(names), TOPS, np.int32), k=names, z=zeros, o=ones, kids=kids)

        for batch in batches:
            for kind, slot, share, data, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (kind, slot, share) != now:
                    if now is not None:
                        yield from done()
                    now, keys, words = (kind, slot, share), Counts(), Counter()
                if kind == WORDS:
                    words.update(dict(zip(unpacked_words(data), unpacked(n, "<i8").tolist())))
                else:
                    keys.add(unpacked_keys(data), unpacked(n, "<i8"))
        if now is not None:
            yield from done()

    by = ["kind", "slot", "share"]
    return sent.select(*by, "keys", "n").repartition(*by).sortWithinPartitions(*by).mapInArrow(run, GROWN)


def _spans(keys: np.ndarray, size: int = 200_000) -> Iterator[tuple[int, int]]:
    """Parts of about so many ascending keys; no context of three bytes is in two."""
    three, at = keys >> 8 * (DEEP - 2), 0
    while at < len(keys):
        end = min(at + size, len(keys))
        end = int(np.searchsorted(three, three[end - 1], side="right"))
        yield at, end
        at = end


def answers(asked: DataFrame, upper: bytes) -> DataFrame:
    """(block, kind, keys, n): for each row of ``asked`` with a block the log10 probability of
    its keys (32-bit floats), or the counts of its words. ``asked`` also has each slot's sums,
    without a block, for every share."""
    shared = asked.sparkSession.sparkContext.broadcast(upper)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, model = _arrow("block long, kind int, keys binary, n binary"), pickle.loads(shared.value)
        now, table, words = None, None, {}
        for batch in batches:
            for kind, slot, share, block, data, n in zip(*(c.to_pylist() for c in batch.columns)):
                if block is None:
                    now = kind, slot, share
                    if kind == WORDS:
                        words = dict(zip(unpacked_words(data), unpacked(n, "<i8").tolist()))
                        continue
                    k, c = unpacked_keys(data), unpacked(n, "<i8")
                    table = Table(k, np.concatenate([model.logs(k[a:b], subtrees(k[a:b], c[a:b])[0]) for a, b in _spans(k)]).astype("<f4"))
                    continue
                if (kind, slot, share) != now:
                    raise RuntimeError("a slot's sums are missing")
                out = np.array([words[w] for w in unpacked_words(data)], "<i8") if kind == WORDS else table.get(unpacked_keys(data))[0]
                yield _rows(schema, block=[block], kind=[kind], keys=[data], n=[packed(out)])

    by = ["kind", "slot", "share"]
    # Nulls come first: a slot's sums stand before what it is asked.
    return asked.select(*by, "block", "keys", "n").repartition(*by).sortWithinPartitions(*by, "block").mapInArrow(run, "block long, kind int, keys binary, n binary")


def deep_scores(texts: list[bytes], logs: Table) -> np.ndarray:
    """log10 of each text's probability; ``logs`` has every key of the texts."""
    out = np.zeros(len(texts))
    for data, starts, owner in pieces(texts, CHUNK):
        lp = logs.get(deep_keys(data))[0].astype(np.float64)
        lp[_context(len(data), starts)] = 0
        np.add.at(out, owner, np.add.reduceat(lp, starts))
    return out


def scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte): one row
    per input row. ``train`` is a condition on ``docs``."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.coalesce(train, F.lit(False)).alias("train"))
    kind = rows.schema["id"].dataType.simpleString()
    made = materialize(blocks(rows), "ctw_blocks", compression="zstd")
    sent = made.filter(F.col("kind") != TEXT).select("kind", "block", "slot", "keys", "n")
    shares = max(1, -(-made.agg(F.count_distinct("block")).first()[0] // FAN))
    dealt = sent.withColumn("share", F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int"))
    alone = F.lit(0).alias("share")
    first = dealt if shares == 1 else materialize(grown(dealt, False), "ctw_shares").withColumn("share", alone)
    tree = materialize(grown(first, True), "ctw_slots")
    sums = tree.filter(F.col("kind") != TOPS)
    total = sums.filter(F.col("kind") == WORDS).agg(F.coalesce(F.sum("z"), F.lit(0.0)).alias("n"), F.coalesce(F.sum("o"), F.lit(0.0)).alias("v")).first()
    n_train, distinct = int(total["n"]), int(total["v"])
    tops = tree.filter(F.col("kind") == TOPS).groupBy("k").agg(F.sum("z"), F.sum("o"), F.sum("kids")).toArrow()
    arrays = [c.to_numpy() for c in tops.columns]
    order = np.argsort(arrays[0])
    upper = pickle.dumps(Upper(*(x[order] for x in arrays)), protocol=5)
    every = sums.select("kind", "slot", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(None).cast("long").alias("block"), "keys", "n")
    told = answers(every.unionByName(dealt), upper)
    texts = made.filter(F.col("kind") == TEXT).select("block", "kind", "keys", "n", "id", "t", "train")
    met = told.unionByName(texts, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind")
    fields = f"id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, now, logs, words = None, None, None, {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        below = float(np.log10(n_train + distinct + 1))
        for batch in batches:
            schema = schema or _arrow(fields, id=batch.schema.field("id").type)
            blocks_, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], (blocks_[1:] != blocks_[:-1]) | (kinds[1:] != kinds[:-1]), [True])))
            for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                part = batch.slice(a, b - a)
                if blocks_[a] != now:
                    now, held, logs, words = blocks_[a], [], None, {}
                if kinds[a] == KEYS:
                    held += [(unpacked_keys(x), unpacked(y, "<f4")) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                elif kinds[a] == WORDS:
                    for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                        words.update(zip(unpacked_words(x), unpacked(y, "<i8").tolist()))
                else:
                    if logs is None:
                        logs, held = Table(*(np.concatenate(x) for x in zip(*held))), []
                        unknown = {w for w, c in words.items() if not c}
                        words = dict(zip(words, np.log10(1.0 + np.fromiter(words.values(), np.int64, len(words))).tolist()))
                    for some in slices(part, 5, COUNTED):
                        raw = _bytes(some.column(5))
                        score = deep_scores(raw, logs)
                        n_tokens, n_known, base = [], [], []
                        for t, use in zip(raw, some.column(6).to_pylist()):
                            own = t.translate(LOWER).split()
                            own.append(END_WORD)
                            n_tokens.append(len(own))
                            n_known.append(len(own) if use else sum(w not in unknown for w in own))
                            base.append(sum(map(words.__getitem__, own)) - len(own) * below)
                        bits = -score / np.log10(2) / (1 + np.fromiter(map(len, raw), np.int64, len(raw)))
                        yield _rows(schema, id=some.column(4), train=some.column(6), n_tokens=n_tokens, n_known=n_known, train_tokens=[n_train] * len(raw), base_score=base, score=score, bits_per_byte=bits)

    return met.select("block", "kind", "keys", "n", "id", "t", "train").mapInArrow(run, fields)
