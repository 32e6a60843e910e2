"""Array helpers of the operators that run in Python workers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def give_back() -> None:
    """Return freed memory to the system, where the C library and Arrow hold on to it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of ``mapInArrow``, giving back memory after each batch and at its end: Spark
    keeps the worker, whose freed memory would else count beside that of later stages."""

    def fed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            give_back()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(fed(batches))
        give_back()

    return whole


class Table:
    """Whole-number keys (0 and up) to values, by open addressing; added to and looked up
    for whole arrays at once. It doubles before it is half full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.size, bits = 0, max(6, int(2 * len(keys)).bit_length())
        self._clear(bits, values.dtype)
        self.add(keys, values)

    def _clear(self, bits: int, kind: np.dtype) -> None:
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, kind)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Put in distinct keys that are not there yet."""
        keys = np.ascontiguousarray(keys, np.int64)
        if 2 * (self.size + len(keys)) > len(self.keys):
            held = np.flatnonzero(self.keys >= 0)
            keys, values = np.concatenate((self.keys[held], keys)), np.concatenate((self.values[held], values))
            self._clear(max(6, int(4 * len(keys)).bit_length()), self.values.dtype)
            self.size = 0
        self.size += len(keys)
        at, left = self._first(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]
            won = self.keys[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], at[~won] + 1 & self.mask

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each key (anything where there is none) and whether there is one."""
        keys = np.ascontiguousarray(keys, np.int64)
        at = self._first(keys)
        found, out = self.keys[at], self.values[at]
        hit = found == keys
        miss = np.flatnonzero(~hit & (found >= 0))
        at = at[miss]
        while len(miss):
            at = at + 1 & self.mask
            found = self.keys[at]
            ok = found == keys[miss]
            hit[miss[ok]] = True
            out[miss[ok]] = self.values[at[ok]]
            on = ~ok & (found >= 0)
            miss, at = miss[on], at[on]
        return out, hit


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[k], starts[k] + 1 ... of which there are sizes[k], one k after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, nulls empty, and the n + 1 offsets into them."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column over bytes and the n + 1 offsets into them."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with at most ``limit`` bytes in a column, or one row."""
    sizes = np.diff(bytes_of(batch.column(column))[1])
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + limit, side="right")))
        yield batch.slice(at, upto - at)
        at = upto
