"""Context-tree weighting against a naive tree that counts one decision at a time."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrakin.llm import ctw
from terrakin.llm.arrays import Table

TRAIN = [b"the cat sat on the mat", b"the hat", b"", "déjà vu THE CAT".encode(), b"the cat sat on the mat"]
OTHER = [b"the cat sat", b"zebra!", "déjà".encode(), b"9 HATS"]


def kt(z: int, o: int) -> float:
    return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)


class Naive:
    """Counts of every (decision node, context path); weighted probabilities by recursion."""

    def __init__(self):
        self.n = defaultdict(lambda: [0, 0])
        self.kids = defaultdict(set)

    def add(self, u: int, path: tuple[int, ...], bit: int, times: int = 1) -> None:
        for d in range(ctw.DEEP + 1):
            self.n[u, path[:d]][bit] += times
            if d:
                self.kids[u, path[: d - 1]].add(path[d - 1])

    def weighted(self, u: int, path: tuple[int, ...]) -> float:
        est = kt(*self.n[u, path])
        if len(path) == ctw.DEEP:
            return est
        below = sum(self.weighted(u, (*path, k)) for k in self.kids[u, path])
        return np.logaddexp(est, below) - math.log(2)

    def bit(self, u: int, path: tuple[int, ...], bit: int) -> float:
        was = self.weighted(u, ())
        self.add(u, path, bit)
        now = self.weighted(u, ())
        self.add(u, path, bit, -1)
        return (now - was) / math.log(10)


def walk(text: bytes):
    full = b"\n" * ctw.DEEP + text + b"\xff"
    for k in range(ctw.DEEP, len(full)):
        u = 1
        for s in range(7, -1, -1):
            bit = full[k] >> s & 1
            yield u, tuple(full[k - 1 - d] for d in range(ctw.DEEP)), bit
            u = 2 * u + bit


@pytest.mark.parametrize("block, fan", [(ctw.BLOCK, ctw.FAN), (20, 2), (20, 1_000)])
def test_scores_are_the_quotients_of_weighted_probabilities(spark, monkeypatch, block, fan):
    """Of exact contexts of all depths; with one block, and with many in one or two steps."""
    monkeypatch.setattr(ctw, "BLOCK", block)
    monkeypatch.setattr(ctw, "FAN", fan)
    naive = Naive()
    for t in TRAIN:
        for step in walk(t):
            naive.add(*step)
    texts = TRAIN + OTHER
    df = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["id"]: r for r in ctw.scores(df, F.col("doc_id") < len(TRAIN)).collect()}
    for k, t in enumerate(texts):
        want = sum(naive.bit(*step) for step in walk(t))
        assert abs(got[k]["score"] - want) < 1e-6
        assert math.isclose(got[k]["bits_per_byte"], -want * math.log2(10) / (len(t) + 1), rel_tol=1e-5)


def test_without_training_every_decision_is_one_half(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "")], "doc_id long, text string")
    got = {r["id"]: r["score"] for r in ctw.scores(df, F.lit(False)).collect()}
    assert all(abs(got[k] - n * 8 * math.log10(0.5)) < 1e-6 for k, n in ((1, 3), (2, 1)))


def test_contexts_are_exact_and_case_counts(spark):
    df = spark.createDataFrame([(k, "xB1 " * 200 + "xC2 " * 200) for k in range(3)] + [(9, "xB1 " * 50), (10, "xB2 " * 50)], "doc_id long, text string")
    got = {r["id"]: r["score"] for r in ctw.scores(df, F.col("doc_id") < 3).collect()}
    assert got[9] > got[10] + 50


def test_bytes_of_every_context_sum_to_one():
    counts = ctw.Counts()
    ctw.count([b"some words and some more words"], counts, True)
    seen, _ = counts.merged()
    for context in np.unique(seen >> 8)[::5]:
        every = np.union1d(seen, context << 8 | np.arange(256))
        n = np.zeros(len(every), np.int64)
        n[np.searchsorted(every, seen)] = counts.merged()[1]
        grown = [ctw.subtrees(every[a:b], n[a:b]) for a, b in ctw._spans(every)]
        upper = ctw.Upper(*(np.concatenate(x) for x in zip(*(g[1] for g in grown))))
        logs = upper.logs(every, np.concatenate([g[0] for g in grown]))
        assert abs((10.0 ** logs[every >> 8 == context]).sum() - 1) < 1e-9


def test_long_texts_are_cut_without_effect(monkeypatch):
    texts = [b"abcdefgh" * 9, b"", b"xyz" * 5]

    def run():
        counts = ctw.Counts()
        ctw.count(texts, counts, True)
        k, n = counts.merged()
        return k, n, ctw.deep_scores(texts, Table(k, -np.arange(len(k), dtype=np.float32)))

    whole = run()
    monkeypatch.setattr(ctw, "CHUNK", 7)
    monkeypatch.setattr(ctw, "COUNTED", 5)
    monkeypatch.setattr(ctw, "HELD", 3)
    assert all(np.array_equal(a, b) for a, b in zip(whole, run()))
    assert whole[1].sum() == sum(map(len, texts)) + 3


def test_keys_are_packed_and_dealt_whole():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 56, 5_000))
    assert (ctw.unpacked_keys(ctw.packed_keys(keys)) == keys).all()
    logs = rng.random(77).astype("<f4")
    assert (ctw.unpacked(ctw.packed(logs), "<f4") == logs).all()
    assert ctw.unpacked_words(ctw.packed_words([b"", b"a\0b", b"c"])) == [b"", b"a\0b", b"c"]
    assert [x for a, b in ctw._spans(keys, 10) for x in range(a, b)] == list(range(len(keys)))


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 2, 7.5, 100.5, 1e9])
    assert np.allclose(ctw._lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-10)
