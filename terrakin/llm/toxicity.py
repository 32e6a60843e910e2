"""Toxicity by compression distance: one zstandard dictionary of toxic and one of ordinary
text; a window of a document speaks for toxicity by as many bytes as the toxic dictionary
makes it shorter.

Windows are ``WORDS`` consecutive words (white space folded to one space, A-Z lower-cased,
cut again at ``WIDEST`` bytes), so every byte of a whole text is scored. Toxic documents are
mostly ordinary text, so a dictionary of all of it (which is what zstandard's own trainer
makes: it keeps what is frequent) tells nothing. Each dictionary is trained on its class by
document frequency instead. The ordinary one takes passages from all ordinary documents of
the sample in turn. The toxic one takes every passage of words whose beginnings (``GRAMS``
bytes with the space before, or the whole of a shorter word) are in toxic documents more often than in ordinary ones by ``Z``
standard errors and a factor of ``LIFT``; behind that it holds the ordinary one's content, so
that a window without such words is compressed alike by both. On documents that the dictionaries
have not seen, a logistic curve is calibrated on how the windows' savings stand out: the mean
of exp(savings / 2), the largest, the sum of what is above ``QUIET`` bytes, the mean, and the
share of windows that save ``MARK`` bytes or more.

Labels come from a bounded sample: at most ``per_class`` labelled documents of each class, the
smallest by a hash of their id, and of each the whole text. Each class weighs in the
calibration as much as it has labelled documents.

Defined results: null and empty texts have no window and the score of a document without
evidence; very long texts are scored window by window to their end; repeated rows are scored
each, equal texts alike; a null id keeps its row and is never a training row; rows of ``labels``
with null labels are ignored; conflicting repeated labels count for both classes; of rows that
share a labelled id the smallest text is learned from; extra columns are ignored; an empty
table gives an empty result. With too few labelled rows of either class, or without telling
passages, every score is the share of label 1 (0 if there is none).
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from terrakin.llm.arrays import thrifty

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORDS, WIDEST = 8, 1024
LEVEL, STRATEGY, MATCH = 9, zstandard.STRATEGY_BTLAZY2, 4
GRAMS, Z, LIFT, LEAST = (6, 8, 10), 4.5, 3.0, 4
QUIET, MARK, FEATURES = 3, 2, 5
PLAIN_BYTES = 110_000


def windows(text: str | None) -> list[bytes]:
    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    out = []
    for at in range(0, len(parts), WORDS):
        w = b" ".join(parts[at : at + WORDS])
        out += [w] if len(w) <= WIDEST else [w[a : a + WIDEST] for a in range(0, len(w), WIDEST)]
    return out


@dataclass
class Model:
    """Both dictionaries and the logistic curve (bias, weights of the features)."""

    toxic: bytes = b""
    plain: bytes = b""
    curve: tuple[float, ...] = (-50.0,)

    def __post_init__(self) -> None:
        self.pair = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"pair": None}

    def savings(self, text: str | None) -> np.ndarray:
        """For each window the bytes saved by the toxic dictionary against the ordinary one."""
        if self.pair is None:
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MATCH, strategy=STRATEGY, write_content_size=0, write_dict_id=0, write_checksum=0)
            self.pair = []
            for raw in (self.toxic, self.plain):
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=how)
                self.pair.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress)
        a, b = self.pair
        return np.fromiter((len(b(w)) - len(a(w)) for w in windows(text)), np.int32)

    def features(self, text: str | None) -> tuple[float, ...]:
        s = self.savings(text)
        if not len(s):
            return (0.0,) * FEATURES
        return math.log(float(np.exp(np.minimum(s, 40) / 2).mean())), float(s.max()), math.log1p(int(np.maximum(s - QUIET, 0).sum())), float(s.mean()), float((s >= MARK).mean())

    def score(self, text: str | None) -> float:
        z = self.curve[0]
        if self.toxic:
            z += sum(w * f for w, f in zip(self.curve[1:], self.features(text)))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def beginnings(word: bytes) -> set[bytes]:
    """The first GRAMS bytes of a word with a space before and behind."""
    return {(b" %b " % word)[:n] for n in GRAMS}


def telling(toxic: list[bytes], plain: list[bytes]) -> set[bytes]:
    """The beginnings of words that mark toxic documents."""

    def grams(b: bytes) -> set[bytes]:
        return {g for w in set(b.split()) for g in beginnings(w)}

    often = {g: c for g, c in Counter(g for b in toxic for g in grams(b)).items() if c >= LEAST}
    other = Counter(g for b in plain for g in grams(b) & often.keys())
    n0, n1 = len(plain), len(toxic)

    def marks(g: bytes) -> bool:
        a, b = often[g], other[g]
        p = (a + b) / (n0 + n1)
        return a / n1 > LIFT * (b + 1) / n0 and a / n1 - b / n0 > Z * math.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))

    return {g for g in often if marks(g)}


def passages(data: bytes, grams: set[bytes]) -> list[bytes]:
    """The runs of words in ``data`` that begin with telling strings, with a space before."""
    out: list[list[bytes]] = [[]]
    for w in data.split():
        if not grams.isdisjoint(beginnings(w)):
            out[-1].append(w)
        elif out[-1]:
            out.append([])
    return [b" " + b" ".join(run) for run in out if run]


def train(texts: list[str], labels: list[int], weights: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Fit on labelled texts: even positions of each class make the dictionaries, odd ones
    calibrate. ``weights``: of a document of class 0 and 1 in the calibration."""
    total = [weights[k] * labels.count(k) for k in (0, 1)]
    prior = math.log(max(total[1], 1e-9) / max(total[0], 1e-9))
    flat = Model(curve=(max(-50.0, min(50.0, prior)),))
    if not labels:
        return Model()
    sides = {k: [t for t, y in zip(texts, labels) if y == k] for k in (0, 1)}
    if min(len(sides[0]), len(sides[1])) < 8:
        return flat
    cut = {k: [b" " + b" ".join(windows(t)) + b" " for t in v[::2]] for k, v in sides.items()}
    grams = telling(cut[1], cut[0])
    found = Counter(p for b in cut[1] for p in passages(b, grams))
    if not found:
        return flat
    toxic = b""
    for p, _ in sorted(found.items(), key=lambda x: (-len(x[0]), x[0])):  # each passage once
        if p + b" " not in toxic + b" ":
            toxic += p
    # Ordinary passages from all over the sample: a slice of each document in turn.
    step, longest, plain = 64, max(map(len, cut[0])), b""
    while len(plain) < PLAIN_BYTES and step < 2 * longest:
        plain = b"".join(b[len(b) // 3 : len(b) // 3 + step] for b in cut[0])
        step *= 2
    base = plain[-PLAIN_BYTES:]
    model = Model(toxic + base, base)
    held = [(t, k) for k in (0, 1) for t in sides[k][1::2]]
    x = np.array([(1.0, *model.features(t)) for t, _ in held])
    y = np.array([float(k) for _, k in held])
    model.curve = _logistic(x, y, np.where(y == 1, weights[1], weights[0]))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Newton steps for P(y) = 1 / (1 + exp(-x b)), with a small ridge."""
    b, w = np.zeros(x.shape[1]), w / w.mean()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (w * (y - p)) - ridge * b
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), grad)
        b = b + step * min(1.0, 4 / (abs(step).max() + 1e-12))
        if abs(step).max() < 1e-9:
            break
    return tuple(map(float, b))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on at most ``per_class`` labelled documents of each class."""
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").distinct()
    counts = {r["y"]: r["n"] for r in named.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [named.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    # A row for each id and class, however often documents repeat an id: the sample stays bounded.
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = texts.join(F.broadcast(picked[0].unionAll(picked[1])), "id").groupBy("id", "y").agg(F.min("t").alias("t")).orderBy("id", "y").collect()
    return train([r["t"] for r in rows], [r["y"] for r in rows], tuple(counts.get(y, 0) / min(max(counts.get(y, 0), 1), per_class) for y in (0, 1)))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` as (id, score): 0 to 1, higher where label 1 is likelier."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.score(t.as_py()) for t in batch.column(1)], pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, score double")


def rejected(docs: DataFrame, model: Model, text_col: str = "text", cutoff: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text scores ``cutoff`` or more; columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([m.score(t.as_py()) < cutoff for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(thrifty(run), docs.schema)
