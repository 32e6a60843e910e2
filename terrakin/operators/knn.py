"""Nearest-neighbour joins. ``points`` has id and features (doubles); results are
(q, rank, c, dist), rank 0 the point itself, ties to the smaller id."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from terrakin.functions.vectors import doubles
from terrakin.storage import discard, materialize

BLOCK, TILE, ROWS, PAIRS = 4_096, 256, 64, 262_144
FOUND = pa.schema([("q", pa.int64()), ("c", pa.int64()), ("dist", pa.float64())])


def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and rows of a table whose first columns are id and features."""
    features = table.column(1).combine_chunks()
    if isinstance(features, pa.ChunkedArray):
        features = pa.concat_arrays(features.chunks)
    return table.column(0).to_numpy(), features.flatten().to_numpy().reshape(table.num_rows, -1)


def nearest(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, distance) of each query's k nearest others."""
    best = Nearest(q_ids, q, k)
    best.meet(c_ids, c, np.arange(len(c)))
    r, at = np.nonzero(best.rows >= 0)
    return r, best.rows[r, at], best.dists[r, at]


class Nearest:
    """The ``k`` nearest others of some queries among all blocks of candidates met so far, ties
    to the smaller id. A matrix product of single precision gives a lower bound of every squared
    distance; the pairs that it leaves are summed in doubles dimension by dimension, as SQL
    would. Where it leaves too many, one of double precision leaves fewer."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        self.ids, self.x, self.k = ids, x, k
        whole = x[np.isfinite(x).all(axis=1)]
        self.middle = whole.mean(axis=0) if len(whole) else np.zeros(x.shape[1])
        self.centred = x - self.middle
        self.dists, self.found, self.rows = np.full((len(x), k), np.inf), np.zeros((len(x), k), np.int64), np.full((len(x), k), -1, np.int64)

    def _bounds(self, c: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two matrices whose product bounds squared distances from below, and by how much they
        are larger at most."""
        share = float(np.finfo(kind).eps) * 2 * (c.shape[1] + 16)
        one, other = self.centred, c - self.middle
        nq, nc = (one * one).sum(axis=1), (other * other).sum(axis=1)
        # What centring itself may round off, where all points lie far from 0.
        off = 4 * np.finfo(float).eps * c.shape[1] ** 0.5 * np.abs(self.middle).max(initial=0)
        slack = off * off + 2 * off * np.sqrt(2 * (nq + np.nanmax(nc)))
        left = np.concatenate([-2 * one, np.ones((len(one), 1)), (nq * (1 - share) - slack)[:, None]], axis=1).astype(kind)
        right = np.concatenate([other, nc[:, None] * (1 - share), np.ones((len(c), 1))], axis=1).astype(kind)
        return left, right.T.copy(), 2 * share * (nq + np.nanmax(nc)) + 2 * slack

    def meet(self, c_ids: np.ndarray, c: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Take in a block of candidates."""
        if not len(c) or not len(self.x) or not self.k:
            return
        with np.errstate(over="ignore", invalid="ignore"):
            single = self._bounds(c, np.float32)
        double = None
        if not (np.isfinite(single[0]).all() and np.isfinite(single[1]).all()):
            single = double = self._bounds(c, np.float64)
        kth = self.dists[:, -1] ** 2 * (1 + 1e-12)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for a in range(0, len(self.x), ROWS):
            z = min(len(self.x), a + ROWS)
            got = self._pairs(single, kth[a:z], a, z, c_ids)
            if len(got[0]) > (z - a) * len(c) // 16 and double is not single:
                double = double or self._bounds(c, np.float64)
                got = self._pairs(double, kth[a:z], a, z, c_ids)
            held.append(got)
            if z == len(self.x) or sum(len(r) for r, _ in held) > PAIRS:
                self.take(*(np.concatenate(x) for x in zip(*held)), c_ids, c, rows)
                held = []

    def _pairs(self, bounds: tuple[np.ndarray, np.ndarray, np.ndarray], kth: np.ndarray, a: int, z: int, c_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right, over = bounds
        low = left[a:z] @ right
        if not np.isfinite(kth).all():  # not all have k neighbours yet: this block's own bound
            low[self.ids[a:z, None] == c_ids[None, :]] = np.inf
            k = min(self.k, low.shape[1]) - 1
            most = np.partition(low, k, axis=1)[:, k].astype(float) + over[a:z]
            kth = np.where(np.isfinite(most) & (k + 1 == self.k), np.minimum(kth, most), kth)
        # The next number up, as the comparison is of the product's precision.
        near = (low <= np.nextafter(kth.astype(low.dtype), np.inf)[:, None]).ravel()
        if len(near) % 8:
            at = np.flatnonzero(near)
        else:  # most are not near: eight at a time
            some = np.flatnonzero(near.view(np.uint64))
            at = (some[:, None] * 8 + np.arange(8))[near.reshape(-1, 8)[some]]
        r, s = np.divmod(at, low.shape[1])
        other = self.ids[r + a] != c_ids[s]
        return r[other] + a, s[other]

    def take(self, r: np.ndarray, s: np.ndarray, c_ids: np.ndarray, c: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Measure these pairs of a query's row and a candidate's and keep the nearest."""
        if not len(r):
            return
        d = np.empty(len(r))
        for m in range(0, len(r), PAIRS):
            acc = np.zeros(len(r[m : m + PAIRS]))
            for t in range(c.shape[1]):
                diff = self.x[r[m : m + PAIRS], t] - c[s[m : m + PAIRS], t]
                acc += diff * diff
            d[m : m + PAIRS] = np.sqrt(acc)
        new = d <= self.dists[r, -1]
        r, s, d = r[new], s[new], d[new]
        if not len(r):
            return
        touched = np.unique(r)
        row = np.concatenate([np.repeat(touched, self.k), r])
        dist = np.concatenate([self.dists[touched].ravel(), d])
        name = np.concatenate([self.found[touched].ravel(), c_ids[s]])
        at = np.concatenate([self.rows[touched].ravel(), rows[s] if rows is not None else np.zeros(len(s), np.int64)])
        order = np.lexsort((name, dist, row))
        row = row[order]
        first = np.arange(len(row)) - np.searchsorted(row, row, side="left") < self.k
        order = order[first]  # k of every row, as there were k before
        self.dists[touched], self.found[touched], self.rows[touched] = (x[order].reshape(-1, self.k) for x in (dist, name, at))

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, neighbour, distance), by ids."""
        r, at = np.nonzero(self.rows >= 0)
        return self.ids[r], self.found[r, at], self.dists[r, at]


def _self(points: DataFrame) -> DataFrame:
    return points.select(F.col("id").alias("q"), F.lit(0).alias("rank"), F.col("id").alias("c"), F.lit(0.0).alias("dist"))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy("dist", "c"))
    return found.withColumn("rank", rank).filter(F.col("rank") < k).select("q", "rank", "c", "dist")


def _packed(points: DataFrame, parts: int, block: int) -> DataFrame:
    """(ids, x): the points in ``parts`` even partitions, a row for up to ``block`` of them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def row(some: list[pa.RecordBatch]) -> pa.RecordBatch:
            ids, x = matrix(pa.Table.from_batches(some))
            return pa.RecordBatch.from_arrays([pa.array([ids.astype(np.int64).tobytes()]), pa.array([np.asarray(x, float).tobytes()])], ["ids", "x"])

        for batch in batches:
            while batch.num_rows:
                room = block - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if room <= held[-1].num_rows:
                    yield row(held)
                    held = []
        if held:
            yield row(held)

    return points.select("id", doubles(F.col("features")).alias("features")).repartition(parts).mapInArrow(pack, "ids binary, x binary")


def unpacked(ids: pa.Scalar, x: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids.as_buffer(), np.int64)
    return ids, np.frombuffer(x.as_buffer(), float).reshape(len(ids), -1)


def _meet(points: DataFrame, queries: DataFrame, block: int, kernel, schema: str) -> DataFrame:
    """All points pass by every group of queries: ``kernel(ids, rows)`` is made for a group, its
    ``meet(ids, rows)`` takes a block of points and its ``end()`` what is left, both yield record
    batches. The points are written once, in blocks; a task streams them from the shared folder
    and holds one block and one group of about ``block`` queries, so nothing is copied for the
    pairs of blocks."""
    n, m, cores = points.count(), queries.count(), points.sparkSession.sparkContext.defaultParallelism
    blocks = materialize(_packed(points, max(1, math.ceil(n / block)), block), "knn_blocks")
    groups = max(1, math.ceil(m / block), min(math.ceil(m / 64), 2 * cores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, object] = {}  # of the task's groups, as a rule one
        for batch in batches:
            for k in range(batch.num_rows):
                c_ids, c_x, q_ids, q_x = (batch.column(t)[k] for t in range(4))
                name = q_ids.as_py()
                if name not in held:
                    held[name] = kernel(*unpacked(q_ids, q_x))
                yield from held[name].meet(*unpacked(c_ids, c_x))
        for group in held.values():
            yield from group.end()

    left = blocks.coalesce(1).withColumnsRenamed({"ids": "c_ids", "x": "c_x"}).hint("shuffle_replicate_nl")
    return left.crossJoin(_packed(queries, groups, math.ceil(m / groups) + block)).mapInArrow(run, schema)


class _Ranking:
    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        self.best = Nearest(ids, x, k)

    def meet(self, c_ids: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.best.meet(c_ids, c)
        return iter(())

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from pa.Table.from_arrays([pa.array(x) for x in self.best.table()], schema=FOUND).to_batches(max_chunksize=65_536)


class _Distances:
    """All distances to points of larger ids, in tiles."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]

    def meet(self, c_ids: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(c_ids, kind="stable")
        c_ids, c = c_ids[order], c[order]
        for a in range(0, len(self.ids), TILE):
            ids, x = self.ids[a : a + TILE], self.x[a : a + TILE]
            low = np.searchsorted(c_ids, ids[0], side="right")
            for b in range(low, len(c_ids), TILE):
                near, y = c_ids[b : b + TILE], c[b : b + TILE]
                acc = np.zeros((len(ids), len(near)))
                for t in range(x.shape[1]):
                    diff = x[:, t, None] - y[None, :, t]
                    acc += diff * diff
                r, s = np.nonzero(ids[:, None] < near[None, :])
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(near[s]), pa.array(np.sqrt(acc[r, s]))], schema=FOUND)

    def end(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def exact(points: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """The k nearest of every point, itself included. All points meet all others, so the work is
    quadratic by definition; what is written and shuffled is linear."""
    if k < 2:
        return _self(points)
    return _self(points).unionByName(_ranked(_meet(points, points, block, lambda ids, x: _Ranking(ids, x, k - 1), "q long, c long, dist double"), k))


def pairwise(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """(q, c, dist) of all pairs q < c: the whole distance matrix, once. Its rows are quadratic
    by definition; beside them only the points are written, and a task holds two blocks."""
    return _meet(points, points, block, _Distances, "q long, c long, dist double")


def precomputed(dists: DataFrame, k: int) -> DataFrame:
    """The k smallest of each row of a distance table (row, col, dist); a row's own column
    comes first among equals. A row of fewer than k distances is an error."""
    if not dists.groupBy("row").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < k).isEmpty():
        raise ValueError(f"some rows hold fewer than {k} distances")
    rank = F.row_number().over(Window.partitionBy("row").orderBy("dist", (F.col("row") != F.col("col")).cast("int"), "col")) - 1
    return dists.withColumn("rank", rank).filter(F.col("rank") < k).select(F.col("row").alias("q"), "rank", F.col("col").alias("c"), "dist")


def approximate(points: DataFrame, k: int, trees: int = 8, cell: int = 512, rounds: int = 2, candidates: int = 10, seed: int = 42) -> DataFrame:
    """Near-linear search. Each of ``trees`` random directions orders the points; within
    windows of ``cell`` consecutive points, overlapping by half, neighbours are exact. Each
    descent round then tries the neighbours of neighbours (``candidates`` nearest each way).
    Distances are exact; which neighbours are found is not guaranteed."""
    spark = points.sparkSession
    base = materialize(points.select("id", doubles(F.col("features")).alias("features")), "knn_points")
    first = base.select(F.size("features")).first()
    dims = first[0] if first else 0
    directions = np.random.default_rng(seed).standard_normal((trees, dims))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = matrix(pa.Table.from_batches([batch]))
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), t, np.int32)), pa.array(x @ directions[t]), *batch.columns], ["tree", "at", "id", "features"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            ids, x = matrix(rows)
            r, s, d = nearest(ids, x, ids, x, k - 1)
            yield from pa.Table.from_arrays([pa.array(ids[r]), pa.array(ids[s]), pa.array(d)], schema=FOUND).to_batches()

        held: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch]).select(["id", "features"])
            held = new if held is None else pa.concat_tables([held, new])
            while held.num_rows >= cell:
                yield from found(held.slice(0, cell))
                held = held.slice(cell // 2)
        if held is not None and held.num_rows:
            yield from found(held)

    projected = base.mapInArrow(project, "tree int, at double, id long, features array<double>")
    ordered = projected.repartitionByRange("tree", "at").sortWithinPartitions("tree", "at", "id")
    now = materialize(_ranked(ordered.mapInArrow(search, "q long, c long, dist double").distinct(), k), "knn_round")
    for _ in range(rounds):
        near = now.filter(F.col("rank") <= candidates).select("q", "c")
        back = now.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy("dist", "q"))).filter(F.col("r") <= candidates)
        links = near.union(back.select(F.col("c").alias("q"), F.col("q").alias("c"))).groupBy("q").agg(F.collect_set("c").alias("far"))
        links = materialize(links, "knn_links")
        # Lists of neighbours travel, not pairs; each point's pairs are made where they are measured.
        lists = links.select("q", F.explode("far").alias("c")).join(links.select(F.col("q").alias("c"), "far"), "c").groupBy("q").agg(F.flatten(F.collect_list("far")).alias("far"))
        known = now.groupBy("q").agg(F.collect_list("c").alias("known"))
        wanted = lists.join(known, "q", "left").select("q", F.array_except(F.array_except(F.array_distinct("far"), F.coalesce("known", F.array().cast("array<bigint>"))), F.array("q")).alias("far"))
        tried = _measured(base, wanted.filter(F.size("far") > 0), k - 1)
        last, now = now, materialize(_ranked(now.select("q", "c", "dist").union(tried), k), "knn_round")
        discard(last), discard(links)
    return _self(base).unionByName(now)


def _measured(points: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(q, c, dist) of every point q and the k nearest of the points ``far`` (an array) that it is
    to be measured with. A task holds some points with their lists and streams all blocks of
    points past them, so vectors are not copied for the pairs."""
    n, cores, block = points.count(), points.sparkSession.sparkContext.defaultParallelism, 8 * BLOCK
    blocks = materialize(_packed(points, max(1, math.ceil(n / block)), block), "knn_blocks")
    groups = max(1, math.ceil(n / BLOCK), min(math.ceil(n / 64), 2 * cores))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            all_ = pa.Table.from_batches(rows).combine_chunks()
            q, far, x = all_.column("q").to_numpy(), all_.column("far").combine_chunks(), all_.column("features").combine_chunks()
            far, x = (pa.concat_arrays(y.chunks) if isinstance(y, pa.ChunkedArray) else y for y in (far, x))
            sizes = far.value_lengths().to_numpy()
            c, at = far.flatten().to_numpy(), np.repeat(np.arange(len(q)), sizes)
            order = np.argsort(c, kind="stable")
            yield pa.RecordBatch.from_arrays([pa.array([y.tobytes()], pa.binary()) for y in (q, x.flatten().to_numpy(), c[order], at[order].astype(np.int32))], ["q", "x", "c", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: Nearest | None = None  # a task has one group
        for batch in batches:
            for row in range(batch.num_rows):
                q, c, at = (np.frombuffer(batch.column(n)[row].as_buffer(), t) for n, t in (("q", np.int64), ("c", np.int64), ("at", np.int32)))
                if best is None:
                    best = Nearest(q.copy(), np.frombuffer(batch.column("x")[row].as_buffer(), float).reshape(len(q), -1).copy(), k)
                c_ids, y = unpacked(batch.column("c_ids")[row], batch.column("c_x")[row])
                low, high = np.searchsorted(c, c_ids, side="left"), np.searchsorted(c, c_ids, side="right")
                s = np.repeat(np.arange(len(c_ids)), high - low)
                pair = np.arange(len(s)) - np.repeat(np.cumsum(high - low) - high, high - low)
                for m in range(0, len(s), PAIRS):
                    best.take(at[pair[m : m + PAIRS]], s[m : m + PAIRS], c_ids, y)
        if best is not None:
            yield from pa.Table.from_arrays([pa.array(x) for x in best.table()], schema=FOUND).to_batches(max_chunksize=65_536)

    listed = wanted.join(points.withColumnRenamed("id", "q"), "q").repartition(groups, "q").mapInArrow(pack, "q binary, x binary, c binary, at binary")
    left = blocks.coalesce(1).withColumnsRenamed({"ids": "c_ids", "x": "c_x"}).hint("shuffle_replicate_nl")
    return left.crossJoin(listed).mapInArrow(run, "q long, c long, dist double")


def search(points: DataFrame, k: int, algorithm: str = "exact", seed: int = 42) -> DataFrame:
    from terrakin.params import EXACT

    return exact(points, k) if algorithm in EXACT else approximate(points, k, seed=seed)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(recall): share of the true neighbours (rank 1 and up) that were found."""
    hit = truth.filter("rank > 0").join(found.filter("rank > 0").select("q", "c", F.lit(1).alias("hit")), ["q", "c"], "left")
    return hit.agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def label_agreement(knn: DataFrame, points: DataFrame) -> DataFrame:
    """(q, same, n): how many of a point's neighbours share its label."""
    a = points.select(F.col("id").alias("q"), F.col("label").alias("own"))
    b = points.select(F.col("id").alias("c"), F.col("label").alias("other"))
    return knn.filter("rank > 0").join(a, "q").join(b, "c").groupBy("q").agg(F.count(F.when(F.col("own") == F.col("other"), 1)).alias("same"), F.count(F.lit(1)).alias("n"))


def shifted(knn: DataFrame, points: DataFrame) -> DataFrame:
    """(id, at, value): every point moved by the mean difference to its neighbours (rank 1 and
    up), which is to their mean, by dimension."""
    there = points.select(F.col("id").alias("c"), "features")
    # Vectors are dealt by the point they count for, whole: their sums need no other exchange.
    met = knn.filter("rank > 0").select("q", "c").join(there, "c").select(F.col("q").alias("id"), "features").repartition("id")
    return met.select("id", F.posexplode("features").alias("at", "v")).groupBy("id", "at").agg(F.avg(F.col("v").cast("double")).alias("value"))
