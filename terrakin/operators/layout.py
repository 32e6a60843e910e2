"""Layouts: initial positions and stochastic gradient descent over a weighted graph."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from terrakin.functions.rng import uniform
from terrakin.functions.vectors import clipped
from terrakin.operators.components import components
from terrakin.operators.index import numbered
from terrakin.storage import discard, materialize

NEGATIVES, LIMIT, PUSH = 5, 4.0, 4.0
#: Up to so many vertices and edges a layout is one task's work; beyond, epochs are passes.
ROWS, EDGES = 50_000, 1_000_000
SOLVED = 32_000_000  # edges of a component whose eigenvectors one task finds
DENSE, LEAST = 3_000, 4  # vertices of a component for a dense eigen-solver, and for any
TOLERANCE, STEPS = 1e-6, 400  # of the iterated solver
PLACE = "id long, x double, y double"


def random_init(nodes: DataFrame, level: int, seed: int) -> DataFrame:
    """(id, x, y) uniform in [-10, 10)."""
    draw = lambda dim: uniform(seed, "init", level, F.col("id"), dim) * 20 - 10
    return nodes.select("id", draw(0).alias("x"), draw(1).alias("y"))


def normals(seed: int, *key: Column | str | int) -> Column:
    """Standard normal draws, by Box and Muller."""
    u, v = (uniform(seed, "normal", k, *key) for k in (0, 1))
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.lit(float(np.pi)) * v)


def spectral_init(graph: DataFrame, nodes: DataFrame, seed: int = 42, points: DataFrame | None = None, distances: DataFrame | None = None) -> DataFrame:
    """(id, x, y): each connected component by eigenvectors 2 and 3 of its normalised
    Laplacian, components placed by ``component_places``, all scaled to 10, with normal noise of
    1e-4. Components of fewer than four vertices lie at their place. Components of up to
    ``DENSE`` vertices are solved densely, larger ones by Lanczos steps of joins until the
    residual is below ``TOLERANCE``; both give the same vectors up to that. Vectors are signed so
    that their largest component is positive. ``points`` (id, features) or ``distances`` (row,
    col, dist) tell how far components lie from each other."""
    links = components(graph, "i", "j")
    part = nodes.join(links.withColumnRenamed("node", "id").hint("merge"), "id", "left").select("id", F.coalesce("root", "id").alias("part"))
    part = materialize(part, "spectral_parts")
    sizes = materialize(part.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "spectral_sizes")
    rows = graph.join(part.withColumnRenamed("id", "i").hint("merge"), "i").select("part", "i", "j", "w").join(sizes.hint("merge"), "part")

    def dense(edges: pa.Table, members: pa.Table) -> pa.Table:
        ids = np.sort(members.column("id").to_numpy())
        n = len(ids)
        xy = np.zeros((n, 2))
        if n >= LEAST:
            w = np.zeros((n, n))
            w[np.searchsorted(ids, edges.column("i").to_numpy()), np.searchsorted(ids, edges.column("j").to_numpy())] = edges.column("w").to_numpy()
            root = np.sqrt(np.maximum(w.sum(axis=1), 1e-300))
            xy = np.linalg.eigh(np.eye(n) - w / root[:, None] / root[None, :])[1][:, 1:3]
            xy = xy * np.where(xy[np.abs(xy).argmax(axis=0), [0, 1]] < 0, -1, 1)
            xy = xy / np.abs(xy).max()
        return pa.Table.from_arrays([pa.array(ids), pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["id", "x", "y"])

    rows = materialize(rows, "spectral_edges")
    small = materialize(part.join(sizes.filter(F.col("n") <= DENSE).select("part"), "part"), "spectral_members")
    found = rows.filter(F.col("n") <= DENSE).groupBy("part").cogroup(small.groupBy("part")).applyInArrow(dense, PLACE)
    for r in sizes.filter(F.col("n") > DENSE).toLocalIterator():  # at most n / DENSE components
        found = found.unionByName(_iterated(rows.filter(F.col("part") == r["part"]), seed))
    found = found.join(part, "id")
    if sizes.count() > 1:
        at = component_places(sizes, part, seed, points, distances)
        found = found.join(at, "part").select("id", (F.col("x") * F.col("span") + F.col("px")).alias("x"), (F.col("y") * F.col("span") + F.col("py")).alias("y"))
    found = materialize(found.select("id", "x", "y"), "spectral_places")
    top = found.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 1.0
    noise = lambda dim: normals(seed, "spectral", F.col("id"), dim) * 1e-4
    return found.select("id", (F.col("x") * (10 / top) + noise(0)).alias("x"), (F.col("y") * (10 / top) + noise(1)).alias("y"))


def centroids(points: DataFrame, part: DataFrame) -> DataFrame:
    """(part, at, mean): the mean vector of each component, by dimension."""
    rows = points.select("id", F.posexplode("features").alias("at", "v")).join(part, "id")
    return rows.groupBy("part", "at").agg(F.avg("v").alias("mean"))


def linkage(distances: DataFrame, part: DataFrame) -> DataFrame:
    """(a, b, dist), a < b: the smallest distance between two components that have one."""
    a, b = part.select(F.col("id").alias("row"), F.col("part").alias("a")), part.select(F.col("id").alias("col"), F.col("part").alias("b"))
    met = distances.join(a, "row").join(b, "col").filter("a <> b")
    return met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("dist").alias("dist"))


def component_places(sizes: DataFrame, part: DataFrame, seed: int = 42, points: DataFrame | None = None, distances: DataFrame | None = None) -> DataFrame:
    """(part, px, py, span): where components go and how far they may reach, half the way to
    the nearest other. Up to four lie on the axes, in the order of their smallest vertices: one
    each way. More are laid out by the affinities exp(-d^2) of their centroids (``points``) or of
    their nearest members (``distances``; 1 where none is known): eigenvectors 2 and 3 of the
    normalised Laplacian, over the square roots of the degrees, scaled to 1. Without either, or
    with more than ``DENSE`` components, places are uniform draws."""
    names = [r["part"] for r in sizes.select("part").orderBy("part").limit(DENSE + 1).collect()]
    n = len(names)
    if n > DENSE or n > 4 and points is None and distances is None:
        at = lambda dim: uniform(seed, "part", F.col("part"), dim) * 2 - 1
        return sizes.select("part", at(0).alias("px"), at(1).alias("py"), (F.lit(0.5) / F.sqrt(F.lit(float(sizes.count())))).alias("span"))
    if n <= 4:
        half = -(-n // 2)
        xy = np.array([(np.eye(2)[k % half] if half > 1 else np.array([1.0, 0.0])) * (1 if k < half else -1) for k in range(n)])
    else:
        place = {p: k for k, p in enumerate(names)}
        d = np.ones((n, n)) - np.eye(n)
        if points is not None:
            means = centroids(points, part).toPandas()
            x = np.zeros((n, int(means["at"].max()) + 1))
            x[means["part"].map(place), means["at"]] = means["mean"]
            d = np.sqrt(np.maximum(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2), 0))
        else:
            for r in linkage(distances, part).toLocalIterator():
                d[place[r["a"]], place[r["b"]]] = d[place[r["b"]], place[r["a"]]] = r["dist"]
        w = np.exp(-d * d)
        np.fill_diagonal(w, 0)
        root = np.sqrt(w.sum(axis=1))
        xy = np.linalg.eigh(np.eye(n) - w / root[:, None] / root[None, :])[1][:, 1:3] / root[:, None]
        xy = xy * np.where(xy[np.abs(xy).argmax(axis=0), [0, 1]] < 0, -1, 1)
        xy = xy / xy.max()
    gap = np.sqrt(((xy[:, None, :] - xy[None, :, :]) ** 2).sum(axis=2))
    span = np.where(gap > 0, gap, np.inf).min(axis=1) / 2
    span = np.where(np.isfinite(span), span, 1.0)
    rows = [(int(p), float(a), float(b), float(c)) for p, (a, b), c in zip(names, xy, span)]
    return sizes.sparkSession.createDataFrame(rows, "part long, px double, py double, span double")


def _numbers(vertices: DataFrame, name: str) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """The vertices (id) with ``pos``, their rank, to be joined as either end of an edge."""
    at = materialize(numbered(vertices, ["id"], "pos").select("id", "pos"), name)
    ends = (at.select(F.col("id").alias(e), F.col("pos").alias(f"p{e}")).hint("merge") for e in "ij")
    return at, tuple(ends)


def _iterated(edges: DataFrame, seed: int) -> DataFrame:
    """(id, x, y) of one component: eigenvectors 2 and 3, scaled to 1, one after the other. Up to
    ``SOLVED`` edges the steps are one task's work, of some 40 bytes an edge; beyond, joins."""
    if edges.count() > SOLVED:
        return _iterated_joins(edges, seed)
    at, (i, j) = _numbers(edges.select(F.col("i").alias("id")).distinct(), "spectral_vertices")
    places = edges.join(i, "i").join(j, "j").select("pi", "pj", "w")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [b.column(0).to_numpy().astype(np.int32), b.column(1).to_numpy().astype(np.int32), b.column(2).to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), *(pa.array([x.tobytes()]) for x in parts)], ["job", "i", "j", "w"])

    def solve(e: pa.Table, v: pa.Table) -> pa.Table:
        order = np.argsort(v.column("pos").to_numpy())
        ids, starts, draws = v.column("id").to_numpy()[order], [v.column(f"s{k}").to_numpy()[order] for k in (1, 2)], [v.column(c).to_numpy()[order] for c in "xy"]
        i, j, w = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in e.column(c)]) for c, t in (("i", np.int32), ("j", np.int32), ("w", np.float64)))
        order = np.lexsort((j, i))
        i, j, w = i[order], j[order], w[order]
        first = np.searchsorted(i, np.arange(len(ids)))
        root = np.sqrt(np.add.reduceat(w, first))
        w = w / root[i] / root[j]
        del i, order
        known = [root / np.sqrt(root @ root)]
        for start in starts:
            vector = _eigenvector(lambda q: np.add.reduceat(w * q[j], first), known, start)
            if vector is None:  # no convergence: this component's places are draws
                return pa.Table.from_arrays([pa.array(ids), *map(pa.array, draws)], ["id", "x", "y"])
            known.append(vector)
        ends = [d[np.abs(d).argmax()] for d in known[1:]]
        xy = [d * (np.sign(end) / np.abs(ends).max()) for d, end in zip(known[1:], ends)]
        return pa.Table.from_arrays([pa.array(ids), *map(pa.array, xy)], ["id", "x", "y"])

    draw = lambda dim: uniform(seed, "spectral", F.col("id"), dim) * 2 - 1
    starts = at.select(F.lit(0).alias("job"), "id", "pos", *[(uniform(seed, "lanczos", k, F.col("id")) - 0.5).alias(f"s{k}") for k in (1, 2)], draw(0).alias("x"), draw(1).alias("y"))
    packed = materialize(places.mapInArrow(pack, "job int, i binary, j binary, w binary"), "spectral_matrix")
    return packed.groupBy("job").cogroup(starts.groupBy("job")).applyInArrow(solve, PLACE)


def _eigenvector(product, known: list[np.ndarray], start: np.ndarray) -> np.ndarray | None:
    """The eigenvector of the largest eigenvalue beside the ``known`` ones, by the steps of
    ``_lanczos``. The steps run again to add their vectors up, so these are never held at once."""

    def cleared(v: np.ndarray) -> tuple[np.ndarray, float]:
        v = v - sum((d @ v) * d for d in known)
        length = float(np.sqrt(v @ v))
        return v / (length or 1.0), length

    alphas: list[float] = []
    betas: list[float] = []
    now, last = cleared(start)[0], 0.0
    done = False
    while not done:
        if len(alphas) == STEPS:
            return None
        w = product(now)
        alphas.append(float(w @ now))
        w, beta = cleared(w - alphas[-1] * now - (betas[-1] if betas else 0.0) * last)
        values, vectors = np.linalg.eigh(np.diag(alphas) + np.diag(betas, 1) + np.diag(betas, -1))
        done = beta < 1e-12 or abs(beta * vectors[-1, -1]) < TOLERANCE
        if not done:
            betas.append(beta)
            now, last = w, now
    shares = vectors[:, -1]
    now, last = cleared(start)[0], 0.0
    found = shares[0] * now
    for k in range(len(betas)):
        w = cleared(product(now) - alphas[k] * now - (betas[k - 1] if k else 0.0) * last)[0]
        now, last = w, now
        found = found + shares[k + 1] * now
    return cleared(found)[0]


def _iterated_joins(edges: DataFrame, seed: int) -> DataFrame:
    """(id, x, y) of one component: the same by joins."""
    root = materialize(edges.groupBy("i").agg(F.sqrt(F.sum("w")).alias("root")), "spectral_roots")
    step = materialize(edges.join(root.hint("merge"), "i").join(root.hint("merge").select(F.col("i").alias("j"), F.col("root").alias("other")), "j").select("i", "j", (F.col("w") / F.col("root") / F.col("other")).alias("m")), "spectral_matrix")
    size = root.agg(F.sqrt(F.sum(F.col("root") * F.col("root")))).first()[0]
    known = materialize(root.select("i", (F.col("root") / size).alias("d0")), "spectral_known")
    for k in (1, 2):
        vector = _lanczos(step, known, k, seed)
        if vector is None:  # no convergence: this component's places are draws
            draw = lambda dim: uniform(seed, "spectral", F.col("i"), dim) * 2 - 1
            return root.select(F.col("i").alias("id"), draw(0).alias("x"), draw(1).alias("y"))
        known = materialize(known.join(vector.hint("merge"), "i"), "spectral_known")
    signs = known.agg(*[F.max_by(c, F.struct(F.abs(F.col(c)), -F.col("i"))).alias(c) for c in ("d1", "d2")]).first()
    top = max(abs(signs["d1"]), abs(signs["d2"]))
    x, y = (F.col(c) * (np.sign(signs[c]) / top) for c in ("d1", "d2"))
    return known.select(F.col("i").alias("id"), x.alias("x"), y.alias("y"))


def _lanczos(step: DataFrame, known: DataFrame, k: int, seed: int) -> DataFrame | None:
    """(i, dk): the eigenvector of ``step`` (i, j, m) with the largest eigenvalue beside the
    ``known`` ones (i, d0 ...); None if the residual stays above TOLERANCE."""
    names = [c for c in known.columns if c != "i"]
    dot = lambda a, b: F.sum(F.col(a) * F.col(b))

    def cleared(df: DataFrame, v: str) -> DataFrame:
        """``v`` without its part along the known vectors, of length 1, and that length."""
        along = df.agg(*[dot(v, d).alias(d) for d in names]).first()
        out = df.withColumn(v, F.col(v) - sum((F.col(d) * along[d] for d in names), F.lit(0.0)))
        length = out.agg(F.sqrt(dot(v, v))).first()[0]
        return out.withColumn(v, F.col(v) / (length or 1.0)), length

    now, _ = cleared(known.withColumn("q", uniform(seed, "lanczos", k, F.col("i")) - 0.5), "q")
    now = materialize(now.withColumn("p", F.lit(0.0)), "lanczos")
    written, alphas, betas = [now], [], []
    for _ in range(STEPS):
        moved = step.join(now.select(F.col("i").alias("j"), "q").hint("merge"), "j").groupBy("i").agg(F.sum(F.col("m") * F.col("q")).alias("w"))
        made = materialize(now.join(moved.hint("merge"), "i"), "lanczos_step")
        alphas.append(made.agg(dot("w", "q")).first()[0])
        made = made.withColumn("w", F.col("w") - alphas[-1] * F.col("q") - (betas[-1] if betas else 0.0) * F.col("p"))
        made, beta = cleared(made, "w")
        values, vectors = np.linalg.eigh(np.diag(alphas) + np.diag(betas, 1) + np.diag(betas, -1))
        done = beta < 1e-12 or abs(beta * vectors[-1, -1]) < TOLERANCE
        if done:
            break
        betas.append(beta)
        now = materialize(made.select("i", *names, F.col("q").alias("p"), F.col("w").alias("q")), "lanczos")
        written.append(now)
    else:
        return None
    parts = [df.select("i", (F.col("q") * float(c)).alias("q")) for df, c in zip(written, vectors[:, -1])]
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    found, _ = cleared(known.join(found.groupBy("i").agg(F.sum("q").alias(f"d{k}")).hint("merge"), "i"), f"d{k}")
    found = materialize(found.select("i", f"d{k}"), "lanczos_vector")
    for df in written:
        discard(df)
    return found


def rescaled(places: DataFrame, fixed: DataFrame) -> DataFrame:
    """Places with the fixed ones put in, mapped to [0, 10] on each axis, and ``is_fixed``."""
    f = fixed.select("id", F.col("x").alias("fx"), F.col("y").alias("fy"), F.lit(True).alias("is_fixed"))
    put = places.join(f, "id", "left").select("id", F.coalesce("fx", "x").alias("x"), F.coalesce("fy", "y").alias("y"), F.coalesce("is_fixed", F.lit(False)).alias("is_fixed"))
    put = materialize(put, "fixed_places")
    ends = put.agg(*[f(c).alias(n + c) for c in "xy" for f, n in ((F.min, "lo_"), (F.max, "hi_"))])
    one = lambda c: F.when(ends.select(f"hi_{c}").scalar() > ends.select(f"lo_{c}").scalar(), 10 * (F.col(c) - ends.select(f"lo_{c}").scalar()) / (ends.select(f"hi_{c}").scalar() - ends.select(f"lo_{c}").scalar())).otherwise(0.0)
    return put.select("id", one("x").alias("x"), one("y").alias("y"), "is_fixed")


def attraction(d2, a: float, b: float):
    """Coefficient of an edge's pull at squared distance ``d2`` (a Column)."""
    return F.when(d2 > 0, -2 * a * b * F.pow(d2, b - 1) / (a * F.pow(d2, b) + 1)).otherwise(0.0)


def edge_gradient(places: DataFrame, graph: DataFrame, a: float, b: float) -> DataFrame:
    """(i, j, gx, gy): the clipped pull of every edge on its first end."""
    p, q = places.select(F.col("id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi")), places.select(F.col("id").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"))
    met = graph.join(p, "i").join(q, "j").withColumns({"dx": F.col("xi") - F.col("xj"), "dy": F.col("yi") - F.col("yj")})
    c = attraction(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"), a, b)
    return met.withColumn("c", c).select("i", "j", clipped(F.col("c") * F.col("dx")).alias("gx"), clipped(F.col("c") * F.col("dy")).alias("gy"))


def alpha(epoch: int, n_epochs: int) -> float:
    """The learning rate: 1 in the first two epochs, then falling to 0."""
    return 1.0 - max(0, epoch - 1) / n_epochs


def negatives(seed: int, epoch: int, n: int) -> Column:
    """An array of the places (0 to n - 1) that edge (i, j) is pushed away from in an epoch:
    h + draw * g for the first and next 60 bits of md5(seed | neg | epoch | i | j)."""
    text = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("neg"), F.lit(str(epoch)), F.col("i").cast("string"), F.col("j").cast("string")))
    h, g = (F.pmod(F.conv(F.substring(text, at, 15), 16, 10).cast("long"), F.lit(n)) for at in (1, 16))
    return F.array(*[F.pmod(h + k * g, F.lit(n)) for k in range(NEGATIVES)])


def negatives_of(seed: int, epoch: int, n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The same for arrays of edges, a row each."""
    raw = b"".join(hashlib.md5(f"{seed}|neg|{epoch}|{a}|{b}".encode()).digest() for a, b in zip(i.tolist(), j.tolist()))
    high, low = np.frombuffer(raw, ">u8").reshape(-1, 2).astype(np.uint64).T
    h, g = (high >> np.uint64(4)) % np.uint64(n), ((high & np.uint64(15)) << np.uint64(56) | low >> np.uint64(8)) % np.uint64(n)
    return (h[:, None].astype(np.int64) + np.arange(NEGATIVES) * g[:, None].astype(np.int64)) % n


def repulsion(d2: Column, a: float, b: float) -> Column:
    """Coefficient of a push at squared distance ``d2``."""
    return F.when(d2 > 0, 2 * b / ((0.001 + d2) * (a * F.pow(d2, b) + 1))).otherwise(0.0)


def push_gradient(places: DataFrame, edges: DataFrame, a: float, b: float, epoch: int, seed: int) -> DataFrame:
    """(i, j, draw, k, gx, gy): the push of every drawn place on an edge's first end. ``places``
    has pos, the rank of the id. A place drawn for itself does not push."""
    n = places.count()
    drawn = edges.select("i", "j", F.posexplode(negatives(seed, epoch, n)).alias("draw", "pos"))
    met = drawn.join(places.select("pos", F.col("id").alias("k"), F.col("x").alias("xk"), F.col("y").alias("yk")), "pos")
    met = met.join(places.select(F.col("id").alias("i"), "x", "y"), "i").filter("i <> k")
    met = met.withColumns({"dx": F.col("x") - F.col("xk"), "dy": F.col("y") - F.col("yk")})
    c = repulsion(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"), a, b)
    push = lambda d: F.when(F.col("c") > 0, clipped(F.col("c") * F.col(d))).otherwise(PUSH)
    return met.withColumn("c", c).select("i", "j", "draw", "k", push("dx").alias("gx"), push("dy").alias("gy"))


def pulls(delta: np.ndarray, a: float, b: float) -> np.ndarray:
    """The clipped pulls of edges on their first ends."""
    d2 = (delta * delta).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = np.where(d2 > 0, -2 * a * b * d2 ** (b - 1) / (a * d2**b + 1), 0.0)
    return np.clip(c[:, None] * delta, -LIMIT, LIMIT)


def pushes(delta: np.ndarray, a: float, b: float) -> np.ndarray:
    """The pushes of drawn places on edges' first ends."""
    d2 = (delta * delta).sum(axis=1)
    c = np.where(d2 > 0, 2 * b / ((0.001 + d2) * (a * d2**b + 1)), 0.0)
    return np.where(c[:, None] > 0, np.clip(c[:, None] * delta, -LIMIT, LIMIT), PUSH)


def descend(xy: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray, move: np.ndarray, a: float, b: float, n_epochs: int, seed: int, ids: np.ndarray | None = None) -> np.ndarray:
    """All epochs over arrays. Every epoch's pulls and pushes are taken at the positions
    before it and added up, so the result does not depend on the order of edges. ``ids``: of
    the positions, which name edges in draws."""
    n, every = len(xy), w.max(initial=0) / w
    ids = np.arange(n) if ids is None else ids
    for epoch in range(1, n_epochs):
        due = np.floor(epoch / every) > np.floor((epoch - 1) / every)
        h, t = i[due], j[due]
        g = pulls(xy[h] - xy[t], a, b)
        step = np.zeros_like(xy)
        for axis in (0, 1):
            step[:, axis] += np.bincount(h, g[:, axis], n) - np.bincount(t, g[:, axis], n)
        for k in negatives_of(seed, epoch, n, ids[h], ids[t]).T:
            g = pushes(xy[h] - xy[k], a, b)
            g[h == k] = 0
            for axis in (0, 1):
                step[:, axis] += np.bincount(h, g[:, axis], n)
        xy = xy + alpha(epoch, n_epochs) * step * move[:, None]
    return xy


def optimized(places: DataFrame, graph: DataFrame, a: float, b: float, n_epochs: int, seed: int, fixing_term: float = 0.01) -> DataFrame:
    """(id, x, y) after ``n_epochs``. ``places`` has id, x, y and perhaps is_fixed: such rows
    move by ``fixing_term`` of their gradient. Graphs up to ``ROWS`` and ``EDGES`` are one
    task; larger ones take a pass over blocks an epoch, with the same draws and steps: results
    are equal up to rounding."""
    if "is_fixed" not in places.columns:
        places = places.withColumn("is_fixed", F.lit(False))
    places = materialize(places.select("id", "x", "y", "is_fixed"), "layout_places")
    edges = materialize(graph.select("i", "j", "w"), "layout_edges")
    if places.count() > ROWS or edges.count() > EDGES:
        return _block_epochs(places, edges, a, b, n_epochs, seed, fixing_term)

    def kernel(p: pa.Table, e: pa.Table) -> pa.Table:
        ids = p.column("id").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        xy = np.stack([p.column(c).to_numpy()[order] for c in "xy"], axis=1)
        move = np.where(np.array(p.column("is_fixed").to_pylist(), bool)[order], fixing_term, 1.0)
        i, j = (np.searchsorted(ids, e.column(c).to_numpy()) for c in "ij")
        by = np.lexsort((j, i))
        xy = descend(xy, i[by], j[by], e.column("w").to_numpy()[by], move, a, b, n_epochs, seed, ids)
        return pa.Table.from_arrays([pa.array(ids), pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["id", "x", "y"])

    one = F.lit(0).alias("job")
    return places.select(one, "*").groupBy("job").cogroup(edges.select(one, "*").groupBy("job")).applyInArrow(kernel, PLACE)


def _block_epochs(places: DataFrame, edges: DataFrame, a: float, b: float, n_epochs: int, seed: int, fixing_term: float) -> DataFrame:
    """An epoch is one pass over blocks of vertices. A block's row holds its vertices and the
    edges that begin or end there, and is written once; a task reads it beside the places of all
    vertices, 16 bytes each, and gives its own vertices' new places."""
    n, cores = places.count(), places.sparkSession.sparkContext.defaultParallelism
    size = max(64, min(16_384, -(-n // (4 * cores))))
    at = materialize(numbered(places, ["id"], "pos").select("id", "x", "y", "is_fixed", "pos"), "layout_numbers")
    ends = [at.select(F.col("id").alias(e), F.col("pos").alias(f"p{e}")).hint("merge") for e in "ij"]
    met = edges.withColumn("every", edges.agg(F.max("w")).scalar() / F.col("w")).join(ends[0], "i").join(ends[1], "j")
    met = materialize(met.select("pi", "pj", "j", "every"), "layout_every")
    block = lambda c: F.floor(F.col(c) / size).alias("block")
    roles = met.select(block("pi"), F.lit(True).alias("head"), "*").union(met.select(block("pj"), F.lit(False), "*"))

    def pack(v: pa.Table, e: pa.Table) -> pa.Table:
        order = np.argsort(v.column("pos").to_numpy())
        xy = np.stack([v.column(c).to_numpy()[order] for c in "xy"], axis=1)
        own = [v.column("id").to_numpy()[order], xy, np.where(np.array(v.column("is_fixed").to_pylist(), bool)[order], fixing_term, 1.0)]
        head, (i, j) = np.array(e.column("head").to_pylist(), bool), (e.column(c).to_numpy() for c in ("pi", "pj"))
        by = np.lexsort((j, i))
        by = [by[head[by]], by[~head[by]]] if len(by) else [by, by]
        names, every = e.column("j").to_numpy(), e.column("every").to_numpy()
        sides = [x for k in by for x in (i[k].astype(np.int32), j[k].astype(np.int32), every[k])]
        start = int(v.column("pos").to_numpy()[order[0]])
        return pa.Table.from_arrays([pa.array([start]), *(pa.array([x.tobytes()], pa.binary()) for x in (*own, *sides, names[by[0]]))], [f.split()[0] for f in packed.split(", ")])

    packed = "start long, ids binary, xy binary, move binary, hi binary, hj binary, hevery binary, ti binary, tj binary, tevery binary, hname binary"
    blocks = at.select(block("pos"), "*").groupBy("block").cogroup(roles.groupBy("block")).applyInArrow(pack, packed)
    blocks = materialize(blocks, "layout_blocks")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {start: x for batch in batches for start, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())}
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts[k] for k in sorted(parts))], pa.binary())], ["whole"])

    def epoch_of(epoch: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    read = lambda c, t: np.frombuffer(batch.column(c)[row].as_buffer(), t)
                    start, xy, ids = batch.column("start")[row].as_py(), read("whole", float).reshape(-1, 2), read("ids", np.int64)
                    step = np.zeros((len(ids), 2))
                    for side, sign in (("h", 1), ("t", -1)):
                        i, j, every = read(f"{side}i", np.int32), read(f"{side}j", np.int32), read(f"{side}every", float)
                        due = np.floor(epoch / every) > np.floor((epoch - 1) / every)
                        i, j = i[due], j[due]
                        own, g = (i if sign > 0 else j) - start, pulls(xy[i] - xy[j], a, b)
                        for axis in (0, 1):
                            step[:, axis] += sign * np.bincount(own, g[:, axis], len(ids))
                        if sign > 0:
                            names = ids[own], read("hname", np.int64)[due]
                            head, origin = own, i
                    for k in negatives_of(seed, epoch, len(xy), *names).T:
                        g = pushes(xy[origin] - xy[k], a, b)
                        g[origin == k] = 0
                        for axis in (0, 1):
                            step[:, axis] += np.bincount(head, g[:, axis], len(ids))
                    new = xy[start : start + len(ids)] + alpha(epoch, n_epochs) * step * read("move", float)[:, None]
                    yield pa.RecordBatch.from_arrays([pa.array([start]), pa.array([new.tobytes()], pa.binary())], ["start", "xy"])

        return run

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, ids, whole in zip(batch.column("start").to_pylist(), batch.column("ids"), batch.column("whole")):
                ids = np.frombuffer(ids.as_buffer(), np.int64)
                xy = np.frombuffer(whole.as_buffer(), float).reshape(-1, 2)[start : start + len(ids)]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["id", "x", "y"])

    beside = lambda now, some: now.coalesce(1).hint("shuffle_replicate_nl").crossJoin(some)
    one = lambda parts: materialize(parts.repartition(1).mapInArrow(joined, "whole binary"), "layout_epoch")
    now = one(blocks.select("start", "xy"))
    blocks = blocks.drop("xy")
    for epoch in range(1, n_epochs):
        last, now = now, one(beside(now, blocks).mapInArrow(epoch_of(epoch), "start long, xy binary"))
        discard(last)
    return beside(now, blocks.select("start", "ids")).mapInArrow(rows, PLACE)
