"""Quality of a layout against the original vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from terrakin.operators import knn as nn
from terrakin.operators.index import numbered
from terrakin.storage import materialize

SAMPLE = 3_000


def pair_distances(points: DataFrame, layout: DataFrame) -> DataFrame:
    """(q, c, high, low) of all pairs q < c of a bounded sample of points that have a place."""
    low = materialize(layout.select("id", F.array("x", "y").alias("features")), "metric_low")
    high = materialize(points.select("id", "features").join(low.select("id"), "id", "left_semi"), "metric_high")
    return nn.pairwise(high).withColumnRenamed("dist", "high").join(nn.pairwise(low).withColumnRenamed("dist", "low"), ["q", "c"])


def stress(pairs: DataFrame) -> DataFrame:
    """(stress): sqrt(sum (low - high)^2 / sum high^2), both scaled by their largest."""
    top = pairs.agg(F.max("high").alias("h"), F.max("low").alias("l"))
    h, low = F.col("high") / top.select("h").scalar(), F.col("low") / top.select("l").scalar()
    return pairs.agg(F.sqrt(F.sum((low - h) * (low - h)) / F.sum(h * h)).alias("stress"))


def spearman(pairs: DataFrame, n: int) -> DataFrame:
    """(correlation): Spearman's of the squared distances over the full n x n matrices, both
    triangles and the zero diagonal included. Equal distances share their mean rank; ranks
    come from the counts of distinct values, so pairs are never sorted in one task."""
    both = pairs.select((F.col("high") * F.col("high")).alias("h"), (F.col("low") * F.col("low")).alias("l"))

    def ranked(c: str) -> DataFrame:
        held = both.filter(F.col(c) > 0).groupBy(c).agg((2 * F.count(F.lit(1))).alias("n"))
        runs = numbered(held, [c], "at").withColumn("part", F.floor(F.col("at") / 4096))
        sums = runs.groupBy("part").agg(F.sum("n").alias("s"))
        base = sums.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("base"))
        upto = F.col("base") + F.sum("n").over(Window.partitionBy("part").orderBy("at"))
        return runs.join(base, "part").select(c, (upto - F.col("n") + (F.col("n") + 1) / 2).alias(f"r{c}"))

    # Zero distances come first: the diagonal and both triangles' pairs of equal points.
    zh, zl = (2 * both.filter(F.col(c) == 0).count() + n for c in "hl")
    rh, rl = (zh + 1) / 2, (zl + 1) / 2
    met = both.join(ranked("h"), "h", "left").join(ranked("l"), "l", "left")
    met = met.select(F.coalesce(F.col("rh") + zh, F.lit(rh)).alias("rh"), F.coalesce(F.col("rl") + zl, F.lit(rl)).alias("rl"))
    s = [F.sum(2 * x).cast("double") for x in (F.col("rh"), F.col("rl"), F.col("rh") * F.col("rh"), F.col("rl") * F.col("rl"), F.col("rh") * F.col("rl"))]
    m = float(n) * n
    sums = met.agg(*[(x + n * v).alias(c) for x, v, c in zip(s, (rh, rl, rh * rh, rl * rl, rh * rl), ("a", "b", "aa", "bb", "ab"))])
    return sums.select(((F.col("ab") - F.col("a") * F.col("b") / m) / F.sqrt((F.col("aa") - F.col("a") * F.col("a") / m) * (F.col("bb") - F.col("b") * F.col("b") / m))).alias("correlation"))


def neighborhood_preservation(high: DataFrame, low: DataFrame, k: int = 30) -> DataFrame:
    """(neighbors, np) for 1 to k neighbours: the mean share of a point's nearest that stay
    its nearest. Both inputs are neighbour tables with rank 0 as the point itself; a pair
    counts from the larger of its two ranks on."""
    n = high.select("q").distinct().count()
    a = high.filter(F.col("rank").between(1, k)).select("q", "c", "rank")
    b = low.filter(F.col("rank").between(1, k)).select("q", "c", F.col("rank").alias("other"))
    kept = a.join(b, ["q", "c"]).groupBy(F.greatest("rank", "other").alias("at")).agg(F.count(F.lit(1)).alias("hits"))
    each = high.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("at")).join(kept, "at", "left").fillna(0, ["hits"])
    upto = F.sum("hits").over(Window.orderBy("at"))  # k rows
    return each.select((F.col("at") - 1).alias("neighbors"), (upto / (F.lit(n) * F.col("at"))).alias("np"))


def procrustes(a: DataFrame, b: DataFrame) -> float:
    """Disparity of two layouts (id, x, y) over their common points: both centred and scaled
    to norm 1, the second turned and scaled to fit. Moments are summed in the cluster; only
    they come to the driver."""
    m = a.select("id", F.col("x").alias("ax"), F.col("y").alias("ay")).join(b.select("id", F.col("x").alias("bx"), F.col("y").alias("by")), "id")
    names = ["ax", "ay", "bx", "by"]
    s = m.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names], *[F.sum(F.col(p) * F.col(q)).alias(p + q) for k, p in enumerate(names) for q in names[k:]]).first()
    cov = lambda p, q: s[p + q] - s[p] * s[q] / s["n"]
    na, nb = (cov(f"{t}x", f"{t}x") + cov(f"{t}y", f"{t}y") for t in "ab")
    cross = np.array([[cov(f"a{p}", f"b{q}") for q in "xy"] for p in "xy"]) / (na * nb) ** 0.5
    return float(1 - np.linalg.svd(cross, compute_uv=False).sum() ** 2)


def report(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mean and population deviation of repeated measurements."""
    return values.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def reproducible(*runs: DataFrame) -> bool:
    """Whether all runs have the same rows."""
    return all(runs[0].exceptAll(r).isEmpty() and r.exceptAll(runs[0]).isEmpty() for r in runs[1:])
