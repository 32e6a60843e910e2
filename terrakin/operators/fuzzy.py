"""From neighbours to a weighted graph."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

TOLERANCE, FLOOR, STEPS = 1e-5, 1e-3, 64


def bandwidths(d: np.ndarray, k: int, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """(sigma, rho) of rows of ascending distances, padded with NaN. Sigma makes the
    memberships of ranks 1 and up add to log2(k); rho is the first positive distance."""
    positive = d > 0
    rho = np.where(positive.any(axis=1), d[np.arange(len(d)), positive.argmax(axis=1)], 0.0)
    beyond, known = d[:, 1:] - rho[:, None], ~np.isnan(d[:, 1:])
    lo, hi, mid = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    open_ = np.ones(len(d), bool)
    for _ in range(STEPS):
        with np.errstate(invalid="ignore", over="ignore"):
            part = np.where(known, np.where(beyond > 0, np.exp(-beyond / mid[:, None]), 1.0), 0.0)
        gap = part.sum(axis=1) - math.log2(k)
        open_ &= np.abs(gap) >= TOLERANCE
        if not open_.any():
            break
        up, down = open_ & (gap <= 0), open_ & (gap > 0)
        hi[down], lo[up] = mid[down], mid[up]
        mid = np.where(open_, np.where(np.isinf(hi), mid * 2, (lo + hi) / 2), mid)
    own = np.nanmean(d, axis=1)
    return np.maximum(mid, FLOOR * np.where(rho > 0, own, mean)), rho


def smooth(knn: DataFrame, k: int) -> DataFrame:
    """(id, sigma, rho) of (q, rank, c, dist)."""

    @F.pandas_udf("sigma double, rho double")
    def run(dists: pd.Series, mean: pd.Series) -> pd.DataFrame:
        d = np.full((len(dists), max(map(len, dists), default=1)), np.nan)
        for row, x in zip(d, dists):
            row[: len(x)] = x
        sigma, rho = bandwidths(d, k, float(mean.iloc[0]) if len(mean) else 0.0)
        return pd.DataFrame({"sigma": sigma, "rho": rho})

    rows = knn.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "dist"))).alias("r"))
    mean = knn.agg(F.avg("dist").alias("mean"))
    return rows.select("q", F.col("r.dist").alias("d"), mean.scalar().alias("mean")).select(F.col("q").alias("id"), run("d", "mean").alias("s")).select("id", "s.sigma", "s.rho")


def edges(knn: DataFrame, bands: DataFrame) -> DataFrame:
    """(i, rank, j, v, p): membership strengths and their shares of the row."""
    over = F.col("dist") - F.col("rho")
    v = F.when(F.col("q") == F.col("c"), 0.0).when((over <= 0) | (F.col("sigma") == 0), 1.0).otherwise(F.exp(-over / F.col("sigma")))
    rows = knn.join(bands.withColumnRenamed("id", "q"), "q").select(F.col("q").alias("i"), "rank", F.col("c").alias("j"), v.alias("v"))
    mass = F.sum("v").over(Window.partitionBy("i"))
    return rows.withColumn("p", F.when(mass > 0, F.col("v") / mass))


def graph(edges: DataFrame) -> DataFrame:
    """(i, j, w): the mean of both directions' strengths."""
    there = edges.filter("v > 0").select("i", "j", "v")
    back = there.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return there.union(back).groupBy("i", "j").agg((F.sum("v") * 0.5).alias("w"))


def pruned(graph: DataFrame, n_epochs: int) -> DataFrame:
    """Edges that are sampled at least once in ``n_epochs``. The graph itself is unchanged."""
    return graph.filter(F.col("w") > graph.agg(F.max("w")).scalar() / n_epochs)


def epochs_per_sample(graph: DataFrame) -> DataFrame:
    """Edges with the epochs between two samples."""
    return graph.withColumn("epochs", graph.agg(F.max("w")).scalar() / F.col("w"))
