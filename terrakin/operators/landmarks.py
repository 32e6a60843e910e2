"""Landmarks of a level, what they represent, and distances between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terrakin.operators.index import numbered


def chosen(counts: DataFrame, n: int) -> DataFrame:
    """(slot, id): the n vertices where most walks end, ties to the smaller id; slot is the
    place in that order and the id in the next level."""
    order = [F.desc("cnt"), F.asc("id")]
    return numbered(counts, order, "slot").filter(F.col("slot") < n).select("slot", "id")


def neighborhoods(hits: DataFrame, landmarks: DataFrame, knn: DataFrame | None = None, near: int = 0) -> DataFrame:
    """(slot, pt): the points that reach each landmark; with ``near`` above 1 also those
    that have it among their neighbours of ranks 1 to near - 1."""
    rows = hits.select("id", "pt")
    if knn is not None and near > 1:
        local = knn.filter(F.col("rank").between(1, near - 1)).select(F.col("c").alias("id"), F.col("q").alias("pt"))
        rows = rows.union(local.join(landmarks.select(F.col("id").alias("pt")), "pt", "left_anti").select("id", "pt"))
    return rows.join(landmarks, "id").select("slot", "pt").distinct()


def overlaps(hoods: DataFrame) -> DataFrame:
    """(row, col, shared): points that two landmarks share. A point reaches at most as many
    landmarks as it makes walks, which bounds its pairs."""
    a, b = hoods.withColumnRenamed("slot", "row"), hoods.withColumnRenamed("slot", "col")
    return a.join(b, "pt").groupBy("row", "col").agg(F.count(F.lit(1)).alias("shared"))


def distances(hoods: DataFrame, landmarks: DataFrame, k: int, n: int) -> DataFrame:
    """(row, col, dist): 1 - shared / M, M the largest neighbourhood. Rows with fewer than k
    entries get distance 1 to those of the columns 0 to k-1 that they lack, their own
    excepted, and to column k (their own, if there is none) if that leaves them short."""
    shared = overlaps(hoods)
    largest = hoods.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"))
    known = shared.select("row", "col", (F.lit(1.0) - F.col("shared") / largest.scalar()).alias("dist"))
    held = known.groupBy("row").agg(F.count(F.lit(1)).alias("entries"), F.max((F.col("row") == F.col("col")).cast("int")).alias("own"))
    short = landmarks.select(F.col("slot").alias("row")).join(held, "row", "left").fillna(0, ["entries", "own"]).filter(F.col("entries") < k)
    extra = F.when((F.col("own") == 0) & (F.col("row") < k), F.array(F.lit(k).cast("long") if n > k else F.col("row"))).otherwise(F.array().cast("array<bigint>"))
    low = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(min(k, n) - 1).cast("long")), lambda c: c != F.col("row"))
    pads = short.select("row", F.explode(F.concat(low, extra)).alias("col")).join(known.select("row", "col"), ["row", "col"], "left_anti")
    return known.union(pads.select("row", "col", F.lit(1.0).alias("dist")))
