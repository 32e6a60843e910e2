"""Tabular operators: sparse forms, gathers, grids, samples and nearest levels."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, functions as F

from terrakin.functions.rng import uniform


def coo(points: DataFrame) -> DataFrame:
    """(row, col, val) of the non-zero features."""
    return points.select(F.col("id").alias("row"), F.posexplode("features").alias("col", "val")).filter("val <> 0")


def sparse_rows(entries: DataFrame) -> DataFrame:
    """(row, entries): each row's entries as an array of (col, val), by column."""
    return entries.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "val"))).alias("entries"))


def symmetric(entries: DataFrame) -> DataFrame:
    """Every entry on both sides of the diagonal. Where two entries meet the later one in
    (row, col) order wins, as when they are written one after the other."""
    both = entries.select("row", "col", "val", F.struct("row", "col").alias("at")).union(entries.select("col", "row", "val", F.struct("row", "col").alias("at")))
    return both.groupBy("row", "col").agg(F.max_by("val", "at").alias("val"))


def dense_rows(entries: DataFrame, width: int) -> DataFrame:
    """(row, features): arrays of ``width`` with zeros where there is no entry. Entries are put
    in their places, so a row costs its width and its entries."""
    packed = entries.groupBy("row").agg(F.collect_list(F.struct("col", "val")).alias("e"))
    packed = packed.select("row", F.transform("e", lambda e: e["col"].cast("long")).alias("cols"), F.transform("e", lambda e: F.coalesce(e["val"].cast("double"), F.lit(0.0))).alias("vals"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = max(1, 1_000_000 // max(1, width))
        for batch in batches:
            for a in range(0, batch.num_rows, some):
                part = batch.slice(a, some)
                sizes = pa.compute.list_value_length(part.column(1)).to_numpy(zero_copy_only=False)
                at, col, val = np.repeat(np.arange(part.num_rows), sizes), part.column(1).flatten().to_numpy(zero_copy_only=False), part.column(2).flatten().to_numpy(zero_copy_only=False)
                out, inside = np.zeros((part.num_rows, width)), (col >= 0) & (col < width)
                out[at[inside], col[inside]] = val[inside]
                ends = pa.array(np.arange(0, out.size + 1, max(1, width), dtype=np.int32) if width else np.zeros(part.num_rows + 1, np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], ["row", "features"])

    return packed.mapInArrow(fill, f"row {entries.schema['row'].dataType.simpleString()}, features array<double>")


def gathered(data: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``data`` for each (pos, key) of ``wanted``, with their place in that order."""
    return wanted.join(data, key)


def nearest_level(levels: DataFrame, target: int) -> DataFrame:
    """The level whose ``size`` is nearest to ``target``; the first of equals."""
    return levels.agg(F.min_by(F.col("level"), F.struct(F.abs(F.col("size") - target), F.col("level"))).alias("level"))


def grid(spark: SparkSession, **values: list) -> DataFrame:
    """All combinations of the named lists, a row each."""
    out = spark.range(1).select()
    for name, vs in values.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v).cast("long") if type(v) is int else F.lit(v) for v in vs])).alias(name))
    return out


def sampled(df: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """``n`` rows, the same ones every time: those with the smallest draws."""
    return df.withColumn("_u", uniform(seed, "sample", F.col(key))).orderBy("_u", key).limit(n).drop("_u")


def split(df: DataFrame, share: float, seed: int = 42, key: str = "id") -> DataFrame:
    """``df`` with ``part``: train for about ``share`` of the rows, else test."""
    return df.withColumn("part", F.when(uniform(seed, "split", F.col(key)) < share, "train").otherwise("test"))


def stacked_levels(tables: dict[str, DataFrame]) -> DataFrame:
    """Result tables under each other, with their technique."""
    return reduce(DataFrame.unionByName, [t.withColumn("technique", F.lit(name)) for name, t in tables.items()])


def next_iteration(done: DataFrame) -> DataFrame:
    """(it): the iteration to go on with after those in ``done``."""
    return done.agg((F.coalesce(F.max("it"), F.lit(-1)) + 1).alias("it"))


def common_landmarks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Points of both levels in the first one's order: (pos, orig_id, other)."""
    return a.select(F.col("slot").alias("pos"), "orig_id").join(b.select("orig_id", F.col("slot").alias("other")), "orig_id")


def linked(layout: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A level's layout beside the documents that its points stand for."""
    return layout.join(docs.select(F.col(id_col).alias("orig_id"), F.col(text_col).alias("document")), "orig_id")
