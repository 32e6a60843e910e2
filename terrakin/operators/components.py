"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terrakin.storage import discard, materialize


def components(edges: DataFrame, a: str, b: str, rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node of each connected component, for every node of an
    edge. Alternating large-star and small-star steps (Kiveris et al. 2014): each step is a
    partial-aggregated min and a plain join, in which adaptive execution splits a hub's rows."""
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lows.select("u", F.col("m").alias("v")))
        last, now = now, materialize(small.filter("u <> v").distinct(), "edges")
        discard(last)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
