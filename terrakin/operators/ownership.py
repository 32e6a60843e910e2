"""Which landmark owns a point, and how many points each landmark influences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from terrakin.storage import discard, materialize


def owners(knn: DataFrame, landmarks: DataFrame, rounds: int = 1_000) -> DataFrame:
    """(id, owner, owner_slot, strength, first_slot, association) of every point.

    Landmarks own themselves. A point among a landmark's neighbours goes to the nearest such
    landmark (ties: smaller slot); ``first_slot`` is the smallest slot that reaches it and
    ``association`` the slots that were nearest so far, in slot order. Then, in rounds, a
    point without owner takes that of its nearest neighbour that is a landmark or had an
    owner before the round. A point that no round reaches is an error."""
    knn = knn.filter("rank > 0")
    one = F.array(F.col("slot"))
    selves = landmarks.select("id", F.col("id").alias("owner"), F.col("slot").alias("owner_slot"), F.lit(0.0).alias("strength"), F.col("slot").alias("first_slot"), one.alias("association"))
    reach = knn.join(landmarks.select(F.col("id").alias("q"), "slot"), "q").select(F.col("c").alias("id"), F.col("q").alias("owner"), "slot", "dist")
    reach = reach.join(landmarks.select("id"), "id", "left_anti")
    so_far = F.min("dist").over(Window.partitionBy("id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    better = reach.withColumn("nearer", so_far.isNull() | (F.col("dist") < so_far))
    best = better.groupBy("id").agg(
        F.min(F.struct("dist", "slot", "owner")).alias("b"),
        F.min("slot").alias("first_slot"),
        F.sort_array(F.collect_list(F.when(F.col("nearer"), F.col("slot")))).alias("association"),
    )
    first = best.select("id", F.col("b.owner").alias("owner"), F.col("b.slot").alias("owner_slot"), F.col("b.dist").alias("strength"), "first_slot", "association")
    now = materialize(selves.unionByName(first), "owners")
    every = knn.select(F.col("q").alias("id")).distinct()
    n, owned = every.count(), now.count()
    for _ in range(rounds):
        if owned >= n:
            return now
        open_ = knn.join(now.select(F.col("id").alias("q")), "q", "left_anti").join(now.select(F.col("id").alias("c"), "owner", "owner_slot"), "c")
        new = open_.groupBy(F.col("q").alias("id")).agg(F.min(F.struct("rank", "owner", "owner_slot", "dist")).alias("b"))
        new = new.select("id", F.col("b.owner").alias("owner"), F.col("b.owner_slot").alias("owner_slot"), F.col("b.dist").alias("strength"), F.col("b.owner_slot").alias("first_slot"), F.array("b.owner_slot").alias("association"))
        last, now = now, materialize(now.unionByName(new), "owners")
        discard(last)
        before, owned = owned, now.count()
        if owned == before:
            raise ValueError(f"{n - owned} points reach no landmark")
    raise ValueError("ownership did not settle")


def influence(membership: DataFrame, below: DataFrame | None = None) -> DataFrame:
    """(slot, cnt) of a level's landmarks: at first the points that each reaches first; above
    that the sums over what its members influence (``below``)."""
    if below is None:
        return membership.groupBy(F.col("first_slot").alias("slot")).agg(F.count(F.lit(1)).alias("cnt"))
    met = membership.select("id", "owner_slot").join(below.select(F.col("slot").alias("id"), "cnt"), "id")
    return met.groupBy(F.col("owner_slot").alias("slot")).agg(F.sum("cnt").alias("cnt"))
