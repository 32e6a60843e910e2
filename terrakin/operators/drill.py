"""Drill-down: what the selected landmarks of a level own one level below."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terrakin.operators.index import numbered
from terrakin.operators.knn import precomputed
from terrakin.storage import materialize


def selected(level: DataFrame, labels: list[int]) -> DataFrame:
    """(slot) of a level's points with one of these labels."""
    return level.filter(F.col("label").isin(labels)).select("slot")


def members(membership: DataFrame, selection: DataFrame) -> DataFrame:
    """(id, owner_slot) of the points that the selected slots own, the landmarks included."""
    return membership.select("id", "owner_slot").join(selection.select(F.col("slot").alias("owner_slot")), "owner_slot", "left_semi")


def induced(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (id)."""
    return graph.join(nodes.select(F.col("id").alias("i")), "i", "left_semi").join(nodes.select(F.col("id").alias("j")), "j", "left_semi").select("i", "j", "w")


def with_context(below: DataFrame, focus: DataFrame, above: DataFrame, context: DataFrame) -> DataFrame:
    """(role, i, j, w): the graph below among ``focus`` and the graph above among ``context``,
    side by side without edges between them."""
    a, b = induced(below, focus), induced(above, context)
    return a.select(F.lit("focus").alias("role"), "i", "j", "w").union(b.select(F.lit("context").alias("role"), "i", "j", "w"))


def outside(level: DataFrame, selection: DataFrame) -> DataFrame:
    """(id) of a level's slots that are not selected."""
    return level.join(selection.select("slot"), "slot", "left_anti").select(F.col("slot").alias("id"))


def padded(data: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(row, col, dist): distances (row, col, val) among ``nodes`` (id), unknown pairs at 1, as
    far as a search for k neighbours can use them. Rows with fewer than k below 1 get the
    distance 1 to those of themselves and of the first k nodes that they lack."""
    nodes = nodes.distinct()
    near = data.filter("val < 1").join(nodes.select(F.col("id").alias("row")), "row", "left_semi").join(nodes.select(F.col("id").alias("col")), "col", "left_semi").select("row", "col", F.col("val").alias("dist"))
    held = nodes.select(F.col("id").alias("row")).join(near.groupBy("row").agg(F.count(F.lit(1)).alias("n")), "row", "left").filter(F.coalesce("n", F.lit(0)) < k)
    first = numbered(nodes, ["id"], "place").filter(F.col("place") < k).agg(F.sort_array(F.collect_list("id")).alias("first")).scalar()
    pads = held.select("row", F.explode(F.array_union(first, F.array("row"))).alias("col")).join(near.select("row", "col"), ["row", "col"], "left_anti")
    return near.union(pads.select("row", "col", F.lit(1.0)))


def padded_neighbors(data: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The k nearest of ``padded``; k is cut to the number of nodes."""
    nodes = materialize(nodes.distinct(), "padded_nodes")
    return precomputed(materialize(padded(data, nodes, k), "padded"), min(k, nodes.count()))


def among(distances: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distances (row, col, dist) with both ends among ``nodes`` (id)."""
    return distances.join(nodes.select(F.col("id").alias("row")), "row", "left_semi").join(nodes.select(F.col("id").alias("col")), "col", "left_semi").select("row", "col", "dist")


def correspondence(above: DataFrame, below: DataFrame, chosen: DataFrame) -> DataFrame:
    """(slot, id, place): the point below (slot, orig_id) that each chosen slot above is, by
    their original ids, and its rank among them."""
    met = above.join(chosen.select("slot"), "slot", "left_semi").select("slot", "orig_id").join(below.select(F.col("slot").alias("id"), "orig_id"), "orig_id").select("slot", "id")
    return numbered(met, ["slot"], "place")
