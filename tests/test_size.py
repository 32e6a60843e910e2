"""What grows with the input no faster than it, seen at small sizes: bytes shuffled and spilled."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrakin.operators import drill, knn as nn, layout, metrics, tables, walks
from terrakin.plans import queries
from terrakin.plans.queries import embeddings

SF = "/root/testdata/sf0.1"
POINTS = 2_000 * (64 * 8 + 24)  # bytes of sf0.1's vectors as doubles


def moved(spark, run) -> int:
    """Bytes that stages wrote to shuffles and spilled while ``run`` ran."""

    def total() -> int:
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteBytes() + stages.apply(k).diskBytesSpilled() for k in range(stages.size()))

    before = total()
    run()
    return total() - before


def by_hand(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of every row."""
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def test_pairs_of_blocks_copy_no_points(spark):
    p = embeddings(spark, SF)
    assert moved(spark, lambda: nn.pairwise(p, 256).write.format("noop").mode("overwrite").save()) < 3 * POINTS


def test_exact_neighbours_copy_no_points(spark):
    p = embeddings(spark, SF)
    assert moved(spark, lambda: nn.exact(p, 15, 256).write.format("noop").mode("overwrite").save()) < 4 * POINTS


@pytest.mark.parametrize("kind", ["far from 0", "copies", "one far away", "huge"])
def test_exact_neighbours_of_odd_vectors(spark, kind):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((300, 6))
    if kind == "far from 0":
        x = x * 1e-3 + 1e9
    elif kind == "copies":
        x = np.round(x)
    elif kind == "one far away":
        x = np.concatenate([x[1:] * 1e-6, np.full((1, 6), 1e8)])
    else:
        x = x * 1e30
    p = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "id long, features array<double>")
    got = np.full((300, 7), -1)
    for r in nn.exact(p, 8, 64).filter("rank > 0").collect():
        got[r["q"], r["rank"] - 1] = r["c"]
    assert (got == by_hand(x, 7)).all()


def test_means_of_neighbours_move_whole_vectors(spark):
    p = embeddings(spark, SF)
    near = spark.range(2_000).select(F.col("id").alias("q"), F.explode(F.sequence(F.lit(1), F.lit(14))).alias("rank")).withColumn("c", F.pmod(F.col("q") * 31 + F.col("rank") * 17, F.lit(2_000)))
    assert moved(spark, lambda: nn.shifted(near, p).write.format("noop").mode("overwrite").save()) < 14 * POINTS


def test_wide_dense_rows(spark):
    """A width of 20,000, of which each row has 2,000 entries."""
    e = spark.range(40).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(19_999), F.lit(10))).alias("col")).withColumn("val", F.col("col") + F.col("row") + 0.5)
    begun = time.monotonic()
    got = tables.dense_rows(e, 20_000).agg(F.count("*"), F.min(F.size("features")), F.max(F.size("features")), F.sum(F.aggregate("features", F.lit(0.0), lambda a, x: a + x))).first()
    assert tuple(got) == (40, 20_000, 20_000, sum(c + r + 0.5 for r in range(40) for c in range(0, 20_000, 10)))
    assert time.monotonic() - begun < 10
    few = spark.createDataFrame([(7, 1, 2.0), (7, 9, 1.0), (8, 0, None)], "row long, col int, val double")
    assert {r["row"]: r["features"] for r in tables.dense_rows(few, 3).collect()} == {7: [0.0, 2.0, 0.0], 8: [0.0, 0.0, 0.0]}


def test_large_components_send_nothing_to_the_driver(spark, monkeypatch):
    """A ring of 400 with growing weights, solved densely, in one task and by joins."""
    ring = [(k, (k + 1) % 400, 1.0 + (k % 7) / 10 + k / 400) for k in range(400)]
    g = spark.createDataFrame([e for a, b, w in ring for e in ((a, b, w), (b, a, w))], "i long, j long, w double").cache()
    dense = layout.spectral_init(g, spark.range(400)).orderBy("id").toPandas()[["x", "y"]].to_numpy()
    monkeypatch.setattr(layout, "DENSE", 50)
    monkeypatch.setattr(layout, "_lanczos", None)  # no step is a job of its own
    assert np.allclose(layout.spectral_init(g, spark.range(400)).orderBy("id").toPandas()[["x", "y"]].to_numpy(), dense, atol=2e-2)


def test_layout_quality_asks_all_points(spark, monkeypatch):
    seen = []
    real = nn.exact
    monkeypatch.setattr(queries.metrics, "SAMPLE", 60)
    monkeypatch.setattr(queries, "umap_flat", lambda spark, sf: embeddings(spark, sf).select(F.col("id").alias("slot"), F.col("features")[0].alias("x"), F.col("features")[1].alias("y")))
    monkeypatch.setattr(queries.nn, "exact", lambda p, k: seen.append(p.count()) or real(p, k))
    got = queries.layout_quality(spark, "/root/testdata/sf0.01").first()
    assert seen == [500, 500, 500] and got["placed"] == 500


def test_epochs_of_large_layouts_are_passes_over_blocks(spark, monkeypatch):
    """300 vertices in blocks of 64, some of them fixed and one without edges: the same as in
    one task, without a join in an epoch."""
    rng = np.random.default_rng(3)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 299, (900, 2)) if a < b}
    g = spark.createDataFrame([e for a, b in pairs for e in ((2 * a, 2 * b, 0.1 + (a + b) % 10 / 10), (2 * b, 2 * a, 0.1 + (a + b) % 10 / 10))], "i long, j long, w double")
    start = layout.random_init(spark.range(0, 600, 2), 0, 1).withColumn("is_fixed", F.col("id") % 10 == 0)
    one = layout.optimized(start, g, 1.4, 0.9, 6, 42).orderBy("id").toPandas().to_numpy()
    monkeypatch.setattr(layout, "ROWS", 0)
    monkeypatch.setattr(layout, "edge_gradient", None)
    assert np.allclose(layout.optimized(start, g, 1.4, 0.9, 6, 42).orderBy("id").toPandas().to_numpy(), one, atol=1e-9)


def test_walks_pass_no_graph_by_the_driver(spark, monkeypatch):
    e = spark.range(600).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("rank")).withColumn("j", F.pmod(F.col("i") * 7 + F.col("rank"), F.lit(600))).withColumn("p", F.lit(1 / 3))
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", None)
    arrays = walks.end_points(e, 0, 42, 3, 4)
    assert arrays.agg(F.sum("cnt")).first()[0] == 1_800
    monkeypatch.setattr(walks, "EDGES", 0)
    assert metrics.reproducible(arrays, walks.end_points(e, 0, 42, 3, 4))


def test_neighbours_of_neighbours_copy_no_vectors(spark):
    """Each of two rounds measures up to 400 pairs a point, of two vectors each."""
    p = embeddings(spark, SF)
    kept, limit = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert moved(spark, lambda: kept.extend(nn.approximate(p, 15, trees=2).collect())) < 45 * POINTS
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    x = np.array([r["features"] for r in p.orderBy("id").collect()])
    want, got = by_hand(x, 14), np.full((2_000, 14), -1)
    for r in kept:
        if r["rank"]:
            got[r["q"], r["rank"] - 1] = r["c"]
    assert np.mean([len(set(a) & set(b)) / 14 for a, b in zip(want.tolist(), got.tolist())]) > 0.6


def test_padding_turns_only_the_selection_around(spark, monkeypatch):
    m = queries.model(spark, "/root/testdata/sf0.001")
    seen = []
    real = tables.symmetric
    monkeypatch.setattr(tables, "symmetric", lambda e: seen.append(e.count()) or real(e))
    some = spark.range(2).withColumnRenamed("id", "slot")
    got = m.padded_neighbors(2, 5, slots=some)
    monkeypatch.undo()
    nodes = m.members(2, slots=some).select("id")
    assert seen and seen[0] < m.levels[1].distances.count() / 4
    assert metrics.reproducible(got, drill.padded_neighbors(m.get_data(1), nodes, 5))
