"""Properties of a fitted hierarchy, and what is refused."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrakin.functions.curve import find_ab
from terrakin.operators import drill, knn as nn, landmarks, layout, metrics, ownership, tables, walks
from terrakin.operators.components import components
from terrakin.params import Params
from terrakin.plans import hierarchy
from terrakin.plans.queries import PARAMS, embeddings, model
from terrakin.sources import readers, writers
from terrakin.streaming.assign import assigned

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fitted(spark):
    return model(spark, SF)


def test_levels_shrink_and_influence_is_kept(fitted):
    n = fitted.levels[0].points.count()
    sizes = [lv.points.count() for lv in fitted.levels]
    assert sizes == PARAMS.sizes(n) and sizes == sorted(sizes, reverse=True)
    for level in (1, 2):
        assert fitted.influence(level).agg(F.sum("cnt")).first()[0] == n


def test_every_point_has_one_owner_and_landmarks_own_themselves(fitted):
    at = fitted.levels[0]
    assert at.membership.count() == at.membership.select("id").distinct().count() == 500
    own = at.membership.join(at.landmarks, "id")
    assert own.filter("owner <> id or strength <> 0").isEmpty()


def test_graph_is_symmetric_and_shares_add_up(fitted):
    g = fitted.levels[0].graph
    assert g.exceptAll(g.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).isEmpty()
    assert g.filter("i = j").isEmpty()
    sums = fitted.levels[0].edges.groupBy("i").agg(F.sum("p").alias("p"))
    assert sums.filter("abs(p - 1) > 1e-9").isEmpty()


def test_layouts_and_drill_down(fitted):
    top = fitted.embed(2)
    assert top.count() == 20 and top.filter("isnan(x) or isnan(y)").isEmpty()
    fixed = fitted.embed(1, fixed_df=fitted.fixed_from(1, top))
    assert fixed.count() == 100
    drilled = fitted.drill(2, labels=[1, 3], focus_context=True)
    roles = {r["role"]: r["n"] for r in drilled.groupBy("role").agg(F.count("*").alias("n")).collect()}
    assert roles["focus"] == fitted.members(2, labels=[1, 3]).count() and roles["context"] > 0


def test_same_seed_same_layout(fitted):
    assert metrics.reproducible(fitted.embed(2), fitted.embed(2))


def test_layout_from_given_places(spark, fitted):
    at = fitted.levels[2].points.select(F.col("slot").alias("id"), F.col("slot").cast("double").alias("x"), F.lit(0.5).alias("y"))
    one = fitted.embed(2, init_df=at)
    assert one.count() == 20 and metrics.reproducible(one, fitted.embed(2, init_df=at)) and not metrics.reproducible(one, fitted.embed(2))


@pytest.mark.parametrize("bad", [0, 3, -1])
def test_levels_out_of_bounds(fitted, bad):
    with pytest.raises(ValueError):
        fitted.labels(bad)


def test_drill_at_level_zero_is_refused(spark, fitted):
    with pytest.raises(ValueError):
        fitted.drill(0, slots=spark.range(3).withColumnRenamed("id", "slot"))


def test_bad_points(spark):
    rows = lambda n, d: spark.range(n).select("id", F.array(*[F.rand(1).cast("float") for _ in range(d)]).alias("features"))
    for points in (rows(50, 1), rows(50, 2), None, [[1, 2, 3]], rows(50, 3).withColumn("features", F.array("features")), rows(50, 3).withColumn("id", F.lit(1)), rows(0, 3)):
        with pytest.raises(ValueError):
            hierarchy.fit(points, Params(n_neighbors=5))
    with pytest.raises(ValueError, match="more than"):
        hierarchy.fit(rows(100, 3), Params(n_neighbors=30))
    for wrong in ({"knn_algorithm": "none"}, {"init": "x"}, {"fixing_term": 2}, {"n_neighbors": 1}):
        with pytest.raises(ValueError):
            Params(**wrong)


def test_curve():
    a, b = find_ab(1.0, 0.15)
    assert abs(a - 1.41399994) < 1e-4 and abs(b - 0.94881525) < 1e-4


def test_approximate_neighbours(spark):
    p = embeddings(spark, "/root/testdata/sf0.1")
    got = nn.recall(nn.approximate(p, 15), nn.exact(p, 15)).first()[0]
    assert got >= 0.9


def test_walks_by_joins_and_by_arrays_agree(spark, fitted, monkeypatch):
    at = fitted.levels[1]
    marks = at.landmarks
    runs = []
    for edges in (walks.EDGES, 0):
        monkeypatch.setattr(walks, "EDGES", edges)
        runs.append((walks.end_points(at.edges, 1, 42, 3, 4), walks.absorbed(at.edges, marks, 1, 42, 2, 6)))
    assert metrics.reproducible(runs[0][0], runs[1][0]) and metrics.reproducible(runs[0][1], runs[1][1])


def test_epochs_by_joins_move_points(spark, monkeypatch):
    g = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 0.5), (2, 1, 0.5)], "i long, j long, w double")
    start = layout.random_init(spark.range(3), 0, 1)
    monkeypatch.setattr(layout, "ROWS", 0)
    out = layout.optimized(start, g, 1.4, 0.9, 4, 1).toPandas()
    assert len(out) == 3 and np.isfinite(out[["x", "y"]].to_numpy()).all()


def test_epochs_by_joins_and_by_arrays_agree(spark, fitted, monkeypatch):
    at = fitted.levels[2]
    start = layout.random_init(at.points.select(F.col("slot").alias("id")), 2, 42).withColumn("is_fixed", F.col("id") % 5 == 0)
    runs = []
    for rows in (layout.ROWS, 0):
        monkeypatch.setattr(layout, "ROWS", rows)
        runs.append(layout.optimized(start, at.graph, 1.4, 0.9, 5, 42).orderBy("id").toPandas()[["x", "y"]].to_numpy())
    assert np.allclose(*runs, atol=1e-6)


def test_spectral_by_joins_and_dense_agree(spark, monkeypatch):
    """A path of 12 with growing weights, a triangle and a lone vertex."""
    path = [(k, k + 1, 1.0 + k / 10) for k in range(11)] + [(20, 21, 1.0), (21, 22, 0.5), (20, 22, 0.5)]
    g = spark.createDataFrame([e for a, b, w in path for e in ((a, b, w), (b, a, w))], "i long, j long, w double")
    nodes = spark.createDataFrame([(k,) for k in [*range(12), 20, 21, 22, 30]], "id long")
    runs = []
    for dense in (layout.DENSE, 6):
        monkeypatch.setattr(layout, "DENSE", dense)
        runs.append(layout.spectral_init(g, nodes).orderBy("id").toPandas()[["x", "y"]].to_numpy())
    assert np.allclose(*runs, atol=1e-3)
    xy = runs[0]
    # Three components: along x, along y, against x; half the way apart, scaled to 10.
    assert np.allclose(xy[12:15], [0, xy[12, 1]], atol=2e-3) and abs(xy[15, 1]) < 2e-3
    m = np.zeros((12, 12))
    for i, j, w in path[:11]:
        m[i, j] = m[j, i] = w
    root = np.sqrt(m.sum(axis=1))
    values, vectors = np.linalg.eigh(m / root[:, None] / root[None, :])
    got = xy[:12] - [xy[15, 0] * -1, 0]
    for axis, v in ((0, vectors[:, -2]), (1, vectors[:, -3])):
        assert abs(abs(np.dot(got[:, axis], v)) - np.linalg.norm(got[:, axis])) < 1e-2


def test_components_are_placed_by_their_means_or_links(spark):
    ids = list(range(18))
    part = spark.createDataFrame([(k, k // 3 * 3) for k in ids], "id long, part long")
    sizes = part.groupBy("part").agg(F.count("*").alias("n"))
    far = {0: 0.0, 3: 0.1, 6: 0.2, 9: 2.0, 12: 2.1, 15: 2.2}
    points = spark.createDataFrame([(k, [far[k // 3 * 3], 0.0, 0.0]) for k in ids], "id long, features array<double>")
    links = spark.createDataFrame([(a, b, abs(far[a] - far[b])) for a in far for b in far if a != b], "row long, col long, dist double")
    for how in ({"points": points}, {"distances": links}):
        at = {r["part"]: (r["px"], r["py"]) for r in layout.component_places(sizes, part, **how).collect()}
        gap = lambda a, b: np.hypot(at[a][0] - at[b][0], at[a][1] - at[b][1])
        assert max(gap(0, 3), gap(3, 6), gap(9, 12), gap(12, 15)) < min(gap(0, 9), gap(6, 12), gap(3, 15))
    drawn = layout.component_places(sizes, part).collect()
    assert len(drawn) == 6 and all(-1 <= r["px"] <= 1 and r["span"] > 0 for r in drawn)


def test_neighbours_are_cut_to_what_there_is(spark):
    rows = spark.range(9).select("id", F.array(*[F.rand(k).cast("float") for k in range(3)]).alias("features"))
    assert hierarchy.umap(rows, Params(n_neighbors=50, n_epochs=3, init="Spectral")).count() == 9
    with pytest.raises(ValueError, match="fewer than 3"):
        nn.precomputed(spark.createDataFrame([(0, 0, 0.0), (0, 1, 1.0)], "row long, col long, dist double"), 3)


def test_unknown_pairs_are_one_apart(spark):
    data = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.5), (2, 9, 0.1), (3, 0, 0.2), (3, 1, 1.0), (3, 3, 0.4)], "row long, col long, val double")
    nodes = spark.createDataFrame([(0,), (1,), (2,), (3,)], "id long")
    got = {(r["q"], r["rank"]): (r["c"], r["dist"]) for r in drill.padded_neighbors(data, nodes, 3).collect()}
    assert [got[0, k] for k in range(3)] == [(1, 0.5), (0, 1.0), (2, 1.0)]
    assert [got[2, k] for k in range(3)] == [(2, 1.0), (0, 1.0), (1, 1.0)]
    assert [got[3, k] for k in range(3)] == [(0, 0.2), (3, 0.4), (1, 1.0)]


def test_padding_by_hand(spark):
    hoods = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 2), (1, 3)], "slot long, pt long")
    marks = spark.createDataFrame([(0, 10), (1, 11), (2, 12)], "slot long, id long")
    got = {(r["row"], r["col"]): round(r["dist"], 6) for r in landmarks.distances(hoods, marks, 2, 3).collect()}
    assert got == {(0, 0): 0.0, (0, 1): 0.333333, (1, 0): 0.333333, (1, 1): 0.333333, (2, 0): 1.0, (2, 1): 1.0}


def test_owner_is_the_nearest_landmark(spark):
    knn = spark.createDataFrame([(0, 0, 0, 0.0), (0, 1, 2, 5.0), (1, 0, 1, 0.0), (1, 1, 2, 3.0), (2, 0, 2, 0.0), (2, 1, 1, 3.0), (3, 0, 3, 0.0), (3, 1, 2, 1.0)], "q long, rank int, c long, dist double")
    marks = spark.createDataFrame([(0, 0), (1, 1)], "slot long, id long")
    got = {r["id"]: (r["owner"], r["first_slot"], r["association"]) for r in ownership.owners(knn, marks).collect()}
    assert got[2] == (1, 0, [0, 1]) and got[3] == (1, 1, [1]) and got[0] == (0, 0, [0])
    with pytest.raises(ValueError, match="reach no landmark"):
        ownership.owners(knn.union(spark.createDataFrame([(9, 1, 8, 1.0)], knn.schema)), marks)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (8, 8)], "a long, b long")
    assert {(r[0], r[1]) for r in components(e, "a", "b").collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,label,p,q,r\n0,3,1,2,3\n1,4,4,5,6\n")
    rows = readers.csv_points(spark, str(tmp_path / "a.csv")).orderBy("id").collect()
    assert rows[1]["features"] == [4, 5, 6] and rows[1]["label"] == 4
    (tmp_path / "x.txt").write_text(" 1  2 3\n4 5 6\n")
    (tmp_path / "y.txt").write_text("1.0\n2.0\n")
    rows = readers.text_points(spark, str(tmp_path / "x.txt"), str(tmp_path / "y.txt")).orderBy("id").collect()
    assert rows[1]["features"] == [4, 5, 6] and rows[1]["label"] == 2
    np.save(tmp_path / "x.npy", np.arange(12, dtype=np.float32).reshape(4, 3))
    assert readers.npy_points(spark, str(tmp_path / "x.npy")).count() == 4
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n3 2 2\n1 1 5\n3 2 7\n")
    assert {tuple(r) for r in readers.market_matrix(spark, str(tmp_path / "m.mtx")).collect()} == {(0, 0, 5.0), (2, 1, 7.0)}
    (tmp_path / "tenx").mkdir()
    (tmp_path / "tenx" / "matrix.mtx").write_text("%%MatrixMarket\n2 2 2\n1 1 5\n2 2 7\n")
    (tmp_path / "tenx" / "genes.tsv").write_text("g1\tACTB\ng2\tMT-CO1\n")
    assert {tuple(r) for r in readers.ten_x(spark, str(tmp_path / "tenx"), "b1").collect()} == {("b1", 0, "ACTB", 5.0), ("b1", 1, "MT-CO1", 7.0)}
    spark.range(2).write.parquet(str(tmp_path / "s1"))
    spark.range(3).withColumn("more", F.lit("x")).write.parquet(str(tmp_path / "s2"))
    both = readers.shards(spark, [str(tmp_path / "s1"), str(tmp_path / "s2")])
    assert both.count() == 5 and both.filter("more is null").count() == 2
    for phase in ("Fit", "Level 2"):
        writers.log_seconds(spark, str(tmp_path / "times"), "t", phase, 1.5)
    writers.log_line(spark, str(tmp_path / "study"), id=3, distance_similarity=False, n_neighbors=15, value=0.5)
    assert {tuple(r) for r in spark.read.csv(str(tmp_path / "times")).collect()} == {("t", "Fit", "1.5"), ("t", "Level 2", "1.5")}
    assert tuple(spark.read.csv(str(tmp_path / "study")).first()) == ("3", "false", "15", "0.5")
    places = spark.createDataFrame([(1, 0, 5, 2, 0.5, 0.25)], "level int, slot long, orig_id long, label int, x double, y double")
    for it in (0, 1, 1):
        writers.write_layout(places, str(tmp_path / "out"), "d", "t", it)
    back = writers.read_layouts(spark, str(tmp_path / "out"))
    assert back.count() == 2 and tables.next_iteration(back.select("it")).first()[0] == 2


def test_stream_is_assigned_to_landmarks(spark, fitted, tmp_path):
    p = embeddings(spark, SF)
    marks = fitted.levels[1].points.join(p.select(F.col("id").alias("orig_id"), "features"), "orig_id").select("slot", "features")
    p.select("id", "features").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, features array<float>").parquet(str(tmp_path / "in"))
    q = assigned(stream, marks).writeStream.format("memory").queryName("assigned").start()
    q.processAllAvailable()
    q.stop()
    assert metrics.reproducible(spark.table("assigned"), assigned(p, marks))
    own = spark.table("assigned").join(fitted.levels[1].points.select(F.col("orig_id").alias("id"), F.col("slot").alias("own")), "id")
    assert own.filter("slot <> own").isEmpty()
