"""The registered queries of the engine's own operators, on ``embeddings`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrakin.functions import vectors
from terrakin.functions.curve import find_ab
from terrakin.operators import drill, fuzzy, knn as nn, landmarks as lm, layout, metrics, ownership, prep, tables, walks
from terrakin.operators.components import components
from terrakin.operators.index import numbered
from terrakin.params import Params
from terrakin.plans import hierarchy
from terrakin.sources.readers import points
from terrakin.storage import materialize

PARAMS = Params(levels=(0.2, 0.2), n_neighbors=15, min_dist=0.15, n_epochs=200)
CLASSES = [1, 3]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(table(spark, sf_dir, "embeddings"))


def r6(c: str | Column) -> Column:
    """Rounded, as both engines' last bits differ."""
    return F.round(c, 6)


_models: dict[tuple[str, str], hierarchy.Model] = {}


def model(spark: SparkSession, sf_dir: str) -> hierarchy.Model:
    """The hierarchy of ``embeddings``, fitted once for a session and folder."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _models:
        _models[key] = hierarchy.fit(embeddings(spark, sf_dir), PARAMS)
    return _models[key]


def forget() -> None:
    """The next question fits again."""
    _models.clear()


def pairwise_distance(spark, sf):
    return nn.pairwise(embeddings(spark, sf)).select("q", "c", r6("dist").alias("dist"))


def knn_exact(spark, sf):
    return nn.exact(embeddings(spark, sf), PARAMS.n_neighbors).select("q", "rank", "c", r6("dist").alias("dist"))


def knn_label_agreement(spark, sf):
    p = embeddings(spark, sf)
    return nn.label_agreement(nn.exact(p, PARAMS.n_neighbors), p)


def knn_approximate(spark, sf):
    return nn.approximate(embeddings(spark, sf), PARAMS.n_neighbors).select("q", "rank", "c", r6("dist").alias("dist"))


def knn_recall(spark, sf):
    p = materialize(embeddings(spark, sf), "recall_points")
    found = nn.recall(nn.approximate(p, PARAMS.n_neighbors), nn.exact(p, PARAMS.n_neighbors))
    return found.select((F.col("recall") >= 0.9).alias("enough"))


def _nearest_only(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Neighbours, and the components that each point's nearest neighbour alone makes."""
    knn = materialize(nn.exact(embeddings(spark, sf), PARAMS.n_neighbors), "knn")
    return knn, components(knn.filter("rank = 1"), "q", "c")


def graph_components(spark, sf):
    return _nearest_only(spark, sf)[1]


def component_centroids(spark, sf):
    part = _nearest_only(spark, sf)[1].select(F.col("node").alias("id"), F.col("root").alias("part"))
    return layout.centroids(embeddings(spark, sf), part).select("part", "at", r6("mean").alias("mean"))


def component_linkage(spark, sf):
    knn, parts = _nearest_only(spark, sf)
    near = knn.filter("rank > 0").select(F.col("q").alias("row"), F.col("c").alias("col"), "dist")
    return layout.linkage(near, parts.select(F.col("node").alias("id"), F.col("root").alias("part"))).select("a", "b", r6("dist").alias("dist"))


def _edges(spark, sf) -> tuple[DataFrame, DataFrame]:
    knn = materialize(nn.exact(embeddings(spark, sf), PARAMS.n_neighbors), "knn")
    bands = fuzzy.smooth(knn, PARAMS.n_neighbors)
    return bands, fuzzy.edges(knn, bands)


def smooth_knn(spark, sf):
    return _edges(spark, sf)[0].select("id", r6("sigma").alias("sigma"), r6("rho").alias("rho"))


def membership(spark, sf):
    return _edges(spark, sf)[1].select("i", "rank", "j", r6("v").alias("v"))


def transition(spark, sf):
    return _edges(spark, sf)[1].select("i", "rank", "j", r6("p").alias("p"))


def fuzzy_graph(spark, sf):
    return fuzzy.graph(_edges(spark, sf)[1]).select("i", "j", r6("w").alias("w"))


def pruned_graph(spark, sf):
    return fuzzy.pruned(materialize(fuzzy.graph(_edges(spark, sf)[1]), "graph"), 10).select("i", "j", r6("w").alias("w"))


def epochs_per_sample(spark, sf):
    return fuzzy.epochs_per_sample(materialize(fuzzy.graph(_edges(spark, sf)[1]), "graph")).select("i", "j", r6("epochs").alias("epochs"))


def walk_endpoints(spark, sf):
    return walks.end_points(model(spark, sf).levels[0].edges, 0, PARAMS.seed, PARAMS.landmark_walks, PARAMS.landmark_steps)


def landmarks_l1(spark, sf):
    return model(spark, sf).levels[0].landmarks.select("slot", "id")


def neighborhood_l1(spark, sf):
    at = model(spark, sf).levels[0]
    hits = walks.absorbed(at.edges, at.landmarks, 0, PARAMS.seed, PARAMS.influence_walks, PARAMS.influence_steps)
    return lm.neighborhoods(hits, at.landmarks)


def local_neighborhood_l1(spark, sf):
    at = model(spark, sf).levels[0]
    none = spark.createDataFrame([], "id long, pt long")
    return lm.neighborhoods(none, at.landmarks, at.knn, 10)


def landmark_distance_l1(spark, sf):
    return model(spark, sf).levels[1].distances.select("row", "col", r6("dist").alias("dist"))


def landmark_data_l1(spark, sf):
    return model(spark, sf).get_data(1).select("row", "col", r6("val").alias("val"))


def knn_l1(spark, sf):
    return model(spark, sf).levels[1].knn.select("q", "rank", "c", r6("dist").alias("dist"))


def fuzzy_graph_l1(spark, sf):
    return model(spark, sf).levels[1].graph.select("i", "j", r6("w").alias("w"))


def ownership_l0(spark, sf):
    return model(spark, sf).levels[0].membership.select("id", "owner", "owner_slot", r6("strength").alias("strength"))


def association_l0(spark, sf):
    return model(spark, sf).levels[0].membership.select("id", F.posexplode("association").alias("pos", "slot"))


def count_influence(spark, sf):
    return ownership.influence(model(spark, sf).levels[0].membership)


def owned_count(spark, sf):
    return model(spark, sf).levels[0].membership.groupBy("owner_slot").agg(F.count(F.lit(1)).alias("n"))


def influence_l1(spark, sf):
    return model(spark, sf).influence(1)


def influence_l2(spark, sf):
    return model(spark, sf).influence(2)


def labels_l2(spark, sf):
    return model(spark, sf).labels(2)


def original_indices_l2(spark, sf):
    return model(spark, sf).original_indices(2)


def owner_slots_l1(spark, sf):
    return model(spark, sf).get_indices(1)


def drill_members_by_class(spark, sf):
    return model(spark, sf).members(2, labels=CLASSES)


def drill_members_by_index(spark, sf):
    return model(spark, sf).members(2, slots=spark.range(5).withColumnRenamed("id", "slot"))


def drill_subgraph(spark, sf):
    m = model(spark, sf)
    return drill.induced(m.levels[0].graph, m.members(1, labels=CLASSES)).select("i", "j", r6("w").alias("w"))


def focus_context_graph(spark, sf):
    m = model(spark, sf)
    chosen = drill.selected(m.levels[2].points, CLASSES)
    both = drill.with_context(m.levels[1].graph, m.members(2, slots=chosen), m.levels[2].graph, drill.outside(m.levels[2].points, chosen))
    return both.select("role", "i", "j", r6("w").alias("w"))


def drill_padded_knn(spark, sf):
    return model(spark, sf).padded_neighbors(2, PARAMS.n_neighbors, labels=CLASSES).select("q", "rank", "c", r6("dist").alias("dist"))


def drill_correspondence(spark, sf):
    return model(spark, sf).correspondence(2, labels=CLASSES)


def drill_layout(spark, sf):
    return model(spark, sf).drill(2, labels=CLASSES, focus_context=True)


def random_init(spark, sf):
    return layout.random_init(embeddings(spark, sf), 0, PARAMS.seed).select("id", r6("x").alias("x"), r6("y").alias("y"))


def _plane(spark, sf) -> DataFrame:
    """The first two features as a fixed projection."""
    return embeddings(spark, sf).select("id", F.col("features")[0].cast("double").alias("x"), F.col("features")[1].cast("double").alias("y"))


def fixed_rescale(spark, sf):
    start = layout.random_init(embeddings(spark, sf), 0, PARAMS.seed)
    return layout.rescaled(start, _plane(spark, sf).filter("id % 7 = 0")).select("id", r6("x").alias("x"), r6("y").alias("y"), "is_fixed")


def sgd_edge_gradient(spark, sf):
    a, b = find_ab(PARAMS.spread, PARAMS.min_dist)
    edges = nn.exact(embeddings(spark, sf), PARAMS.n_neighbors).filter("rank > 0").select(F.col("q").alias("i"), F.col("c").alias("j"))
    return layout.edge_gradient(_plane(spark, sf), edges, a, b).select("i", "j", r6("gx").alias("gx"), r6("gy").alias("gy"))


def sgd_push(spark, sf):
    a, b = find_ab(PARAMS.spread, PARAMS.min_dist)
    edges = nn.exact(embeddings(spark, sf), PARAMS.n_neighbors).filter("rank > 0").select(F.col("q").alias("i"), F.col("c").alias("j"))
    places = materialize(numbered(_plane(spark, sf), ["id"], "pos"), "push_places")
    return layout.push_gradient(places, edges, a, b, 1, PARAMS.seed).select("i", "j", "draw", "k", r6("gx").alias("gx"), r6("gy").alias("gy"))


def spectral_init(spark, sf):
    at = model(spark, sf).levels[0]
    return layout.spectral_init(at.graph, at.points.select(F.col("slot").alias("id")))


def embed_level(spark, sf):
    return model(spark, sf).embed(1)


def embed_with_fixed(spark, sf):
    m = model(spark, sf)
    return m.embed(0, fixed_df=m.fixed_from(0, m.embed(1)))


def umap_flat(spark, sf):
    return hierarchy.umap(embeddings(spark, sf), Params(n_neighbors=15, n_epochs=200, init="Spectral"))


def layout_quality(spark, sf):
    """How the flat layout holds up: every point placed once, all finite, and more of all points'
    15 nearest kept than by the two main components."""
    p = materialize(embeddings(spark, sf), "quality_points")
    made = materialize(umap_flat(spark, sf).select(F.col("slot").alias("id"), F.array("x", "y").alias("features")), "quality_layout")
    flat = materialize(prep.pca(p, 2).select("id", "features"), "quality_flat")
    high = materialize(nn.exact(p, 16), "quality_high")
    kept = lambda low: metrics.neighborhood_preservation(high, materialize(nn.exact(low, 16), "quality_low"), 15).filter("neighbors = 14").first()["np"]
    whole = made.agg(F.count_distinct("id").alias("placed"), F.every(F.forall("features", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))).alias("finite"))
    return whole.select("placed", "finite", F.lit(kept(made) > kept(flat)).alias("beats_pca"))


def _sample(spark, sf) -> DataFrame:
    return tables.sampled(embeddings(spark, sf), metrics.SAMPLE, PARAMS.seed)


def metric_stress(spark, sf):
    p = _sample(spark, sf)
    return metrics.stress(metrics.pair_distances(p, _plane(spark, sf).join(p.select("id"), "id"))).select(r6("stress").alias("stress"))


def metric_spearman(spark, sf):
    p = materialize(_sample(spark, sf), "sample")
    pairs = materialize(metrics.pair_distances(p, _plane(spark, sf).join(p.select("id"), "id")), "pairs")
    return metrics.spearman(pairs, p.count()).select(r6("correlation").alias("correlation"))


def metric_np(spark, sf):
    p = _sample(spark, sf)
    p = materialize(p, "sample")
    low = materialize(_plane(spark, sf).join(p.select("id"), "id").select("id", F.array("x", "y").alias("features")), "np_plane")
    kept = metrics.neighborhood_preservation(materialize(nn.exact(p, 31), "np_high"), materialize(nn.exact(low, 31), "np_low"), 30)
    return kept.select("neighbors", r6("np").alias("np"))


def metric_procrustes(spark, sf):
    other = embeddings(spark, sf).select("id", F.col("features")[2].cast("double").alias("x"), F.col("features")[3].cast("double").alias("y"))
    value = metrics.procrustes(_plane(spark, sf), other)
    return spark.range(1).select(r6(F.lit(value)).alias("disparity"))


def _counts(spark, sf) -> DataFrame:
    return prep.counts(table(spark, sf, "documents"))


def library_size_filter(spark, sf):
    return prep.library_size_filter(prep.library_sizes(_counts(spark, sf)))


def rare_gene_filter(spark, sf):
    return prep.rare_gene_filter(_counts(spark, sf)).groupBy("gene").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n"))


def lib_norm_sqrt(spark, sf):
    return prep.square_root(prep.library_normalized(_counts(spark, sf))).select("batch", "cell", "gene", r6("value").alias("value"))


def prefix_filter(spark, sf):
    return prep.gene_set_filter(_counts(spark, sf), "th")


def label_encode(spark, sf):
    return prep.label_encoded(table(spark, sf, "documents").select("doc_id", "lang"), "lang")


def batch_union(spark, sf):
    docs = table(spark, sf, "documents").filter("lang is not null")
    names = [r["lang"] for r in docs.select("lang").distinct().limit(1_001).collect()]
    if len(names) > 1_000:
        raise ValueError("batches are a few named tables")
    return prep.batch_union({name: docs.filter(F.col("lang") == name).select("doc_id", "source") for name in names})


def sparse_symmetric(spark, sf):
    entries = tables.coo(embeddings(spark, sf)).select("row", F.col("col").cast("long").alias("col"), F.col("val").cast("double").alias("val"))
    return tables.symmetric(entries).select("row", "col", r6("val").alias("val"))


def sparse_rows(spark, sf):
    packed = tables.sparse_rows(tables.coo(embeddings(spark, sf)))
    return packed.select("row", F.size("entries").cast("long").alias("n"), F.element_at("entries", 1)["col"].alias("first_col"), F.element_at("entries", -1)["col"].alias("last_col"))


def dense_rows(spark, sf):
    """Of the level's sparse distances: what no entry holds is 0."""
    m = model(spark, sf)
    back = tables.dense_rows(m.get_data(2).withColumn("col", F.col("col").cast("int")), m.levels[2].points.count())
    return back.select("row", F.posexplode("features").alias("col", "val")).select("row", "col", r6("val").alias("val"))


def gather_by_index(spark, sf):
    p = embeddings(spark, sf)
    n = p.count()
    wanted = p.select(F.pmod(F.col("id") * 7 + 3, F.lit(n)).alias("id"), F.col("id").alias("pos"))
    return tables.gathered(p.select("id", "label"), wanted, "id").select("pos", "id", "label")


def param_grid(spark, sf):
    return tables.grid(spark, n_neighbors=[15, 100], distance_similarity=[False, True], influence_nw=[10, 20, 30, 40], influence_wl=[5, 10, 20, 30, 40, 50, 60, 70])


def nearest_level(spark, sf):
    m = model(spark, sf)
    sizes = None
    for k, level in enumerate(m.levels):
        one = level.points.agg(F.count(F.lit(1)).alias("size")).select(F.lit(k).alias("level"), "size")
        sizes = one if sizes is None else sizes.union(one)
    return tables.nearest_level(sizes, 70)


def sample_n(spark, sf):
    return tables.sampled(embeddings(spark, sf).select("id", "label"), 100, PARAMS.seed)


def train_split(spark, sf):
    return tables.split(embeddings(spark, sf).select("id"), 0.8, PARAMS.seed)


def l2_normalize(spark, sf):
    rows = prep.l2_normalized_rows(embeddings(spark, sf))
    return rows.select("id", F.posexplode("features").alias("col", "val")).select("id", "col", r6("val").alias("val"))


def doc_lookup_join(spark, sf):
    m = model(spark, sf)
    return tables.linked(m.levels[1].points, table(spark, sf, "documents"), "doc_id", "text").select("slot", "orig_id", "label", "document")


def mean_shift(spark, sf):
    p = embeddings(spark, sf)
    return nn.shifted(nn.exact(p, PARAMS.n_neighbors), p).select("id", "at", r6("value").alias("value"))


def stacked_report(spark, sf):
    """Labels of both upper levels under each other, and their mean and deviation."""
    m = model(spark, sf)
    stacked = tables.stacked_levels({f"level {k}": m.levels[k].points for k in (1, 2)})
    report = metrics.report(stacked, ["technique"], "label")
    return report.select("technique", r6("mean").alias("mean"), r6("std").alias("std"))


def common_landmarks(spark, sf):
    m = model(spark, sf)
    return tables.common_landmarks(m.levels[2].points, m.levels[1].points).select("pos", "orig_id", "other")


def vector_distance(spark, sf):
    """Squared distances of neighbours in id order, under the pair's name."""
    p = embeddings(spark, sf).select("id", vectors.doubles(F.col("features")).alias("f"))
    after = p.select((F.col("id") - 1).alias("id"), F.col("f").alias("g"))
    return p.join(after, "id").select(vectors.pair_name(F.col("id"), F.col("id") + 1).alias("pair"), r6(vectors.squared_distance(F.col("f"), F.col("g"))).alias("d2"))


def curve_grid(spark, sf):
    """The places at which the layout's curve is fitted."""
    return spark.range(1).select(F.posexplode(vectors.linspace(0.0, 3.0 * PARAMS.spread, 300)).alias("at", "x")).select("at", r6("x").alias("x"))


def pca_2(spark, sf):
    """Places on the two main axes, whose signs are free, as distances from the middle."""
    parts = materialize(prep.pca(embeddings(spark, sf), 2).select("id", F.col("features")[0].alias("a"), F.col("features")[1].alias("b")), "pca_parts")
    mean = parts.agg(F.avg("a").alias("a"), F.avg("b").alias("b")).first()
    return parts.select("id", *[F.round(F.abs(F.col(c) - mean[c]), 4).alias(f"off_{c}") for c in "ab"])


def kmeans_selection(spark, sf):
    return prep.kmeans(embeddings(spark, sf), 10).select("id", "cluster")


_NAMES = [
    pairwise_distance, knn_exact, knn_label_agreement, knn_approximate, knn_recall, graph_components, component_centroids, component_linkage, smooth_knn, membership, transition, fuzzy_graph, pruned_graph, epochs_per_sample,
    walk_endpoints, landmarks_l1, neighborhood_l1, local_neighborhood_l1, landmark_distance_l1, landmark_data_l1, knn_l1, fuzzy_graph_l1,
    ownership_l0, association_l0, count_influence, owned_count, influence_l1, influence_l2, labels_l2, original_indices_l2, owner_slots_l1,
    drill_members_by_class, drill_members_by_index, drill_subgraph, focus_context_graph, drill_padded_knn, drill_correspondence, drill_layout,
    random_init, fixed_rescale, sgd_edge_gradient, sgd_push, spectral_init, embed_level, embed_with_fixed, umap_flat, layout_quality,
    metric_stress, metric_spearman, metric_np, metric_procrustes,
    library_size_filter, rare_gene_filter, lib_norm_sqrt, prefix_filter, label_encode, batch_union,
    sparse_symmetric, sparse_rows, dense_rows, gather_by_index, param_grid, nearest_level, sample_n, train_split, l2_normalize, doc_lookup_join, mean_shift, stacked_report, common_landmarks, vector_distance, curve_grid, pca_2, kmeans_selection,
]

QUERIES = {f.__name__: f for f in _NAMES}
