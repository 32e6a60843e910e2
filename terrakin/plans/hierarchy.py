"""The hierarchy: fit it from points, then ask for levels, layouts and drill-downs."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

from terrakin.functions.curve import find_ab
from terrakin.operators import drill, fuzzy, knn as nn, landmarks as lm, layout, ownership, walks
from terrakin.params import Params
from terrakin.storage import materialize


@dataclass(frozen=True)
class Level:
    """Tables of one level. ``points``: slot, orig_id, label (slot of level 0 is the id).
    ``membership`` and ``landmarks`` lead to the next level and are missing on the last."""

    points: DataFrame
    knn: DataFrame
    bands: DataFrame
    edges: DataFrame
    graph: DataFrame
    features: DataFrame | None = None
    distances: DataFrame | None = None
    landmarks: DataFrame | None = None
    membership: DataFrame | None = None
    influence: DataFrame | None = None


def validated(points: DataFrame) -> DataFrame:
    """(id, features, label) with whole rows, or an error: ids unique and present, vectors of
    one length above 2, no null or non-finite component. A missing label is 0."""
    if points is None or not isinstance(points, DataFrame):
        raise ValueError("points are a DataFrame of id, features and perhaps label")
    if not {"id", "features"} <= set(points.columns) or not points.schema["features"].dataType.simpleString().startswith("array<") or points.schema["features"].dataType.simpleString().startswith("array<array"):
        raise ValueError("points need id and features, an array of numbers")
    label = F.coalesce(F.col("label"), F.lit(0)).cast("int") if "label" in points.columns else F.lit(0)
    rows = points.select(F.col("id").cast("long").alias("id"), F.transform("features", lambda x: x.cast("double")).alias("features"), label.alias("label"))
    odd = F.col("features").isNull() | F.exists("features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.min(F.size("features")).alias("lo"), F.max(F.size("features")).alias("hi"), F.count(F.when(odd, 1)).alias("odd")).first()
    if not s["n"]:
        raise ValueError("no points")
    if s["ids"] != s["n"]:
        raise ValueError("ids are missing or repeated")
    if s["odd"] or s["lo"] != s["hi"]:
        raise ValueError("vectors differ in length or hold null or non-finite components")
    if s["hi"] <= 2:
        raise ValueError("more than 2 features are needed")
    return rows


def _graphs(knn: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    knn = materialize(knn, "knn")
    bands = materialize(fuzzy.smooth(knn, k), "bands")
    edges = materialize(fuzzy.edges(knn, bands), "edges")
    return knn, bands, edges, materialize(fuzzy.graph(edges), "graph")


def fit(points: DataFrame, params: Params = Params()) -> "Model":
    """Build all levels. Every table is written once to the cluster's shared folder."""
    rows = materialize(validated(points), "points")
    sizes = params.checked(rows.count())
    k = params.n_neighbors
    tables = rows.select(F.col("id").alias("slot"), F.col("id").alias("orig_id"), "label")
    knn, bands, edges, graph = _graphs(nn.search(rows, k, params.knn_algorithm, params.seed), k)
    level, levels, influence = Level(tables, knn, bands, edges, graph, features=rows.select("id", "features")), [], None
    for at, size in enumerate(sizes[1:]):
        counts = walks.end_points(level.edges, at, params.seed, params.landmark_walks, params.landmark_steps)
        marks = materialize(lm.chosen(counts, size), "landmarks")
        hits = walks.absorbed(level.edges, marks, at, params.seed, params.influence_walks, params.influence_steps)
        hoods = materialize(lm.neighborhoods(hits, marks, level.knn, params.influence_neighborhood), "hoods")
        if hoods.isEmpty():
            raise ValueError("no walk reaches a landmark")
        dists = materialize(lm.distances(hoods, marks, k, size), "distances")
        owned = ownership.owners(level.knn, marks)
        influence = materialize(ownership.influence(owned, influence), "influence")
        levels.append(replace(level, landmarks=marks, membership=owned))
        above = marks.join(level.points.withColumnRenamed("slot", "id"), "id").select("slot", "orig_id", "label")
        knn, bands, edges, graph = _graphs(nn.precomputed(dists, k), k)
        level = Level(materialize(above, "level"), knn, bands, edges, graph, distances=dists, influence=influence)
    return Model(params, (*levels, level))


@dataclass(frozen=True)
class Model:
    """A fitted hierarchy. It never changes; every question returns a DataFrame."""

    params: Params
    levels: tuple[Level, ...] = field(repr=False)

    def _level(self, level: int, least: int = 0) -> Level:
        if not least <= level < len(self.levels):
            raise ValueError(f"level {level} is not one of {least} to {len(self.levels) - 1}")
        return self.levels[level]

    def labels(self, level: int) -> DataFrame:
        return self._level(level, 1).points.select("slot", "label")

    def original_indices(self, level: int) -> DataFrame:
        return self._level(level, 1).points.select("slot", "orig_id")

    def influence(self, level: int) -> DataFrame:
        """(slot, cnt); landmarks that influence nothing have 0."""
        at = self._level(level, 1)
        return at.points.select("slot").join(at.influence, "slot", "left").fillna(0, ["cnt"])

    def get_knn(self, level: int) -> DataFrame:
        return self._level(level).knn.select("q", "rank", "c")

    def get_knn_distances(self, level: int) -> DataFrame:
        return self._level(level).knn.select("q", "rank", "dist")

    def get_data(self, level: int) -> DataFrame:
        """(row, col, val): the symmetric landmark distances."""
        from terrakin.operators.tables import symmetric

        return symmetric(self._level(level, 1).distances.withColumnRenamed("dist", "val"))

    def get_indices(self, level: int) -> DataFrame:
        """(id, owner_slot): where each point of a level belongs in the next."""
        at = self._level(level)
        if at.membership is None:
            raise ValueError("the last level has no owners")
        return at.membership.select("id", "owner_slot")

    def _init(self, graph: DataFrame, nodes: DataFrame, level: int, init_df: DataFrame | None) -> DataFrame:
        at = self.levels[level]
        if init_df is not None:
            return nodes.join(init_df.select("id", "x", "y"), "id")
        if self.params.init == "Spectral":
            return layout.spectral_init(graph, nodes, self.params.seed, at.features, at.distances)
        return layout.random_init(nodes, level, self.params.seed)

    def _laid_out(self, graph: DataFrame, nodes: DataFrame, level: int, fixed: DataFrame | None, init_df: DataFrame | None) -> DataFrame:
        nodes = materialize(nodes, "layout_nodes")
        n = self.params.epochs(nodes.count())
        kept = fuzzy.pruned(graph, n)
        start = self._init(kept, nodes, level, init_df)
        if fixed is not None:
            start = layout.rescaled(start, fixed)
        a, b = find_ab(self.params.spread, self.params.min_dist)
        return layout.optimized(start, kept, a, b, n, self.params.seed, self.params.fixing_term)

    def embed(self, level: int, init_df: DataFrame | None = None, fixed_df: DataFrame | None = None) -> DataFrame:
        """(level, slot, orig_id, label, x, y). ``init_df``: first places (id, x, y);
        ``fixed_df``: places to keep near."""
        at = self._level(level)
        places = self._laid_out(at.graph, at.points.select(F.col("slot").alias("id")), level, fixed_df, init_df)
        return at.points.join(places.withColumnRenamed("id", "slot"), "slot").select(F.lit(level).alias("level"), "slot", "orig_id", "label", "x", "y")

    transform = embed

    def fixed_from(self, level: int, above: DataFrame) -> DataFrame:
        """(id, x, y): the places of a level's points that the layout of the next level has."""
        marks = self._level(level).landmarks
        return above.select("slot", "x", "y").join(marks, "slot").select("id", "x", "y")

    def members(self, level: int, slots: DataFrame | None = None, labels: list[int] | None = None) -> DataFrame:
        """(id, owner_slot) one level below the selection (``slots``, or by ``labels``)."""
        above = self._level(level, 1)
        chosen = slots if labels is None else drill.selected(above.points, labels)
        return drill.members(self._level(level - 1).membership, chosen)

    def padded_neighbors(self, level: int, k: int, slots: DataFrame | None = None, labels: list[int] | None = None) -> DataFrame:
        """(q, rank, c, dist): the k nearest among what the selection owns one level below
        (which has distances of its own), where unknown pairs are 1 apart."""
        below = self._level(level - 1, 1)
        if below.distances is None:
            return None
        from terrakin.operators.tables import symmetric

        nodes = materialize(self.members(level, slots, labels).select("id").distinct(), "padded_members")
        data = symmetric(drill.among(below.distances, nodes).withColumnRenamed("dist", "val"))
        return drill.padded_neighbors(data, nodes, k)

    def correspondence(self, level: int, slots: DataFrame | None = None, labels: list[int] | None = None) -> DataFrame:
        """(slot, id, place): the point one level below that each selected landmark is, and its
        place in the order of landmarks."""
        chosen = slots if labels is None else drill.selected(self._level(level, 1).points, labels)
        return drill.correspondence(self._level(level, 1).points, self._level(level - 1).points, chosen)

    def drill(self, level: int, slots: DataFrame | None = None, labels: list[int] | None = None, focus_context: bool = False, fixed_df: DataFrame | None = None) -> DataFrame:
        """(slot, orig_id, label, influence, is_fixed, role, x, y) of what the selection owns
        one level below; with ``focus_context`` the unselected landmarks stay around it
        (not at level 1, where the reference semantics have no context)."""
        above, below = self._level(level, 1), self._level(level - 1)
        chosen = slots if labels is None else drill.selected(above.points, labels)
        if chosen is None or chosen.isEmpty():
            raise ValueError("the selection is empty")
        focus = drill.members(below.membership, chosen).select("id")
        graph, nodes = drill.induced(below.graph, focus), focus
        rows = below.points.join(focus.withColumnRenamed("id", "slot"), "slot", "left_semi")
        counts = self.influence(level - 1) if level > 1 else rows.select("slot", F.lit(1).cast("long").alias("cnt"))
        fixed = fixed_df.select("id", F.lit(True).alias("is_fixed")) if fixed_df is not None else None
        out = rows.join(counts, "slot", "left").withColumn("role", F.lit("focus"))
        if focus_context and level > 1:
            # Context slots are told apart from focus slots by a negative id in the layout.
            context = drill.outside(above.points, chosen)
            far = drill.induced(above.graph, context)
            graph = graph.union(far.select(-F.col("i") - 1, -F.col("j") - 1, "w"))
            nodes = nodes.union(context.select(-F.col("id") - 1))
            around = above.points.join(context.withColumnRenamed("id", "slot"), "slot", "left_semi").join(self.influence(level), "slot", "left")
            out = out.unionByName(around.withColumn("role", F.lit("context")))
        places = self._laid_out(graph, nodes, level - 1, fixed_df, None)
        key = F.when(F.col("role") == "focus", F.col("slot")).otherwise(-F.col("slot") - 1)
        out = out.withColumn("id", key).join(places, "id")
        out = out.join(fixed, "id", "left") if fixed is not None else out.withColumn("is_fixed", F.lit(None).cast("boolean"))
        return out.select("slot", "orig_id", "label", F.col("cnt").alias("influence"), F.coalesce("is_fixed", F.lit(False)).alias("is_fixed"), "role", "x", "y")


def umap(points: DataFrame, params: Params | None = None, init_df: DataFrame | None = None) -> DataFrame:
    """(slot, orig_id, label, x, y) of one level, with a spectral start unless told otherwise."""
    params = replace(params or Params(init="Spectral"), levels=())
    n = validated(points).count()
    if n <= params.n_neighbors:  # one level alone takes all there are; levels above refuse
        params = replace(params, n_neighbors=n - 1)
    return fit(points, params).embed(0, init_df=init_df).drop("level")
