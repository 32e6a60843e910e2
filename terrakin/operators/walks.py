"""Random walks as joins: a state (start, walk, v) meets the row of its vertex in every step.
Draws are functions of (seed, kind, level, start, walk, step), so walks are reproducible.
Graphs of up to ``EDGES`` edges are read as arrays by every task and walked in place, with the
same draws and results."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from terrakin.functions.rng import uniform
from terrakin.storage import materialize

CUT = 10  # steps between written states
EDGES = 24_000_000  # of 17 bytes each


def fans(edges: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """(v, fan): per vertex its edges by rank as (hi, j, hit): running sum of shares, target,
    whether the target is in ``marked`` (column id)."""
    hi = F.sum("p").over(Window.partitionBy("i").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = edges.select("i", "rank", "j", hi.alias("hi"))
    if marked is None:
        rows = rows.withColumn("hit", F.lit(False))
    else:
        rows = rows.join(marked.select(F.col("id").alias("j"), F.lit(True).alias("hit")), "j", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    packed = rows.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("rank", "hi", "j", "hit"))).alias("fan"))
    return materialize(packed.select(F.col("i").alias("v"), "fan"), "fans")


def _walk(starts: DataFrame, fan: DataFrame, kind: str, level: int, seed: int, walks: int, steps: int) -> DataFrame:
    """(start, walk, v, hit) after all steps; v is null where a walk died."""
    if fan.agg(F.coalesce(F.sum(F.size("fan")), F.lit(0))).first()[0] <= EDGES:
        return _walk_arrays(starts, fan, f"{seed}|{kind}|{level}", walks, steps)
    now = starts.select(F.col("id").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"))
    now = now.withColumns({"v": F.col("start"), "hit": F.lit(False)})
    for step in range(steps):
        if step and step % CUT == 0:
            now = materialize(now, "walks")
            if now.filter("v is not null and not hit").isEmpty():
                break
        # Ended walks get keys that no vertex has, spread like the starts.
        live = F.expr("v is not null and not hit")
        keyed = now.withColumn("key", F.when(live, F.col("v").cast("string")).otherwise(F.concat(F.lit("-"), F.col("start").cast("string"), F.lit("|"), F.col("walk").cast("string"))))
        draw = uniform(seed, kind, level, F.col("start"), F.col("walk"), step)
        met = keyed.join(fan.select(F.col("v").cast("string").alias("key"), "fan"), "key", "left")
        met = met.select("start", "walk", "v", "hit", F.get(F.filter("fan", lambda e: e["hi"] > draw), F.lit(0)).alias("e"))
        now = met.select("start", "walk", F.when(live, F.col("e.j")).otherwise(F.col("v")).alias("v"), F.when(live, F.coalesce(F.col("e.hit"), F.lit(False))).otherwise(F.col("hit")).alias("hit"))
    return now


def _walk_arrays(starts: DataFrame, fan: DataFrame, key: str, walks: int, steps: int) -> DataFrame:
    """The same where a task reads all fans from the shared folder, past the driver."""
    types = {"names": np.int64, "n": np.int64, "hi": float, "j": np.int64, "hit": bool}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of ascending vertices; rows do not overlap."""
        for batch in filter(len, batches):
            flat = [batch.column(c).flatten().fill_null(x).to_numpy(zero_copy_only=False) for c, x in (("hi", -1.0), ("j", 0), ("hit", False))]
            columns = [batch.column("v").to_numpy(), batch.column("n").to_numpy(), *flat]
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in zip(columns, types.values())], list(types))

    rows = fan.select("v", F.size("fan").alias("n"), F.col("fan.hi").alias("hi"), F.col("fan.j").alias("j"), F.col("fan.hit").alias("hit"))
    packed = materialize(rows.repartitionByRange("v").sortWithinPartitions("v").mapInArrow(pack, ", ".join(f"{c} binary" for c in types)), "fan_arrays")

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = [b.column(0).to_numpy() for b in filter(len, batches)]
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(ids).tobytes()])], ["starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, None] = {}
        blocks: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                held[batch.column("starts")[k].as_py()] = None
                block = [np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in types.items()]
                if (first := int(block[0][0])) not in blocks:
                    blocks[first] = [x.copy() for x in block]
        if not held:
            return
        parts = [blocks.pop(k) for k in sorted(blocks)]
        names, sizes, hi, j, hit = (np.concatenate(x) for x in zip(*parts))
        del parts
        for own in held:
            yield from walked(np.frombuffer(own, np.int64), names, np.concatenate(([0], np.cumsum(sizes))), hi, j, hit)

    def walked(ids: np.ndarray, names: np.ndarray, ends: np.ndarray, hi: np.ndarray, j: np.ndarray, hit: np.ndarray) -> Iterator[pa.RecordBatch]:
        def place(v: np.ndarray) -> np.ndarray:
            """Where vertices are among the names; -1 where they have no edge."""
            at = np.minimum(np.searchsorted(names, v), max(len(names) - 1, 0))
            return np.where(names[at] == v, at, -1) if len(names) else np.full(len(v), -1)

        for a in range(0, len(ids), 4_096):
            own = ids[a : a + 4_096]
            start, walk = np.repeat(own, walks), np.tile(np.arange(walks), len(own))
            v, dead, done = start.astype(np.int64), np.zeros(len(start), bool), np.zeros(len(start), bool)
            live = np.arange(len(start))
            for step in range(steps):
                raw = b"".join(hashlib.md5(f"{key}|{s}|{w}|{step}".encode()).digest()[:4] for s, w in zip(start[live].tolist(), walk[live].tolist()))
                u, k = np.frombuffer(raw, ">u4") / 4294967296.0, place(v[live])
                low, end = np.where(k >= 0, ends[k], 0), np.where(k >= 0, ends[k + 1], 0)
                high = end
                while (low < high).any():  # the first edge whose running share is over the draw
                    mid = np.minimum((low + high) // 2, len(hi) - 1)
                    over = hi[mid] > u
                    low, high = np.where((low < high) & ~over, mid + 1, low), np.where((low < high) & over, mid, high)
                on = low < end
                dead[live[~on]] = True
                live, at = live[on], low[on]
                v[live], done[live] = j[at], hit[at]
                live = live[~done[live]]
                if not len(live):
                    break
            yield pa.RecordBatch.from_arrays([pa.array(start, pa.int64()), pa.array(walk, pa.int32()), pa.array(v, mask=dead), pa.array(done)], ["start", "walk", "v", "hit"])

    groups = max(2 * starts.sparkSession.sparkContext.defaultParallelism, -(-starts.count() // 32_768))
    own = starts.select(F.col("id").cast("long").alias("id")).repartition(groups, "id").mapInArrow(group, "starts binary")
    return packed.coalesce(1).hint("shuffle_replicate_nl").crossJoin(own).mapInArrow(run, "start long, walk int, v long, hit boolean")


def end_points(edges: DataFrame, level: int, seed: int, walks: int, steps: int) -> DataFrame:
    """(id, cnt) of every vertex: how many of all vertices' walks end there."""
    nodes = edges.select(F.col("i").alias("id")).distinct()
    ends = _walk(nodes, fans(edges), "lm", level, seed, walks, steps).filter("v is not null").groupBy(F.col("v").alias("id")).agg(F.count(F.lit(1)).alias("cnt"))
    return nodes.join(ends, "id", "left").select("id", F.coalesce("cnt", F.lit(0).cast("long")).alias("cnt"))


def absorbed(edges: DataFrame, landmarks: DataFrame, level: int, seed: int, walks: int, steps: int) -> DataFrame:
    """(pt, walk, id): the first landmark that each walk of each other vertex meets."""
    nodes = edges.select(F.col("i").alias("id")).distinct().join(landmarks, "id", "left_anti")
    return _walk(nodes, fans(edges, landmarks), "ab", level, seed, walks, steps).filter("hit").select(F.col("start").alias("pt"), "walk", F.col("v").alias("id"))
