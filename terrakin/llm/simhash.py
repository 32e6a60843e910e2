"""SimHash near-duplicate detection with pigeonring candidate pruning.

A text is lower-cased (A-Z only), cut into words ``[^\\x20\\x09-\\x0D]+`` and hashed as
word shingles (repeats count) with XXH64. Bit b of the 64-bit fingerprint is 1 when it is
set in more than half of the hashes. Two fingerprints are linked when they differ in at
most ``tau`` bits; components are the transitive closure of the links.

How links are found without comparing everything: the fingerprint is a ring of ``m``
segments. If two fingerprints differ in at most ``tau`` bits, then some start segment i
has every chain of l consecutive segments from i differing in at most ``l * tau / m`` bits
(the pigeonring principle). The first ``ceil(m / tau) - 1`` segments of such a chain have a
budget below one bit, so they are equal: they are the equi-join key. The remaining chain
budgets prune the candidates before the full Hamming check.

Buckets (one start segment, one key) of at most ``bucket`` fingerprints enumerate their
pairs. Members of larger buckets are resolved exactly without pairs: two fingerprints at
distance <= 2 share a centre at distance <= 1 from both, so every such member is sent once
to its 65 centres and linked to the smallest member there. ``BUCKET`` is the size from
which a bucket has more pairs than its members have centres.

A similarity of shingle sets (Jaccard) is beyond any usable ``tau``: at 0.8 two fingerprints
differ in 10 of 64 bits on average. ``unlike`` therefore has links of its own: texts whose
MinHashes agree in one of ``BANDS`` bands of ``ROWS`` are candidates, and candidates are
compared by their whole sets. A pair at exactly 0.8 shares no band with probability 6e-5.
Buckets of at most ``PAIRED`` sets compare all pairs. In larger ones each member is first
compared with ``HUBS`` others, which joins most of a large group; where that leaves a bucket
in several components, all its pairs that can be alike by size and are not joined yet are
compared as well, in blocks of about ``MET`` sets or ``GRAMS`` shingles that meet two by two.

Defined results: null and empty texts have no shingles and fingerprint 0, linked like any
other; fewer words than the shingle length make one shingle of all words; very long texts are
hashed whole, in blocks of shingles; a bit that exactly half of the shingles set is 0; repeated
rows stay repeated; a null id keeps its row and never names a component unless no other id
does; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from terrakin.llm.arrays import thrifty
from terrakin.llm.common import components, materialize

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BUCKET = 2 * 65 + 1
BLOCK = 1 << 15  # shingles counted at once: bounds memory on very long texts
ROW = "row struct<a:long,b:long>"
BANDS, ROWS, PAIRED, HUBS = 32, 6, 32, 4
MET, GRAMS = 512, 1 << 19  # a block's sets and shingles: bounds the memory of a meeting
_DRAWN = np.random.default_rng(42).integers(0, 1 << 32, (2, BANDS * ROWS), dtype=np.uint32)
FACTORS, SHIFTS = _DRAWN[0] | np.uint32(1), _DRAWN[1]


def _shingles(text: str | None, words: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of the word shingles, in blocks."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    lo, hi = starts[:n].tolist(), ends[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        yield np.fromiter((digest(joined[a:b], seed) for a, b in zip(lo[at : at + BLOCK], hi[at : at + BLOCK])), np.uint64)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of one text."""
    n, ones = 0, np.zeros(64, np.int64)
    for hashes in _shingles(text, words, seed):
        n += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def shingle_set(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_shingles(text, words, seed)]))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of MinHashes of a set; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    short, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 1024):
        np.minimum(least, (short[at : at + 1024, None] * FACTORS + SHIFTS).min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(row.tobytes()) for row in least.reshape(BANDS, ROWS)], np.uint64).view(np.int64)


def row_key(docs: DataFrame) -> Column:
    """128 bits of hash of a whole row, nulls and their places included."""
    parts = [p for c in docs.columns for p in (F.col(c), F.col(c).isNull())]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): one row per input row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.fromiter((fingerprint(t.as_py(), words, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "id long, fp long")


def ring(m: int) -> list[tuple[int, int]]:
    """(offset, width) of the m segments of 64 bits."""
    cuts = [64 * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _mask(bits: list[tuple[int, int]]) -> int:
    """The signed long with the bits of these segments set."""
    x = sum(((1 << w) - 1) << a for a, w in bits)
    return x - (1 << 64) if x >> 63 else x


def _viable(diff: F.Column, i: int, m: int, tau: int) -> F.Column:
    """Whether every chain from segment i stays within its proportional budget."""
    segs, ok = ring(m), F.lit(True)
    order = [segs[(i + k) % m] for k in range(m)]
    for k in range(1, m + 1):
        budget = k * tau // m
        ok = ok & (F.bit_count(diff.bitwiseAND(F.lit(_mask(order[:k])))) <= budget)
    return ok


def links(fps: DataFrame, tau: int = 2, m: int = 9, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a < b: pairs of distinct fingerprints whose closure is that of all pairs at
    Hamming distance <= tau (1 or 2). ``fps`` has one row per distinct ``fp``."""
    if not 1 <= tau <= 2:
        raise ValueError("tau is 1 or 2")
    segs, exact = ring(m), math.ceil(m / tau) - 1
    keys = [_mask([segs[(i + k) % m] for k in range(exact)]) for i in range(m)]
    posted = fps.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(k)) for k in keys])).alias("i", "key")
    )
    sizes = posted.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialize(posted.join(sizes, ["i", "key"]), "simhash_shared")

    cold = shared.filter(F.col("n") <= bucket).groupBy("i", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = cold.select("i", F.posexplode("fps").alias("at", "a"), "fps")
    pairs = pairs.select("i", "a", F.explode(F.slice("fps", F.col("at") + 2, F.size("fps"))).alias("b"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    pruned = F.lit(False)
    for i in range(m):
        pruned = F.when(F.col("i") == i, _viable(diff, i, m, tau)).otherwise(pruned)
    near = pairs.filter(pruned).filter(F.bit_count(diff) <= tau).select("a", "b")

    hot = shared.filter(F.col("n") > bucket).select("fp").distinct()
    flips = F.array(*[F.lit(v) for v in [0, *[_mask([(b, 1)]) for b in range(64)]]])
    centres = hot.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    if tau == 1:
        centres = centres.filter("fp = z or bit_count(fp ^ z) = 1").join(hot.select(F.col("fp").alias("z")), "z", "left_semi")
    hub = centres.groupBy("z").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    starred = centres.join(hub.select("z", "a"), "z").filter("fp <> a").select("a", F.col("fp").alias("b"))
    return near.union(starred).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, tau: int = 2, m: int = 9, bucket: int = BUCKET) -> DataFrame:
    """(id, fp, component): one row per input row; component is the smallest id reachable."""
    marked = materialize(fingerprints(docs, id_col, text_col, words, seed), "simhash_fp")
    fps = materialize(marked.groupBy("fp").agg(F.min("id").alias("own")), "simhash_distinct")
    labels = components(links(fps.select("fp"), tau, m, bucket), "a", "b")  # (node, root)
    joined = fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "own", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("own").alias("component"))
    merged = joined.join(least, "root").select("fp", "component")
    return marked.join(merged, "fp").select("id", "fp", "component")


def _firsts(docs: DataFrame, id_col: str, rooted: DataFrame) -> DataFrame:
    """The row of ``docs`` that is the least ``first`` of each ``root``."""
    whole = row_key(docs)
    key = ["own_row", "own_id", "unnamed"]
    kept = rooted.groupBy("root").agg(F.min("first").alias("f")).select(F.col("f.row").alias("own_row"), F.col("f.id").alias("own_id"), F.col("f.unnamed").alias("unnamed"))
    named = F.col(id_col).cast("long")
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("d"), whole.alias("own_row"), F.coalesce(named, F.lit(0)).alias("own_id"), named.isNull().alias("unnamed"))
    # Rows that are equal in every column have equal keys: one of them stays. The join's
    # partitioning serves the second step as well, so texts are shuffled once.
    return packed.join(kept, key, "left_semi").dropDuplicates(key).select("d.*")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group is kept: the row with
    the smallest (id, hash of the row), null ids last. Columns are unchanged. The choice goes by
    partial minima, so a group of copies is never gathered into one task."""
    whole = row_key(docs)
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), whole.alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.fromiter((fingerprint(t.as_py(), how.get("words", 3), how.get("seed", 42)) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out.view(np.int64))], ["id", "row", "fp"])

    marked = materialize(keyed.mapInArrow(thrifty(run), f"id long, {ROW}, fp long"), "simhash_rows")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), F.coalesce("id", F.lit(0)).alias("id"), F.col("row")))
    fps = materialize(marked.groupBy("fp").agg(first.alias("first")), "simhash_firsts")
    labels = components(links(fps.select("fp"), how.get("tau", 2), how.get("m", 9), how.get("bucket", BUCKET)), "a", "b")
    rooted = fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(F.coalesce("root", "fp").alias("root"), "first")
    return _firsts(docs, id_col, rooted)


def _sets(docs: DataFrame, id_col: str, text_col: str, asked: DataFrame, words: int, seed: int) -> DataFrame:
    """(body, grams): the shingle sets of ``asked``, which has body and first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [shingle_set(t.as_py(), words, seed).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["body", "grams"])

    asked = asked.select("body", F.col("first.id").alias("own_id"), F.col("first.unnamed").alias("unnamed"), F.col("first.row").alias("own_row"))
    named = F.col(id_col).cast("long")
    texts = docs.select(F.coalesce(named, F.lit(0)).alias("own_id"), named.isNull().alias("unnamed"), row_key(docs).alias("own_row"), F.col(text_col).alias("t"))
    found = texts.join(asked, ["own_id", "unnamed", "own_row"]).dropDuplicates(["body"]).select("body", "t")
    return materialize(found.mapInArrow(thrifty(run), "body long, grams array<long>"), "simhash_sets")


def _met(table: pa.Table, permille: int) -> pa.Table:
    """(a, b): alike pairs of one meeting that are in different components so far; what a pair
    joins counts for the pairs after it. Rows have body, size, root, grams and whether they
    are of the second block; without such rows the first block meets itself."""
    table = table.combine_chunks().sort_by("size")
    body, size, root, second = (table[c].to_numpy().copy() for c in ("body", "size", "root", "second"))
    ends = np.cumsum(size)
    starts = ends - size
    grams = np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy() for c in table["grams"].chunks)])
    code = np.unique(grams, return_inverse=True)[1]
    there, out = np.zeros(int(code.max(initial=-1)) + 1, bool), []
    alone = not second.any()
    for x in range(len(body)):  # with the larger sets: those after it
        upto = int(np.searchsorted(size * permille, size[x] * 1000, side="right"))
        some = np.flatnonzero((root[x + 1 : upto] != root[x]) & (alone | (second[x + 1 : upto] != second[x]))) + x + 1
        if not len(some):
            continue
        there[code[starts[x] : ends[x]]] = True
        lo, hi = some[0], some[-1] + 1
        common = np.add.reduceat(there[code[starts[lo] : ends[hi - 1]]], starts[lo:hi] - starts[lo], dtype=np.int64)[some - lo]
        there[code[starts[x] : ends[x]]] = False
        for y in some[common * 1000 >= (size[x] + size[some] - common) * permille]:
            if root[y] != root[x]:
                out.append((body[x], body[y]))
                root[root == root[y]] = root[x]
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _across(hot: DataFrame, labels: DataFrame, sets: DataFrame, permille: int) -> DataFrame:
    """(a, b): links that join what ``labels``, (node, root) of the links so far, leaves apart
    in the buckets of ``hot``: (band, key, body, size). All of a bucket's pairs are compared
    but those in one component and those whose sizes rule them out."""
    bucket, block = ["band", "key"], ["band", "key", "grade", "slot"]
    rooted = hot.join(labels.withColumnRenamed("node", "body"), "body", "left").select(*bucket, "body", "size", F.coalesce("root", "body").alias("root"))
    apart = rooted.groupBy(*bucket).agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select(*bucket)
    # Sizes of one grade are about alike, so few grades of a bucket meet; the meetings
    # themselves go by the blocks' real sizes.
    graded = rooted.join(apart, bucket).withColumn("grade", F.floor(F.log("size") / math.log(1000 / min(permille, 999))))
    wide = graded.groupBy(*bucket, "grade").agg(F.ceil(F.greatest(F.count(F.lit(1)) / MET, F.sum("size") / GRAMS)).alias("slots"))
    dealt = graded.join(wide, [*bucket, "grade"]).select(*bucket, "grade", F.pmod(F.xxhash64("body"), "slots").alias("slot"), "body", "size", "root")
    dealt = materialize(dealt, "simhash_blocks")
    blocks = dealt.groupBy(*block).agg(*[f(c).alias(f"{n}_{c}") for c in ("size", "root") for f, n in ((F.min, "least"), (F.max, "most"))])
    one, two = (blocks.select(*bucket, F.struct(*blocks.columns[2:]).alias(n)) for n in "xy")
    at = lambda n: F.struct(f"{n}.grade", f"{n}.slot")
    fits = [F.col(f"{p}.most_size") * 1000 >= F.col(f"{q}.least_size") * permille for p, q in ("xy", "yx")]
    apart = F.least("x.least_root", "y.least_root") < F.greatest("x.most_root", "y.most_root")
    meetings = one.join(two, bucket).filter((at("x") <= at("y")) & fits[0] & fits[1] & apart)
    meetings = meetings.select(*bucket, F.struct(at("x").alias("x"), at("y").alias("y")).alias("meeting"), F.explode(F.array_distinct(F.array(at("x"), at("y")))).alias("own"))
    meetings = meetings.select(*bucket, "own.grade", "own.slot", F.to_json("meeting").alias("meeting"), (F.col("own") != F.col("meeting.x")).alias("second"))
    full = dealt.join(meetings, block).join(sets, "body").select(*bucket, "meeting", "second", "body", "size", "root", "grams")
    # A number of partitions is given, so that few bytes are not taken for little work.
    full = full.repartition(int(full.sparkSession.conf.get("spark.sql.shuffle.partitions")), *bucket, "meeting")
    return full.groupBy(*bucket, "meeting").applyInArrow(lambda t: _met(t, permille), "a long, b long")


def _alike(docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, permille: int, words: int, seed: int) -> DataFrame:
    """(node, root): the components of bodies (digests of sets) whose shingle sets are alike in
    ``permille`` thousandths or more. ``nodes`` has body, size, keys and first, the
    (unnamed, id, row) of one row with it."""
    posted = nodes.select("body", "size", F.posexplode("keys").alias("band", "key"))
    sizes = posted.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialize(posted.join(sizes, ["band", "key"]), "simhash_bands")
    cold = shared.filter(F.col("n") <= PAIRED).groupBy("band", "key").agg(F.sort_array(F.collect_list(F.struct("body", "size"))).alias("all"))
    pairs = cold.select(F.posexplode("all").alias("at", "x"), "all")
    pairs = pairs.select("x", F.explode(F.slice("all", F.col("at") + 2, F.size("all"))).alias("y"))
    hot = shared.filter(F.col("n") > PAIRED)
    least = [F.min(F.struct(F.xxhash64("body", F.lit(k)), "body", "size")) for k in range(HUBS)]
    hubs = hot.groupBy("band", "key").agg(F.array(*least).alias("hubs")).select("band", "key", F.explode("hubs").alias("hub"))
    starred = hot.join(hubs, ["band", "key"]).select(F.struct("body", "size").alias("x"), F.struct("hub.body", "hub.size").alias("y"))
    both = pairs.union(starred.filter("x.body <> y.body").select(F.least("x", "y"), F.greatest("x", "y")))
    fits = F.least("x.size", "y.size") * 1000 >= F.greatest("x.size", "y.size") * permille
    near = materialize(both.filter(fits).select(F.col("x.body").alias("a"), F.col("y.body").alias("b")).distinct(), "simhash_candidates")

    asked = near.select(F.col("a").alias("body")).union(near.select(F.col("b").alias("body"))).union(hot.select("body")).distinct()
    sets = _sets(docs, id_col, text_col, asked.join(nodes.select("body", "first"), "body"), words, seed)
    met = near.join(sets.select(F.col("body").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("body").alias("b"), F.col("grams").alias("gb")), "b")
    met = met.select("a", "b", F.size(F.array_intersect("ga", "gb")).alias("common"), (F.size("ga") + F.size("gb")).alias("all"))
    found = materialize(met.filter(F.col("common") * 1000 >= (F.col("all") - F.col("common")) * permille).select("a", "b"), "simhash_alike")
    labels = components(found, "a", "b")
    if hot.isEmpty():
        return labels
    more = materialize(_across(hot.select("band", "key", "body", "size"), labels, sets, permille), "simhash_across")
    return labels if more.isEmpty() else components(found.union(more), "a", "b")


def unlike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, permille: int = 800, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` that stay when one of each group of texts is kept whose sets of
    shingles are alike in ``permille`` thousandths or more; the choice is that of
    ``representatives``."""
    whole = row_key(docs)
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), whole.alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, size, keys = np.zeros(batch.num_rows, np.uint64), [], []
            for k, t in enumerate(batch.column(1)):
                own = shingle_set(t.as_py(), words, seed)
                body[k] = xxhash.xxh64_intdigest(own.tobytes())
                size.append(len(own)), keys.append(bands(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(body.view(np.int64)), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "row", "body", "size", "keys"])

    marked = keyed.mapInArrow(thrifty(run), f"id long, {ROW}, body long, size long, keys array<long>")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), F.coalesce("id", F.lit(0)).alias("id"), F.col("row")))
    nodes = materialize(marked.groupBy("body").agg(first.alias("first"), F.any_value("size").alias("size"), F.any_value("keys").alias("keys")), "simhash_bodies")
    labels = _alike(docs, id_col, text_col, nodes, permille, words, seed)
    rooted = nodes.join(labels.withColumnRenamed("node", "body"), "body", "left").select(F.coalesce("root", "body").alias("root"), "first")
    return _firsts(docs, id_col, rooted)
