"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

A term is a component position, a posting (row, weight) a non-zero integer weight there.
Queries and candidates are dealt into blocks by a hash of the row, and every query block
meets every candidate block in one task: each sparse query row scatters its terms' weighted
postings into a dense score array of the block, the block's best k are taken by partition
selection, and the k best of all blocks are merged. Block sizes are fixed, so a task's
memory is too, whatever the tables' sizes.

Defined results: rows with a null id, a null vector or a null or non-finite component take
no part; rows that share an id are candidates each (but not of a query of that id), and
queries each, whose answers compete for the same k ranks; of rows equal in id and vector no
more than k can be among k answers, so no more are compared; a vector shorter than others has
no posting in the missing positions, and a very long one is whole in its row; ties go to the
smaller id; a query with fewer than
k candidates returns them all; extra columns are ignored; empty tables give an empty
result. Inner products that could pass 2**63 raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from terrakin.llm.common import materialize

QUERY_BLOCK, CANDIDATE_BLOCK = 2_048, 8_192
RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and their vectors padded with zeros."""
    ids = table.column("id").to_numpy()
    vectors = table.column("v").combine_chunks()
    if isinstance(vectors, pa.ChunkedArray):
        vectors = pa.concat_arrays(vectors.chunks)
    flat, sizes = vectors.flatten().to_numpy(), np.asarray(vectors.value_lengths())
    full = np.zeros((len(ids), int(sizes.max(initial=0))), np.int64)
    full[np.repeat(np.arange(len(ids)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    order = np.argsort(ids, kind="stable")
    return ids[order], full[order]


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[list[int], list[int], list[int]]:
    """(query, id, score) of each query's k best rows; ``ids`` ascend."""
    dims = min(queries.shape[1], vectors.shape[1])
    top = [int(np.abs(m[:, :dims]).max(initial=0)) for m in (queries, vectors)]
    bound = top[0] * top[1] * max(dims, 1)
    if bound >= 1 << 63:
        raise ValueError("inner products could pass 2**63")
    kind = np.int32 if bound < 1 << 31 else np.int64
    postings = []
    for t in range(dims):
        rows = np.flatnonzero(vectors[:, t])
        full = len(rows) * 2 > len(ids)  # a long posting list is scanned as a column
        postings.append((None if full else rows, vectors[:, t].astype(kind) if full else vectors[rows, t].astype(kind)))
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    for name, query in zip(query_ids.tolist(), queries.astype(kind)):
        score = np.zeros(len(ids), kind)
        for t in np.flatnonzero(query[:dims]):
            rows, weights = postings[t]
            if rows is None:
                score += query[t] * weights
            else:
                score[rows] += query[t] * weights
        a, b = np.searchsorted(ids, name, side="left"), np.searchsorted(ids, name, side="right")
        n = len(ids) - int(b - a)
        if n <= 0:
            continue
        score[a:b] = np.iinfo(kind).min  # its own id
        floor = np.partition(score, len(ids) - min(k, n))[len(ids) - min(k, n)]
        near = np.flatnonzero(score >= floor)
        near = near[(near < a) | (near >= b)]
        near = near[np.argsort(-score[near].astype(np.int64), kind="stable")][:k]
        out[0].extend([name] * len(near))
        out[1].extend(ids[near].tolist())
        out[2].extend(score[near].tolist())
    return out


def search(rows: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row where ``is_query`` (a condition on
    ``id``) its k best other rows by the inner product of floor(scale * component)."""
    v = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ints = rows.filter(sound).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))
    copies = F.least(F.count(F.lit(1)), F.lit(k)).cast("int")
    ints = ints.groupBy("id", "v").agg(F.sequence(F.lit(1), copies).alias("copy")).select("id", "v", F.explode("copy").alias("copy"))
    ints = materialize(ints, "topk_vectors")
    asked = ints.filter(is_query)
    n_q, n_c = max(1, -(-asked.count() // QUERY_BLOCK)), max(1, -(-ints.count() // CANDIDATE_BLOCK))
    dealt = lambda df, n, name: df.withColumn(name, F.pmod(F.xxhash64("id", "v", "copy"), F.lit(n)).cast("int"))
    queries = dealt(asked, n_q, "qb").withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    candidates = dealt(ints, n_c, "cb").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return RESULT.empty_table()
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in best(*_matrix(left), *_matrix(right), k)], schema=RESULT)

    blocks = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return blocks.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
