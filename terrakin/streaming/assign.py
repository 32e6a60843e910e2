"""New points of a stream, assigned to the landmarks of a fitted level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from terrakin.operators.knn import matrix, nearest

MOST = 65_536  # landmarks that are broadcast


def assigned(stream: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(id, slot, dist): the nearest landmark (slot, features) of each row (id, features), of
    a stream or a table; ties to the smaller slot. Landmarks are counted before they are
    broadcast; use a coarser level where they are more than ``MOST``."""
    if landmarks.count() > MOST:
        raise ValueError(f"more than {MOST} landmarks: assign to a coarser level")
    rows = landmarks.select(F.col("slot").alias("id"), F.transform("features", lambda x: x.cast("double")).alias("features")).toArrow()
    slots, marks = matrix(rows)
    shared = stream.sparkSession.sparkContext.broadcast((slots, marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, marks = shared.value
        for batch in batches:
            ids, x = matrix(pa.Table.from_batches([batch]))
            r, s, d = nearest(np.full(len(ids), -1), x, slots, marks, 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(slots[s]), pa.array(d)], ["id", "slot", "dist"])

    return stream.select(F.col("id").cast("long").alias("id"), F.transform("features", lambda x: x.cast("double")).alias("features")).mapInArrow(run, "id long, slot long, dist double")
