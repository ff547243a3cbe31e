"""Neighbours of a stream of query vectors in a fixed point set.

Each query row is answered on its own, so the stream keeps no state, needs no watermark and may
recover by replaying its input. ``knn_stream`` is a map whose tasks hold all points, which must fit
``BROADCAST_BYTES``; ``knn_batches`` takes points of any number and searches each micro-batch by blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from nearfield.functions import arrow as A
from nearfield.operators.knn import BROADCAST_BYTES, FOUND, knn_search


def knn_stream(queries: DataFrame, points: DataFrame, k: int, keep_self: bool = True) -> DataFrame:
    """(query_id, neighbor_id, distance), nearest first within a query, for a streaming or batch frame (id, v)."""
    table = points.select("id", "v").toArrow()
    ids, matrix = A.long_values(A.chunk(table, "id")), A.matrix(A.chunk(table, "v"))
    if matrix.nbytes > BROADCAST_BYTES:
        raise ValueError(f"{len(ids)} points exceed {BROADCAST_BYTES} bytes; use knn_batches")
    if not 0 < k <= len(ids):
        raise ValueError(f"k = {k} must be from 1 to the {len(ids)} points")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = A.nearest_rows(A.matrix(batch.column("v")), A.long_values(batch.column("id")), matrix, ids, k, keep_self)
                yield pa.record_batch([pa.array(x) for x in found], names=["query_id", "neighbor_id", "distance"])

    return queries.select("id", "v").mapInArrow(run, FOUND)


def knn_batches(queries: DataFrame, points: DataFrame, k: int, write: Callable[[DataFrame, int], None], keep_self: bool = True) -> DataStreamWriter:
    """A writer that answers every micro-batch of a streaming frame (id, v) and hands ``write`` its rows (query_id, rank, neighbor_id, distance) and number.

    A batch that fails is replayed under the same number, so ``write`` should be idempotent by it.
    """

    def answer(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            write(knn_search(batch.select("id", "v"), points, k, keep_self), number)

    return queries.writeStream.foreachBatch(answer)
