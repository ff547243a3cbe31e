"""Exact k-nearest-neighbour search between vector sets (id, v).

Results are rows (query_id, rank, neighbor_id, distance), rank from 1, ties to the smaller id. Two
physical forms give the same rows:

* ``broadcast``: the points are one matrix that every task holds. Used only if its measured size is at
  most ``BROADCAST_BYTES``. The search is then a map over the queries, without a shuffle.
* ``blocks``: both sides are dealt to blocks of bounded size by hash, once. The blocks of points are
  written out, one row each; a task has one block of queries, reads those of the points one after the
  other and keeps the k nearest so far. Nothing is broadcast, and no row is shuffled more than once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield import scratch
from nearfield.functions import arrow as A
from nearfield.operators import validate
from nearfield.sources.vectors import shape

BROADCAST_BYTES = 32 << 20
#: Bytes of points, and of queries, that one unit may hold; ``memory_ratio`` says which part of them blocks use.
POINT_BYTES, QUERY_BYTES = 8 << 20, 4 << 20
#: Pairs in one batch of a distance matrix.
PAIR_ROWS = 20_000
RESULT = "query_id long, rank int, neighbor_id long, distance double"
#: What a stream gives.
FOUND = "query_id long, neighbor_id long, distance double"


def _pack(most: int | None):
    """mapInArrow function from rows (grp, block, id, v) to one row (grp, ids, v) a block, by ascending id.

    Of equal vectors in a block, the ``most`` with the smallest ids are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(A.long_values(b.column("block")), A.long_values(b.column("grp")), A.long_values(b.column("id")), A.matrix(b.column("v"))) for b in batches if b.num_rows]
        block, grp, ids, m = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 4
        for number in np.unique(block):
            here = np.flatnonzero(block == number)
            here = here[np.argsort(ids[here], kind="stable")]
            if most is not None:
                here = here[A.first_copies(m[here], most)]
            yield pa.record_batch([pa.array(grp[here[:1]]), A.binaries(ids[here][None]), A.binaries(m[here].reshape(1, -1))], names=["grp", "ids", "v"])

    return run


def packed(rows: DataFrame, blocks: int, most: int | None = None) -> DataFrame:
    """One row (grp, ids, v) for each of the ``blocks`` that rows (grp, block, id, v) are dealt to; a task packs one block."""
    return rows.select("grp", "block", "id", "v").repartitionById(blocks, "block").mapInArrow(_pack(most), "grp long, ids binary, v binary")


def unpacked(batch: pa.RecordBatch, ids: str, v: str, row: int) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(batch.column(ids)[row].as_buffer(), np.int64)
    return names, np.frombuffer(batch.column(v)[row].as_buffer(), np.float64).reshape(len(names), -1)


def meet(asked: DataFrame, held: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over rows (ids, v, point_ids, point_v): each packed block of ``asked`` with all of ``held`` of its group.

    ``held`` is written out and every task reads it from there, so that pairs of blocks are not shuffled.
    """
    held = scratch.materialize(held, "blocks").select(F.col("grp").alias("of"), F.col("ids").alias("point_ids"), F.col("v").alias("point_v"))
    pairs = held.coalesce(1).hint("shuffle_replicate_nl").join(asked, F.col("of") == F.col("grp"))
    return pairs.select("ids", "v", "point_ids", "point_v").mapInArrow(run, schema)


def nearest_of_blocks(asked: DataFrame, held: DataFrame, k: int, keep_self: bool) -> DataFrame:
    """(query_id, rank, neighbor_id, distance) from packed blocks of queries and of points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, A.Nearest] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                names, m = unpacked(batch, "ids", "v", row)
                key = names[:1].tobytes()
                if key not in best:
                    best[key] = A.Nearest(names.copy(), m.copy(), k, keep_self)
                best[key].add(*unpacked(batch, "point_ids", "point_v", row))
        for found in best.values():
            yield pa.record_batch([pa.array(x) for x in found.rows()], names=["query_id", "rank", "neighbor_id", "distance"])

    return meet(asked, held, run, RESULT)


def block_counts(m: int, n: int, dim: int, memory_ratio: float) -> tuple[int, int]:
    """How many blocks m queries and n points are dealt to."""
    return tuple(math.ceil(count / max(1, int(memory_ratio * most) // (8 * dim))) for count, most in ((m, QUERY_BYTES), (n, POINT_BYTES)))


def _dealt(rows: DataFrame, blocks: int) -> DataFrame:
    return rows.select(F.lit(0).cast("long").alias("grp"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "v")


def search_blocks(queries: DataFrame, points: DataFrame, counts: tuple[int, int], k: int, keep_self: bool) -> DataFrame:
    """The ``blocks`` form; there are as many blocks of queries as tasks can run, at least."""
    rows, columns = max(counts[0], queries.sparkSession.sparkContext.defaultParallelism), counts[1]
    return nearest_of_blocks(packed(_dealt(queries, rows), rows), packed(_dealt(points, columns), columns, k + 1), k, keep_self)


def _broadcast(queries: DataFrame, points: DataFrame, k: int, keep_self: bool) -> DataFrame:
    table = points.select("id", "v").toArrow()
    ids, matrix = A.long_values(A.chunk(table, "id")), A.matrix(A.chunk(table, "v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                name, near, far = A.nearest_rows(A.matrix(batch.column("v")), A.long_values(batch.column("id")), matrix, ids, k, keep_self)
                begin = np.flatnonzero(np.concatenate(([True], np.diff(name) != 0))) if len(name) else np.zeros(0, np.int64)
                rank = np.arange(len(name)) - np.repeat(begin, np.diff(np.append(begin, len(name)))) + 1
                yield pa.record_batch([pa.array(name), pa.array(rank.astype(np.int32)), pa.array(near), pa.array(far)], names=["query_id", "rank", "neighbor_id", "distance"])

    spread = queries.sparkSession.sparkContext.defaultParallelism
    return queries.select("id", "v").repartition(spread, "id").mapInArrow(run, RESULT)


def knn_search(queries: DataFrame, points: DataFrame, k: int, keep_self: bool = True, mode: str = "auto", precision: str = "double", memory_ratio: float = 0.5) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k nearest ``points`` of each row of ``queries``.

    A point equal to a query is a neighbour at distance 0; with ``keep_self=False`` a point with the
    query's own id is left out before the nearest are chosen. Ids are distinct within each set.
    ``memory_ratio`` in (0, 1] bounds the memory of a unit of the ``blocks`` form.
    """
    validate.check_options(mode, precision, memory_ratio)
    m, n, dim = shape(queries, points)
    validate.check_knn(m, n, dim, k if keep_self or queries is not points else k + 1, mode)
    if precision == "single":
        queries, points = (x.withColumn("v", F.col("v").cast("array<float>").cast("array<double>")) for x in (queries, points))
    if mode == "broadcast" or mode == "auto" and n * dim * 8 <= BROADCAST_BYTES:
        if n * dim * 8 > BROADCAST_BYTES:
            raise ValueError(f"{n} points of dimension {dim} are too large to broadcast; use mode='blocks'")
        return _broadcast(queries, points, k, keep_self)
    return search_blocks(queries, points, block_counts(m, n, dim, memory_ratio), k, keep_self)


def all_to_all(points: DataFrame, k: int, mode: str = "auto") -> DataFrame:
    """The k nearest other points of each point; k + 1 points are needed."""
    return knn_search(points, points, k, keep_self=False, mode=mode)


def pair_distances(queries: DataFrame, points: DataFrame, value: str = "direct", memory_ratio: float = 0.5, digits: int | None = None) -> DataFrame:
    """(a, b, value) for each query a and point b, from blocks: the whole distance matrix, M x N rows.

    ``value``: dot, expanded or direct (squared distances), or distance (Euclidean), rounded to ``digits`` if given.
    """
    rows, columns = block_counts(*shape(queries, points), memory_ratio)
    rows = max(rows, queries.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own, asked = unpacked(batch, "ids", "v", row)
                names, points = unpacked(batch, "point_ids", "point_v", row)
                norms = (points * points).sum(axis=1)
                step = max(1, PAIR_ROWS // len(points))
                for lo in range(0, len(asked), step):
                    q = asked[lo : lo + step]
                    if value == "dot":
                        got = q @ points.T
                    elif value == "expanded":
                        got = np.maximum(0, norms + (q * q).sum(axis=1)[:, None] - 2 * (q @ points.T))
                    else:
                        got = A.squared_differences(q, points)
                    got = (np.sqrt(got) if value == "distance" else got).ravel()
                    got = got if digits is None else A.rounded(got, digits)
                    yield pa.record_batch([pa.array(np.repeat(own[lo : lo + step], len(names))), pa.array(np.tile(names, len(q))), pa.array(got)], names=["a", "b", "value"])

    return meet(packed(_dealt(queries, rows), rows), packed(_dealt(points, columns), columns), run, "a long, b long, value double")


def wide(result: DataFrame) -> DataFrame:
    """(query_id, neighbor_ids, distances): one row per query, arrays in order of rank."""
    rows = F.sort_array(F.collect_list(F.struct("rank", "neighbor_id", "distance")))
    both = result.groupBy("query_id").agg(rows.alias("r"))
    return both.select("query_id", F.col("r.neighbor_id").alias("neighbor_ids"), F.col("r.distance").alias("distances"))
