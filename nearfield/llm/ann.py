"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation is three rounds of random signs and a fast Hadamard transform on the dimension
padded to a power of two. A unit vector's hash is the signed axis nearest to its rotated image: the
coordinate of largest magnitude, with its sign. Each of ``tables`` tables chains ``parts`` rotations of
its own, at any number of rows; with 64 dimensions two parts make 16,384 buckets.

A query probes, in each table, the best buckets by the squared length that its image misses on the
chosen axes: ``SHARE`` of them, and no fewer than hold about ``LEAST_ROWS`` rows, as few rows lie farther
apart. On vectors without much cluster structure that compares a query with about an eighth of the
rows of a large table and finds 0.93 of its nearest ten. Vectors travel with their buckets, in single precision where the input has that. Buckets are cut into slices of about ``SLICE_ROWS`` rows, whatever their
size, and a query goes to every slice of the buckets it probes; each slice ranks its candidates by
exact distance and gives the nearest few for each query, so a hot bucket is spread over tasks and
nothing is capped: the union of slices holds the exact nearest among all candidates.

Directions decide buckets; distances are exact Euclidean ones of the original vectors in double
precision. Where a query finds fewer than k candidates in its buckets it is compared with all rows,
slice by slice, so short results occur only where rows are few.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part; vectors of another dimension are no candidates; a null id counts as the largest and is
returned as null; ties go to the smaller id; a row is no candidate of a query with the same id; equal
rows count once, rows that share an id but differ are candidates of their own; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield import scratch
from nearfield.functions import arrow as A
from nearfield.llm import textbatch as tb
from nearfield.llm import vectors as vec

TABLES = 12
PARTS = 2
#: Share of a table's buckets that a query probes, and rows that the probed buckets of a table hold at least, about.
SHARE, LEAST_ROWS = 0.0088, 256
SLICE_ROWS = 4096
#: Pairs of a cell above which it is ranked by a matrix product, and pairs that are ranked at once.
LARGE_CELL, PAIR_ROWS = 20_000, 40_000
QUERY_ROWS = 64
ROUNDS = 3
PLACED = "bucket long, id long, v binary"


def rotation(x: np.ndarray, table: int, part: int) -> np.ndarray:
    """Pseudo-rotated rows, padded to a power of two; signs come from table, part and round alone."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    for turn in range(ROUNDS):
        y = y * (np.random.default_rng([table, part, turn, 0xA7]).integers(0, 2, width) * 2 - 1)
        h = 1
        while h < width:
            y = y.reshape(len(x), -1, 2, h)
            y = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), width)
            h *= 2
        y /= math.sqrt(width)
    return y


def axes(y: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` best signed axes of each row, best first, and what each misses of the best."""
    both = np.concatenate((y, -y), axis=1)
    order = np.argsort(-both, axis=1, kind="stable")[:, :count]
    value = np.take_along_axis(both, order, axis=1)
    return order, (value[:, :1] - value) ** 2


def _bucket(table: int, dim: int, chosen: np.ndarray) -> np.ndarray:
    """Bucket keys from the chosen axes of the table's parts (rows, parts)."""
    key = np.full(len(chosen), table * 100_003 + dim, np.uint64)
    for part in range(chosen.shape[1]):
        key = tb.mix(key + chosen[:, part].astype(np.uint64) + np.uint64(1))
    return key.view(np.int64)


def place(tables: int, parts: int, dtype: type):
    """mapInArrow function: the bucket of each vector in each table, with the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = A.long_values(batch.column("id"))
            for rows, matrix in A.matrices(batch.column("v")):
                directions, raw = vec.unit(matrix), A.binaries(matrix.astype(dtype))
                for table in range(tables):
                    images = [rotation(directions, table, part) for part in range(parts)]
                    best = np.stack([np.concatenate((y, -y), axis=1).argmax(axis=1) for y in images], axis=1)
                    yield pa.record_batch([pa.array(_bucket(table, matrix.shape[1], best)), pa.array(ids[rows]), raw], names=["bucket", "id", "v"])

    return run


def probe(tables: int, parts: int, probes: int):
    """mapInArrow function: the ``probes`` best buckets of each vector in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = A.long_values(batch.column("id"))
            for rows, matrix in A.matrices(batch.column("v")):
                for lo in range(0, len(rows), QUERY_ROWS):
                    directions, own = vec.unit(matrix[lo : lo + QUERY_ROWS]), ids[rows[lo : lo + QUERY_ROWS]]
                    for table in range(tables):
                        keys = _probed(table, matrix.shape[1], [rotation(directions, table, part) for part in range(parts)], probes)
                        yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(own, keys.shape[1]))], names=["bucket", "id"])

    return run


def _probed(table: int, dim: int, images: list[np.ndarray], probes: int) -> np.ndarray:
    """The ``probes`` buckets with the least sum of missed parts."""
    width = 2 * images[0].shape[1]
    order, missed = axes(images[0], min(probes, width))
    chosen = order[:, :, None]
    for y in images[1:]:
        more, cost = axes(y, min(probes, width))
        total = missed[:, :, None] + cost[:, None, :]
        n, a, b = total.shape
        few = min(probes, a * b)
        pick = np.argpartition(total.reshape(n, -1), few - 1, axis=1)[:, :few]
        i, j = pick // b, pick % b
        missed = np.take_along_axis(total.reshape(n, -1), pick, axis=1)
        chosen = np.concatenate((np.take_along_axis(chosen, i[:, :, None], axis=1), np.take_along_axis(more, j, axis=1)[:, :, None]), axis=2)
    return np.stack([_bucket(table, dim, chosen[:, k]) for k in range(chosen.shape[1])], axis=1)


def rank_cells(k: int, dtype: type):
    """Work on whole cells, points before queries in each: the k nearest candidates of each query, by exact distance, ties to the smaller id."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        size = pc.binary_length(A.chunk(table, "v")).to_numpy(zero_copy_only=False)
        for width in np.unique(size):
            part = table if size.min() == size.max() else table.take(pa.array(np.flatnonzero(size == width)))
            found = _best(*_cell_candidates(part, k, dtype), k)
            yield pa.record_batch([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    return work


def _cell_candidates(table: pa.Table, k: int, dtype: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids and distances: all pairs of small cells, the k nearest of each query in larger ones."""
    cell, ids = (A.long_values(A.chunk(table, c)) for c in ("cell", "id"))
    query = np.asarray(A.chunk(table, "query").to_numpy(zero_copy_only=False), bool)
    matrix = A.from_binaries(A.chunk(table, "v"), dtype)
    begin = np.flatnonzero(np.concatenate(([True], np.diff(cell) != 0)))
    held = np.add.reduceat((~query).astype(np.int64), begin)
    total = np.diff(np.append(begin, len(cell)))
    large = held * (total - held) > LARGE_CELL
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for c in np.flatnonzero(large):
        p, q = slice(begin[c], begin[c] + held[c]), slice(begin[c] + held[c], begin[c] + total[c])
        out.append(A.nearest_rows(matrix[q].astype(np.float64), ids[q], matrix[p].astype(np.float64), ids[p], k))
    asked = np.flatnonzero(query)
    own = np.searchsorted(begin, asked, side="right") - 1
    asked, own = asked[~large[own]], own[~large[own]]
    upto = np.concatenate(([0], np.cumsum(held[own])))
    lo = 0
    while lo < len(asked):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PAIR_ROWS, side="right")) - 1)
        count = held[own[lo:hi]]
        left = np.repeat(asked[lo:hi], count)
        right = np.arange(int(count.sum())) + np.repeat(begin[own[lo:hi]] - (upto[lo:hi] - upto[lo]), count)
        left, right = left[ids[left] != ids[right]], right[ids[left] != ids[right]]
        far = np.sqrt(((matrix[right].astype(np.float64) - matrix[left]) ** 2).sum(axis=1))
        out.append(_best(ids[left], ids[right], far, k))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _best(query: np.ndarray, ids: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest different candidates of each query, ties to the smaller id."""
    order = np.lexsort((ids, far, query))
    query, ids, far = query[order], ids[order], far[order]
    fresh = np.ones(len(query), bool)
    fresh[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1]) | (far[1:] != far[:-1])
    query, ids, far = query[fresh], ids[fresh], far[fresh]
    first = np.flatnonzero(np.concatenate(([True], np.diff(query) != 0))) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return query[rank < k], ids[rank < k], far[rank < k]


def _ranked(probes: DataFrame, vectors: DataFrame, points: DataFrame, k: int, dtype: type) -> DataFrame:
    """Nearest candidates per slice, for ``probes`` (bucket, id) of queries with ``vectors`` (id, v); the buckets of ``points`` (bucket, id, v) are cut into slices."""
    sizes = scratch.materialize(points.groupBy("bucket").agg(F.ceil(F.count("*") / SLICE_ROWS).cast("int").alias("slices")), "buckets")
    met = scratch.materialize(probes.join(scratch.small_side(sizes), "bucket"), "met")
    asked = met.join(scratch.small_side(vectors), "id").select("bucket", "id", "v", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(True).alias("query"))
    wanted = scratch.materialize(met.select("bucket", "slices").distinct(), "wanted")
    held = points.join(scratch.small_side(wanted), "bucket")
    held = held.select("bucket", "id", "v", F.pmod(F.xxhash64("id", "v"), F.col("slices")).cast("int").alias("slice"), F.lit(False).alias("query"))
    cells = asked.unionByName(held).withColumn("cell", F.xxhash64("bucket", "slice")).select("cell", "id", "v", "query")
    dealt = cells.repartition("cell").sortWithinPartitions("cell", "query")
    return dealt.mapInArrow(A.frugal(A.by_whole_keys("cell", rank_cells(k, dtype))), "query_id long, vec_id long, score double")


def nearest(df: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES, probes: int | None = None, parts: int = PARTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (distance), for rows (vec_id, embedding) of ``queries`` against ``df``.

    ``probes`` is the number of buckets a table, in place of the rule above.
    """
    single = all(isinstance(x.schema["embedding"].dataType.elementType, T.FloatType) for x in (df, queries))
    dtype = np.float32 if single else np.float64
    points = scratch.materialize(vec.usable_rows(df, "vec_id", "embedding").distinct(), "points")
    asked = scratch.materialize(vec.usable_rows(queries, "vec_id", "embedding").distinct(), "queries")
    shape = points.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("dim")).first()
    buckets = (2 << (shape["dim"] - 1).bit_length()) ** parts
    probes = probes or min(buckets, math.ceil(buckets * max(SHARE, LEAST_ROWS / max(1, shape["n"]))))
    index = scratch.materialize(points.mapInArrow(A.frugal(place(tables, parts, dtype)), PLACED), "index")
    spread = asked.repartition(asked.sparkSession.sparkContext.defaultParallelism, "id", F.xxhash64("v"))
    probed = scratch.materialize(spread.mapInArrow(A.frugal(probe(tables, parts, probes)), "bucket long, id long"), "probes")
    pack = lambda rows: rows.withColumn("bucket", F.size("v").cast("long")).select("bucket", "id", "v").mapInArrow(_packed(dtype), PLACED)
    vectors = scratch.materialize(pack(asked).select("id", "v"), "query_vectors")
    best = F.slice(F.sort_array(F.collect_set(F.struct("score", "vec_id"))), 1, k)
    found = scratch.materialize(_ranked(probed, vectors, index, k, dtype).groupBy("query_id").agg(best.alias("best")), "nearest")
    short = scratch.materialize(asked.join(found.filter(F.size("best") >= k).select(F.col("query_id").alias("id")), "id", "left_anti"), "short")
    if not short.isEmpty():
        whole = short.select(F.size("v").cast("long").alias("bucket"), "id")
        more = _ranked(whole, vectors, pack(points), k, dtype).groupBy("query_id").agg(best.alias("best"))
        found = found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(more)
    rows = found.select("query_id", F.posexplode("best").alias("pos", "b"))
    name = lambda c: F.nullif(F.col(c), F.lit(vec.LAST_ID))
    return rows.select(name("query_id").alias("query_id"), (F.col("pos") + 1).cast("int").alias("rank"), name("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def _packed(dtype: type):
    """mapInArrow function: vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for rows, matrix in A.matrices(batch.column("v")):
                    at = pa.array(rows)
                    yield pa.record_batch([batch.column("bucket").take(at), batch.column("id").take(at), A.binaries(matrix.astype(dtype))], names=["bucket", "id", "v"])

    return run
