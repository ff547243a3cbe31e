"""One-pass clustering of a vector set: seeds, one assignment, and merging of clusters that are too small.

Seeds are the ids with the smallest MD5 (or an explicit list); seed j is in cluster j always; every
other point joins its nearest seed, ties to the smaller cluster. There is no second assignment. Means
are taken before merging. The lowest-numbered cluster with fewer than ``least`` points is merged into
the valid cluster whose mean is nearest (ties to the smaller number), whose mean is then renewed; this
repeats until none is left, and the rest are numbered anew in order.

Only per-cluster summaries, whose number is the number of clusters, reach the driver, and only lists of
that length (or of the seeds that a caller names) are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield import scratch
from nearfield.functions import arrow as A
from nearfield.functions import distance
from nearfield.operators import knn
from nearfield.sources import vectors

#: Largest matrix of seeds that tasks may hold; more are searched by pairs of blocks.
SEED_BYTES = 64 << 20


def seeds(points: DataFrame, clusters: int, seed_ids: Sequence[int] | None = None) -> DataFrame:
    """(id, v, cluster_id) of the seeds."""
    if seed_ids is not None:
        named = points.sparkSession.createDataFrame([(int(x), j) for j, x in enumerate(seed_ids)], "id long, cluster_id int")
        return points.join(F.broadcast(named), "id").select("id", "v", "cluster_id")
    first = points.orderBy(F.md5(F.col("id").cast("string")), "id").limit(clusters)
    order = Window.orderBy(F.md5(F.col("id").cast("string")), "id")
    return first.select("id", "v", (F.row_number().over(order) - 1).alias("cluster_id"))


def non_seed_points(points: DataFrame, seed_rows: DataFrame) -> DataFrame:
    return points.join(seed_rows.select("id"), "id", "left_anti")


def assign(points: DataFrame, seed_rows: DataFrame) -> DataFrame:
    """(id, cluster_id, v) of every point."""
    seed_rows = scratch.materialize(seed_rows.select("id", "v", "cluster_id"), "seeds")
    count, dim = vectors.shape(seed_rows)
    if 8 * count * dim > SEED_BYTES:
        return _assign_by_blocks(points, seed_rows, dim)
    table = seed_rows.orderBy("cluster_id").select("id", "v").toArrow()
    own, centers = A.long_values(A.chunk(table, "id")), A.matrix(A.chunk(table, "v"))
    by_id = np.argsort(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = A.long_values(batch.column("id"))
                _, cluster, _ = A.nearest_rows(A.matrix(batch.column("v")), np.arange(len(ids)), centers, np.arange(len(centers)), 1, keep_self=True)
                at = by_id[np.minimum(np.searchsorted(own[by_id], ids), len(own) - 1)]
                cluster = np.where(own[at] == ids, at, cluster)
                yield pa.record_batch([batch.column("id"), pa.array(cluster.astype(np.int32)), batch.column("v")], names=["id", "cluster_id", "v"])

    return points.select("id", "v").mapInArrow(run, "id long, cluster_id int, v array<double>")


def _assign_by_blocks(points: DataFrame, seed_rows: DataFrame, dim: int) -> DataFrame:
    """``assign`` for seeds of any number: a blocked search for the nearest one, and equi-joins on the id."""
    centers = seed_rows.select(F.col("cluster_id").cast("long").alias("id"), "v")
    counts = knn.block_counts(points.count(), seed_rows.count(), dim, 0.5)
    near = knn.search_blocks(points, centers, counts, 1, keep_self=True).select(F.col("query_id").alias("id"), F.col("neighbor_id").alias("near"))
    own = seed_rows.select("id", F.col("cluster_id").alias("own"))
    return points.select("id", "v").join(near, "id").join(own, "id", "left").select("id", F.coalesce("own", "near").cast("int").alias("cluster_id"), "v")


def sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster_id").agg(F.count("*").alias("n"))


def undersized(assigned: DataFrame, least: int) -> DataFrame:
    return sizes(assigned).filter(F.col("n") < least)


def clusters_by_size(assigned: DataFrame) -> DataFrame:
    """(cluster_id, n, size_rank), largest first, ties to the smaller id. One row per cluster is ordered in one task."""
    return sizes(assigned).withColumn("size_rank", F.row_number().over(Window.orderBy(F.desc("n"), "cluster_id")))


def members(assigned: DataFrame) -> DataFrame:
    """(cluster_id, id, pos): each cluster's points by ascending id, from 1.

    Points are dealt by ranges of (cluster, id); positions count on from the ranges before, so that a
    large cluster is numbered in many tasks.
    """
    ranged = assigned.select("cluster_id", "id").repartitionByRange("cluster_id", "id").withColumn("part", F.spark_partition_id())
    ranged = scratch.materialize(ranged, "ranges")
    upto = Window.partitionBy("cluster_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("cluster_id", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")
    before = scratch.materialize(before, "range_starts")
    at = F.row_number().over(Window.partitionBy("cluster_id", "part").orderBy("id"))
    return ranged.withColumn("at", at).join(scratch.small_side(before), ["cluster_id", "part"]).select("cluster_id", "id", (F.col("before") + F.col("at")).cast("int").alias("pos"))


def summaries(assigned: DataFrame) -> DataFrame:
    """(cluster_id, n, sum_v): counts and vector sums, added up per task first."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            if batch.num_rows:
                cluster, m = A.long_values(batch.column("cluster_id")), A.matrix(batch.column("v"))
                for c in np.unique(cluster):
                    here = cluster == c
                    sums[c] = sums.get(c, 0) + m[here].sum(axis=0)
                    counts[c] = counts.get(c, 0) + int(here.sum())
        if sums:
            keys = list(sums)
            yield pa.record_batch([pa.array(np.array(keys, np.int32)), pa.array([counts[c] for c in keys], pa.int64()), pa.array([list(sums[c]) for c in keys], pa.list_(pa.float64()))], names=["cluster_id", "n", "s"])

    parts = assigned.select("cluster_id", "v").mapInArrow(part, "cluster_id int, n long, s array<double>")
    each = parts.select("cluster_id", "n", F.posexplode("s").alias("pos", "x")).groupBy("cluster_id", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    rows = F.sort_array(F.collect_list(F.struct("pos", "x")))
    return each.groupBy("cluster_id").agg(F.max("n").alias("n"), rows.alias("r")).select("cluster_id", "n", F.col("r.x").alias("sum_v"))


def centroids(assigned: DataFrame) -> DataFrame:
    """(cluster_id, n, centroid)."""
    return summaries(assigned).select("cluster_id", "n", distance.mean_of(F.col("sum_v"), F.col("n")).alias("centroid"))


def nearest_centroids(assigned: DataFrame) -> DataFrame:
    """(cluster_id, nearest_id, d2): each mean's nearest other mean, ties to the smaller id; computed on the summaries."""
    rows = centroids(assigned).orderBy("cluster_id").collect()
    ids, m = np.array([r["cluster_id"] for r in rows], np.int64), np.array([r["centroid"] for r in rows])
    name, near, far = A.nearest_rows(m, ids, m, ids, 1) if len(ids) > 1 else (ids[:0], ids[:0], np.zeros(0))
    out = [(int(a), int(b), float(d * d)) for a, b, d in zip(name, near, far, strict=True)]
    return assigned.sparkSession.createDataFrame(out, "cluster_id int, nearest_id int, d2 double")


@dataclass(frozen=True)
class MergePlan:
    """New cluster of each old one, the merges in order as (from, into), and the new sizes."""

    new_ids: dict[int, int]
    merges: tuple[tuple[int, int], ...]
    sizes: tuple[int, ...]


def plan_merges(summary: list[tuple[int, int, Sequence[float]]], least: int) -> MergePlan:
    """From (cluster_id, n, sum_v) of every cluster; needs no pass over the points."""
    summary = sorted(summary, key=lambda r: r[0])
    ids = [r[0] for r in summary]
    count = np.array([r[1] for r in summary], np.int64)
    total = np.array([r[2] for r in summary], np.float64)
    mean = total / count[:, None]
    alive = np.ones(len(ids), bool)
    into = list(range(len(ids)))
    merges = []
    while (small := np.flatnonzero(alive & (count < least))).size and alive.sum() > 1:
        c = int(small[0])
        far = ((mean - mean[c]) ** 2).sum(axis=1)
        far[~alive] = np.inf
        far[c] = np.inf
        t = int(far.argmin())
        merges.append((ids[c], ids[t]))
        count[t] += count[c]
        total[t] += total[c]
        mean[t] = total[t] / count[t]
        alive[c] = False
        into = [t if x == c else x for x in into]
    order = {int(c): j for j, c in enumerate(np.flatnonzero(alive))}
    return MergePlan({ids[i]: order[t] for i, t in enumerate(into)}, tuple(merges), tuple(int(count[c]) for c in order))


def merge_small(assigned: DataFrame, least: int) -> tuple[DataFrame, MergePlan]:
    """Points (id, cluster_id, v) with merged cluster numbers, and the plan."""
    plan = plan_merges([(r["cluster_id"], r["n"], r["sum_v"]) for r in summaries(assigned).toLocalIterator()], least)
    remap = assigned.sparkSession.createDataFrame([(old, new) for old, new in plan.new_ids.items()], "old int, new int")
    rows = assigned.withColumnRenamed("cluster_id", "old").join(F.broadcast(remap), "old")
    return rows.select("id", F.col("new").alias("cluster_id"), "v"), plan
