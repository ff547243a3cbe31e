"""Recall, throughput and load of neighbour searches."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield import scratch
from nearfield.operators import ann, clustering, knn

BENCH = "mode string, n_workers int, n_clusters int, seconds double, qps double, recall_pct double"


def per_query_recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, n_found, n_total): true neighbours of each query, and how many of them were found."""
    hits = truth.select("query_id", "neighbor_id").join(found.select("query_id", "neighbor_id", F.lit(1).alias("hit")), ["query_id", "neighbor_id"], "left")
    return hits.groupBy("query_id").agg(F.count("hit").alias("n_found"), F.count("*").alias("n_total"))


def recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(n_found, n_total, recall_pct) over all queries; recall_pct is null for an empty truth."""
    return in_all(per_query_recall(truth, found))


def clustered_recall(points: DataFrame, k: int, clusters: int, seed_ids: Sequence[int] | None = None) -> DataFrame:
    """``per_query_recall`` of ``ann.clustered_all_to_all`` against ``knn.all_to_all``, with both searches in one pass."""
    clustered, plan = ann.cluster_points(points, k, clusters, seed_ids)
    return ann.hits(clustered, k, plan.sizes)


def in_all(counts: DataFrame) -> DataFrame:
    """(n_found, n_total, recall_pct) from the counts of each query."""
    total = counts.agg(F.coalesce(F.sum("n_found"), F.lit(0)).alias("n_found"), F.coalesce(F.sum("n_total"), F.lit(0)).alias("n_total"))
    return total.withColumn("recall_pct", F.when(F.col("n_total") > 0, F.col("n_found") * 100.0 / F.col("n_total")))


def worker_loads(sizes: Sequence[int], workers: int) -> list[int]:
    """Points of each worker when clusters go, largest first, to the worker with the fewest points (ties to the lowest)."""
    loads = [0] * workers
    for n in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += n
    return loads


def worker_load(assigned: DataFrame, workers: int) -> DataFrame:
    """(worker, load)."""
    sizes = [r["n"] for r in clustering.sizes(assigned).collect()]
    return assigned.sparkSession.createDataFrame(list(enumerate(worker_loads(sizes, workers))), "worker int, load long")


def _timed(df: DataFrame) -> tuple[float, DataFrame]:
    """Seconds to compute a result, which is kept for its recall."""
    began = time.perf_counter()
    kept = scratch.materialize(df, "bench")
    return time.perf_counter() - began, kept


def _row(mode: str, workers: int, clusters: int, seconds: float, queries: int, truth: DataFrame, found: DataFrame) -> tuple:
    return mode, workers, clusters, seconds, queries / seconds, recall(truth, found).first()["recall_pct"]


def bench_knn(queries: DataFrame, points: DataFrame, truth: DataFrame, k: int, modes: Sequence[str] = ("broadcast", "blocks")) -> DataFrame:
    """Throughput and recall of exact search by physical form."""
    spark, m = queries.sparkSession, queries.count()
    rows = []
    for mode in modes:
        seconds, found = _timed(knn.knn_search(queries, points, k, mode=mode))
        rows.append(_row(mode, spark.sparkContext.defaultParallelism, 0, seconds, m, truth, found))
    return spark.createDataFrame(rows, BENCH)


def bench_ann_grid(points: DataFrame, truth: DataFrame, k: int, workers: Sequence[int], clusters: Sequence[int]) -> DataFrame:
    """Throughput and recall of approximate search over numbers of partitions and of clusters."""
    spark, n = points.sparkSession, points.count()
    rows = []
    for w in workers:
        dealt = points.repartition(w, "id")
        for c in clusters:
            began = time.perf_counter()
            _, found = _timed(ann.clustered_all_to_all(dealt, k, c))
            rows.append(_row("ann", w, c, time.perf_counter() - began, n, truth, found))
    return spark.createDataFrame(rows, BENCH)


def bench_recall_vs_throughput(points: DataFrame, truth: DataFrame, k: int, workers: int, clusters: Sequence[int]) -> DataFrame:
    """A sweep over numbers of clusters at a fixed number of partitions."""
    return bench_ann_grid(points, truth, k, [workers], clusters)
