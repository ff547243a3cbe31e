"""Registered queries over ``embeddings``: each applies one operator to the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import distance
from nearfield.operators import ann, clustering, evaluate, knn
from nearfield.sources import vectors

K, CLUSTERS, MANY_CLUSTERS, WORKERS = 10, 10, 40, 4


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.scan_vectors(spark, f"{sf_dir}/embeddings.parquet", "vec_id", "embedding")


def split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries (every fifth id) and corpus (the rest)."""
    rows = points(spark, sf_dir)
    return rows.filter("id % 5 = 0"), rows.filter("id % 5 <> 0")


def digits(column: str) -> Column:
    return (F.round(F.col(column), 6) + 0.0).alias(column)


def shown(result: DataFrame) -> DataFrame:
    return result.select("query_id", "rank", "neighbor_id", digits("distance"))


def assigned(spark: SparkSession, sf_dir: str, clusters: int = CLUSTERS) -> DataFrame:
    rows = points(spark, sf_dir)
    return clustering.assign(rows, clustering.seeds(rows, clusters))


def _pairs(value: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return knn.pair_distances(*split(spark, sf_dir), value, digits=6)

    return query


def scan_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.scan_vectors(spark, f"{sf_dir}/embeddings.parquet", "vec_id", "embedding", keep=["label"])
    return rows.select(F.col("id").alias("vec_id"), "label", F.size("v").cast("long").alias("dim"))


def concat_train_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    test, train = split(spark, sf_dir)
    return vectors.concat_train_test(train, test).select("id", "split", digits_of_sum())


def digits_of_sum() -> Column:
    return (F.round(distance.squared_norm(F.col("v")), 6) + 0.0).alias("sq_norm")


def sq_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select(F.col("id").alias("vec_id"), digits_of_sum())


def exact_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(knn.knn_search(*split(spark, sf_dir), K))


def knn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(knn.knn_search(*split(spark, sf_dir), K, mode="blocks"))


def knn_self_included(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, _ = split(spark, sf_dir)
    return shown(knn.knn_search(queries, points(spark, sf_dir), K))


def knn_self_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, _ = split(spark, sf_dir)
    return shown(knn.knn_search(queries, points(spark, sf_dir), K, keep_self=False))


def exact_all_to_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(knn.all_to_all(points(spark, sf_dir), K))


def knn_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = knn.wide(knn.knn_search(*split(spark, sf_dir), K))
    return rows.select("query_id", F.array_join(F.col("neighbor_ids").cast("array<string>"), ",").alias("neighbor_ids"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.seeds(points(spark, sf_dir), CLUSTERS).select(F.col("id").alias("vec_id"), F.col("cluster_id").cast("long").alias("cluster_id"))


def non_seed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir)
    return clustering.non_seed_points(rows, clustering.seeds(rows, CLUSTERS)).select(F.col("id").alias("vec_id"))


def assign_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark, sf_dir).select(F.col("id").alias("vec_id"), F.col("cluster_id").cast("long").alias("cluster_id"))


def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.sizes(assigned(spark, sf_dir)).select(F.col("cluster_id").cast("long").alias("cluster_id"), "n")


def undersized_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.undersized(assigned(spark, sf_dir, MANY_CLUSTERS), K + 1).select(F.col("cluster_id").cast("long").alias("cluster_id"), "n")


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clustering.centroids(assigned(spark, sf_dir)).select("cluster_id", "n", F.posexplode("centroid").alias("dim", "value"))
    return rows.select(F.col("cluster_id").cast("long").alias("cluster_id"), "n", F.col("dim").cast("long").alias("dim"), digits("value"))


def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clustering.nearest_centroids(assigned(spark, sf_dir))
    return rows.select(*[F.col(c).cast("long").alias(c) for c in ("cluster_id", "nearest_id")], digits("d2"))


def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.members(assigned(spark, sf_dir)).select(F.col("cluster_id").cast("long").alias("cluster_id"), F.col("id").alias("vec_id"), F.col("pos").cast("long").alias("pos"))


def clusters_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clustering.clusters_by_size(assigned(spark, sf_dir))
    return rows.select(F.col("cluster_id").cast("long").alias("cluster_id"), "n", F.col("size_rank").cast("long").alias("size_rank"))


def worker_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.worker_load(assigned(spark, sf_dir), WORKERS)


def merge_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = clustering.merge_small(assigned(spark, sf_dir, MANY_CLUSTERS), K + 1)
    return rows.select(F.col("id").alias("vec_id"), F.col("cluster_id").cast("long").alias("cluster_id"))


def _ann(clusters: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(ann.clustered_all_to_all(points(spark, sf_dir), K, clusters))

    return query


def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.in_all(per_query_recall(spark, sf_dir)).select("n_found", "n_total", digits("recall_pct"))


def per_query_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.clustered_recall(points(spark, sf_dir), K, CLUSTERS)


QUERIES = {
    f.__name__: f
    for f in (
        scan_vectors, concat_train_test, sq_norms, exact_knn, knn_blocks, knn_self_included, knn_self_excluded, exact_all_to_all, knn_wide, seeds, non_seed_points, assign_clusters,
        cluster_sizes, undersized_clusters, centroids, nearest_centroid, cluster_members, clusters_by_size, worker_load, merge_clusters, recall, per_query_recall,
    )
} | {
    "dot_products": _pairs("dot"), "sq_distance_expanded": _pairs("expanded"), "sq_distance_direct": _pairs("direct"), "pairwise_distance": _pairs("distance"),
    "ann_knn": _ann(CLUSTERS), "ann_knn_merged": _ann(MANY_CLUSTERS), "ann_single_cluster": _ann(1),
}

_E = "e as (select vec_id as id, embedding::double[] as v from embeddings), q as (select * from e where id % 5 = 0), c as (select * from e where id % 5 <> 0)"
_D2 = "list_sum(list_transform(list_zip({0}.v, {1}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_NORM = "list_sum(list_transform({0}.v, lambda x: x * x))"
_DOT = "list_sum(list_transform(list_zip({0}.v, {1}.v), lambda z: z[1] * z[2]))"


def _pair_sql(value: str) -> str:
    return f"with {_E} select q.id as a, c.id as b, round({value}, 6) + 0.0::double as value from q, c"


def _top(asked: str, held: str, condition: str = "true", extra: str = "") -> str:
    """A select of the K nearest rows of ``held`` for each row of ``asked``."""
    return f"""select query_id, rank::int as rank, neighbor_id, round(distance, 6) + 0.0::double as distance from (
      select a.id as query_id, b.id as neighbor_id, sqrt({_D2.format("a", "b")}) as distance,
        row_number() over (partition by a.id order by {_D2.format("a", "b")}, b.id) as rank
      from {asked} a, {held} b where {condition}{extra}
    ) where rank <= {K}"""


def _assigned_sql(clusters: int, name: str = "m") -> str:
    """CTEs: s (seeds) and ``name`` (id, v, cluster_id)."""
    return f"""s as (
      select id, v, row_number() over (order by md5(id::varchar), id) - 1 as cluster_id from e qualify cluster_id < {clusters}
    ), {name} as (
      select e.id, any_value(e.v) as v, arg_min(s.cluster_id, case when e.id = s.id then -1 else {_D2.format("e", "s")} end) as cluster_id
      from (select e.* from e) e, (select * from s order by cluster_id) s group by e.id
    )"""


def _merged_sql(clusters: int, least: int) -> str:
    """CTEs: m (id, v, cluster_id) with merged cluster numbers. A recursion merges one cluster a step."""
    d2 = "list_sum(list_transform(list_zip(x.s, f.s), lambda z: (z[1] / x.n - z[2] / f.n) * (z[1] / x.n - z[2] / f.n)))"
    return f"""{_assigned_sql(clusters, "o")}, sums as (
      select cluster_id, max(n)::bigint as n, list(x order by dim) as s from (
        select cluster_id, dim, count(*) as n, sum(x) as x from (select cluster_id, generate_subscripts(v, 1) as dim, unnest(v) as x from o) group by cluster_id, dim
      ) group by cluster_id
    ), steps as (
      select 0 as step, list(struct_pack(id := cluster_id, n := n, s := s) order by cluster_id) as c, list(struct_pack(old := cluster_id, cur := cluster_id) order by cluster_id) as now from sums
      union all
      select step + 1,
        list_transform(list_filter(c, lambda x: x.id <> f.id), lambda x: case when x.id = t then struct_pack(id := x.id, n := x.n + f.n, s := list_transform(list_zip(x.s, f.s), lambda z: z[1] + z[2])) else x end),
        list_transform(now, lambda y: case when y.cur = f.id then struct_pack(old := y.old, cur := t) else y end)
      from (
        select step, c, now, f, list_sort(list_transform(list_filter(c, lambda x: x.id <> f.id), lambda x: struct_pack(d := {d2}, id := x.id)))[1].id as t
        from (select step, c, now, list_filter(c, lambda x: x.n < {least})[1] as f from steps) where f is not null and len(c) > 1
      )
    ), last as (select unnest(arg_max(now, step), recursive := true) from steps),
    renamed as (select old, dense_rank() over (order by cur) - 1 as cluster_id from last),
    m as (select o.id, o.v, r.cluster_id from o join renamed r on o.cluster_id = r.old)"""


_M = _assigned_sql(CLUSTERS)
_MERGED = _merged_sql(MANY_CLUSTERS, K + 1)
_MEANS = """r as (select cluster_id, generate_subscripts(v, 1) - 1 as dim, unnest(v) as x from m),
  t as (select cluster_id, dim, count(*) as n, sum(x) / count(*) as value from r group by cluster_id, dim)"""
_ANN = _top("m", "m", "a.cluster_id = b.cluster_id and a.id <> b.id")
_EXACT = _top("e", "e", "a.id <> b.id")

ORACLES = {
    "scan_vectors": "select vec_id, label, len(embedding) as dim from embeddings",
    "concat_train_test": f"""with {_E}, joined as (select id, v, 'train' as split from c union all select id + (select max(id) + 1 from c), v, 'test' from q)
      select id, split, round({_NORM.format("joined")}, 6) + 0.0::double as sq_norm from joined""",
    "sq_norms": f"with {_E} select id as vec_id, round({_NORM.format('e')}, 6) + 0.0::double as sq_norm from e",
    "dot_products": _pair_sql(_DOT.format("q", "c")),
    "sq_distance_expanded": _pair_sql(f"greatest(0.0::double, {_NORM.format('q')} + {_NORM.format('c')} - 2 * {_DOT.format('q', 'c')})"),
    "sq_distance_direct": _pair_sql(_D2.format("q", "c")),
    "pairwise_distance": _pair_sql(f"sqrt({_D2.format('q', 'c')})"),
    "exact_knn": f"with {_E} {_top('q', 'c')}",
    "knn_blocks": f"with {_E} {_top('q', 'c')}",
    "knn_self_included": f"with {_E} {_top('q', 'e')}",
    "knn_self_excluded": f"with {_E} {_top('q', 'e', 'a.id <> b.id')}",
    "exact_all_to_all": f"with {_E} {_EXACT}",
    "knn_wide": f"with {_E}, f as ({_top('q', 'c')}) select query_id, string_agg(neighbor_id::varchar, ',' order by rank) as neighbor_ids from f group by query_id",
    "seeds": f"with {_E}, {_M} select id as vec_id, cluster_id from s",
    "non_seed_points": f"with {_E}, {_M} select id as vec_id from e where id not in (select id from s)",
    "assign_clusters": f"with {_E}, {_M} select id as vec_id, cluster_id from m",
    "cluster_sizes": f"with {_E}, {_M} select cluster_id, count(*) as n from m group by cluster_id",
    "undersized_clusters": f"with {_E}, {_assigned_sql(MANY_CLUSTERS)} select cluster_id, count(*) as n from m group by cluster_id having n < {K + 1}",
    "centroids": f"with {_E}, {_M}, {_MEANS} select cluster_id, n, dim, round(value, 6) + 0.0::double as value from t",
    "nearest_centroid": f"""with {_E}, {_M}, {_MEANS}, p as (
        select a.cluster_id, b.cluster_id as nearest_id, sum((a.value - b.value) * (a.value - b.value)) as d2
        from t a join t b on a.dim = b.dim and a.cluster_id <> b.cluster_id group by a.cluster_id, b.cluster_id
      ) select cluster_id, nearest_id, round(d2, 6) + 0.0::double as d2 from p qualify row_number() over (partition by cluster_id order by p.d2, nearest_id) = 1""",
    "cluster_members": f"with {_E}, {_M} select cluster_id, id as vec_id, row_number() over (partition by cluster_id order by id) as pos from m",
    "clusters_by_size": f"with {_E}, {_M} select cluster_id, count(*) as n, row_number() over (order by count(*) desc, cluster_id) as size_rank from m group by cluster_id",
    "ann_knn": f"with {_E}, {_M} {_ANN}",
    "worker_load": f"""with recursive {_E}, {_M}, z as (select row_number() over (order by count(*) desc, cluster_id) as i, count(*)::bigint as n from m group by cluster_id),
      l as (
        select 0::bigint as step, list_transform(range({WORKERS}), lambda x: 0::bigint) as loads
        union all
        select step + 1, list_transform(loads, lambda x, i: x + case when i = list_position(loads, list_min(loads)) then z.n else 0::bigint end) from l join z on z.i = l.step + 1
      ), e2 as (select arg_max(loads, step) as loads from l)
      select (generate_subscripts(loads, 1) - 1)::int as worker, unnest(loads)::bigint as load from e2""",
    "merge_clusters": f"with recursive {_E}, {_MERGED} select id as vec_id, cluster_id from m",
    "ann_knn_merged": f"with recursive {_E}, {_MERGED} {_ANN}",
    "ann_single_cluster": f"with {_E} {_EXACT}",
    "recall": f"""with {_E}, {_M}, x as ({_EXACT}), y as ({_ANN}), z as (select count(y.query_id) as n_found, count(*) as n_total from x left join y using (query_id, neighbor_id))
      select n_found, n_total, round(n_found * 100.0::double / n_total, 6) + 0.0::double as recall_pct from z""",
    "per_query_recall": f"with {_E}, {_M}, x as ({_EXACT}), y as ({_ANN}) select x.query_id, count(y.query_id) as n_found, count(*) as n_total from x left join y using (query_id, neighbor_id) group by x.query_id",
}
