import hashlib

import numpy as np
import pytest

from nearfield.operators import ann, clustering, evaluate, knn, validate
from nearfield.plans import reference_queries
from nearfield.plans.reference_queries import points as embeddings


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, v array<double>").repartition(3)


def brute_clusters(m, clusters, least):
    """Plain numpy version of seeds, one assignment and merging that looks at all points again for each mean."""
    order = sorted(range(len(m)), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))[:clusters]
    far = ((m[:, None] - m[order]) ** 2).sum(axis=2)
    own = far.argmin(axis=1)
    own[order] = np.arange(clusters)
    mean = [m[own == c].mean(axis=0) for c in range(clusters)]
    valid, merges = [True] * clusters, 0
    while True:
        small = [c for c in range(clusters) if valid[c] and (own == c).sum() < least]
        if not small or sum(valid) == 1:
            break
        c = small[0]
        others = [t for t in range(clusters) if valid[t] and t != c]
        t = min(others, key=lambda t: (((mean[t] - mean[c]) ** 2).sum(), t))
        own[own == c] = t
        mean[t] = m[own == t].mean(axis=0)
        valid[c] = False
        merges += 1
    names = {c: j for j, c in enumerate(c for c in range(clusters) if valid[c])}
    return [names[c] for c in own], merges


@pytest.mark.parametrize(("clusters", "merges"), [(10, 0), (40, 11)])
def test_merging_equals_brute_force(spark, clusters, merges):
    rows = embeddings(spark, "/root/testdata/sf0.01")
    table = rows.orderBy("id").collect()
    expected, times = brute_clusters(np.array([r["v"] for r in table]), clusters, 11)
    found, plan = clustering.merge_small(clustering.assign(rows, clustering.seeds(rows, clusters)), 11)
    assert [r["cluster_id"] for r in found.orderBy("id").collect()] == expected
    assert len(plan.merges) == times == merges
    assert min(plan.sizes) >= 11 and sum(plan.sizes) == len(table)


def test_chain_of_merges():
    plan = clustering.plan_merges([(0, 1, [0.0]), (1, 1, [1.0]), (2, 5, [50.0]), (3, 9, [900.0])], 3)
    assert plan.merges == ((0, 1), (1, 2))
    assert plan.new_ids == {0: 0, 1: 0, 2: 0, 3: 1} and plan.sizes == (7, 9)


@pytest.mark.parametrize("clusters", [1, 5, 18])
def test_every_point_has_k_others_of_its_cluster(spark, clusters, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 16)
    m = np.random.default_rng(2).random((200, 6))
    rows, k = frame(spark, m), 10
    clustered, plan = ann.cluster_points(rows, k, clusters)
    own = {r["id"]: r["cluster_id"] for r in clustered.collect()}
    found = ann.search_clusters(clustered, k, plan.sizes).orderBy("query_id", "rank").collect()
    assert len(found) == 200 * k
    exact = {(r["query_id"], r["rank"]): r for r in knn.all_to_all(rows, k).collect()}
    for r in found:
        assert r["query_id"] != r["neighbor_id"] and own[r["query_id"]] == own[r["neighbor_id"]]
        assert r["distance"] >= exact[r["query_id"], r["rank"]]["distance"] - 1e-12
        if clusters == 1:
            assert r["neighbor_id"] == exact[r["query_id"], r["rank"]]["neighbor_id"]
    assert len({(r["query_id"], r["neighbor_id"]) for r in found}) == len(found)


@pytest.mark.parametrize(("clusters", "percent"), [(5, 32.16), (10, 20.92), (40, 19.18)])
def test_recall_of_the_survey(spark, clusters, percent):
    rows = embeddings(spark, "/root/testdata/sf0.01")
    got = evaluate.recall(knn.all_to_all(rows, 10), ann.clustered_all_to_all(rows, 10, clusters)).first()
    assert got["n_total"] == 5000 and abs(got["recall_pct"] - percent) < 1e-9


def test_many_seeds_are_searched_by_blocks(spark, monkeypatch):
    rows = frame(spark, np.random.default_rng(9).random((120, 5)))
    chosen = clustering.seeds(rows, 30)
    expected = {r["id"]: r["cluster_id"] for r in clustering.assign(rows, chosen).collect()}
    monkeypatch.setattr(clustering, "SEED_BYTES", 100)
    got = clustering.assign(rows, chosen)
    assert got.columns == ["id", "cluster_id", "v"] and {r["id"]: r["cluster_id"] for r in got.collect()} == expected


def test_members_are_numbered_in_order(spark):
    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 as id", "cast(id % 3 = 0 as int) as cluster_id").repartition(5)
    for c in (0, 1):
        got = [(r["pos"], r["id"]) for r in clustering.members(rows).filter(f"cluster_id = {c}").orderBy("pos").collect()]
        assert [p for p, _ in got] == list(range(1, len(got) + 1)) and [i for _, i in got] == sorted(i for _, i in got)


def test_duplicate_seeds_keep_their_clusters(spark):
    rows = frame(spark, [[1.0], [1.0], [1.0], [9.0]])
    assigned = clustering.assign(rows, clustering.seeds(rows, 2, seed_ids=[0, 1]))
    assert {r["id"]: r["cluster_id"] for r in assigned.collect()} == {0: 0, 1: 1, 2: 0, 3: 0}


def test_reports(spark):
    rows = frame(spark, np.random.default_rng(4).random((60, 3)))
    assigned = clustering.assign(rows, clustering.seeds(rows, 4))
    assert evaluate.worker_loads([5, 9, 4, 4], 2) == [13, 9] and sum(r["load"] for r in evaluate.worker_load(assigned, 3).collect()) == 60
    assert [r["size_rank"] for r in clustering.clusters_by_size(assigned).orderBy("size_rank").collect()] == [1, 2, 3, 4]
    truth = knn.all_to_all(rows, 5)
    assert evaluate.bench_knn(rows, rows, knn.knn_search(rows, rows, 5), 5).count() == 2
    grid = evaluate.bench_ann_grid(rows, truth, 5, [2], [1, 4]).orderBy("n_clusters").collect()
    assert grid[0]["recall_pct"] == 100.0 and grid[1]["recall_pct"] < 100.0
    empty = evaluate.recall(truth.limit(0), truth).first()
    assert empty["n_total"] == 0 and empty["recall_pct"] is None


def test_bad_arguments():
    for args in [(0, 2, 1, 1), (10, 2, 0, 1), (10, 2, 1, 0), (10, 2, 1, 11), (10, 2, 5, 2), (10, 2, 10, 1)]:
        with pytest.raises(ValueError):
            validate.check_ann(*args)
    validate.check_ann(10, 2, 4, 2)
    for ratio in (0, -1, 1.5):
        with pytest.raises(ValueError):
            validate.check_ratio(ratio)


def test_large_clusters_are_shuffled_once(spark, monkeypatch):
    m = np.random.default_rng(11).integers(0, 4, (150, 3)).astype(float)
    rows = frame(spark, m)
    clustered, plan = ann.cluster_points(rows, 4, 3)
    expected = sorted(tuple(r) for r in ann.search_clusters(clustered, 4, plan.sizes).collect())
    monkeypatch.setattr(ann, "BLOCK_ROWS", 9)
    monkeypatch.setattr(ann, "UNIT_BLOCKS", sorted(plan.sizes)[1] // 9 + 1)
    cut = ann.search_clusters(clustered, 4, plan.sizes)
    text = cut._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in text and "CartesianProduct" in text
    assert sorted(tuple(r) for r in cut.collect()) == expected


def test_recall_repeats_no_row(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 10)
    rows = frame(spark, np.random.default_rng(12).random((90, 4)))
    clustered, plan = ann.cluster_points(rows, 3, 1)
    report = evaluate.per_query_recall(knn.all_to_all(rows, 3, mode="blocks"), ann.search_clusters(clustered, 3, plan.sizes))
    assert "Generate" not in report._jdf.queryExecution().executedPlan().toString()
    assert {(r["n_found"], r["n_total"]) for r in report.collect()} == {(3, 3)} and report.count() == 90


def test_recall_percent_repeats_no_row(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 10)
    rows = frame(spark, np.random.default_rng(15).random((90, 4)))
    clustered, plan = ann.cluster_points(rows, 3, 1)
    report = evaluate.recall(knn.all_to_all(rows, 3, mode="blocks"), ann.search_clusters(clustered, 3, plan.sizes))
    assert "Generate" not in report._jdf.queryExecution().executedPlan().toString()
    assert tuple(report.first()) == (270, 270, 100.0)


def shuffled_rows(spark):
    """Rows that stages have written for a shuffle so far."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_recall_shuffles_points_once(spark, tmp_path):
    m = np.random.default_rng(16).random((2000, 3))
    spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    before = shuffled_rows(spark)
    n_found, n_total, _ = reference_queries.recall(spark, str(tmp_path)).first()
    assert n_total == 20_000 and 10_000 < n_found < 20_000
    assert shuffled_rows(spark) - before < 4000


@pytest.mark.parametrize("clusters", [1, 4])
def test_one_pass_recall(spark, monkeypatch, clusters):
    monkeypatch.setattr(knn, "QUERY_BYTES", 16 * 8 * 3)
    monkeypatch.setattr(knn, "POINT_BYTES", 26 * 8 * 3)
    m = np.random.default_rng(17).integers(0, 5, (200, 3)).astype(float)
    m[:40] = m[0]
    rows = frame(spark, m)
    clustered, plan = ann.cluster_points(rows, 4, clusters)
    expected = evaluate.per_query_recall(knn.all_to_all(rows, 4, mode="broadcast"), ann.search_clusters(clustered, 4, plan.sizes))
    got = evaluate.clustered_recall(rows, 4, clusters)
    assert got.columns == expected.columns and got.count() == 200
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    assert tuple(evaluate.in_all(got).first()) == tuple(evaluate.in_all(expected).first())
