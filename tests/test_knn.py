import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import arrow as A
from nearfield.functions import distance
from nearfield.operators import knn
from nearfield.sources.vectors import normalize_vectors


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, v array<double>").repartition(3)


def brute(queries, points, k, exclude=False):
    out = []
    for i, q in enumerate(queries):
        d = np.sqrt(((points - q) ** 2).sum(axis=1))
        if exclude:
            d[i] = np.inf
        order = np.lexsort((np.arange(len(points)), d))[:k]
        out += [(i, r + 1, int(c), d[c]) for r, c in enumerate(order)]
    return out


def rows_of(df):
    return [tuple(r) for r in df.orderBy("query_id", "rank").collect()]


def assert_same(found, expected):
    assert [r[:3] for r in found] == [r[:3] for r in expected]
    assert np.allclose([r[3] for r in found], [r[3] for r in expected], atol=1e-9)


@pytest.mark.parametrize("mode", ["broadcast", "blocks"])
def test_fixed_cases(spark, mode):
    # fixed values: the small vectors of the golden cases in FIXTURES.md; the distances are worked out by hand
    one = knn.knn_search(frame(spark, [[3.7]]), frame(spark, [[7.2]]), 1, mode=mode)
    assert_same(rows_of(one), [(0, 1, 0, 3.5)])
    corpus = [[4.7, 5.2, 4.9], [0.0, 1.1, 2.0], [2.4, 6.7, 3.3]]
    two = knn.knn_search(frame(spark, [[3.7, 1.2, 4.6]]), frame(spark, corpus), 2, mode=mode)
    assert_same(rows_of(two), [(0, 1, 0, math.sqrt(17.09)), (0, 2, 1, math.sqrt(20.46))])


@pytest.mark.parametrize("case", range(6))
def test_random_cases(spark, case):
    rng = np.random.default_rng(case)
    m, n, dim = rng.integers(1, 60, 3)
    k = int(rng.integers(1, n + 1))
    q, c = rng.random((m, dim)), rng.random((n, dim))
    for mode in ("broadcast", "blocks"):
        assert_same(rows_of(knn.knn_search(frame(spark, q), frame(spark, c), k, mode=mode)), brute(q, c, k))


@pytest.mark.parametrize("mode", ["broadcast", "blocks"])
def test_copies_and_ties(spark, mode, monkeypatch):
    monkeypatch.setattr(knn, "POINT_BYTES", 8 * 2 * 32)
    monkeypatch.setattr(knn, "QUERY_BYTES", 5 * 2 * 32)
    rng = np.random.default_rng(1)
    points = np.concatenate((np.full((12, 4), 0.3), rng.integers(0, 3, (40, 4)).astype(float)))
    found = rows_of(knn.knn_search(frame(spark, points), frame(spark, points), 3, keep_self=False, mode=mode))
    assert_same(found, brute(points, points, 3, exclude=True))
    assert not any(math.isnan(r[3]) for r in found)
    assert all(r[3] == 0 for r in found if r[0] < 12)


def test_identical_point_is_a_neighbour(spark):
    points = frame(spark, [[1.0, 2.0], [5.0, 5.0]])
    assert rows_of(knn.knn_search(points, points, 1)) == [(0, 1, 0, 0.0), (1, 1, 1, 0.0)]


def test_wide_and_single_precision(spark):
    points = frame(spark, np.random.default_rng(3).random((20, 5)))
    wide = knn.wide(knn.knn_search(points, points, 4, precision="single")).orderBy("query_id").first()
    assert wide["neighbor_ids"][0] == 0 and wide["distances"] == sorted(wide["distances"])


def test_bad_arguments(spark):
    points = frame(spark, [[1.0], [2.0]])
    for k in (0, -1, 3):
        with pytest.raises(ValueError):
            knn.knn_search(points, points, k)
    with pytest.raises(ValueError):
        knn.knn_search(points, points, 1, mode="threads")
    with pytest.raises(ValueError):
        knn.knn_search(points, points, 1, precision="half")
    for ratio in (0, -0.5, 1.5):
        with pytest.raises(ValueError):
            knn.knn_search(points, points, 1, memory_ratio=ratio)
    with pytest.raises(ValueError):
        knn.all_to_all(points, 2)
    with pytest.raises(ValueError):
        knn.knn_search(points.limit(0), points, 1)
    with pytest.raises(ValueError):
        knn.knn_search(points, frame(spark, [[1.0, 2.0], [1.0, 1.0]]), 1)
    with pytest.raises(ValueError):
        normalize_vectors(spark.createDataFrame([(1, ["a"])], "id long, v array<string>"))
    for bad in ([(1, None)], [(None, [1.0])], [(1, [1.0, None])]):
        with pytest.raises(Exception, match="null id, vector or component"):
            normalize_vectors(spark.createDataFrame(bad, "id long, v array<double>")).collect()


def test_distance_columns(spark):
    df = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0])], "a array<double>, b array<double>")
    row = df.select(distance.squared_norm(F.col("a")).alias("n"), distance.mean_of(F.col("b"), F.lit(2)).alias("mean")).first()
    assert (row["n"], row["mean"]) == (5.0, [2.0, 3.0])


def test_memory_ratio_changes_blocks_and_not_results(spark, monkeypatch):
    monkeypatch.setattr(knn, "POINT_BYTES", 40 * 24)
    monkeypatch.setattr(knn, "QUERY_BYTES", 40 * 24)
    assert knn.block_counts(40, 40, 3, 1.0) == (1, 1) and knn.block_counts(40, 40, 3, 0.1) == (10, 10) and knn.block_counts(5, 5, 10**9, 0.1) == (5, 5)
    rows = np.random.default_rng(7).random((40, 3))
    for ratio in (0.1, 1.0):
        assert_same(rows_of(knn.knn_search(frame(spark, rows), frame(spark, rows), 3, mode="blocks", memory_ratio=ratio)), brute(rows, rows, 3))


@pytest.mark.parametrize("value", ["dot", "expanded", "direct", "distance"])
def test_pair_distances(spark, value):
    rng = np.random.default_rng(5)
    q, c = rng.random((7, 3)), rng.random((9, 3))
    far = ((q[:, None] - c) ** 2).sum(axis=2)
    expected = {"dot": q @ c.T, "expanded": far, "direct": far, "distance": np.sqrt(far)}[value]
    rows = knn.pair_distances(frame(spark, q), frame(spark, c), value).collect()
    assert len(rows) == 63
    assert all(abs(r["value"] - expected[r["a"], r["b"]]) < 1e-9 for r in rows)


@pytest.mark.parametrize("value", ["dot", "expanded", "direct", "distance"])
def test_blocks_of_pairs_are_not_shuffled(spark, value, monkeypatch):
    monkeypatch.setattr(knn, "POINT_BYTES", 2 * 8 * 3 * 5)
    monkeypatch.setattr(knn, "QUERY_BYTES", 2 * 8 * 3 * 4)
    rng = np.random.default_rng(6)
    q, c = rng.random((23, 3)), rng.random((31, 3))
    far = ((q[:, None] - c) ** 2).sum(axis=2)
    expected = {"dot": q @ c.T, "expanded": far, "direct": far, "distance": np.sqrt(far)}[value]
    df = knn.pair_distances(frame(spark, q), frame(spark, c), value, digits=3)
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()  # no row is repeated
    rows = {(r["a"], r["b"]): r["value"] for r in df.collect()}
    assert len(rows) == 23 * 31 and all(abs(v - expected[p]) <= 0.0005 + 1e-12 for p, v in rows.items())


def test_rounding_and_differences():
    x = np.array([0.5, -0.5, 1.25, -1.25, -0.01, 2.0**60, np.inf, 0.049999999999999996])
    assert A.rounded(x, 1).tolist() == [0.5, -0.5, 1.3, -1.3, 0.0, 2.0**60, np.inf, 0.0] and not np.signbit(A.rounded(x, 1)[4])
    q, c = np.random.default_rng(8).random((2, 1500, 5))
    assert np.allclose(A.squared_differences(q[:37], c), ((q[:37, None] - c) ** 2).sum(axis=2), rtol=1e-12)


@pytest.mark.parametrize("case", range(8))
def test_nearest_by_blocks_equals_nearest_rows(case):
    rng = np.random.default_rng(case)
    points = [rng.random((90, 5)), rng.integers(0, 3, (90, 3)).astype(float), 1e6 + 1e-3 * rng.random((90, 4)), np.full((90, 2), 0.3)][case % 4]
    ids, names = rng.permutation(200)[:90], rng.permutation(200)[:30]
    asked, keep_self = points[rng.integers(0, 90, 30)], case >= 4
    best = A.Nearest(names, asked, 7, keep_self)
    for part in np.array_split(rng.permutation(90), [4, 30, 31, 80]):
        part = part[np.argsort(ids[part])]
        part = part[A.first_copies(points[part], 8)]
        best.add(ids[part], points[part])
    name, rank, near, far = best.rows()
    for got, expected in zip((name, near, far), A.nearest_rows(asked, names, points, ids, 7, keep_self), strict=True):
        assert np.array_equal(got, expected)
    assert rank.tolist() == [*range(1, 8)] * 30


def test_copies_beyond_the_first_are_left_out():
    rows = np.array([[1.0, 2.0], [0.0, 0.0], [1.0, 2.0], [1.0, 2.0], [0.0, 0.0], [5.0, 5.0]])
    assert A.first_copies(rows, 2).tolist() == [0, 1, 2, 4, 5] and A.first_copies(rows, 1).tolist() == [0, 1, 5]


def test_blocks_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(knn, "POINT_BYTES", 2 * 8 * 3 * 5)
    rows = frame(spark, np.random.default_rng(6).random((40, 3)))
    plan = knn.all_to_all(rows, 2, mode="blocks")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "CartesianProduct" in plan


def test_a_block_is_merged_once(monkeypatch):
    rng, merges, merge = np.random.default_rng(13), [], A.Nearest._merge
    points = rng.integers(0, 4, (90, 3)).astype(float)
    names, asked = np.arange(1000, 2300), rng.random((1300, 3))
    monkeypatch.setattr(A.Nearest, "_merge", lambda self, *given: merges.append(1) or merge(self, *given))
    best = A.Nearest(names, asked, 5)
    for lo in (0, 40):
        best.add(np.arange(90)[lo : lo + 40 + lo], points[lo : lo + 40 + lo])
    name, _, near, far = best.rows()
    for got, expected in zip((name, near, far), A.nearest_rows(asked, names, points, np.arange(90), 5), strict=True):
        assert np.array_equal(got, expected)
    assert len(merges) == 2


def test_true_places():
    rng = np.random.default_rng(14)
    for rows, columns, share in [(1, 1, 1), (1, 7, 0.5), (3, 5, 0.2), (9, 8, 0), (20, 37, 0.01), (4, 64, 1)]:
        mask = rng.random((rows, columns)) < share
        assert A.true_places(mask).tolist() == np.flatnonzero(mask).tolist()
