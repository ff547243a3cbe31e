"""Nearest neighbours and the metric join against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import ann, metric_join, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(seed=0, n=260, dim=16):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim))
    m[60:120] = m[5] + 0.12 * rng.normal(size=(60, dim))
    m[120:150] = m[7]
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows = [(int(i), [float(np.float32(x)) for x in v], int(i % 3 if i < 60 or i >= 150 else 1)) for i, v in enumerate(m)]
    odd = [
        (300, None, 1), (301, [0.0] * dim, 1), (302, [math.nan] + [0.1] * (dim - 1), 1), (303, [math.inf] + [0.1] * (dim - 1), 1), (304, [None] + [0.1] * (dim - 1), 1),
        (305, rows[7][1], None), (306, [1.0, 2.0], 1), (307, [2.0, 4.0], 1), (None, rows[7][1], 1), (308, [], 1), (309, [2 * x for x in rows[7][1]], 1),
    ]
    return rows + odd + [rows[9], rows[9]]


def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("sizes", [(2048, 1024), (16, 8)])
def test_metric_join(spark, sizes, monkeypatch):
    monkeypatch.setattr(metric_join, "CELL_ROWS", sizes[0])
    monkeypatch.setattr(metric_join, "BLOCK_ROWS", sizes[1])
    rows = vectors()
    ids = [metric_join.vec.LAST_ID if r[0] is None else r[0] for r in rows]
    links = np.zeros((len(rows), len(rows)), bool)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i != j and fine(a[1]) and fine(b[1]) and a[2] is not None and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                links[i, j] = x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93
    component = list(ids)
    same_id = np.array([[a == b for b in ids] for a in ids])
    for _ in rows:
        component = [min(component[j] for j in np.flatnonzero(links[i] | same_id[i])) for i in range(len(rows))]
    shown = lambda x: None if x == metric_join.vec.LAST_ID else x
    expected = sorted((ids[i], int(links[i].sum()), component[i]) for i in range(len(rows)))
    got = metric_join.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(((metric_join.vec.LAST_ID if r["vec_id"] is None else r["vec_id"]), r["n_links"], metric_join.vec.LAST_ID if r["component_id"] is None else r["component_id"]) for r in got) == expected
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert any(shown(c) is not None for c in component)


def brute(rows, query, k):
    best = {}
    for i, v, *_ in rows:
        if i != query[0] and fine(v) and len(v) == len(query[1]):
            d = math.sqrt(sum((x - y) ** 2 for x, y in zip(np.array(v, float), np.array(query[1], float), strict=True)))
            best[i, d] = d
    return sorted((d, metric_join.vec.LAST_ID if i is None else i) for (i, d) in best)[:k]


@pytest.mark.parametrize(("parts", "probes", "large"), [(1, 32, 20_000), (2, 1024, 20_000), (1, 32, 0)])
def test_nearest_is_exact_with_all_probes(spark, monkeypatch, parts, probes, large):
    monkeypatch.setattr(ann, "SLICE_ROWS", 20)
    monkeypatch.setattr(ann, "LARGE_CELL", large)
    monkeypatch.setattr(ann, "PAIR_ROWS", 50)
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 10 = 0"), k=6, tables=1, probes=probes, parts=parts).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], metric_join.vec.LAST_ID if r["vec_id"] is None else r["vec_id"]))
    asked = [r for r in rows if r[0] is not None and r[0] % 10 == 0 and fine(r[1])]
    assert set(got) == {r[0] for r in asked}
    for q in asked:
        found = sorted(got[q[0]])
        assert [x[0] for x in found] == list(range(1, len(found) + 1))
        expected = brute(rows, q, 6)
        assert [x[2] for x in found] == [i for _, i in expected]
        assert np.allclose([x[1] for x in found], [d for d, _ in expected], atol=1e-12)


def test_recall(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    found = queries.op2_ann(spark, sf_dir).collect()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((m - m[ids == q][0]) ** 2).sum(axis=1))
        far[ids == q] = np.inf
        best = set(ids[np.lexsort((ids, far))[:10]])
        own = [r for r in found if r["query_id"] == q]
        hits, total = hits + len(best & {r["vec_id"] for r in own}), total + 10
        assert len(own) == 10 and all(abs(r["score"] - far[ids == r["vec_id"]][0]) < 1e-12 for r in own)
    assert hits / total >= 0.9


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_several_parts(spark, parts):
    """Chains of rotations find near neighbours, and a vector's own copies."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    m = np.concatenate([base + 0.05 * rng.normal(size=base.shape) for _ in range(10)])
    df = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(m)], SCHEMA)
    found = ann.nearest(df, df.filter("vec_id < 40"), k=5, tables=6, probes=6**parts, parts=parts).collect()
    assert np.mean([r["vec_id"] % 40 == r["query_id"] % 40 for r in found]) > 0.95


def test_vector_operators_ignore_clashing_names(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)], 0) for i in range(20)], SCHEMA)
    odd = df
    for name in ("id", "v", "bucket", "cell", "grp", "h1", "w", "unit"):
        odd = odd.withColumn(name, F.lit(f"my {name}"))
    for operator in (lambda d: ann.nearest(d, d.filter("vec_id < 5"), k=3), lambda d: metric_join.near_vectors(d, 0.8)):
        assert sorted(map(tuple, operator(df).collect())) == sorted(map(tuple, operator(odd).collect()))


def test_routing_steps_agree(monkeypatch):
    """Guests do not depend on the size of a step, and every linked pair meets in the earlier home."""
    rng = np.random.default_rng(8)
    m, eps = metric_join.vec.unit(rng.normal(size=(300, 6))), 0.4
    pivots = m[:40]
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    home, row, cell = metric_join._cells_of(m, pivots, apart, eps)
    monkeypatch.setattr(metric_join, "ROUTE_CELLS", 100)
    again = metric_join._cells_of(m, pivots, apart, eps)
    assert all((x == y).all() for x, y in zip((home, row, cell), again, strict=True))
    guests = set(zip(row.tolist(), cell.tolist(), strict=True))
    near = np.sqrt(np.maximum(0, 2 - 2 * m @ m.T)) <= eps
    for x, y in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        first, later = (x, y) if home[x] <= home[y] else (y, x)
        assert home[x] == home[y] or (later, home[first]) in guests


def test_rotation_keeps_lengths_and_fewer_rows_than_k(spark):
    x = np.random.default_rng(1).normal(size=(5, 11))
    assert np.allclose(np.linalg.norm(ann.rotation(x, 3, 0), axis=1), np.linalg.norm(x, axis=1))
    few = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [-1.0, 0.1], 0)], SCHEMA)
    assert ann.nearest(few, few, k=10).count() == 6
    empty = spark.createDataFrame([], SCHEMA)
    assert ann.nearest(empty, empty).count() == 0 and metric_join.near_vectors(empty).count() == 0
    assert ann.nearest(few, empty).count() == 0
