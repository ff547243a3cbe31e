import subprocess
import sys
from pathlib import Path

import pytest

from nearfield.operators import knn
from nearfield.sources import vectors
from nearfield.streaming.knn_stream import knn_batches, knn_stream

ROOT = Path(__file__).resolve().parent.parent


def test_store(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    first, second = (vectors.random_vectors(spark, n, 3) for n in (4, 6))
    vectors.write_dataset(first, store, "train", "w")
    vectors.write_dataset(second, store, "test")
    assert vectors.read_dataset(spark, store, "train").count() == 4
    vectors.write_dataset(second, store, "train")
    assert vectors.read_dataset(spark, store, "train").count() == 6
    vectors.write_dataset(first, store, "train", "skip")
    assert vectors.read_dataset(spark, store, "train").count() == 6
    vectors.write_dataset(first, store, "only", "w")
    assert sorted(p.name for p in (tmp_path / "store").iterdir() if p.is_dir()) == ["only"]
    with pytest.raises(ValueError):
        vectors.write_dataset(first, store, "x", "b")


def test_files(spark, tmp_path):
    for name in ("b.txt", "a.txt", "c.csv"):
        (tmp_path / name).write_text("")
    (tmp_path / "d.txt").mkdir()
    assert vectors.list_files(spark, f"file://{tmp_path}", ".txt") == ["a.txt", "b.txt"]
    assert vectors.has_extension("a.txt", ".txt") and not vectors.has_extension("txt", ".txt")


def test_vectors(spark):
    scalar = vectors.normalize_vectors(spark.createDataFrame([(1, 2.5)], "id long, v double"))
    assert scalar.first()["v"] == [2.5]
    third = vectors.normalize_vectors(spark.createDataFrame([(1, [1 / 3])], "id int, v array<double>"), precision="single").first()["v"][0]
    assert third != 1 / 3 and abs(third - 1 / 3) < 1e-7
    train, test = vectors.random_vectors(spark, 5, 2), vectors.random_vectors(spark, 2, 2, seed=1)
    both = vectors.concat_train_test(train, test)
    assert sorted((r["id"], r["split"]) for r in both.collect()) == [(i, "train") for i in range(5)] + [(5, "test"), (6, "test")]
    assert all(0 <= x < 1 for r in both.collect() for x in r["v"])
    with pytest.raises(ValueError):
        vectors.shape(train, train.limit(0))


def test_stream_equals_batch(spark, tmp_path):
    points = vectors.random_vectors(spark, 30, 4)
    queries = vectors.random_vectors(spark, 8, 4, seed=9)
    for part in range(2):
        queries.filter(f"id % 2 = {part}").write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, v array<double>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = knn_stream(stream, points, 3).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    run.awaitTermination()
    got = {(r["query_id"], r["neighbor_id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(r["query_id"], r["neighbor_id"]) for r in knn.knn_search(queries, points, 3).collect()}


def test_library_stands_alone(tmp_path):
    """Without the corpus subpackage everything else imports, and no other module names it."""
    for path in (ROOT / "nearfield").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path
    for path in (ROOT / "nearfield").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            copy = tmp_path / path.relative_to(ROOT)
            copy.parent.mkdir(parents=True, exist_ok=True)
            copy.write_text(path.read_text())
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[0]) >= 29


def test_stream_of_queries_by_batches(spark, tmp_path):
    points = vectors.random_vectors(spark, 40, 3)
    vectors.random_vectors(spark, 10, 3, seed=2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, v array<double>").parquet(f"{tmp_path}/in")
    write = lambda rows, number: rows.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
    knn_batches(stream, points, 3, write).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("query_id", "rank", "neighbor_id")
    expected = knn.knn_search(spark.read.parquet(f"{tmp_path}/in"), points, 3).select("query_id", "rank", "neighbor_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
