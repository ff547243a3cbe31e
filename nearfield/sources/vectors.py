"""Vector sets: reading, writing, checking and joining tables of (id, v).

A named dataset is a Parquet directory below a store directory. A vector set has an ``id bigint`` and
a vector ``v array<double>``; single precision rounds the components to floats first.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.IntegerType, T.FloatType, T.DoubleType)


def normalize_vectors(df: DataFrame, id_col: str = "id", vector_col: str = "v", precision: str = "double", keep: Sequence[str] = ()) -> DataFrame:
    """(id, v) and the columns ``keep`` from a table with an id and an array of ints, floats or doubles; a scalar is a vector of one.

    Other types raise. Null ids or vectors, null components and mixed dimensions raise when the plan runs.
    """
    if precision not in ("single", "double"):
        raise ValueError(f"precision must be 'single' or 'double', not {precision!r}")
    kind = df.schema[vector_col].dataType
    vector = F.col(vector_col)
    if not isinstance(kind, T.ArrayType):
        vector, kind = F.when(vector.isNotNull(), F.array(vector)), T.ArrayType(kind)
    if not isinstance(kind.elementType, NUMBERS):
        raise ValueError(f"vector components must be int, float or double, not {kind.elementType.simpleString()}")
    if precision == "single":
        vector = vector.cast("array<float>")
    vector = vector.cast("array<double>")
    fine = vector.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    checked = F.when(F.coalesce(fine, F.lit(False)), vector).otherwise(F.raise_error(F.lit("null id, vector or component")).cast("array<double>"))
    return df.select(F.col(id_col).cast("long").alias("id"), checked.alias("v"), *keep)


def shape(*sets: DataFrame) -> tuple[int, ...]:
    """The rows of each vector set and their common dimension, in one job; raises if a set is empty or dimensions differ."""
    every = [df.select(F.lit(k).alias("k"), F.size("v").alias("d")) for k, df in enumerate(sets)]
    rows = functools.reduce(DataFrame.unionByName, every).groupBy("k").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).collect()
    if len(rows) < len(sets):
        raise ValueError("a vector set is empty")
    low, high = min(r["lo"] for r in rows), max(r["hi"] for r in rows)
    if low != high:
        raise ValueError(f"vectors of different dimensions: {low} to {high}")
    return *(r["n"] for r in sorted(rows, key=lambda r: r["k"])), low


def scan_vectors(spark: SparkSession, path: str, id_col: str = "id", vector_col: str = "v", precision: str = "double", keep: Sequence[str] = ()) -> DataFrame:
    return normalize_vectors(spark.read.parquet(path), id_col, vector_col, precision, keep)


def write_dataset(df: DataFrame, store: str, name: str, mode: str = "a") -> None:
    """Write a named dataset. ``a`` replaces a dataset of that name and leaves the others; ``w`` empties the store first; ``skip`` keeps an existing one."""
    if mode not in ("a", "w", "skip"):
        raise ValueError(f"mode must be 'a', 'w' or 'skip', not {mode!r}")
    if mode == "w":
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(store)
        folder.getFileSystem(conf).delete(folder, True)
    df.write.mode("ignore" if mode == "skip" else "overwrite").option("compression", "gzip").parquet(f"{store.rstrip('/')}/{name}")


def read_dataset(spark: SparkSession, store: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{store.rstrip('/')}/{name}")


def has_extension(name: str, extension: str) -> bool:
    return name.endswith(extension)


def list_files(spark: SparkSession, folder: str, extension: str, ordered: bool = True) -> list[str]:
    """Names of the files in a folder that end with ``extension``, in byte order if ``ordered``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [x.getPath().getName() for x in found if not x.isDirectory() and has_extension(x.getPath().getName(), extension)]
    return sorted(names, key=str.encode) if ordered else names


def show_matrix(df: DataFrame, n: int = 20) -> None:
    df.orderBy("id").show(n, truncate=False)


def concat_train_test(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both sets as one, (id, v, split): rows of ``test`` are numbered on behind the largest id of ``train``."""
    shift = train.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("shift"))
    moved = test.join(F.broadcast(shift)).select((F.col("id") + F.col("shift")).alias("id"), "v", F.lit("test").alias("split"))
    return train.select("id", "v", F.lit("train").alias("split")).unionByName(moved)


def random_vectors(spark: SparkSession, rows: int, dim: int, seed: int = 0) -> DataFrame:
    """(id, v) with components uniform in [0, 1), the same for any partitioning."""
    part = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), j), F.lit(1 << 53)) / float(1 << 53))
    return spark.range(rows).select("id", part.alias("v"))
