"""Intermediate tables that survive the loss of an executor.

A step whose result is read more than once is written as Parquet below the folder that the
cluster names in ``spark.checkpoint.dir`` and read back, which also cuts the lineage. Where that
setting is absent, a local master gets a temporary folder of its own; any other master gets a
folder below the warehouse, which all executors share.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch of whole texts.
TEXT_ROWS = 2000
_own: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """Folder for this application's intermediate tables."""
    app = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if master.startswith("local") and not master.startswith("local-cluster"):
            if app not in _own:
                _own[app] = tempfile.mkdtemp(prefix="nearfield-")
                atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
            shared = "file://" + _own[app]
        else:
            shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_nearfield"
    return f"{shared.rstrip('/')}/nearfield-{app}"


def materialize(df: DataFrame, name: str, batch_rows: int | None = None, file_rows: int = 0) -> DataFrame:
    """Write a frame to a fresh folder and return a frame that reads it.

    ``batch_rows`` bounds the rows of an Arrow batch in this write, for steps that hand whole texts to Python,
    and ``file_rows`` the rows of a file, for rows so large that a reader should not hold many.
    """
    spark = df.sparkSession
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(BATCH)
    if batch_rows is not None:
        spark.conf.set(BATCH, str(min(batch_rows, int(before)) if int(before) > 0 else batch_rows))
    try:
        df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; call it when no result is needed any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def size_bytes(df: DataFrame) -> int:
    """Bytes that the optimizer expects of a frame; for a frame from ``materialize`` these are its files' sizes."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _beyond(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value outside its own eight-byte slot."""
    none = F.lit(0).cast("long")
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(value).cast("long"), none)
    if isinstance(kind, T.StructType):
        return sum((_beyond(value[f.name], f.dataType) for f in kind.fields), F.lit(8 + 8 * len(kind.fields)).cast("long"))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(value, none, lambda total, x: total + 8 + _beyond(x, kind.elementType)), none)
    return none


def memory_bytes(df: DataFrame) -> int:
    """Bytes of a frame's rows in a hash table with room to grow, counted over the frame in one job."""
    width = sum((_beyond(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(64 + 16 * len(df.columns)).cast("long"))
    return df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]


#: A side of a join is broadcast only if its rows take at most this much memory.
BROADCAST_BYTES = 8 << 20


def is_small(df: DataFrame) -> bool:
    """Whether a materialized frame is measured to be small enough in memory for a broadcast."""
    return size_bytes(df) <= BROADCAST_BYTES and memory_bytes(df) <= BROADCAST_BYTES


def small_side(df: DataFrame) -> DataFrame:
    """Hint a broadcast of a materialized frame if it is small; beyond that the join shuffles, and AQE splits hot keys."""
    return df.hint("broadcast" if is_small(df) else "merge")
