import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("OMP_NUM_THREADS", "1")
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sql(sf_dir):
    """A function that runs SQL in the other engine over the same tables and gives columns and rows."""
    import duckdb

    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from '{path if path.is_file() else f'{path}/*.parquet'}'")

    def run(text):
        result = con.execute(text)
        return [c[0] for c in result.description], result.fetchall()

    return run


@pytest.fixture(scope="session")
def same(spark, sf_dir, sql):
    """A check that a registered query and its SQL give the same rows."""

    def check(query, oracle):
        df = query(spark, sf_dir)
        names, rows = sql(oracle)
        assert sorted(names) == sorted(df.columns)
        columns = sorted(names)
        tidy = lambda v: round(v, 9) if isinstance(v, float) else v
        key = lambda row: tuple((v is None, v if v is not None else 0) for v in row)
        ours = sorted((tuple(tidy(r[c]) for c in columns) for r in df.collect()), key=key)
        theirs = sorted((tuple(tidy(r[names.index(c)]) for c in columns) for r in rows), key=key)
        assert ours == theirs

    return check
