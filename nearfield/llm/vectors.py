"""Vector columns: which vectors take part, and unit vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAST_ID = 2**63 - 1


def usable(vector: Column) -> Column:
    """True unless the vector is null, empty, zero or holds a null, NaN or infinite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def usable_rows(df: DataFrame, id_col: str, vector_col: str, *others: str) -> DataFrame:
    """id (null becomes the largest), v (array of doubles) and the other columns, of the rows that take part."""
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), *others)
    return rows.filter(usable(F.col("v")))


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow or underflow."""
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
