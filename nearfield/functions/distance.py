"""Distance expressions over ``array<double>`` columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)


def mean_of(total: Column, n: Column) -> Column:
    return F.transform(total, lambda x: x / n)
