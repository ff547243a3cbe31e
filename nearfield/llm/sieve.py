"""Bit filters of bounded size that tell rows which cannot match, so that they need no shuffle; DataFrame functions only.

A filter has ``BITS`` bits, one by hash for each key, gathered by an aggregation into at most
``BITS`` / 64 rows, which are broadcast. A row whose bit is not set has no partner. With very many
keys most bits are set and most rows may match; results never depend on it, since a join follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield import scratch

BITS = 1 << 22


def flagged(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with a boolean ``_may``: false if no row of ``keys`` agrees in the columns ``on``, which hold no nulls."""
    slot = F.pmod(F.xxhash64(*on), F.lit(BITS)).alias("_slot")
    words = keys.select(slot).groupBy(F.shiftright("_slot", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_slot % 64 as int))")).alias("_mask"))
    words = F.broadcast(scratch.materialize(words, "bits"))
    out = rows.select("*", slot).join(words, F.shiftright("_slot", 6) == F.col("_word"), "left")
    may = F.coalesce(F.getbit("_mask", (F.col("_slot") % 64).cast("int")) == 1, F.lit(False))
    return out.withColumn("_may", may).drop("_slot", "_word", "_mask")
