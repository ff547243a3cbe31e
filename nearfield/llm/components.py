"""Connected components of a link table by smallest labels and pointer jumping.

Each round gives every vertex the smallest label among itself and its neighbours, by an aggregation
that is combined before the shuffle, and then the label of that label. At the fixed point the labels
of neighbours agree, so a label is the smallest id of its component. Labels of earlier rounds are ids
of the vertex's own component, too, so stopping early joins no two components. Neither a vertex with
very many links nor a large component meets in one task. Links stay distributed, and each round is
written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield import scratch


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """id, component for every id in ``links`` (two integer columns a, b; order and repeats don't matter).

    The component is the smallest id reachable; with ``rounds``, the smallest found in that many.
    """
    arcs = links.filter("a <> b").select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")), F.struct(F.col("a").alias("x"), F.col("a").alias("y")), F.struct(F.col("b").alias("x"), F.col("b").alias("y")))).alias("e"))
    arcs = scratch.materialize(arcs.select("e.x", "e.y").distinct(), "links")
    labels = arcs.groupBy("x").agg(F.min("y").alias("label")).withColumn("before", F.col("x"))
    turn = 0
    while True:
        labels = scratch.materialize(labels, "labels")
        turn += 1
        if labels.filter("label < before").isEmpty() or turn == rounds:
            return labels.select(F.col("x").alias("id"), F.col("label").alias("component"))
        onward = labels.select(F.col("x").alias("label"), F.col("label").alias("further"))
        jumped = labels.select("x", "label").join(scratch.small_side(onward), "label").select(F.col("x").alias("y"), F.col("further").alias("l"))
        jumped = scratch.materialize(jumped, "jumped")
        own = F.max(F.when(F.col("x") == F.col("y"), F.col("l"))).alias("before")
        labels = arcs.join(scratch.small_side(jumped), "y").groupBy("x").agg(F.min("l").alias("label"), own)
