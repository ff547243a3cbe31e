"""Embedding near-dedup as an exact metric range join: pivots, triangle inequality, independent cells.

Only vectors of one group (equal, not null labels; equal dimension) are compared. Cosine >= c on unit
vectors is Euclidean distance <= eps = sqrt(2 - 2c), a metric. Equal vectors of a group form one
class with a weight, found by an aggregation, so copies cost nothing further.

Pivots are drawn by hash, about one for ``CELL_ROWS`` classes and at most ``MAX_PIVOTS`` in all: the
only thing that is broadcast, and of bounded size. A vector's home is the cell of its nearest pivot.
If x has home i and y is within eps of x, the triangle inequality gives d(y, p_i) <= d(y, p_k) + 2 eps
for every pivot k, and in Euclidean space d(y, p_i)^2 - d(y, p_k)^2 <= 2 eps d(p_i, p_k). A vector is
replicated as a guest into every cell before its home that passes both tests, the second for the
pivots nearest to it; so each linked pair meets in exactly one cell, the earlier of their homes.

Cells join independently. A cell is a grid of pairs of blocks of at most about ``BLOCK_ROWS`` vectors,
home against home and home against guests, and each pair of blocks is a unit of its own with a hash of
its own as shuffle key; a cell of any size is thus spread over tasks. A unit gives each vector its
number of links and, in place of all pairs, one link to its group's first vector inside the unit.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those
with a null label, link with nothing; a null vec_id counts as the largest id and is returned as
null; repeated rows are vectors of their own that link with each other, and rows that share a vec_id
share a component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield import scratch
from nearfield.functions import arrow as A
from nearfield.llm import vectors as vec
from nearfield.llm.components import components

CELL_ROWS = 2048
MAX_PIVOTS = 2048
BLOCK_ROWS = 1024
#: Pivots whose bounds a vector is tested against, and distances to pivots that are held at once.
NEAR_PIVOTS, ROUTE_CELLS = 16, 2_000_000
#: Slack on bounds, far above rounding errors of unit vectors.
SLACK = 1e-9
KEY = ["grp", "h1", "h2"]
ROUTED = "grp long, cell int, id long, w long, guest boolean, v binary"


def _grouped(df: DataFrame) -> DataFrame:
    """id, v, grp, h1, h2 of the vectors that take part."""
    rows = vec.usable_rows(df, "vec_id", "embedding", "label").filter("label is not null")
    return rows.select("id", "v", F.xxhash64("label", F.size("v")).alias("grp"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))


def pivot_table(classes: DataFrame) -> dict[int, list[np.ndarray]]:
    """The pivots of each group that has more than one; at most about MAX_PIVOTS vectors come to the driver."""
    sizes = classes.groupBy("grp").agg(F.count("*").alias("n"))
    total = classes.count()
    per = max(CELL_ROWS, math.ceil(total / MAX_PIVOTS))
    large = scratch.materialize(sizes.filter(F.col("n") > per).select("grp", F.ceil(F.col("n") / per).alias("k"), "n"), "large_groups")
    drawn = classes.join(scratch.small_side(large), "grp").withColumn("u", F.xxhash64(F.lit(7), "h1", "h2").cast("double") / 2.0**64 + 0.5)
    drawn = drawn.filter(F.col("u") < F.col("k") / F.col("n"))
    out: dict[int, list[np.ndarray]] = {}
    for row in drawn.select("grp", "v", "id").orderBy("grp", "id").toLocalIterator():
        out.setdefault(row["grp"], []).append(vec.unit(np.array([row["v"]]))[0])
    return out


def route(pivots: dict[int, list[np.ndarray]], eps: float):
    """mapInArrow function: each class in its home cell and, as a guest, in earlier cells that may hold a neighbour."""
    tables = {g: np.array(p) for g, p in pivots.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = {g: np.sqrt(np.maximum(0, 2 - 2 * p @ p.T)) for g, p in tables.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            grp, ids, w = (A.long_values(batch.column(c)) for c in ("grp", "id", "w"))
            for rows, matrix in A.matrices(batch.column("v")):
                matrix = vec.unit(matrix)
                for g in np.unique(grp[rows]):
                    here = grp[rows] == g
                    m, own = matrix[here], rows[here]
                    if g in tables:
                        home, at, cell = _cells_of(m, tables[g], apart[g], eps)
                        at, cell = np.concatenate((np.arange(len(m)), at)), np.concatenate((home, cell))
                    else:
                        at, cell = np.arange(len(m)), np.zeros(len(m), int)
                    guest = np.arange(len(at)) >= len(m)
                    for lo in range(0, len(at), 20_000):
                        s = slice(lo, lo + 20_000)
                        src = own[at[s]]
                        yield pa.record_batch([pa.array(np.full(len(src), g)), pa.array(cell[s].astype(np.int32)), pa.array(ids[src]), pa.array(w[src]), pa.array(guest[s]), A.binaries(m[at[s]])], names=["grp", "cell", "id", "w", "guest", "v"])

    return run


def _cells_of(m: np.ndarray, pivots: np.ndarray, apart: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Homes of unit vectors, and their guest cells as (row, cell); steps are of bounded size.

    The bound by d(p_i, p_k) is tested for the NEAR_PIVOTS pivots k nearest to a vector, where it cuts
    most; each test alone is necessary for a link, so fewer tests only make more guests.
    """
    homes, rows, cells = [], [], []
    step = max(1, ROUTE_CELLS // len(pivots))
    few = min(NEAR_PIVOTS, len(pivots))
    for lo in range(0, len(m), step):
        near = np.maximum(0, 2 - 2 * m[lo : lo + step] @ pivots.T)
        home = near.argmin(axis=1)
        least = np.sqrt(near[np.arange(len(near)), home]) + 2 * eps + SLACK
        row, cell = np.nonzero((near <= (least * least)[:, None]) & (np.arange(len(pivots)) < home[:, None]))
        closest = np.argpartition(near, few - 1, axis=1)[:, :few]
        ok = np.ones(len(row), bool)
        for k in closest.T:
            ok &= near[row, cell] - near[row, k[row]] <= 2 * eps * apart[cell, k[row]] + SLACK
        homes.append(home)
        rows.append(row[ok] + lo)
        cells.append(cell[ok])
    return np.concatenate(homes), np.concatenate(rows), np.concatenate(cells)


def units(routed: DataFrame) -> DataFrame:
    """Rows of ``routed`` dealt to units: unit, side (0, 1), same, id, w, v. Each unit is one pair of blocks of a cell."""
    count = routed.groupBy("grp", "cell").agg(
        F.ceil(F.count(F.when(~F.col("guest"), 1)) / BLOCK_ROWS).cast("int").alias("homes"), F.ceil(F.count(F.when(F.col("guest"), 1)) / BLOCK_ROWS).cast("int").alias("guests")
    )
    count = scratch.materialize(count.filter("homes > 0"), "cells")
    rows = routed.join(scratch.small_side(count), ["grp", "cell"])
    blocks = F.when(F.col("guest"), F.col("guests")).otherwise(F.col("homes"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "id", "v"), blocks).cast("int"))
    others = F.when(F.col("guest"), F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda h: F.struct(h.alias("i"), F.col("block").alias("j"), F.lit(True).alias("g"), F.lit(1).alias("side"))))
    homes = F.transform(
        F.sequence(F.lit(0), F.col("homes") - 1),
        lambda h: F.struct(F.least(h, F.col("block")).alias("i"), F.greatest(h, F.col("block")).alias("j"), F.lit(False).alias("g"), (h < F.col("block")).cast("int").alias("side")),
    )
    guests = F.transform(F.sequence(F.lit(0), F.col("guests") - 1), lambda h: F.struct(F.col("block").alias("i"), h.alias("j"), F.lit(True).alias("g"), F.lit(0).alias("side")))
    own = F.concat(homes, F.when(F.col("guests") > 0, guests).otherwise(F.array().cast("array<struct<i:int,j:int,g:boolean,side:int>>")))
    rows = rows.select("grp", "cell", "id", "w", "v", F.explode(F.coalesce(others, own)).alias("u"))
    same = ~F.col("u.g") & (F.col("u.i") == F.col("u.j"))
    return rows.select(F.xxhash64("grp", "cell", "u.i", "u.j", "u.g").alias("unit"), F.col("u.side").alias("side"), same.alias("same"), "id", "w", "v")


def join_unit(least: float):
    """Links inside one unit: id, links (weighted number of linked vectors), first (a vector of its group in the unit)."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, w, side = (A.long_values(A.chunk(table, c)) for c in ("id", "w", "side"))
        matrix = A.from_binaries(A.chunk(table, "v"))
        if table.column("same")[0].as_py():
            left = right = np.arange(len(ids))
            close = matrix @ matrix.T >= least
            np.fill_diagonal(close, False)
        else:
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            close = matrix[left] @ matrix[right].T >= least
        rows, cols = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
        if not len(rows):
            return
        close, left, right = close[np.ix_(rows, cols)], left[rows], right[cols]
        links = np.zeros(len(ids), np.int64)
        links[left] += close @ w[right]
        if not table.column("same")[0].as_py():
            links[right] += w[left] @ close
        label = ids.copy()
        while True:
            label_left = np.minimum(label[left], np.where(close, label[right], vec.LAST_ID).min(axis=1))
            moved = bool((label_left < label[left]).any())
            label[left] = label_left
            label_right = np.minimum(label[right], np.where(close, label[left][:, None], vec.LAST_ID).min(axis=0))
            moved |= bool((label_right < label[right]).any())
            label[right] = label_right
            if not moved:
                break
        out = np.unique(np.concatenate((left, right)))
        yield pa.record_batch([pa.array(ids[out]), pa.array(links[out]), pa.array(label[out])], names=["id", "links", "first"])

    return work


def near_vectors(df: DataFrame, cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``df`` (vec_id, embedding, label)."""
    rows = scratch.materialize(_grouped(df), "vectors")
    reps = rows.groupBy(*KEY).agg(F.min("id").alias("id"), F.count("*").alias("w"), F.any_value("v").alias("v"))
    reps = scratch.materialize(reps, "classes")
    eps = math.sqrt(max(0.0, 2 - 2 * cosine))
    routed = scratch.materialize(reps.select("grp", "id", "w", "v").mapInArrow(route(pivot_table(reps), eps), ROUTED), "routed")
    dealt = units(routed).repartition("unit").sortWithinPartitions("unit")
    found = scratch.materialize(dealt.mapInArrow(A.by_key("unit", join_unit(cosine)), "id long, links long, first long"), "found")
    groups = components(found.select(F.col("id").alias("a"), F.col("first").alias("b")))
    linked = found.groupBy("id").agg(F.sum("links").alias("links")).join(groups, "id", "left")
    named = reps.select(*KEY, F.col("id").alias("rep"), "w").join(linked.withColumnRenamed("id", "rep"), "rep", "left")
    named = scratch.materialize(named.select(*KEY, "rep", "w", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component")), "named")
    every = df.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(vec.LAST_ID)).alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    keyed = every.select("id", F.when(vec.usable(F.col("v")) & F.col("label").isNotNull(), F.xxhash64("label", F.size("v"))).alias("grp"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    out = keyed.join(scratch.small_side(named), KEY, "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.nullif(F.col("id"), F.lit(vec.LAST_ID)).alias("vec_id"), F.coalesce(F.col("w") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
        F.nullif(component, F.lit(vec.LAST_ID)).alias("component_id"), (F.col("id") == component).alias("kept"),
    )
