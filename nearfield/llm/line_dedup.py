"""Line dedup by distinct-site spread, in DataFrame functions only.

A line's spread is the number of distinct sites (``source``) it occurs on. Lines on at least
``min_sites`` sites are boilerplate and are removed, except from the first document (smallest
doc_id, then first place) that holds them, so that text copied to many sites is not lost everywhere.

A HyperLogLog sketch per line hash is kept in sparse form, one row per (line, register) with the
largest rank. Sketches merge by a max aggregation before and after the shuffle; no line's sketch has
more rows than registers, however many sites or copies it has. Lines whose estimate is within the
error band around the threshold get an exact distinct count; the others are decided by the estimate.

Lines are split at newlines and compared exactly, by two 64-bit hashes. Defined results: blank lines
are never counted nor removed; a null source is a site of its own; a null text has no lines and
stays null; rows are told apart by doc_id and text, so repeated rows share decisions; a null doc_id
sorts first; an empty table gives no rows; every input column is returned as it came.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield import scratch
from nearfield.llm.sieve import flagged

PRECISION = 12
LINE = ["h1", "h2"]


def line_table(docs: DataFrame) -> DataFrame:
    """h1, h2, site, reg, rank, doc_id, th, pos: one row for every line that is not blank."""
    site = F.xxhash64(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")))
    tail = F.shiftrightunsigned(site, PRECISION)
    width = 64 - PRECISION
    rank = F.when(tail == 0, width + 1).otherwise(width - F.floor(F.log2(tail.cast("double"))))
    base = docs.select(
        "doc_id", F.xxhash64("text").alias("th"), site.alias("site"), site.bitwiseAND(F.lit((1 << PRECISION) - 1)).cast("int").alias("reg"), rank.cast("int").alias("rank"),
        F.posexplode(F.split("text", "\n")).alias("pos", "line"),
    )
    solid = base.filter(F.trim(F.col("line")) != "")
    return solid.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), F.col("line")).alias("h2"), "site", "reg", "rank", "doc_id", "th", "pos")


def spread_estimates(lines: DataFrame) -> DataFrame:
    """h1, h2, estimate: the sparse sketches, merged and read out (linear counting while registers are free)."""
    m = float(1 << PRECISION)
    registers = lines.groupBy(*LINE, "reg").agg(F.max("rank").alias("rank"))
    read = registers.groupBy(*LINE).agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("z"), F.count("*").alias("used"))
    raw = (0.7213 / (1 + 1.079 / m)) * m * m / (m - F.col("used") + F.col("z"))
    linear = m * F.log(m / (m - F.col("used")))
    return read.select(*LINE, F.when((raw <= 2.5 * m) & (F.col("used") < m), linear).otherwise(raw).alias("estimate"))


def boilerplate_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """h1, h2 of the lines on at least ``min_sites`` distinct sites."""
    band = max(4.0, 6 * 1.04 / math.sqrt(1 << PRECISION) * min_sites)
    judged = scratch.materialize(spread_estimates(lines).filter(F.col("estimate") >= min_sites - band), "spread")
    clear = judged.filter(F.col("estimate") > min_sites + band).select(*LINE)
    near = judged.filter(F.col("estimate") <= min_sites + band).select(*LINE)
    pairs = lines.select(*LINE, "site").join(scratch.small_side(near), LINE, "left_semi").distinct()
    exact = pairs.groupBy(*LINE).count().filter(F.col("count") >= min_sites).select(*LINE)
    return clear.unionByName(exact)


def removals(docs: DataFrame, min_sites: int) -> DataFrame:
    """doc_id, th, removed: the places of the lines that go, one row per document that loses any."""
    lines = scratch.materialize(line_table(docs), "lines")
    boiler = scratch.materialize(boilerplate_lines(lines, min_sites), "boilerplate")
    hits = lines.select(*LINE, "doc_id", "th", "pos").join(scratch.small_side(boiler), LINE)
    place = F.struct("doc_id", "th", "pos")
    first = scratch.materialize(hits.groupBy(*LINE).agg(F.min(place).alias("first")), "first_lines")
    gone = hits.join(scratch.small_side(first), LINE).filter(~place.eqNullSafe(F.col("first")))
    return scratch.materialize(gone.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("removed")), "removed_lines")


def without_lines(text: Column, removed: Column) -> Column:
    kept = F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(removed, i))
    return F.when(removed.isNull(), text).otherwise(F.array_join(kept, "\n"))


def line_dedup(docs: DataFrame, min_sites: int = 10, stats: bool = False) -> DataFrame:
    """The documents without boilerplate lines. ``stats`` adds n_lines and n_removed (not blank, removed).

    Input columns travel as one struct, so none of their names can clash with the operator's own. Only
    texts that lose lines, and a few more that share a bit of the filter with them, are shuffled.
    """
    gone = removals(docs.select("doc_id", "text", "source"), min_sites).select(F.col("doc_id").alias("of"), F.col("th").alias("key"), "removed")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("of"), F.xxhash64("text").alias("key"))
    rows = flagged(rows, gone, ["of", "key"])
    side = gone.select(F.col("of").alias("id"), F.col("key").alias("th"), "removed").hint("merge")
    some = rows.filter("_may").join(side, F.col("of").eqNullSafe(F.col("id")) & (F.col("key") == F.col("th")), "left").select("row", "removed")
    rows = some.unionByName(rows.filter("not _may").select("row", F.lit(None).cast("array<int>").alias("removed")))
    text = F.col("row.text")
    own = [without_lines(text, F.col("removed")).alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    if stats:
        solid = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.trim(line) != ""))
        own += [solid.cast("long").alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed")]
    return rows.select(*own)
