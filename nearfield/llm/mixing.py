"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Every source has a target number of words. A document's expected copies are its source's target
over the source's words (times its own weight, if one is given). The whole part is allocated for
certain; the rest is its inclusion odds in a Pareto order sample: documents are ranked by random
odds U/(1-U) divided by inclusion odds p/(1-p), and the lowest ranks are taken until the words
that remain to the target are filled, so the sample's size is fixed and its probabilities are not
equal. U is a hash of doc_id and seed: reruns agree.

The running sum by rank never gathers a source in one task. Ranks lie in (0, 1) as key = q/(1+q);
words are first summed by source and rank bin, and only the one bin where a source's sum crosses its
target is ordered row by row.

Defined results: a null or empty text has size 0 and is never taken (taken 0); a source without
words has target 0; the null source is a source, last in order; repeated rows are documents of their
own that share a random number; a null doc_id's random number comes from its text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield import scratch

WORD = r"[^\x20\x09-\x0D]+"
RANK_BINS = 4096
#: Rank order within a source.
ORDER = ("_key", "doc_id", "size", "key")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(doc_id: Column, text: Column) -> Column:
    """What a document's random number depends on: its doc_id, or its text where that is null."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("null "), F.coalesce(F.md5(text), F.lit(""))))


def uniform(key: Column, seed: str = "") -> Column:
    """52 bits of MD5 as a number strictly between 0 and 1."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """source, source_size, target: weights go to sources in code-point order, null last, and repeat.

    ``share`` of all words is divided by weight; a target stops at ``max_repeats`` times its source's
    size and the excess is divided anew until none is above. In closed form: with sources by cap over
    weight, those below the common level are capped. One row per source goes through one task here.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), turn + 1)
    rows = total.select("source", "source_size", weight.alias("weight")).withColumn("cap", F.col("source_size") * max_repeats)
    everyone = Window.partitionBy()
    part = Fraction(str(share))
    rows = rows.withColumn("all_words", F.sum("source_size").over(everyone) * part.numerator / part.denominator).withColumn("all_weight", F.sum("weight").over(everyone))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("cap_before", F.coalesce(F.sum("cap").over(order), F.lit(0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(order), F.lit(0)))
    capped = F.col("cap") * (F.col("all_weight") - F.col("weight_before")) < F.col("weight") * (F.col("all_words") - F.col("cap_before"))
    rows = rows.withColumn("capped", capped)
    used = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everyone)
    left = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(everyone)
    level = F.when(left > 0, (F.col("all_words") - used) / left)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.coalesce(level * F.col("weight"), F.col("cap").cast("double")))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def _ranked(rows: DataFrame, max_repeats: int, seed: str) -> DataFrame:
    """Rows (key, size, target, _w, _mass) with _whole, the copies allocated for certain, and _key, the rank in (0, 1) of those with inclusion odds besides."""
    expected = F.when((F.col("size") > 0) & (F.col("_mass") > 0), F.least(F.lit(float(max_repeats)), F.col("_w") * F.col("target") / F.col("_mass"))).otherwise(0.0)
    rows = rows.withColumn("_e", expected).withColumn("_whole", F.floor("_e").cast("long")).withColumn("_p", F.col("_e") - F.col("_whole"))
    u = uniform(F.col("key"), seed)
    odds = (u / (1 - u)) * ((1 - F.col("_p")) / F.col("_p"))
    return rows.withColumn("_key", F.when(F.col("_p") > 0, odds / (1 + odds))).drop("_e", "_p")


def _decided(sized: DataFrame, targets: DataFrame, max_repeats: int, weight_col: str | None, seed: str) -> DataFrame:
    """Rows of ``sized`` with source_size, target, _mass, _whole, _key and _extra (1 for one more copy)."""
    weight = F.lit(1.0) if weight_col is None else F.coalesce(F.col(weight_col).cast("double"), F.lit(1.0))
    rows = sized.withColumn("_w", weight)
    mass = rows.groupBy("source").agg(F.sum(F.col("_w") * F.col("size")).alias("_mass"))
    t = targets.join(mass.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumnRenamed("source", "_source")
    t = scratch.small_side(scratch.materialize(t, "targets_and_mass"))
    rows = _ranked(rows.join(t, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source"), max_repeats, seed)
    rows = rows.withColumn("_bin", F.least(F.lit(RANK_BINS - 1), F.floor(F.col("_key") * RANK_BINS)).cast("int"))
    by_bin = rows.groupBy("source", "_bin").agg(F.sum(F.when(F.col("_key").isNotNull(), F.col("size")).otherwise(0)).alias("_words"), F.sum(F.col("_whole") * F.col("size")).alias("_sure"), F.max("target").alias("_t"))
    in_source = Window.partitionBy("source")
    upto = in_source.orderBy(F.asc_nulls_first("_bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_bin = by_bin.select(
        F.col("source").alias("_bs"), F.col("_bin").alias("_bb"), (F.sum("_words").over(upto) - F.col("_words")).alias("_from"), F.sum("_words").over(upto).alias("_to"), (F.col("_t") - F.sum("_sure").over(in_source)).alias("_rest"),
    )
    by_bin = scratch.small_side(scratch.materialize(by_bin, "bins"))
    rows = rows.join(by_bin, F.col("source").eqNullSafe(F.col("_bs")) & (F.col("_bin") == F.col("_bb")), "left")
    sure = F.col("_to") <= F.col("_rest")
    edge = (F.col("_from") < F.col("_rest")) & (F.col("_to") > F.col("_rest"))
    place = Window.partitionBy("source", "_bin").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_state", F.when(F.col("_key").isNull(), 0).when(sure, 1).when(edge, 2).otherwise(0))
    clear = rows.filter(F.col("_state") != 2).withColumn("_extra", F.col("_state"))
    ends = F.col("_from") + F.sum("size").over(place)
    crossing = rows.filter(F.col("_state") == 2).withColumn("_extra", F.when(2 * ends - F.col("size") <= 2 * F.col("_rest"), 1).otherwise(0))
    return clear.unionByName(crossing).drop("_w", "_bin", "_bs", "_bb", "_from", "_to", "_rest", "_state")


def pareto_mix(sized: DataFrame, targets: DataFrame, max_repeats: int = 3, weight_col: str | None = None, seed: str = "") -> DataFrame:
    """Rows of ``sized`` (doc_id, key, source, size) with source_size, target, copies and taken = copies * size.

    With ``weight_col`` (positive; null counts as 1) expected copies are proportional to it within a
    source, stopped at ``max_repeats``; a source then falls short of its target only where every
    document with inclusion odds is taken. ``targets`` has one row per source, and the sums by bin at
    most RANK_BINS; either is broadcast if it is measured to be small.
    """
    out = _decided(sized, targets, max_repeats, weight_col, seed).withColumn("copies", (F.col("_whole") + F.col("_extra")).cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop("_mass", "_whole", "_key", "_extra")


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, key, source, size of every document, written once: texts are read a single time."""
    return scratch.materialize(docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), "source", word_count(F.col("text")).alias("size")), "sized")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_repeats: int = 3, seed: str = "") -> DataFrame:
    """doc_id, key, source, size, source_size, target, copies, taken for every document."""
    sized = sized_documents(docs)
    targets = scratch.materialize(source_targets(sized, weights, share, max_repeats), "targets")
    return pareto_mix(sized, targets, max_repeats, seed=seed)


def take_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_repeats: int = 3, seed: str = "") -> DataFrame:
    """Rows of ``docs``, each as often as the mix takes it, with their own columns.

    The sample is told by one row per source: its target, and the last place in rank order that is
    taken. A document's rank follows from its own row, so texts are not shuffled. Rows that agree in
    doc_id (or text, where that is null), source and size share a rank and are taken alike, as often as
    the one of them that is taken most.
    """
    sized = sized_documents(docs.select("doc_id", "source", "text"))
    targets = scratch.materialize(source_targets(sized, weights, share, max_repeats), "targets")
    last = F.max(F.when(F.col("_extra") == 1, F.struct(*ORDER))).alias("last")
    per_source = _decided(sized, targets, max_repeats, None, seed).groupBy("source").agg(F.max("target").alias("target"), F.max("_mass").alias("_mass"), last)
    per_source = scratch.small_side(scratch.materialize(per_source.withColumnRenamed("source", "_source"), "last_taken"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, "doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), "source", word_count(F.col("text")).alias("size"), F.lit(1.0).alias("_w"))
    rows = _ranked(rows.join(per_source, F.col("source").eqNullSafe(F.col("_source"))), max_repeats, seed)
    extra = F.when(F.col("_key").isNotNull() & F.col("last").isNotNull() & (F.struct(*ORDER) <= F.col("last")), 1).otherwise(0)
    rows = rows.select("row", (F.col("_whole") + extra).cast("int").alias("copies")).filter("copies > 0")
    rows = rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns])
