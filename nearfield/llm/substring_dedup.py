"""Substring dedup by relative Lempel-Ziv parsing against an index of every document's blocks.

Words are maximal runs of bytes other than space and 0x09-0x0D. A *window* is ``length`` consecutive
words of one document. A word is removed if a window that covers it also starts in a document with
a smaller doc_id; windows are judged on the input.

The reference index. Every window belongs to the first smallest of the ``ANCHOR_WORDS``-word hashes
inside it, its anchor, which depends on the window's words alone. Consecutive windows with one
anchor form a block, so a text of n words has about n/18 blocks and equal passages have equal blocks
but for their two ends. The index has each distinct block with the smallest doc_id that holds it.

The parse. Every place of a document that may continue a copy is looked up in the index: a block that
a smaller document holds has its reference there (document, text and place); any other block whose
anchor occurs in another document lies at a factor's boundary, and there its windows are looked up
one by one among the windows of all distinct blocks with that anchor. Then the document is factored
greedily from left to right: a factor begins at the first place with a reference and goes on for as
long as the next place's reference is the next place of the same reference text; where that ends, the
next factor begins, one word further on, with a reference of its own. A factor (start, length, doc,
th, at) is thus a copy of ``length`` words or more from one place of one smaller document, and is a
duplicate span; shorter copies are literals. Since the windows at factor boundaries are looked up,
too, factors overlap there and no window is skipped, whatever reference it comes from.

Each lookup is an aggregation to the smallest reference per key, combined before the shuffle, and an
equi-join back: no pairs of documents are made, so a passage in very many documents costs one row
per block and document. Keys are two 64-bit hashes (anchor, and block or window).

Defined results: a null text has no words and becomes an empty text; a null doc_id counts as the
largest; rows with the same doc_id are one document's rows and never duplicate each other; repeated
rows share decisions; an empty table gives no rows; other columns are returned as they came.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield import scratch
from nearfield.functions import arrow as A
from nearfield.llm import textbatch as tb
from nearfield.llm.sieve import flagged

WINDOW_WORDS = 50
ANCHOR_WORDS = 16
LAST_ID = 2**63 - 1
DOC = ["doc", "th"]
BLOCK = "doc long, th long, a long, b long, start int, n int"
PROBE = "a long, b long, doc long, j int, w long"
FACTORS = "doc long, th long, factors array<struct<start: int, length: int, doc: long, th: long, at: int>>"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64("text").alias("th"), "text")


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def block_table(length: int):
    """mapInArrow function: one row for each block of each text."""
    width = length - ANCHOR_WORDS + 1

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, th = (A.long_values(batch.column(c)) for c in DOC)
            data, offsets = tb.as_bytes(batch.column("text"))
            for lo, hi in tb.steps(offsets):
                part = data[offsets[lo] : offsets[hi]]
                starts, ends, first = tb.word_bounds(part, offsets[lo : hi + 1] - offsets[lo])
                if len(starts) < length:
                    continue
                words = tb.word_hashes(part, starts, ends)
                grams = tb.run_hashes(words, ANCHOR_WORDS)
                at = tb.leftmost_argmin(grams, width)
                owner = np.repeat(np.arange(hi - lo), np.diff(first))[: len(at)]
                valid = np.flatnonzero(np.arange(len(at)) + length <= first[owner + 1])
                if not len(valid):
                    continue
                at, owner = at[valid], owner[valid]
                begins = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 0) | (np.diff(owner) != 0))))
                count = np.diff(np.append(begins, len(valid)))
                start, anchor, whose = valid[begins], at[begins], owner[begins]
                body = tb.Runs(words).hashes(start, start + count + length - 1)
                body = tb.mix(body + ((anchor - start) * 4096 + count).astype(np.uint64))
                yield pa.record_batch(
                    [pa.array(doc[lo + whose]), pa.array(th[lo + whose]), _signed(grams[anchor]), _signed(body), pa.array((start - first[whose]).astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["doc", "th", "a", "b", "start", "n"],
                )

    return blocks


def window_table(length: int):
    """mapInArrow function: a, b, doc, j (place in the block), w for each window of the listed blocks of a text."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = tb.as_bytes(batch.column("text"))
            lists = batch.column("blocks")
            counts = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            a, b, start, n = (A.long_values(flat.field(k)) for k in range(4))
            doc = A.long_values(batch.column("doc"))
            upto = np.concatenate(([0], np.cumsum(counts)))
            for lo, hi in tb.steps(offsets):
                part = data[offsets[lo] : offsets[hi]]
                starts, ends, first = tb.word_bounds(part, offsets[lo : hi + 1] - offsets[lo])
                own = slice(upto[lo], upto[hi])
                whose = np.repeat(np.arange(hi - lo), counts[lo:hi])
                size = n[own]
                if not len(size):
                    continue
                j = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                place = np.repeat(first[whose] + start[own], size) + j
                w = tb.Runs(tb.word_hashes(part, starts, ends)).hashes(place, place + length)
                yield pa.record_batch(
                    [*(pa.array(np.repeat(x, size)) for x in (a[own], b[own], doc[lo + whose])), pa.array(j.astype(np.int32)), _signed(w)],
                    names=["a", "b", "doc", "j", "w"],
                )

    return windows


def references(docs: DataFrame, length: int = WINDOW_WORDS) -> DataFrame:
    """doc, th, start, n, ref: runs of n windows of a document from ``start`` on, and the place in a smaller document that they copy."""
    keyed = _keyed(docs)
    blocks = scratch.materialize(keyed.filter("text is not null").mapInArrow(A.frugal(block_table(length)), BLOCK), "blocks", scratch.TEXT_ROWS)
    seen = blocks.groupBy("a").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min("b").alias("b1"), F.max("b").alias("b2"))
    shared = scratch.materialize(seen.filter("lo < hi").select("a", "lo", (F.col("b1") != F.col("b2")).alias("mixed")), "anchors")
    found = scratch.materialize(_matching(blocks, shared, ["a"]), "found_blocks")
    place = F.struct("doc", "th", F.col("start").alias("at"))
    plain = found.filter("not mixed")
    first = scratch.materialize(plain.filter("doc = lo").groupBy("a").agg(F.min(place).alias("ref")), "first_places")
    whole = plain.filter("doc > lo").select("a", *DOC, "start", "n").join(scratch.small_side(first), "a").select(*DOC, "start", "n", "ref")
    mixed = found.filter("mixed").drop("mixed", "lo")
    index = scratch.materialize(mixed.groupBy("a", "b").agg(F.min(F.struct(*DOC, F.col("start").alias("at"), "n")).alias("r")), "index")
    ends = scratch.materialize(_boundary_windows(keyed, index, length).groupBy("a", "b", "doc").agg(F.collect_list(F.struct("j", "ref")).alias("ends")), "ends")
    places = scratch.materialize(index.select("a", "b", F.struct("r.doc", "r.th", "r.at").alias("m")), "places")
    held = mixed.join(scratch.small_side(places), ["a", "b"])
    copied = held.filter("doc > m.doc").select(*DOC, "start", "n", F.col("m").alias("ref"))
    edges = mixed.join(scratch.small_side(ends), ["a", "b", "doc"]).select(*DOC, "start", F.explode("ends").alias("e"))
    edges = edges.select(*DOC, (F.col("start") + F.col("e.j")).alias("start"), F.lit(1).alias("n"), F.col("e.ref").alias("ref"))
    return whole.unionByName(copied).unionByName(edges)


def _matching(rows: DataFrame, side: DataFrame, on: list[str]) -> DataFrame:
    """An inner join with a materialized side; if that is too large to broadcast, a bit filter keeps most rows without a partner out of the shuffle."""
    if scratch.is_small(side):
        return rows.join(side.hint("broadcast"), on)
    return flagged(rows, side, on).filter("_may").drop("_may").join(side.hint("merge"), on)


def _boundary_windows(keyed: DataFrame, index: DataFrame, length: int) -> DataFrame:
    """a, b, doc, j, ref: the windows (place j) of distinct blocks, by their first document, that a smaller one holds in another block of the anchor."""
    listed = index.groupBy(F.col("r.doc").alias("doc"), F.col("r.th").alias("th")).agg(F.collect_list(F.struct("a", "b", F.col("r.at").alias("start"), "r.n")).alias("blocks"))
    listed = scratch.materialize(listed, "listed")
    probes = _matching(keyed, listed, DOC).select("doc", "text", "blocks").mapInArrow(A.frugal(window_table(length)), PROBE)
    probes = scratch.materialize(probes, "probes", scratch.TEXT_ROWS)
    least = probes.groupBy("a", "w").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("a", "w", "lo")
    met = scratch.materialize(_matching(probes, scratch.materialize(least, "shared"), ["a", "w"]), "shared_windows")
    source = met.filter("doc = lo").groupBy("a", "w").agg(F.min(F.struct("b", "j")).alias("s")).select("a", "w", F.col("s.b").alias("b0"), F.col("s.j").alias("j0"))
    source = source.join(scratch.small_side(index.select("a", F.col("b").alias("b0"), "r")), ["a", "b0"])
    source = source.select("a", "w", F.struct("r.doc", "r.th", (F.col("r.at") + F.col("j0")).alias("at")).alias("ref"))
    return met.filter("lo < doc").select("a", "b", "doc", "j", "w").join(scratch.small_side(scratch.materialize(source, "sources")), ["a", "w"]).select("a", "b", "doc", "j", "ref")


def parse(length: int):
    """mapInArrow function: the greedy factors of each document from its referenced places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("places")
            flat = lists.flatten()
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            start, n = (A.long_values(flat.field(k)) for k in range(2))
            doc, th, at = (A.long_values(flat.field(2).field(k)) for k in range(3))
            goes_on = np.zeros(len(owner), bool)
            end = start + n
            goes_on[1:] = (owner[1:] == owner[:-1]) & (start[1:] == end[:-1]) & (doc[1:] == doc[:-1]) & (th[1:] == th[:-1]) & (at[1:] == at[:-1] + n[:-1])
            first = np.flatnonzero(~goes_on)
            last = np.append(first[1:], len(owner)) - 1
            size = end[last] - start[first] + length - 1
            parts = [pa.array(x.astype(np.int32)) for x in (start[first], size)] + [pa.array(doc[first]), pa.array(th[first]), pa.array(at[first].astype(np.int32))]
            factors = pa.StructArray.from_arrays(parts, ["start", "length", "doc", "th", "at"])
            yield pa.record_batch([batch.column("doc"), batch.column("th"), tb.list_array(np.bincount(owner[first], minlength=batch.num_rows), factors)], names=["doc", "th", "factors"])

    return run


def factors(docs: DataFrame, length: int = WINDOW_WORDS) -> DataFrame:
    """doc, th, factors: the duplicate factors of each document that has any, left to right, as (start, length, doc, th, at) in words.

    ``doc`` is the doc_id (null: the largest), ``th`` the text's hash; a factor's own doc, th and at
    name its reference.
    """
    places = references(docs, length).groupBy(*DOC).agg(F.sort_array(F.collect_set(F.struct("start", "n", "ref"))).alias("places"))
    return scratch.materialize(places.mapInArrow(A.frugal(parse(length)), FACTORS), "factors")


def cut():
    """Arrow UDF: text and factors to n_words, n_removed and the kept words joined by one space."""
    kind = "struct<n_words: bigint, n_removed: bigint, kept: string>"

    @F.arrow_udf(kind)
    def kept(text: pa.Array, spans: pa.Array) -> pa.Array:
        data, offsets = tb.as_bytes(text)
        counts = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = spans.flatten()
        start, n = (A.long_values(flat.field(k)) for k in range(2))
        upto = np.concatenate(([0], np.cumsum(counts)))
        out: list[pa.Array] = []
        for lo, hi in tb.steps(offsets):
            part = data[offsets[lo] : offsets[hi]]
            starts, ends, first = tb.word_bounds(part, offsets[lo : hi + 1] - offsets[lo])
            change = np.zeros(len(starts) + 1, np.int64)
            own = slice(upto[lo], upto[hi])
            begin = np.repeat(first[:-1], counts[lo:hi]) + start[own]
            np.add.at(change, begin, 1)
            np.add.at(change, begin + n[own], -1)
            gone = np.cumsum(change)[:-1] > 0
            owner = np.repeat(np.arange(hi - lo), np.diff(first))
            removed = np.bincount(owner[gone], minlength=hi - lo)
            left = tb.text_array(part, starts[~gone], ends[~gone], owner[~gone], hi - lo)
            out.append(pa.StructArray.from_arrays([pa.array(np.diff(first)), pa.array(removed.astype(np.int64)), left], ["n_words", "n_removed", "kept"]))
        fields = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
        found = pa.concat_arrays([x.cast(fields) for x in out]) if out else pa.array([], fields)
        A.give_back()
        return found

    return kept


def substring_dedup(docs: DataFrame, length: int = WINDOW_WORDS) -> DataFrame:
    """The documents as they came, with ``text`` cut and a struct ``dedup`` (n_words, n_removed, kept).

    ``dedup`` replaces an input column of that name.
    """
    found = factors(docs.select("doc_id", "text"), length)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64("text").alias("th"))
    if scratch.is_small(found):
        rows = rows.join(found.hint("broadcast"), DOC, "left")
    else:  # texts without factors are not shuffled
        rows = flagged(rows, found, DOC)
        none = F.lit(None).cast(found.schema["factors"].dataType).alias("factors")
        rows = rows.filter("not _may").select(*DOC, "row", none).unionByName(rows.filter("_may").join(found.hint("merge"), DOC, "left").select(*DOC, "row", "factors"))
    rows = rows.withColumn("cut", cut()(F.col("row.text"), F.col("factors")))
    own = [F.col("cut.kept").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c != "dedup"]
    return rows.select(*own, F.struct("cut.n_words", "cut.n_removed", "cut.kept").alias("dedup"))
