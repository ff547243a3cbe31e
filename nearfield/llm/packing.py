"""Best-fit packing of tokenised documents, after Martello-Toth dominance reduction.

Documents are tokenised once; a piece is a whole document or a capacity-sized part of a longer one.
Packing needs only how many pieces have each length, at most ``capacity`` numbers, whatever the
number of documents. On that histogram:

1. Reduction: a small set of pieces is fixed as one sequence for good, and leaves the instance, if it
   dominates every alternative for its largest piece: a full piece alone; two pieces that fill a
   sequence exactly; a piece with the largest that fits, if no two others would fit; a piece with
   the largest fitting two, if no three others would fit and the second bounds every other second.
2. The remainder is packed best-fit decreasing, for all pieces of a length at once: sequences of
   equal content are one pattern with a multiplicity, so the work follows the number of lengths.

Each pattern's places become ranges of ranks among the pieces of a length. Ranks are counted by
length and salt first, so that pieces of one length, however many, are numbered in many tasks.

Defined results: a null text is empty; an empty text is one piece holding the end token; null and
repeated doc_ids are kept as they are, each row being a document; an empty table gives no rows;
other columns are ignored. Only documents longer than the capacity are cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield import scratch
from nearfield.functions import arrow as A
from nearfield.llm import textbatch as tb
from nearfield.llm.wordbpe import WordBpe

CAPACITY = 2048
END_ID = 0
#: Pieces of one length that are numbered in one task.
RANK_ROWS = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


_encoders: dict[str, WordBpe] = {}


def cut_pieces(path: str, capacity: int):
    """mapInArrow function: the pieces of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = WordBpe(path)
        encoder, end = _encoders[path], np.array([END_ID], np.uint32)
        for batch in batches:
            data, offsets = tb.as_bytes(batch.column("text"))
            for lo, hi in tb.steps(offsets):
                ids, upto = encoder.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                total = np.diff(upto) + 1
                pieces = -(-total // capacity)
                owner = np.repeat(np.arange(hi - lo), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, total[owner] - start)
                crc = np.empty(len(owner), np.int64)
                for i, (d, s, n) in enumerate(zip(owner, start, length, strict=True)):
                    own = ids[upto[d] + s : min(upto[d] + s + n, upto[d + 1])]
                    crc[i] = zlib.crc32(end, zlib.crc32(own)) if len(own) < n else zlib.crc32(own)
                doc = batch.column("doc_id").slice(lo, hi - lo).take(pa.array(owner))
                yield pa.record_batch([doc, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def reduce_instance(count: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Dominating sets, as (lengths, times); their pieces are taken from ``count`` (by length, changed in place)."""
    capacity, fixed = len(count) - 1, []

    def fix(*lengths: int) -> None:
        need = {s: lengths.count(s) for s in lengths}
        times = min(int(count[s]) // k for s, k in need.items())
        for s, k in need.items():
            count[s] -= k * times
        fixed.append((lengths, times))

    def largest(limit: int, *used: int) -> int:
        """The largest length up to ``limit`` that is there, besides the pieces used; 0 if none."""
        for s in present[np.searchsorted(present, limit, side="right") - 1 :: -1] if limit >= present[0] else ():
            if count[s] > used.count(int(s)):
                return int(s)
        return 0

    if count[capacity]:
        fix(capacity)
    for s in range(capacity // 2, 0, -1):
        if count[s] and count[capacity - s] and (2 * s < capacity or count[s] > 1):
            fix(capacity - s, s)
    while True:
        present = np.flatnonzero(count)
        if not len(present):
            return fixed
        top = int(present[-1])
        small = [int(s) for s in present[:3] for _ in range(min(3, int(count[s]) - (s == top)))][:3]
        one = largest(capacity - top, top)
        if not one:
            fix(top)
        elif len(small) < 2 or top + small[0] + small[1] > capacity:
            fix(top, one)
        elif len(small) < 3 or top + sum(small) > capacity:
            two = largest(capacity - top - one, top, one)
            half = largest((capacity - top) // 2, top, one)
            if not two or two < half:
                return fixed
            fix(top, one, two)
        else:
            return fixed


def best_fit(count: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing of a histogram: patterns (lengths) with multiplicities."""
    capacity = len(count) - 1
    open_: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    for s in range(capacity, 0, -1):
        left = int(count[s])
        room = s
        while left:
            while room < capacity and not open_[room]:
                room += 1
            if room >= capacity:
                pattern, bins, room_now = (), -(-left // (capacity // s)), capacity
            else:
                (pattern, bins), room_now = open_[room].pop(), room
            per = room_now // s
            full = min(bins, left // per)
            if full:
                open_[room_now - per * s].append((pattern + (s,) * per, full))
                left, bins = left - full * per, bins - full
            if left and bins:
                open_[room_now - left * s].append((pattern + (s,) * left, 1))
                left, bins = 0, bins - 1
            if bins and pattern:
                open_[room_now].append((pattern, bins))
    return [x for group in open_ for x in group]


def slot_table(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first rank of each place, its first sequence and its offset."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for s in lengths:
            rows.setdefault(s, []).append((taken.get(s, 0), sequence, offset))
            taken[s] = taken.get(s, 0) + times
            offset += s
        sequence += times
    return {s: tuple(np.array(x, np.int64).T) for s, x in rows.items()}


def seat(slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """mapInArrow function: sequence_id and offset from length and rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (A.long_values(batch.column(c)) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(length):
                here = length == s
                from_rank, from_sequence, place = slots[int(s)]
                at = np.searchsorted(from_rank, rank[here], side="right") - 1
                sequence[here] = from_sequence[at] + rank[here] - from_rank[at]
                offset[here] = place[at]
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return run


def pack_lengths(count: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns for a histogram by length (index 0 unused)."""
    count = count.copy()
    return [x for x in reduce_instance(count) + best_fit(count) if x[1]]


def best_fit_pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of ``docs`` (doc_id, text)."""
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(A.frugal(cut_pieces(tokenizer_path, capacity)), PIECES)
    pieces = scratch.materialize(pieces, "pieces", scratch.TEXT_ROWS)
    sizes = pieces.groupBy("length").agg(F.count("*").alias("n"))
    count = np.zeros(capacity + 1, np.int64)
    for row in sizes.collect():
        count[row["length"]] = row["n"]
    slots = slot_table(pack_lengths(count))
    salts = {int(s): int(-(-count[s] // RANK_ROWS)) for s in np.flatnonzero(count > RANK_ROWS)}
    salt = F.lit(0)
    if salts:
        by_length = F.create_map(*[F.lit(x) for pair in salts.items() for x in pair])
        salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.coalesce(by_length[F.col("length").cast("int")], F.lit(1))).cast("int")
    salted = pieces.withColumn("salt", salt)
    upto = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")
    first = scratch.materialize(first, "first_ranks")
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("at", F.row_number().over(order)).join(scratch.small_side(first), ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("at") - 1)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(seat(slots), PIECES + ", sequence_id long, offset long")
