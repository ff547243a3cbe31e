"""MinHash near-dedup as a chosen-path set similarity join, with links confirmed on full sets.

A document's set holds the 64-bit hashes of its distinct five-word shingles (ASCII lower case; the
whole sequence if it has fewer words). Documents with equal sets form one class, found by an
aggregation, and only class representatives go on.

A representative carries ``POSITIONS`` minwise tokens. In each of ``trees`` independent trees a node
selects ``BRANCHES`` positions and sends each of its documents to the children named by its tokens
there. Two documents of Jaccard similarity s agree at a position with probability s, so a tree misses
a linked pair with the extinction probability q = (1 - s + s q)^2 at most (0.06 at s = 0.8), and five
trees with under 2e-6; a pair is also missed if its estimated similarity is improbably low (under
1e-6, see ``least_agreement``). Nodes of one document end. The others are handled in two rounds:

1. In two trees, each node at depth 1 is cut into blocks; each block's medoid is paired with the
   block's documents, and medoids of a node's blocks with one another's least. Confirmed links give
   provisional groups, whose members are surely connected: a large group of near copies becomes one
   group, or a few, from a linear number of pairs.
2. In all trees, a node whose documents are in one group ends, since no link in it can change a
   group. Nodes up to ``NODE_DOCS`` documents are compared exhaustively, pair by pair across groups;
   larger ones with at most ``MOST_REST`` documents outside their largest group are dealt to blocks by
   group, and every pair of blocks not within one group is a unit compared in a task of its own: rows
   in proportion to the node. Nodes with more outsiders hold every document against medoids of their
   largest groups, which joins most of what belongs together, and branch on; what is still as large at
   ``DEPTH`` is dealt to blocks, too.

No pair of documents ever becomes a row. A first pass over a unit's signatures keeps the documents that
have a candidate there; their full sets join the unit, which confirms links on them and gives one link
to each document's first partner of its group inside the unit. Pairs already joined inside a unit are
not confirmed again, and a pair that shares several nodes compared at depth 1 is judged in the first of them.
Nothing is capped.

Defined results: a null or blank text has an empty set and links with nothing; a null doc_id counts
as the largest id and is returned as null; rows that share a doc_id are one document, linked by any of
their texts; equal rows get equal results; ties go to the smallest doc_id; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield import scratch
from nearfield.functions import arrow as A
from nearfield.llm import textbatch as tb
from nearfield.llm.components import components

SHINGLE_WORDS = 5
POSITIONS = 64
BRANCHES = 2
TREES = 5
STAR_TREES = 2
NODE_DOCS = 256
DEPTH = 4
#: Bounds of a block of a larger node, and most documents outside the largest group for which a node is cut into blocks above DEPTH.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1_000_000
MOST_REST = 8 * BLOCK_DOCS
#: Representatives of a group, and most groups, that a large node's documents are held against.
MEDOIDS, MEDOID_GROUPS = 8, 32
#: Rounds of label exchange for the provisional groups.
GROUP_ROUNDS = 3
LAST_ID = 2**63 - 1

_rng = np.random.default_rng(0xC4A1)
_FACTORS = _rng.integers(1, 2**63, size=POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _rng.integers(0, 2**63, size=(TREES + 1, BRANCHES), dtype=np.uint64)
#: Positions selected at the roots, by tree and branch.
_ROOTS = (_SALTS[:TREES].ravel() % np.uint64(POSITIONS)).astype(int)
PARSED = "doc long, n long, h1 long, h2 long, sig binary"
CELL = "cell long, id long, comp long, k int, mask long, n long, sig binary"


def shingle_sets(part: np.ndarray, offsets: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and their n+1 offsets."""
    part = tb.ASCII_LOWER[part]
    starts, ends, first = tb.word_bounds(part, offsets)
    n = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    words = tb.word_hashes(part, starts, ends)
    owner = np.repeat(np.arange(n), np.diff(first))
    grams = tb.run_hashes(words, k)
    inside = np.arange(len(grams)) + k <= first[owner[: len(grams)] + 1]
    few = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < k))
    short = tb.mix(tb.Runs(words).hashes(first[few], first[few + 1]) + (first[few + 1] - first[few]).astype(np.uint64)) if len(few) else np.zeros(0, np.uint64)
    value = np.concatenate((grams[inside], short))
    owner = np.concatenate((owner[: len(grams)][inside], few))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return value, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))


def signatures(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minwise tokens (uint32) of sets that are not empty: one row of POSITIONS for each."""
    begin = bounds[:-1]
    out = np.empty((len(begin), POSITIONS), np.uint32)
    for j, factor in enumerate(_FACTORS):
        v = value * factor
        v ^= v >> np.uint64(32)
        v *= _FACTORS[(j + 1) % POSITIONS]
        v >>= np.uint64(32)
        out[:, j] = np.minimum.reduceat(v, begin)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """The signatures in a binary column without nulls."""
    return A.from_binaries(column, np.uint32)


def _set_hashes(value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two hashes of each set; zero for empty ones."""
    n = np.diff(bounds)
    full = np.flatnonzero(n)
    h = np.zeros((2, len(n)), np.uint64)
    if len(full):
        h[0, full] = np.add.reduceat(value, bounds[:-1][full])
        h[1, full] = np.add.reduceat(tb.mix(value), bounds[:-1][full])
    return n, h[0].view(np.int64), h[1].view(np.int64)


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: doc, n, h1, h2, sig of each text (h1, h2: a hash of the set; sig null if it is empty)."""
    for batch in batches:
        doc = A.long_values(batch.column("doc"))
        data, offsets = tb.as_bytes(batch.column("text"))
        for lo, hi in tb.steps(offsets):
            value, bounds = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            n, h1, h2 = _set_hashes(value, bounds)
            full = np.flatnonzero(n)
            column: pa.Array = pa.nulls(hi - lo, pa.binary())
            if len(full):
                sig = A.binaries(signatures(value, np.append(bounds[:-1][full], len(value))))
                place = np.full(hi - lo, -1)
                place[full] = np.arange(len(full))
                column = sig.take(pa.array(place, mask=place < 0))
            yield pa.record_batch([pa.array(doc[lo:hi]), pa.array(n), pa.array(h1), pa.array(h2), column], names=["doc", "n", "h1", "h2", "sig"])


def root_keys(trees: range):
    """mapInArrow function: the nodes at depth 1 of the given trees that a representative goes to."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig, ids = _matrix(batch.column("sig")), batch.column("id")
                for k in range(BRANCHES * trees.start, BRANCHES * trees.stop):
                    node = tb.mix(sig[:, _ROOTS[k]].astype(np.uint64) ^ _SALTS[k // BRANCHES, k % BRANCHES])
                    yield pa.record_batch([pa.array(node.view(np.int64)), ids, pa.array(np.full(len(ids), k, np.int32))], names=["node", "id", "k"])

    return keys


def child_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: the children that a node's document goes to; the node's own key picks the positions."""
    for batch in batches:
        if batch.num_rows:
            sig, ids = _matrix(batch.column("sig")), batch.column("id")
            node = A.long_values(batch.column("node")).view(np.uint64)
            for salt in _SALTS[TREES]:
                at = tb.mix(node ^ salt)
                token = sig[np.arange(len(at)), (at % np.uint64(POSITIONS)).astype(np.int64)].astype(np.uint64)
                yield pa.record_batch([pa.array(tb.mix(at + tb.mix(token)).view(np.int64)), ids, pa.array(np.full(len(ids), len(_ROOTS), np.int32))], names=["node", "id", "k"])


def least_agreement(percent: int, miss: float = 1e-6) -> int:
    """Positions that two signatures must share: pairs of that similarity share fewer with probability under ``miss``."""
    p, total = percent / 100, 0.0
    for c in range(POSITIONS + 1):
        total += math.comb(POSITIONS, c) * p**c * (1 - p) ** (POSITIONS - c)
        if total > miss:
            return c
    return POSITIONS


def _agreeing(percent: int, sig: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shared positions of pairs, and which pairs are candidates: their sizes allow the similarity and enough positions agree."""
    agree = np.zeros(len(a), np.int64)
    for k in range(0, len(a), 50_000):
        agree[k : k + 50_000] = (sig[a[k : k + 50_000]] == sig[b[k : k + 50_000]]).sum(axis=1)
    return agree, (agree >= least_agreement(percent)) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))


class Cells:
    """Whole cells out of rows sorted by cell: columns as arrays, and where each cell begins and how many rows it has."""

    def __init__(self, table: pa.Table):
        self.table = table
        columns = [c for c in table.column_names if c not in ("sig", "grams")]
        self.of = {c: A.long_values(A.chunk(table, c)) for c in columns}
        self.sig = _matrix(A.chunk(table, "sig"))
        cell = self.of["cell"]
        self.begin = np.flatnonzero(np.concatenate(([True], np.diff(cell) != 0)))
        self.size = np.diff(np.append(self.begin, len(cell)))

    def pairs_of_two(self) -> tuple[np.ndarray, np.ndarray]:
        first = self.begin[self.size == 2]
        return first, first + 1

    def larger(self) -> Iterator[np.ndarray]:
        for lo, n in zip(self.begin[self.size > 2], self.size[self.size > 2], strict=True):
            yield np.arange(lo, lo + n)


def over_cells(work):
    """mapInArrow function over rows sorted by cell: calls ``work`` with the whole cells at hand; one cell waits at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if left is None else pa.concat_tables([left, table])
            cell = A.long_values(A.chunk(table, "cell"))
            cut = int(np.flatnonzero(cell == cell[-1])[0])
            if cut:
                yield from work(Cells(table.slice(0, cut)))
            left = table.slice(cut).combine_chunks()
        if left is not None:
            yield from work(Cells(left))

    return run


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def star_pairs(percent: int):
    """Work on cells (id, n, sig): each cell's medoid with its candidate partners, and with itself."""

    def work(cells: Cells) -> Iterator[pa.RecordBatch]:
        ids, n, sig = cells.of["id"], cells.of["n"], cells.sig
        first, second = cells.pairs_of_two()
        _, good = _agreeing(percent, sig, n, first, second)
        yield _pair_batch(ids[first[good]], ids[second[good]])
        for rows in cells.larger():
            own = sig[rows]
            total = np.zeros(len(rows), np.int64)
            for lo in range(0, len(rows), 64):
                total[lo : lo + 64] = (own[lo : lo + 64, None] == own).sum(axis=(1, 2))
            hub = rows[int(np.lexsort((ids[rows], -total))[0])]
            _, good = _agreeing(percent, sig, n, np.full(len(rows), hub), rows)
            good[rows == hub] = True
            yield _pair_batch(ids[rows[good]], np.full(int(good.sum()), ids[hub]))

    return work


def _unjudged(cells: Cells, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether pairs of rows of a cell are of two groups and no earlier node of depth 1 judges them."""
    comp, k, mask = (cells.of[c] for c in ("comp", "k", "mask"))
    free = comp[i] != comp[j]
    for r, root in enumerate(_ROOTS):
        free &= ~((k[i] > r) & (mask[i] >> r & 1 > 0) & (cells.sig[i, root] == cells.sig[j, root]))
    return free


def _candidates(percent: int, cells: Cells) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that are candidates: those of all cells of two rows, then those of each larger cell."""
    n = cells.of["n"]
    i, j = cells.pairs_of_two()
    free = _unjudged(cells, i, j)
    i, j = i[free], j[free]
    _, good = _agreeing(percent, cells.sig, n, i, j)
    yield i[good], j[good]
    for rows in cells.larger():
        step = max(1, 40_000 // len(rows))
        found = []
        for lo in range(0, len(rows) - 1, step):
            i, j = np.nonzero(np.arange(len(rows)) > np.arange(lo, min(lo + step, len(rows)))[:, None])
            i, j = rows[i + lo], rows[j]
            free = _unjudged(cells, i, j)
            i, j = i[free], j[free]
            _, good = _agreeing(percent, cells.sig, n, i, j)
            found.append((i[good], j[good]))
        yield tuple(np.concatenate(x) for x in zip(*found, strict=True))


def hopeful_rows(percent: int):
    """Work on cells: their rows that have a candidate partner in the cell."""

    def work(cells: Cells) -> Iterator[pa.RecordBatch]:
        rows = np.unique(np.concatenate([x for pair in _candidates(percent, cells) for x in pair]))
        yield from cells.table.take(pa.array(rows)).combine_chunks().to_batches()

    return work


def _by_first(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each row that comes first in a pair, with its partners."""
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    edges = np.flatnonzero(np.concatenate(([True], np.diff(i) != 0, [True]))) if len(i) else []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield int(i[lo]), j[lo:hi]


def _similar_to(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets, as sorted hashes that are not empty, are similar enough to one of them."""
    size = np.array([len(x) for x in others])
    every = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
    both = np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)
    return 100 * both >= percent * (len(one) + size - both)


def linked_rows(percent: int):
    """Work on cells (with full sets): links that span the groups of linked documents in each."""

    def work(cells: Cells) -> Iterator[pa.RecordBatch]:
        ids, grams = cells.of["id"], A.chunk(cells.table, "grams")
        raw = np.frombuffer(grams.buffers()[2], np.uint8) if len(grams) else np.zeros(0, np.uint8)
        at = np.frombuffer(grams.buffers()[1], np.int32)[grams.offset : grams.offset + len(grams) + 1].astype(np.int64)
        sets = [raw[at[z] : at[z + 1]].view(np.uint64) for z in range(len(grams))]
        group = cells.of["comp"].copy()
        end = cells.begin + cells.size
        a, b = [], []
        for i, j in _candidates(percent, cells):
            for x, partners in _by_first(i, j):
                partners = partners[group[partners] != group[x]]
                if not len(partners):
                    continue
                cell = np.searchsorted(cells.begin, x, side="right") - 1
                own = group[cells.begin[cell] : end[cell]]
                for y in partners[_similar_to(sets[x], [sets[y] for y in partners.tolist()], percent)]:
                    if group[y] != group[x]:
                        a.append(x)
                        b.append(y)
                        own[own == group[y]] = group[x]
        yield _pair_batch(ids[np.array(a, np.int64)], ids[np.array(b, np.int64)])

    return work


def _by_cell(cells: DataFrame, work, kind: str, *columns: str) -> DataFrame:
    return cells.select("cell", *columns).repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(A.frugal(over_cells(work)), kind)


def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: the sorted shingle hashes of each text as one binary value."""
    for batch in batches:
        data, offsets = tb.as_bytes(batch.column("text"))
        for lo, hi in tb.steps(offsets):
            value, bounds = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            raw = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((bounds * 8).astype(np.int32)), pa.py_buffer(value)])
            yield pa.record_batch([batch.column("id").slice(lo, hi - lo), raw], names=["id", "grams"])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets, as sorted hashes, are similar enough."""
    if not len(a) or not len(b):
        return False
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def linked(percent: int):
    """Arrow UDF: whether two sets, as sorted hashes, are similar enough."""

    @F.arrow_udf("boolean")
    def judge(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([similar(*(np.frombuffer(v.as_buffer(), np.uint64) for v in pair), percent) for pair in zip(left, right, strict=True)], pa.bool_())

    return judge


def sets_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """id, grams of the documents (id, text) named by ``ids``."""
    ids = scratch.materialize(ids.distinct(), "wanted")
    return scratch.materialize(docs.join(scratch.small_side(ids), "id").mapInArrow(A.frugal(full_sets), "id long, grams binary"), "sets", scratch.TEXT_ROWS)


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose full sets are similar enough; ``docs`` has id and text."""
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), docs)
    rows = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
    return scratch.materialize(rows.withColumn("ok", linked(percent)("ga", "gb")).filter("ok").select("a", "b"), "confirmed")


def near_duplicates(docs: DataFrame, percent: int = 80, trees: int = TREES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and set hashes h1, h2: one row per row of ``docs`` (doc_id, text)."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), "text")
    parsed = scratch.materialize(keyed.mapInArrow(A.frugal(parse), PARSED), "parsed", scratch.TEXT_ROWS)
    reps = parsed.filter("n > 0").groupBy("h1", "h2").agg(F.min("doc").alias("id"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig"), F.count("*").alias("rows"))
    reps = scratch.materialize(reps, "reps")
    texts = keyed.withColumnRenamed("doc", "id")

    nodes = reps.mapInArrow(root_keys(range(trees)), "node long, id long, k int")
    nodes = scratch.materialize(nodes, "nodes")
    sizes = nodes.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
    sizes = scratch.materialize(sizes, "node_sizes")
    nodes = scratch.materialize(nodes.join(scratch.small_side(sizes), "node"), "shared_nodes")
    sigs = reps.select("id", "n", "sig")

    first = nodes.filter(F.col("k") < BRANCHES * min(STAR_TREES, trees)).select("node", "id", "size")
    blocks = F.ceil(F.col("size") / NODE_DOCS)
    first = first.withColumn("cell", F.xxhash64("node", F.pmod(F.xxhash64("id"), blocks)))
    cells = first.join(sigs, "id")
    stars = scratch.materialize(_by_cell(cells, star_pairs(percent), "a long, b long", "id", "n", "sig"), "stars")
    hubs = first.join(stars.filter("a = b").select(F.col("a").alias("id")), "id").filter(F.col("size") > NODE_DOCS)
    lead = hubs.groupBy("node").agg(F.min("id").alias("lead"))
    across = hubs.join(lead, "node").filter("id <> lead").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))
    links = confirmed(scratch.materialize(stars.filter("a < b").unionByName(across).distinct(), "pairs"), texts, percent)
    groups = components(links, rounds=GROUP_ROUNDS)

    every, masks = [], None
    nodes = nodes.select("node", "id", "k")
    for depth in range(DEPTH):
        alive = _alive(nodes, groups)
        cells = [alive.filter(F.col("size") <= NODE_DOCS).select(F.col("node").alias("cell"), "id", "comp", "k")]
        large, left = alive.filter(F.col("size") > NODE_DOCS), None
        if not large.isEmpty():
            large = _held(large, sigs)
            ready = F.lit(True) if depth == DEPTH - 1 else F.col("rest") <= MOST_REST
            cells.append(_grid(large.filter(ready)))
            left = scratch.materialize(large.filter(~ready), "left_nodes")
        cells = cells[0] if len(cells) == 1 else scratch.materialize(cells[0].unionByName(cells[1]), "cells")
        every.append(cells)
        if masks is None:
            masks = scratch.materialize(cells.groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("mask")), "masks")
        if left is None or left.isEmpty():
            break
        medoids = _medoids(left)
        if not medoids.isEmpty():
            more = _links(_medoid_cells(left, medoids), sigs, masks, texts, percent)
            links = scratch.materialize(links.unionByName(more), "links_so_far")
            groups = components(links, rounds=GROUP_ROUNDS)
        nodes = left.select("node", "id").join(sigs, "id").mapInArrow(child_keys, "node long, id long, k int")
        nodes = scratch.materialize(nodes, "nodes")
    cells = every[0]
    for more in every[1:]:
        cells = cells.unionByName(more)
    groups = components(links.unionByName(_links(cells, sigs, masks, texts, percent)))

    counted = reps.select("h1", "h2", "rows", "id").join(scratch.small_side(groups), "id", "left").select("h1", "h2", "rows", "id", F.coalesce("component", "id").alias("component"))
    classes = scratch.materialize(counted.filter("rows > 1 or component <> id").select("h1", "h2", "component"), "classes")
    # a set alone in its group needs no row here; sets without words share one key, so they get keys of their own
    spread = parsed.select("doc", "n", "h1", "h2", F.when(F.col("n") > 0, F.col("h1")).otherwise(F.xxhash64("doc")).alias("key"))
    out = spread.join(scratch.small_side(classes.select(F.col("h1").alias("key"), "h2", "component")), ["key", "h2"], "left")
    out = out.withColumn("component", F.when(F.col("n") > 0, F.coalesce("component", "doc")).otherwise(F.col("doc")))
    shown = [F.nullif(F.col(c), F.lit(LAST_ID)).alias(name) for c, name in (("doc", "doc_id"), ("component", "component_id"))]
    return out.select(shown[0], F.col("n").alias("n_shingles"), shown[1], (F.col("doc") == F.col("component")).alias("kept"), "h1", "h2")


def _alive(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """node, id, k, comp and size of the documents in nodes of more than one group."""
    labelled = nodes.join(scratch.small_side(groups), "id", "left").select("node", "id", "k", F.coalesce("component", "id").alias("comp"))
    state = labelled.groupBy("node").agg(F.count("*").alias("size"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
    state = scratch.materialize(state.filter("c1 < c2").select("node", "size"), "open_nodes")
    return scratch.materialize(labelled.join(scratch.small_side(state), "node"), "alive")


def _held(large: DataFrame, sigs: DataFrame) -> DataFrame:
    """Rows of large nodes with ``held``, the documents of their group in the node, ``rest``, those outside its largest group, and ``blocks``.

    ``blocks`` is how many blocks the row's part needs to keep each under BLOCK_DOCS documents and
    BLOCK_SHINGLES shingles; a part is a group above BLOCK_DOCS documents, or all smaller groups.
    """
    rows = scratch.materialize(sigs.select("id", "n").join(scratch.small_side(large), "id"), "large_nodes")
    held = rows.groupBy("node", "comp").agg(F.count("*").alias("held"), F.sum("n").alias("shingles"))
    held = scratch.materialize(held.withColumn("pure", F.when(F.col("held") > BLOCK_DOCS, F.col("comp"))), "held")
    need = F.greatest(F.ceil(F.sum("held") / BLOCK_DOCS), F.ceil(F.sum("shingles") / BLOCK_SHINGLES))
    parts = scratch.materialize(held.groupBy("node", "pure").agg(need.alias("blocks")), "parts")
    rest = scratch.materialize(held.groupBy("node").agg((F.sum("held") - F.max("held")).alias("rest")), "rest")
    held = held.join(scratch.small_side(rest), "node").join(scratch.small_side(parts.withColumnsRenamed({"node": "_n", "pure": "_p"})), (F.col("node") == F.col("_n")) & F.col("pure").eqNullSafe(F.col("_p")))
    held = scratch.materialize(held.select("node", "comp", "held", "pure", "rest", "blocks"), "held_parts")
    return scratch.materialize(rows.join(scratch.small_side(held), ["node", "comp"]), "held_rows")


def _medoids(large: DataFrame) -> DataFrame:
    """node, id, comp, size of MEDOIDS documents of each group that holds a MEDOID_GROUPS-th of its node or more.

    They are the least by hash out of a few drawn by hash, so that no group is ordered as a whole.
    """
    u = F.xxhash64(F.lit(5), "id").cast("double") / 2.0**64 + 0.5
    few = large.filter((F.col("held") > 1) & (F.col("held") * MEDOID_GROUPS >= F.col("size")) & (u * F.col("held") < 4 * MEDOIDS))
    order = Window.partitionBy("node", "comp").orderBy(u, "id")
    few = few.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= MEDOIDS)
    return scratch.materialize(few.select("node", "id", "comp", "size"), "medoids")


def _medoid_cells(large: DataFrame, medoids: DataFrame) -> DataFrame:
    """Cells of large nodes in which every document meets the node's medoids.

    A node's documents are dealt to blocks of about NODE_DOCS, and its medoids go to all of them: rows
    grow in proportion to the node.
    """
    blocks = F.ceil(F.col("size") / NODE_DOCS)
    named = scratch.materialize(medoids.select("node").distinct(), "medoid_nodes")
    own = large.join(scratch.small_side(named), "node").join(scratch.small_side(medoids.select("node", "id")), ["node", "id"], "left_anti")
    own = own.select("node", "id", "comp", F.pmod(F.xxhash64("id"), blocks).alias("block"))
    seen = medoids.select("node", "id", "comp", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    return own.unionByName(seen).select(F.xxhash64("node", "block").alias("cell"), "id", "comp", F.lit(len(_ROOTS)).alias("k"))


def _links(cells: DataFrame, sigs: DataFrame, masks: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Confirmed links a, b inside cells (cell, id, comp, k): enough of them to span the groups of linked documents in each."""
    rows = cells.join(sigs, "id").join(masks, "id", "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("long")))
    columns = ("id", "comp", "k", "mask", "n", "sig")
    hopeful = scratch.materialize(_by_cell(rows, hopeful_rows(percent), CELL, *columns), "hopeful")
    judged = hopeful.join(sets_of(hopeful.select("id"), texts), "id")
    return scratch.materialize(_by_cell(judged, linked_rows(percent), "a long, b long", *columns, "grams"), "linked")


def _grid(large: DataFrame) -> DataFrame:
    """Cells of large nodes (rows of ``_held``): every pair of blocks that are not within one group.

    A group above BLOCK_DOCS documents has blocks of its own; the others share blocks by hash. A cell
    holds two blocks, so its size is bounded, and a document goes to at most ``rest`` / BLOCK_DOCS cells
    and a few more, or, outside the largest group, to as many as the node has blocks.
    """
    block = F.xxhash64(F.coalesce("pure", F.lit(-1)), F.pmod(F.xxhash64(F.lit(8), "id"), F.col("blocks")))
    members = scratch.materialize(large.select("node", "id", "comp", "k", "pure", block.alias("block")), "members")
    blocks = scratch.materialize(members.select("node", "block", "pure").distinct(), "blocks")
    left, right = (blocks.select("node", F.col("block").alias(f"b{k}"), F.col("pure").alias(f"p{k}")) for k in (1, 2))
    both = left.join(right, "node").filter("b1 <= b2 and not coalesce(p1 = p2, false)")
    both = both.withColumn("cell", F.xxhash64("node", "b1", "b2"))
    sides = both.select("node", "cell", F.explode(F.array_distinct(F.array("b1", "b2"))).alias("block"))
    return members.join(sides, ["node", "block"]).select("cell", "id", "comp", "k")


def keep_one(docs: DataFrame, percent: int = 80, trees: int = TREES) -> DataFrame:
    """The rows of ``docs`` that stay: the first of each near-duplicate group, once, and rows without words.

    Rows are matched by doc_id; only rows whose doc_id is null or repeated are shingled again, since
    their texts tell them apart.
    """
    found = near_duplicates(docs.select("doc_id", "text"), percent, trees)
    found = scratch.materialize(found.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "h1", "h2", "kept"), "decisions")
    again = found.groupBy("id").agg(F.count("*").alias("rows")).filter((F.col("rows") > 1) | (F.col("id") == LAST_ID)).select("id")
    again = scratch.materialize(again, "repeated_ids")
    gone = scratch.materialize(found.filter("not kept").select("id", "h1", "h2").distinct(), "not_kept")
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own)
    shown = [F.col(f"row.`{c}`") for c in docs.columns]
    once = rows.join(scratch.small_side(scratch.materialize(gone.select("id").unionByName(again).distinct(), "not_plain")), "id", "left_anti").select(*shown)
    if again.isEmpty():
        return once
    keyed = _with_set(rows.join(scratch.small_side(again), "id", "left_semi").select(*shown)).join(scratch.small_side(gone), ["id", "h1", "h2"], "left_anti")
    keyed = scratch.materialize(keyed, "repeated_rows")
    some = keyed.filter("n > 0").dropDuplicates(["id", "h1", "h2"]).unionByName(keyed.filter("n = 0"))
    return once.unionByName(some.select(*shown))


def _with_set(docs: DataFrame) -> DataFrame:
    """Rows as a struct with id, n, h1 and h2 of their sets."""

    @F.arrow_udf("struct<n: bigint, h1: bigint, h2: bigint>")
    def key(text: pa.Array) -> pa.Array:
        out: list[pa.Array] = []
        data, offsets = tb.as_bytes(text)
        for lo, hi in tb.steps(offsets):
            value, bounds = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            out.append(pa.StructArray.from_arrays([pa.array(x) for x in _set_hashes(value, bounds)], ["n", "h1", "h2"]))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([(c, pa.int64()) for c in ("n", "h1", "h2")]))

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), key(F.col("text")).alias("k")).select("row", "id", "k.n", "k.h1", "k.h2")
