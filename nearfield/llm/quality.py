"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Every whole text becomes a short vector of statistics (``STATS``). Standardised statistics are mapped
to ``FEATURES`` random cosines, whose inner products approximate a Gaussian kernel; partitions sum
their part of the normal equations by fold, the sums are added and solved for ridge scores. Each of
``FOLDS`` folds, dealt by hash, is scored by the sums of the others, and those scores calibrate the
model by isotonic regression (pool adjacent violators). The model is a few arrays of fixed size.

Labels join on doc_id; ``max_rows`` bounds the rows the model is fitted on: beyond it a share of them
is taken by a hash of doc_id. Scoring covers every row.

Defined results: a null text counts as empty; an empty text gets the score of its statistics, all
zero; rows without a label or with a null doc_id are scored and not learned from; of several labels of
one document the largest counts; with labels of one kind, or none, every score is the share of ones
(0.5 without labels); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield import scratch
from nearfield.functions import arrow as A
from nearfield.llm import textbatch as tb

SYMBOLS = "|$%#&*!?<>/\\@_=+~^()[]{}:;-\"'"
STATS = 18 + len(SYMBOLS)
FEATURES = 384
RIDGE = 1e-2
MAX_ROWS = 40_000
PARTS = 8
FOLDS = 4

_DIGIT, _UPPER, _LOWER, _HIGH, _STOP, _OTHER = range(6)
_KIND = np.full(256, 6, np.int64)
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = _DIGIT, _UPPER, _LOWER, _HIGH
_KIND[[ord("."), ord(",")]] = _STOP
for _c in [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]:
    if _c not in (ord("."), ord(",")):
        _KIND[_c] = _OTHER


def statistics(part: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATS numbers for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, STATS))
    size = np.diff(offsets)
    starts, ends, first = tb.word_bounds(part, offsets)
    words = np.diff(first)
    some = words > 0
    if not some.any():
        return out
    per_word, per_byte = 1 / np.maximum(words, 1), 1 / np.maximum(size, 1)
    whose_byte = np.repeat(np.arange(n), size)
    kinds = np.bincount(whose_byte * 7 + _KIND[part], minlength=n * 7).reshape(n, 7)
    whose = np.repeat(np.arange(n), words)
    length = ends - starts
    by_doc = lambda weights: np.bincount(whose, weights=weights, minlength=n)
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(words)
    mean = by_doc(length) * per_word
    out[:, 2], out[:, 3] = mean, np.sqrt(np.maximum(0, by_doc(length.astype(float) ** 2) * per_word - mean**2))
    out[:, 4:10] = np.sqrt(kinds[:, :6] * per_byte[:, None])
    upper = np.concatenate(([0], np.cumsum(_KIND[part] == _UPPER)))
    out[:, 10] = by_doc((upper[ends] - upper[starts] == length) & (length > 1)) * per_word
    odd = np.concatenate(([0], np.cumsum(_KIND[part] == _OTHER)))
    out[:, 11] = by_doc(odd[ends] > odd[starts]) * per_word
    out[:, 12] = by_doc(length == 1) * per_word
    out[:, 13] = by_doc(_KIND[part[ends - 1]] == _STOP) * per_word
    codes = tb.word_hashes(part, starts, ends)
    for column, values, owner in ((14, codes, whose), (15, *_pairs(codes, whose))):
        if len(values):
            order = np.lexsort((values, owner))
            v, o = values[order], owner[order]
            fresh = np.ones(len(v), bool)
            fresh[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
            out[:, column] = np.bincount(o[fresh], minlength=n) / np.maximum(np.bincount(o, minlength=n), 1)
    lines = np.bincount(whose_byte[part == 10], minlength=n)
    out[:, 16] = np.log1p(lines) - out[:, 1] * some
    out[:, 17] = by_doc(length > 20) * per_word
    table = np.full(256, -1)
    for k, c in enumerate(SYMBOLS):
        table[ord(c)] = k
    at = np.flatnonzero(table[part] >= 0)
    marks = np.bincount(whose_byte[at] * len(SYMBOLS) + table[part[at]], minlength=n * len(SYMBOLS)).reshape(n, -1)
    out[:, 18:] = np.sqrt(marks * per_word[:, None])
    out[~some] = 0
    return out


def _pairs(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = owner[1:] == owner[:-1]
    return tb.run_hashes(codes, 2)[inside], owner[:-1][inside]


def _stat_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tb.as_bytes(batch.column("text"))
        for lo, hi in tb.steps(offsets):
            x = statistics(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]).astype(np.float32)
            yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), A.binaries(x)], names=["doc_id", "x"])


def _stats_of(batch: pa.RecordBatch) -> np.ndarray:
    return A.from_binaries(batch.column("x"), np.float32).astype(np.float64)


@dataclass(frozen=True)
class Model:
    """Scores from statistics; ``weights`` is None for a constant score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random cosines and a constant; the projection depends on the seed alone."""
        random = np.random.default_rng(0xF0F)
        w, phase = random.normal(size=(STATS, FEATURES)) / np.sqrt(STATS), random.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate((np.sqrt(2 / FEATURES) * np.cos(z @ w + phase), np.ones((len(x), 1))), axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.levels[0])
        return np.interp(self.raw(x), self.knots, self.levels)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and levels of the rising function nearest to the labels (pool adjacent violators, half a label of either kind added to each pool)."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, y in zip(score[order], label[order], strict=True):
        pools.append([y, 1.0, s, s])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            y2, n2, _, hi = pools.pop()
            pools[-1][0] += y2
            pools[-1][1] += n2
            pools[-1][3] = hi
    knots, levels = [], []
    for total, count, lo, hi in pools:
        level = (total + 0.5) / (count + 1)
        for k in (lo, hi) if hi > lo else (lo,):
            knots.append(k)
            levels.append(level)
    return np.array(knots), np.maximum.accumulate(np.array(levels))


def _summed(rows: DataFrame, per_batch, width: int) -> np.ndarray:
    """Sums over the rows of each fold of ``per_batch(x, y)``, an array of ``width`` numbers; one partial sum per partition and fold."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, width))
        for batch in batches:
            if batch.num_rows:
                x, y, fold = _stats_of(batch), batch.column("y").to_numpy(zero_copy_only=False).astype(float), A.long_values(batch.column("fold"))
                for f in np.unique(fold):
                    total[f] += per_batch(x[fold == f], y[fold == f])
        yield pa.record_batch([pa.array([total.tobytes()])], names=["part"])

    return sum((np.frombuffer(r["part"]).reshape(FOLDS, width) for r in rows.coalesce(PARTS).mapInArrow(part, "part binary").toLocalIterator()), np.zeros((FOLDS, width)))


def _solved(normal: np.ndarray, n: float) -> np.ndarray:
    width = len(normal)
    penalty = np.eye(width) * RIDGE * n / FEATURES
    penalty[-1, -1] = 0
    return np.linalg.solve(normal[:, :width] + penalty + np.eye(width) * 1e-9, normal[:, width])


def fit(train: DataFrame) -> Model:
    """``train`` has x, y (0 or 1) and fold, with bounded rows."""
    zero = np.zeros(STATS)
    train = scratch.materialize(train.repartition(PARTS, F.xxhash64("x")), "training")
    sums = _summed(train, lambda x, y: np.concatenate(([len(y), y.sum()], x.sum(axis=0), (x * x).sum(axis=0))), 2 + 2 * STATS)
    per_fold, sums = sums[:, 0], sums.sum(axis=0)
    n, ones = sums[:2]
    if not 0 < ones < n:
        return Model(zero, zero + 1, None, zero[:1], np.array([ones / n if n else 0.5]))
    mean = sums[2 : 2 + STATS] / n
    scale = np.sqrt(np.maximum(sums[2 + STATS :] / n - mean**2, 0))
    blank = Model(mean, np.where(scale > 1e-6, scale, 1.0), None, zero, zero)
    width = FEATURES + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = blank.features(x)
        balance = np.where(y > 0, 0.5 * n / ones, 0.5 * n / (n - ones))[:, None]
        return np.concatenate(((z * balance).T @ z, (z * balance).T @ y[:, None]), axis=1).ravel()

    parts = _summed(train, normal, width * (width + 1)).reshape(FOLDS, width, width + 1)
    whole = parts.sum(axis=0)
    others = [_solved(whole - parts[f], n - per_fold[f]) if per_fold[f] < n else np.zeros(width) for f in range(FOLDS)]
    kept = train.select("x", "y", "fold").toArrow()
    score, label = [], []
    for batch in kept.to_batches():
        if batch.num_rows:
            fold = A.long_values(batch.column("fold"))
            score.append((blank.features(_stats_of(batch)) * np.array(others)[fold]).sum(axis=1))
            label.append(batch.column("y").to_numpy(zero_copy_only=False).astype(float))
    return Model(mean, blank.scale, _solved(whole, n), *isotonic(np.concatenate(score), np.concatenate(label)))


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id and statistics (x, float32 bytes) of every row; texts are read once."""
    return scratch.materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(A.frugal(_stat_rows), "doc_id long, x binary"), "stats", scratch.TEXT_ROWS)


def chosen_labels(labels: DataFrame, learn: Column | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, y of the rows of ``labels`` (doc_id, quality) to learn from: those for which ``learn``, over doc_id, holds; at most about ``max_rows``."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null")
    named = named.groupBy("doc_id").agg(F.max("y").alias("y"))
    if learn is not None:
        named = named.filter(learn)
    named = scratch.materialize(named, "labels")
    share = max_rows / max(1, named.count())
    draw = lambda seed: F.xxhash64(F.lit(seed), "doc_id").cast("double") / 2.0**64 + 0.5
    if share < 1:
        named = scratch.materialize(named.filter(draw(1) < share), "labels")
    return named


def train_quality(stats: DataFrame, labels: DataFrame, learn: Column | None = None, max_rows: int = MAX_ROWS) -> Model:
    """Fit on rows of ``stats`` that ``chosen_labels`` names."""
    named = chosen_labels(labels, learn, max_rows)
    return _fit_named(stats, named)


def _fit_named(stats: DataFrame, named: DataFrame) -> Model:
    fold = F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(FOLDS)).cast("int")
    return fit(stats.join(scratch.small_side(named), "doc_id").select("x", "y", fold.alias("fold")))


def train_on_texts(docs: DataFrame, labels: DataFrame, learn: Column | None = None, max_rows: int = MAX_ROWS) -> Model:
    """Fit on rows of ``docs`` (doc_id, text) that ``chosen_labels`` names; only their statistics are taken."""
    named = chosen_labels(labels, learn, max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(scratch.small_side(named.select("doc_id")), "doc_id", "left_semi")
    return _fit_named(document_stats(rows), named)


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of ``stats``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([batch.column("doc_id"), pa.array(model.score(_stats_of(batch)))], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``quality_score`` (replacing an input column of that name); all other columns as they came."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        data, offsets = tb.as_bytes(text)
        parts = [statistics(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]).astype(np.float32) for lo, hi in tb.steps(offsets)]
        found = pa.array(model.score(np.concatenate(parts).astype(np.float64)) if parts else np.zeros(0))
        A.give_back()
        return found

    return docs.withColumn("quality_score", score(F.col("text")))
