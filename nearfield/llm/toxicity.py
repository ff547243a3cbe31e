"""Toxicity by a linear-chain conditional random field over words.

The field tags each word as toxic or not. A word's features are the word itself and its first bytes
(``STEMS``), as toxic words are also built from a stem with any ending. Its labelled tokens come from
labelled documents: in a toxic document those words count as toxic that have a feature whose share of
toxic documents is at least ``MIN_LIFT`` times its share of clean ones, by a likelihood ratio of at
least ``MIN_EVIDENCE``; all words of clean documents count as clean. Documents that share their smallest word hash count once there, so
that a family of near copies does not make its words look toxic. Feature weights, a bias, transitions
and starts maximise the penalised conditional likelihood, with expectations from forward-backward.

Scoring runs forward-backward over every whole text. A document's features are its largest marginal,
the expected number of toxic words and its length; a logistic curve fitted on the training documents
turns them into the score; runs of words with marginals of one half or more are the offending spans.

The chain is not walked word by word: a batch of texts is one long chain with restarts at each
document, cut into strips that advance side by side; strip products of two-by-two matrices carry the
state across, so results are exact for texts of any length.

The fit uses at most about ``max_rows`` toxic and twice as many clean labelled documents and
``max_bytes`` of their text, picked by a hash of doc_id. Defined results: a null or empty text has no words, no spans and the score of no evidence;
rows without a label or with a null doc_id are scored and not learned from; of several labels of one
document the largest counts; with labels of one kind, or none, every score is the share of ones (0
without labels); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield import scratch
from nearfield.functions import arrow as A
from nearfield.llm import textbatch as tb

MAX_ROWS = 1000
MAX_BYTES = 16 << 20
#: The ratio statistic of a feature without bearing exceeds 24 about once in a million.
MIN_LIFT, MIN_EVIDENCE = 6.0, 24.0
#: Lengths in bytes of the beginnings of longer words that are features.
STEMS = (5, 6, 7)
STRIP = 128
ROUNDS, RATE, PENALTY = 40, 0.3, 0.02
SCORED = "doc_id long, score double, toxic_words double, spans array<struct<start: long, stop: long>>"

_EDGE = np.zeros(256, bool)
_EDGE[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def tokens(part: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes of each word in ASCII lower case without marks at its ends (0: none); its start and end; first word of each text."""
    starts, ends, first = tb.word_bounds(part, offsets)
    plain = np.concatenate(([0], np.flatnonzero(~_EDGE[part]), [len(part)]))
    lo = plain[np.minimum(np.searchsorted(plain[1:-1], starts) + 1, len(plain) - 1)] if len(starts) else starts
    hi = plain[np.searchsorted(plain[1:-1], ends)] + 1 if len(starts) else ends
    bare = (lo < ends) & (hi > lo)
    lo, hi = np.where(bare, lo, starts), np.where(bare, hi, ends)
    lower = tb.ASCII_LOWER[part]
    out = np.zeros((len(lo), 1 + len(STEMS)), np.uint64)
    out[:, 0] = tb.word_hashes(lower, lo, hi)
    for column, size in enumerate(STEMS, 1):
        longer = np.flatnonzero(hi - lo > size)
        out[longer, column] = tb.mix(tb.word_hashes(lower, lo[longer], lo[longer] + size) + np.uint64(1))
    return out, lo, hi, first


def sweep(emit: np.ndarray, restart: np.ndarray, matrix: np.ndarray, start: np.ndarray) -> np.ndarray:
    """States s_t (n, 2), each summing to 1, of s_t ~ (1, emit_t) * (matrix @ s_{t-1}), or (1, emit_t) * start at a restart."""
    n = len(emit)
    length = max(STRIP, math.isqrt(n))
    strips = -(-n // length)
    size = strips * length
    e = np.ones(size)
    e[:n] = emit
    r = np.zeros(size, bool)
    r[:n] = restart
    e, r = e.reshape(strips, length).T, r.reshape(strips, length).T
    total = np.repeat(np.eye(2)[:, :, None], strips, axis=2)

    def step(state: np.ndarray, t: int) -> np.ndarray:
        """``state`` is (2, k, strips): k columns that advance together."""
        zero = matrix[0, 0] * state[0] + matrix[0, 1] * state[1]
        one = matrix[1, 0] * state[0] + matrix[1, 1] * state[1]
        mass = state[0] + state[1]
        zero = np.where(r[t], start[0] * mass, zero)
        one = np.where(r[t], start[1] * mass, one) * e[t]
        return np.stack((zero, one))

    for t in range(length):
        total = step(total, t)
        total /= total.sum(axis=(0, 1))
    carry = np.empty((2, strips))
    v = np.array([0.5, 0.5])
    for k in range(strips):
        carry[:, k] = v
        v = total[:, :, k] @ v
        v /= v.sum()
    out = np.empty((length, 2, strips))
    state = carry[:, None, :]
    for t in range(length):
        state = step(state, t)
        state = state / state.sum(axis=0)
        out[t] = state[:, 0]
    return out.transpose(2, 0, 1).reshape(size, 2)[:n]


def forward_backward(emit: np.ndarray, first: np.ndarray, pair: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of state 1, and the forward and backward states (each including its own emission).

    ``emit``: weight of state 1 against 0 for each word; ``first``: first word of each text (n+1);
    ``pair[i, j]``: weight of going from i to j; ``start``: weights of the first state.
    """
    begin, stop = np.zeros(len(emit), bool), np.zeros(len(emit), bool)
    full = np.diff(first) > 0
    begin[first[:-1][full]] = True
    stop[first[1:][full] - 1] = True
    ahead = sweep(emit, begin, pair.T, start)
    back = sweep(emit[::-1], stop[::-1], pair, np.ones(2))[::-1]
    one = ahead[:, 1] * back[:, 1] / emit
    return one / (one + ahead[:, 0] * back[:, 0]), ahead, back


@dataclass(frozen=True)
class Model:
    """Word weights by sorted hash, bias, transitions, starts and the document curve; no words: a constant score."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    pair: np.ndarray
    start: np.ndarray
    curve: np.ndarray
    constant: float | None = None

    def emissions(self, features: np.ndarray) -> np.ndarray:
        total = np.full(len(features), self.bias)
        if len(self.keys):
            for column in features.T:
                at = np.minimum(np.searchsorted(self.keys, column), len(self.keys) - 1)
                total += np.where(self.keys[at] == column, self.weights[at], 0.0)
        return np.exp(np.clip(total, -30, 30))

    def marginals(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        return forward_backward(self.emissions(features), first, self.pair, self.start)[0] if len(features) else np.zeros(0)

    def document_features(self, marginal: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Largest marginal, log of one more than the expected number of toxic words, log of one more than the words."""
        n = len(first) - 1
        owner = np.repeat(np.arange(n), np.diff(first))
        top = np.zeros(n)
        np.maximum.at(top, owner, marginal)
        return np.stack((top, np.log1p(np.bincount(owner, weights=marginal, minlength=n)), np.log1p(np.diff(first))), axis=1)

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(features), self.constant)
        return 1 / (1 + np.exp(-np.clip(features @ self.curve[:-1] + self.curve[-1], -30, 30)))


def seeds(words: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Sorted hashes of the features that mark a word as toxic in toxic documents."""
    family = np.array([w[:, 0].min() if len(w) else 0 for w in words], np.uint64)
    kinds = []
    for kind in (1, 0):
        pairs = []
        for i in np.flatnonzero(toxic == kind):
            own = np.unique(words[i])
            pairs.append(np.stack((own, np.full(len(own), family[i])), axis=1))
        both = np.unique(np.concatenate(pairs), axis=0)
        feature, n = np.unique(both[:, 0], return_counts=True)
        kinds.append((feature, n, len(np.unique(family[toxic == kind]))))
    (feature, n, total), (clean, m, others) = kinds
    at = np.minimum(np.searchsorted(clean, feature), max(0, len(clean) - 1))
    seen = np.where(clean[at] == feature, m[at], 0) if len(clean) else np.zeros(len(feature))
    expected = (n + seen) * total / (total + others)
    evidence = 2 * (n * np.log(n / expected) + seen * np.log(np.maximum(seen, 1) / np.maximum(n + seen - expected, 1e-9)))
    return feature[(feature > 0) & (n / total >= MIN_LIFT * (seen + 0.5) / others) & (evidence >= MIN_EVIDENCE)]


def fit(every: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> Model:
    """``every``: the feature hashes of all training words; ``first``: first word of each document (n+1); ``toxic``: 0 or 1 for each."""
    none = np.zeros(0, np.uint64)
    flat_pair, flat_start = np.full((2, 2), 0.5), np.full(2, 0.5)
    if not len(toxic) or toxic.min() == toxic.max():
        return Model(none, np.zeros(0), 0.0, flat_pair, flat_start, np.zeros(4), float(toxic.mean()) if len(toxic) else 0.0)
    seed = seeds([every[a:b] for a, b in itertools.pairwise(first)], toxic)
    owner = np.repeat(np.arange(len(toxic)), np.diff(first))
    y = np.isin(every, seed).any(axis=1) & (toxic[owner] == 1)
    keys, index, count = np.unique(every, return_inverse=True, return_counts=True)
    kept = ((count >= 3) | np.isin(keys, seed)) & (keys > 0)
    row = np.where(kept, np.cumsum(kept) - 1, int(kept.sum())).astype(np.int32)[index].reshape(every.shape)
    keys = keys[kept]
    del index, count
    inner = np.ones(len(every), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    after = np.flatnonzero(inner)
    head = np.flatnonzero(~inner)
    seen_pair = np.bincount(y[after - 1] * 2 + y[after], minlength=4).reshape(2, 2).astype(float)
    seen_start = np.bincount(y[head].astype(int), minlength=2).astype(float)
    size = len(keys)
    theta = np.zeros(size + 1 + 4 + 2)
    theta[size] = np.log((y.sum() + 1) / len(y))
    moment, spread = np.zeros_like(theta), np.zeros_like(theta)
    for turn in range(1, ROUNDS + 1):
        weight = np.append(theta[:size], 0.0)
        emit = np.exp(np.clip(theta[size] + weight[row].sum(axis=1), -30, 30))
        pair, start = np.exp(theta[size + 1 : size + 5]).reshape(2, 2), np.exp(theta[size + 5 :])
        p, ahead, back = forward_backward(emit, first, pair, start)
        joint = ahead[after - 1][:, :, None] * pair * back[after][:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        error = y - p
        grad = np.concatenate((np.bincount(row.ravel(), weights=np.repeat(error, row.shape[1]), minlength=size + 1)[:size], [error.sum()], (seen_pair - joint.sum(axis=0)).ravel(), seen_start - [(1 - p[head]).sum(), p[head].sum()]))
        grad -= PENALTY * theta
        moment = 0.9 * moment + 0.1 * grad
        spread = 0.99 * spread + 0.01 * grad**2
        theta += RATE * (moment / (1 - 0.9**turn)) / (np.sqrt(spread / (1 - 0.99**turn)) + 1e-8)
    live = np.abs(theta[:size]) > 0.05
    pair, start = np.exp(theta[size + 1 : size + 5]).reshape(2, 2), np.exp(theta[size + 5 :])
    model = Model(keys[live], theta[:size][live], float(theta[size]), pair, start, np.zeros(4))
    features = model.document_features(model.marginals(every, first), first)
    return Model(model.keys, model.weights, model.bias, pair, start, logistic(features, toxic.astype(float)))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and a constant (last) of a lightly penalised logistic regression, by Newton steps."""
    z = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (y - p) - 0.1 * w
        hess = (z * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ z + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step * min(1.0, 4 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return w


def train_toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """Fit on rows of ``labels`` (doc_id, toxic) for which ``learn``, over doc_id, holds.

    At most about ``max_rows`` toxic and twice as many clean documents are used, each of at most a
    sixteenth of ``max_bytes`` and together of about ``max_bytes`` of text.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null")
    named = named.groupBy("doc_id").agg(F.max("y").alias("y"))
    if learn is not None:
        named = named.filter(learn)
    named = scratch.materialize(named, "labels")
    count = {r["y"]: r["n"] for r in named.groupBy("y").agg(F.count("*").alias("n")).collect()}
    draw = lambda seed: F.xxhash64(F.lit(seed), "doc_id").cast("double") / 2.0**64 + 0.5
    share = F.when(F.col("y") == 1, max_rows / max(1, count.get(1, 0))).otherwise(2 * max_rows / max(1, count.get(0, 0)))
    picked = scratch.materialize(named.filter(draw(11) < share), "picked")
    size = F.octet_length("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull() & (size <= max_bytes // 16)).join(scratch.small_side(picked), "doc_id")
    rows = scratch.materialize(rows, "training")
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    table = rows.filter(draw(12) < max_bytes / max(1, total)).orderBy("doc_id").toArrow()
    hashes, _, _, first = tokens(*tb.as_bytes(table.column("text")))
    return fit(hashes, first, table.column("y").to_numpy().astype(np.int64))


def tag(model: Model):
    """mapInArrow function: score, expected number of toxic words and offending spans, in code points, of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.as_bytes(batch.column("text"))
            for lo, hi in tb.steps(offsets):
                part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                hashes, starts, ends, first = tokens(part, own)
                marginal = model.marginals(hashes, first)
                features = model.document_features(marginal, first)
                bad = np.flatnonzero(marginal >= 0.5)
                owner = np.searchsorted(first, bad, side="right") - 1
                new = np.ones(len(bad), bool)
                new[1:] = (np.diff(bad) > 1) | (np.diff(owner) > 0)
                last = np.append(np.flatnonzero(new)[1:] - 1, len(bad) - 1) if len(bad) else np.zeros(0, np.int64)
                chars = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
                who = owner[new]
                span = pa.StructArray.from_arrays([pa.array(chars[x] - chars[own[who]]) for x in (starts[bad[new]], ends[bad[last]])], ["start", "stop"])
                spans = tb.list_array(np.bincount(who, minlength=hi - lo), span)
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), pa.array(model.score(features)), pa.array(np.expm1(features[:, 1])), spans], names=["doc_id", "score", "toxic_words", "spans"])

    return run


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, toxic_words and spans of every row of ``docs`` (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(A.frugal(tag(model)), SCORED)
