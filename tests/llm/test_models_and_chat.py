"""Classifiers by held-out accuracy and plain versions; chat formatting by round trips; SQL; the pipeline."""

import itertools
import math

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import chat_formatting, quality, queries, sql, toxicity

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query_equals_sql(name, same):
    same(queries.queries()[name], sql.ORACLES[name])


@pytest.mark.parametrize(("query", "label", "least", "recall", "auc", "size"), [(queries.op3_quality, "quality", 0.95, 0.95, 0.99, "sf0.01"), (queries.op5_toxicity, "toxic", 0.98, 0.88, 0.95, "sf0.1")])
def test_held_out_figures(spark, query, label, least, recall, auc, size):
    """Accuracy, share of ones found, and area under the curve on rows that were not learned from."""
    sf_dir = f"/root/testdata/{size}"
    got = query(spark, sf_dir)
    rows = got.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert np.mean([r["predicted"] == r[label] for r in rows]) >= least
    ones = [r["score"] for r in rows if r[label] == 1]
    zeros = np.sort([r["score"] for r in rows if r[label] == 0])
    assert np.mean([r["predicted"] for r in rows if r[label] == 1]) >= recall
    both = np.searchsorted(zeros, ones, side="left") + np.searchsorted(zeros, ones, side="right")
    assert both.mean() / (2 * len(zeros)) >= auc


def test_isotonic_is_the_least_squares_rising_fit():
    rng = np.random.default_rng(0)
    score, label = rng.random(40), rng.integers(0, 2, 40).astype(float)
    knots, levels = quality.isotonic(score, label)
    assert (np.diff(knots) >= 0).all() and (np.diff(levels) >= 0).all() and 0 < levels.min() <= levels.max() < 1
    order = np.argsort(score)
    s, y = score[order], label[order]
    plain = np.array([max(min(y[j : k + 1].mean() for k in range(i, len(y))) for j in range(i + 1)) for i in range(len(y))])
    pool = np.concatenate(([0], np.cumsum(np.abs(np.diff(plain)) > 1e-12)))
    smooth = np.array([(y[pool == p].sum() + 0.5) / ((pool == p).sum() + 1) for p in pool])
    assert np.allclose(np.interp(s, knots, levels), np.maximum.accumulate(smooth))


def test_classifiers_take_long_texts_and_clashing_names(spark):
    long = "word idiot! " * 300_000
    rows = [(1, long), (2, "a b c"), (None, None), (3, ""), (2, "a b c")]
    docs = spark.createDataFrame(rows, DOCS)
    odd = docs
    for name in ("x", "y", "fold", "score", "spans", "words", "row", "held_out"):
        odd = odd.withColumn(name, F.lit(f"my {name}"))
    named = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for d in (docs, odd):
        stats = quality.document_stats(d)
        model = quality.train_quality(stats, named)
        scores = [r["score"] for r in quality.scored(stats, model).collect()]
        assert len(scores) == 5 and all(0 <= x <= 1 for x in scores)
        again = quality.score_texts(d, quality.train_on_texts(d, named)).collect()
        assert len(again) == 5 and all(0 <= r["quality_score"] <= 1 for r in again)
        tox = toxicity.score_toxicity(d, toxicity.train_toxicity(d, named)).collect()
        assert len(tox) == 5 and all(0 <= r["score"] <= 1 for r in tox)


def test_constant_models(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "x"), (3, "")], DOCS)
    for labels, expected in (([], (0.5, 0.0)), ([(1, 1, 1), (3, 1, 1)], (1.0, 1.0)), ([(1, 0, 0), (None, 1, 1), (2, None, None)], (0.0, 0.0))):
        named = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        stats = quality.document_stats(docs)
        one = quality.scored(stats, quality.train_quality(stats, named)).collect()
        two = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, named)).collect()
        assert [r["score"] for r in one] == [expected[0]] * 4 and [r["score"] for r in two] == [expected[1]] * 4
    empty = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    stats = quality.document_stats(empty)
    assert quality.scored(stats, quality.train_quality(stats, labels)).count() == 0
    assert toxicity.score_toxicity(empty, toxicity.train_toxicity(empty, labels)).count() == 0


def test_score_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 7.0, "mine")], "doc_id long, text string, quality_score double, score string")
    model = quality.Model(np.zeros(quality.STATS), np.ones(quality.STATS), None, np.zeros(1), np.array([0.25]))
    assert tuple(quality.score_texts(docs, model).first()) == (1, "a b", 0.25, "mine")


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    emit, pair, start = rng.random(9) * 3 + 0.1, rng.random((2, 2)) + 0.1, rng.random(2) + 0.1
    first = np.array([0, 0, 4, 5, 9, 9])
    got, _, _ = toxicity.forward_backward(emit, first, pair, start)
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        weight, ones = 0.0, np.zeros(hi - lo)
        for tags in itertools.product((0, 1), repeat=hi - lo):
            if tags:
                w = start[tags[0]] * math.prod(emit[lo + i] for i, t in enumerate(tags) if t) * math.prod(pair[a, b] for a, b in itertools.pairwise(tags))
                weight, ones = weight + w, ones + w * np.array(tags)
        assert np.allclose(got[lo:hi], ones / weight if hi > lo else [])


def test_sweep_over_many_strips():
    rng = np.random.default_rng(2)
    n = 5 * toxicity.STRIP + 17
    emit, restart, matrix, start = rng.random(n) * 5 + 0.01, rng.random(n) < 0.01, rng.random((2, 2)), rng.random(2)
    restart[0] = True
    state, expected = start, []
    for e, r in zip(emit, restart, strict=True):
        state = (start if r else matrix @ state) * np.array([1, e])
        state = state / state.sum()
        expected.append(state)
    assert np.allclose(toxicity.sweep(emit, restart, matrix, start), expected)


def test_spans_are_code_points(spark):
    rng = np.random.default_rng(3)
    clean = [f"wörd{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(300):
        body = list(rng.choice(clean, 20))
        if i % 3 == 0:
            body[int(rng.integers(0, 20))] = '"Vile!"'
        rows.append((i, " ".join(body)))
        labels.append((i, i % 3 == 0))
    docs = spark.createDataFrame(rows, DOCS)
    named = spark.createDataFrame([(i, int(t)) for i, t in labels], "doc_id long, toxic int")
    scored = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, named)).collect()
    texts = dict(rows)
    for r in scored:
        assert (r["score"] >= 0.7) == (r["doc_id"] % 3 == 0)
        assert [texts[r["doc_id"]][s["start"] : s["stop"]] for s in r["spans"]] == (["Vile"] if r["doc_id"] % 3 == 0 else [])


def fold(events):
    """A plain version of the event log's rules, for logs without ties."""
    messages, count = {}, {}
    for conv, seq, kind, msg, role, text in sorted(events, key=lambda e: (e[0], e[1])):
        own = messages.setdefault(conv, [])
        if kind == "message" or not any(m["msg"] == msg for m in own):
            own.append({"msg": msg, "pos": seq, "role": role or "", "text": ""})
        at = max(i for i, m in enumerate(own) if m["msg"] == msg)
        own[at]["text"] = (own[at]["text"] if kind == "delta" else "") + (text or "")
        if role:
            own[at]["role"] = role
        if kind == "regenerate":
            messages[conv] = [m for i, m in enumerate(own) if i <= at]
        count[conv] = count.get(conv, 0) + 1
    return messages


def test_chat_events(spark):
    events = [
        (1, 1, "message", "u1", "user", "hi"), (1, 2, "message", "a1", "assistant", ""), (1, 3, "delta", "a1", None, "Hel"), (1, 4, "delta", "a1", None, "lo"),
        (1, 5, "edit", "u1", None, "hi there"), (1, 6, "message", "u2", "user", "next"), (1, 7, "regenerate", "a1", None, "New "), (1, 8, "delta", "a1", None, "answer </turn>\n### x: \\"),
        (1, 9, "message", "u3", "user", None), (2, 1, "delta", "z", "assistant", "alone"), (2, 2, "message", "z", "us:er#<", "\\l \\e"),
    ]
    df = spark.createDataFrame(events, "conv_id long, seq long, kind string, msg string, role string, text string").repartition(3)
    back = chat_formatting.read_back(chat_formatting.render(chat_formatting.fold_events(df))).collect()
    expected = fold(events)
    for r in back:
        turns = [(m["role"], m["text"]) for m in expected[r["conv_id"]]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert r["loss_text"] == "".join(t for role, t in turns if role == "assistant")
    assert chat_formatting.read_back(chat_formatting.render(chat_formatting.fold_events(df.limit(0)))).count() == 0


def test_chat_nulls(spark):
    turns = spark.createDataFrame([(1, None, "user", None), (1, 0, None, "x"), (None, 2, "assistant", "é日"), (1, 0, None, "x")], "conv_id long, turn long, role string, text string")
    back = chat_formatting.read_back(chat_formatting.render(chat_formatting.fold_events(chat_formatting.events_of_turns(turns)))).collect()
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in back}
    assert got == {1: [("user", ""), ("", "x"), ("", "x")], None: [("assistant", "é日")]}


def test_chat_query_with_repeated_turns_equals_sql(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", "a # <b> \\e"), (1, None, "system", None), (2, 5, None, "x"), (2, 5, "assistant", ""), (2, 5, "assistant", ""), (3, 0, "assistant", "é日" * 3000), (4, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    expected = con.execute(sql.ORACLES["op7_chat_formatting"])
    names = [c[0] for c in expected.description]
    got = queries.op7_chat_formatting(spark, str(tmp_path)).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(expected.fetchall())


def test_chat_ignores_clashing_names(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi", 9, "x", 3), (1, 1, "assistant", "yo", 8, "y", 2)], "conv_id long, turn long, role string, text string, ord long, part string, seq long")
    back = chat_formatting.read_back(chat_formatting.render(chat_formatting.fold_events(chat_formatting.events_of_turns(rows)))).first()
    assert [(t["role"], t["text"]) for t in back["turns"]] == [("user", "hi"), ("assistant", "yo")] and back["loss_text"] == "yo"


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir).cache()
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if k == 2:
            assert docs.select("doc_id").distinct().count() == counts[-1]
    assert counts[0] > counts[1] >= counts[2] > counts[3] and counts[5] >= counts[4] > 0
    assert corpus_pipeline.run(spark, sf_dir).count() == counts[5]


def test_pipeline_stages_take_odd_rows(spark, sf_dir):
    rows = [(1, None, None, None, None), (None, "", "en", "a", 0), (2, "a b " * 50, "en", "a", 1), (2, "a b " * 50, "en", "a", 1)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("row", F.lit("mine")).withColumn("quality_score", F.lit("q"))
    for _, stage in corpus_pipeline.STAGES:
        for docs in (odd, odd.limit(0)):
            out = stage(spark, docs, sf_dir)
            assert out.count() <= 3 * docs.count()
            assert "ids_crc32" in out.columns or out.columns == odd.columns
