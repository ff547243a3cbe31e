"""Line dedup, near-dedup, packing, mixing and substring dedup against plain versions on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfield.llm import components, line_dedup, minhash_dedup, mixing, packing, substring_dedup
from nearfield.llm import textbatch as tb

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def words(text):
    return [w.decode() for w in WORD.findall((text or "").encode())]


def odd_rows():
    """Nulls, empty and very long texts, repeated rows and ids, unusual spaces and characters."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
    passage = " ".join(f"p{i}" for i in range(70))
    return [
        (1, passage, "en", "a", 1), (1, passage, "en", "a", 1), (2, f"start {passage} stop", None, None, None), (3, None, "en", "b", 0), (4, "", "en", "b", 0), (5, " \t\n ", "en", None, 3),
        (None, passage, "en", "c", 9), (None, None, None, None, None), (6, long, "en", "c", 10), (7, long + " end", "en", "a", 11), (8, "é ü 　 日本\x1cx", "xx", "ä", 5), (9, passage.upper(), "en", "b", 2),
        (2, "another text with the same id", "en", "z", 4),
    ]


def random_docs(n=90, seed=0):
    """Texts that share passages, lines and near copies."""
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(300)]
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    passages = [text(rng.randint(45, 130)) for _ in range(5)]
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.45:
            body = list(rng.choice(texts))
            for _ in range(rng.randint(0, max(1, len(body) // 60))):
                body[rng.randrange(len(body))] = rng.choice(vocab)
        else:
            body = text(rng.randint(1, 220))
            for p in rng.sample(passages, rng.randint(0, 2)):
                cut = rng.randint(0, len(p) - 40)
                at = rng.randint(0, len(body))
                body[at:at] = p[cut:]
        texts.append(body)
        lines, k = [], 0
        while k < len(body):
            step = rng.randint(3, 12)
            lines.append(" ".join(body[k : k + step]))
            k += step
        if rng.random() < 0.5:
            lines.insert(rng.randint(0, len(lines)), "the same footer line")
        rows.append((i * 3 + 1, "\n".join(lines), "en", f"s{rng.randint(0, 5)}", 0))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


CASES = [random_docs(), odd_rows()]


@pytest.fixture(params=range(len(CASES)))
def rows(request):
    return CASES[request.param]


def test_line_dedup(spark, rows):
    lines, first = defaultdict(set), {}
    key = lambda r: (r[0] is not None, r[0] or 0)
    hashed = lambda t: spark.sql("select xxhash64(?)", [t]).first()[0]
    for r in rows:
        for pos, line in enumerate((r[1] or "").split("\n")):
            if line.strip(" "):
                lines[line].add(r[3])
    common = {line for line, sites in lines.items() if len(sites) >= 3}
    for r in rows:
        for pos, line in enumerate((r[1] or "").split("\n")):
            if line in common and line.strip(" "):
                place = (key(r), hashed(r[1]), pos)
                first[line] = min(first.get(line, place), place)
    expected = []
    for r in rows:
        kept = None if r[1] is None else "\n".join(x for p, x in enumerate(r[1].split("\n")) if x not in common or first[x] == (key(r), hashed(r[1]), p))
        expected.append((r[0], kept, r[3]))
    got = line_dedup.line_dedup(frame(spark, rows), min_sites=3, stats=True)
    assert got.columns == DOCS.replace(" long", "").replace(" string", "").split(", ") + ["n_lines", "n_removed"]
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got.collect()) == Counter(expected)


def shingles(text):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_duplicates(spark, rows, percent=85):
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    ids = [minhash_dedup.LAST_ID if r[0] is None else r[0] for r in rows]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and (ids[i] == ids[j] or 100 * len(a & b) >= percent * len(a | b)):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = [min(ids[j] for j in range(len(rows)) if group[j] == g) for g in group]
    expected = Counter((r[0], len(s), None if m == minhash_dedup.LAST_ID else m, i == m) for r, s, i, m in zip(rows, sets, ids, least, strict=True))
    found = minhash_dedup.near_duplicates(frame(spark, rows).select("doc_id", "text"), percent)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found.collect()) == expected
    if rows is CASES[1]:
        kept = minhash_dedup.keep_one(frame(spark, rows), percent)
        once = {(i, frozenset(s)) for i, s, m in zip(ids, sets, least, strict=True) if s and i == m}
        assert kept.columns == frame(spark, rows).columns and kept.count() == len(once) + sum(not s for s in sets)


@pytest.mark.parametrize(("limit", "block", "rest"), [(4, 8, 1000), (4, 16, 3), (8, 4, 20)])
def test_large_nodes_branch_and_grid(spark, limit, block, rest, monkeypatch):
    """Nodes far above the limits, of near copies and of texts that only share a beginning, give the same groups: by blocks, and by medoids and branching."""
    monkeypatch.setattr(minhash_dedup, "NODE_DOCS", limit)
    monkeypatch.setattr(minhash_dedup, "BLOCK_DOCS", block)
    monkeypatch.setattr(minhash_dedup, "MOST_REST", rest)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(40):
        body = list(base)
        body[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(body), "en", "a", 0))
    for i in range(40, 70):
        rows.append((i, " ".join(base[:90] + [f"y{i}_{k}" for k in range(12)]), "en", "a", 0))
    test_near_duplicates(spark, rows, 80)


def test_components(spark):
    edges = [(i, i + 1) for i in range(20, 60)] + [(5, 4), (4, 3), (100, 3), (7, 7), (20, 21)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 20 for i in range(20, 61)}, 3: 3, 4: 3, 5: 3, 100: 3}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_substring_dedup(spark, rows):
    starts = defaultdict(set)
    ids = [substring_dedup.LAST_ID if r[0] is None else r[0] for r in rows]
    for i, r in zip(ids, rows, strict=True):
        w = words(r[1])
        for k in range(len(w) - 49):
            starts[hashlib.md5(" ".join(w[k : k + 50]).encode()).digest()].add(i)
    expected = []
    for i, r in zip(ids, rows, strict=True):
        w = words(r[1])
        gone = set()
        for k in range(len(w) - 49):
            if min(starts[hashlib.md5(" ".join(w[k : k + 50]).encode()).digest()]) < i:
                gone.update(range(k, k + 50))
        expected.append((r[0], len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = substring_dedup.substring_dedup(frame(spark, rows).withColumn("th", F.lit("mine")).withColumn("runs", F.lit(1)))
    assert Counter((r["doc_id"], r["dedup"]["n_words"], r["dedup"]["n_removed"], r["text"]) for r in got.collect()) == Counter(expected)
    assert {r["th"] for r in got.collect()} == {"mine"}


def test_factors_are_greedy_copies(spark, rows):
    """Every factor is a copy of 50 words or more of the named place, cannot go on there unless the next place has a smaller reference, and all duplicate windows are in factors."""
    docs = frame(spark, rows)
    texts = {}
    for r in docs.select(F.coalesce("doc_id", F.lit(substring_dedup.LAST_ID)).alias("doc"), F.xxhash64("text").alias("th"), "text").collect():
        texts[r["doc"], r["th"]] = words(r["text"])
    starts = {}
    for (doc, th), w in texts.items():
        for k in range(len(w) - 49):
            starts.setdefault(tuple(w[k : k + 50]), set()).add(doc)
    found = {(r["doc"], r["th"]): r["factors"] for r in substring_dedup.factors(docs).collect()}
    for key, w in texts.items():
        covered = set()
        own = found.get(key, [])
        assert [f["start"] for f in own] == sorted({f["start"] for f in own})
        for f, after in zip(own, [*own, None][1:], strict=True):
            source = texts[f["doc"], f["th"]]
            assert f["length"] >= 50 and f["doc"] < key[0]
            assert w[f["start"] : f["start"] + f["length"]] == source[f["at"] : f["at"] + f["length"]]
            windows = range(f["start"], f["start"] + f["length"] - 49)
            assert covered.isdisjoint(windows)
            covered.update(windows)
            if after is not None and after["start"] == windows.stop:
                assert (after["doc"], after["th"], after["at"]) != (f["doc"], f["th"], f["at"] + len(windows))
        assert covered == {k for k in range(len(w) - 49) if min(starts[tuple(w[k : k + 50])]) < key[0]}


def test_passages_repeated_inside_a_document(spark):
    """Parts of one passage, cut at different places and repeated inside documents and across rows of one doc_id."""
    rng = random.Random(11)
    passage = [f"p{rng.randrange(400)}" for _ in range(260)]
    rows = [(1, " ".join(passage[:150]), "en", "a", 0), (2, " ".join(passage[60:]), "en", "a", 0)]
    for i in range(3, 12):
        body = []
        for _ in range(3):
            lo = rng.randrange(200)
            body += passage[lo : lo + rng.randrange(40, 160)] + [f"f{i}_{rng.randrange(50)}" for _ in range(rng.randrange(1, 20))]
        rows += [(i, " ".join(body * (1 + i % 2)), "en", "a", 0)] * (1 + (i % 4 == 0))
        rows.append((i, " ".join(body[::-1] + body[:70]), "en", "a", 0))
    test_substring_dedup(spark, rows)
    test_factors_are_greedy_copies(spark, rows)


def test_large_sides_are_sieved(spark, monkeypatch):
    """The same results where nothing is small enough to broadcast."""
    monkeypatch.setattr(substring_dedup.scratch, "BROADCAST_BYTES", 0)
    for rows in CASES:
        test_substring_dedup(spark, rows)


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    expected = Counter()
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            expected[r[0], piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = packing.best_fit_pack(frame(spark, rows), TOKENIZER).collect()
    assert Counter(tuple(r[:5]) for r in got) == expected
    check_layout(got)


def check_layout(rows, slack=0.02):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
        total += end
    assert len(bins) <= -(-total // 2048) * (1 + slack) + 1


def test_special_strings_and_spaces_are_tokenised_alike():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    texts = ["a<|endoftext|>b c", "x\u0085y z I'VE don't 12 34", "e ́ \x1c\x1f ΑΣ", "﻿İstanbul ǅ", ""]
    data, offsets = tb.as_bytes(pa.array(texts))
    ids, upto = packing.WordBpe(TOKENIZER).encode(data, offsets)
    assert [list(ids[a:b]) for a, b in zip(upto[:-1], upto[1:], strict=True)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("seed", range(6))
def test_patterns_hold_every_piece(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 60))
    count = np.zeros(capacity + 1, np.int64)
    for s in rng.integers(1, capacity + 1, 400):
        count[s] += rng.integers(1, 4)
    patterns = packing.pack_lengths(count)
    held = np.zeros(capacity + 1, np.int64)
    for lengths, times in patterns:
        assert sum(lengths) <= capacity
        for s in lengths:
            held[s] += times
    assert (held == count).all()
    plain = sum(t for _, t in packing.best_fit(count))
    assert sum(t for _, t in patterns) <= plain * 1.01 + 1


def test_reduction_is_optimal_on_small_instances():
    rng = np.random.default_rng(3)
    for _ in range(60):
        capacity, items = 12, sorted((int(x) for x in rng.integers(3, 13, 7)), reverse=True)
        best = [len(items)]

        def place(i, bins, items=items, best=best, capacity=capacity):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + items[i] <= capacity:
                    place(i + 1, [*bins[:b], bins[b] + items[i], *bins[b + 1 :]])
            place(i + 1, [*bins, items[i]])

        place(0, [])
        count = np.bincount(items, minlength=capacity + 1)
        left = count.copy()
        fixed = sum(t for _, t in packing.reduce_instance(left))
        if not left.any():
            assert fixed == best[0]


def test_ranks_are_dealt_by_salt(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 3)
    rows = [(i, "same words here", "en", "a", 0) for i in range(50)] + [(None, "same words here", "en", "a", 0)] * 4
    got = packing.best_fit_pack(frame(spark, rows), TOKENIZER).collect()
    assert len(got) == 54
    check_layout(got)


def test_mixing(spark, rows):
    got = mixing.mix_documents(frame(spark, rows)).drop("key").collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, left, active = {}, float(sum(sizes.values())), [s for s in names]
    while active:
        level = left / sum(weight[s] for s in active)
        over = [s for s in active if weight[s] * level > 3 * sizes[s]]
        if not over:
            target.update({s: weight[s] * level for s in active})
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            active.remove(s)
    taken, largest = Counter(), Counter()
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in names:
        assert abs(taken[s] - target[s]) <= largest[s]
    again = mixing.mix_documents(frame(spark, rows).repartition(5)).drop("key").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    out = mixing.take_mix(frame(spark, rows).withColumn("size", F.lit("mine")).withColumn("copies", F.lit(0)))
    assert out.columns[-2:] == ["size", "copies"]
    if len({r[0] for r in rows}) == len(rows):
        assert sum(len(words(r["text"])) for r in out.collect()) == sum(taken.values())


def test_unequal_probabilities(spark):
    """Inclusion odds follow the weights; sizes stay fixed; whole copies are certain; null ids have random numbers of their own."""
    rows = [(None if i % 40 == 0 else i, f"{i % 2}", 10, 1.0 + 3 * (i % 4 == 0)) for i in range(4000)]
    sized = spark.createDataFrame([(d, str(d) if d is not None else f"null {i}", s, z, w) for i, (d, s, z, w) in enumerate(rows)], "doc_id long, key string, source string, size long, w double")
    targets = spark.createDataFrame([("0", 20_000, 8_000.0), ("1", 20_000, 25_000.0)], "source string, source_size long, target double")
    first = mixing.pareto_mix(sized, targets, weight_col="w").collect()
    words_of = Counter()
    share = defaultdict(list)
    for r in first:
        words_of[r["source"]] += r["taken"]
        share[r["source"], r["w"]].append(r["copies"])
        assert r["taken"] == r["copies"] * r["size"]
    assert abs(words_of["0"] - 8_000) <= 10 and abs(words_of["1"] - 25_000) <= 10
    assert 3.2 < np.mean(share["0", 4.0]) / np.mean(share["0", 1.0]) < 4.8
    assert min(share["1", 1.0]) == 1 and max(share["1", 1.0]) == 2
    nulls = [r["copies"] for r in first if r["doc_id"] is None]
    assert 0 < np.mean(nulls) < max(nulls)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert line_dedup.line_dedup(empty).count() == 0
    assert minhash_dedup.near_duplicates(empty).count() == 0 and minhash_dedup.keep_one(empty).count() == 0
    assert substring_dedup.substring_dedup(empty).count() == 0
    assert packing.best_fit_pack(empty, TOKENIZER).count() == 0
    assert mixing.mix_documents(empty).count() == 0 and mixing.take_mix(empty).count() == 0


def test_clashing_names(spark):
    odd = ["row", "of", "key", "th", "removed", "id", "h1", "h2", "n", "cut", "doc", "start", "_key", "d", "s", "z"]
    docs = frame(spark, random_docs(12))
    for name in odd:
        docs = docs.withColumn(name, F.lit(f"my {name}"))
    for out in (line_dedup.line_dedup(docs), minhash_dedup.keep_one(docs), substring_dedup.substring_dedup(docs), mixing.take_mix(docs)):
        assert all(r[name] == f"my {name}" for r in out.collect() for name in odd)
