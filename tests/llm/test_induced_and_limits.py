"""Suffix sorting on disk, oversize groups, long words, exact solvers and crowded keys."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lathework.llm import _induced, _io, _windows, packing, quality_classifier, quality_rules, simhash, substring_dedup, suffix_array_dedup
from lathework.llm._bpe import vocabulary, word_bpe
from test_operators import ODD, corpus, make


def common(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("small", [0, 400_000])
@pytest.mark.parametrize("limit", [16, 64 << 20])
def test_sorted_suffixes_and_prefixes(monkeypatch, small, limit):
    rnd, written = random.Random(1), []
    monkeypatch.setattr(_induced, "SMALL", small)
    monkeypatch.setattr(_induced.BucketQueue.__init__, "__defaults__", (limit,))
    put = _induced.BucketQueue._put

    def counted(self, waiting, arrays):
        put(self, waiting, arrays)
        written.append(self.written)

    monkeypatch.setattr(_induced.BucketQueue, "_put", counted)
    for k in range(60):
        x = [rnd.randint(1, rnd.randint(1, 5)) for _ in range(rnd.randint(0, 60))] * rnd.randint(1, 4) + [0]
        most = rnd.choice([2, 9, 500])
        found = list(_induced.sorted_suffixes(np.array(x), most))
        order, prefix = (np.concatenate(c).tolist() for c in zip(*found))
        assert order == sorted(range(len(x)), key=lambda i: x[i:], reverse=True)
        assert prefix[1:] == [min(most, common(x[a:], x[b:])) for a, b in zip(order, order[1:])]
    assert (max(written) > 0) == (limit == 16)


def test_a_shard_many_times_the_queue_limit(monkeypatch):
    rnd, files = random.Random(2), []
    text = "".join(rnd.choice(["the ", "quick ", "fox ", "b", "a", "ab "]) for _ in range(60_000)).encode()
    monkeypatch.setattr(_induced, "SMALL", 2000)  # names repeat, so the recursion goes several levels deep
    monkeypatch.setattr(_induced.BucketQueue.__init__, "__defaults__", (100_000,))
    close = _induced.BucketQueue.close
    monkeypatch.setattr(_induced.BucketQueue, "close", lambda self: (files.append(self.written), close(self)))
    segs = [text[:90_000], text[40_000:140_000], text[:500]]
    got = suffix_array_dedup.repeats(segs, 100)
    seen, want = set(), []
    for s in segs:
        gone = []
        for i in range(len(s) - 99):
            if s[i : i + 100] in seen:
                gone.append(i)
            seen.add(s[i : i + 100])
        want.append(gone)
    assert [g.tolist() for g in got] == want
    assert len(files) >= 9 and max(files) > 3  # three queues a level


@pytest.mark.parametrize("solver", [suffix_array_dedup, substring_dedup])
def test_a_group_larger_than_its_shard(solver):
    rnd, n = random.Random(3), 20
    words = [f"w{i}".encode() for i in range(400)]
    joined = (lambda u: b" ".join(u)) if solver is substring_dedup else (lambda u: b"".join(bytes([x[1] % 250]) for x in u))
    base = [rnd.choice(words) for _ in range(120)]
    rows, seen, want = [], set(), set()
    for d in range(200):
        a = rnd.randint(0, 60)
        u = base[a : a + 40] if d % 3 else [rnd.choice(words) for _ in range(40)]
        s = rnd.randint(0, 9)
        seg = joined(u)
        cut = solver._pieces(seg)
        windows = len(u) - n + 1
        rows.append((5, d, 0, s, d, windows, seg))
        for i in range(windows):
            w = cut(i, i + n)
            if w in seen:
                want.add((d, s + i))
            seen.add(w)
    types = [pa.int64()] * 6 + [pa.binary()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 30]), types)], ["g", "d", "h", "s", "r", "n", "seg"]) for k in range(0, 200, 30)]
    for shard in (300, 1 << 20):
        got = {(r, i) for b in _windows._solve(iter(batches), solver._pieces, solver.repeats, n, shard) for r, s, k in zip(*(c.to_pylist() for c in b.columns)) for i in range(s, s + k)}
        assert got == want


def test_long_words(spark):
    texts = ["x" * 256, "y" * 10_000, "中文" * 500_000, "a b " * 20 + "z" * 1_000_000, "plain words of an ordinary text. " * 3]
    docs = make(spark, list(enumerate(texts)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int")
    got = quality_classifier.score(docs, quality_classifier.fit(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    small = quality_classifier.fit(docs, labels, most_bytes=2000)  # very large sets stay away from the driver
    assert np.isfinite(small.weights).all()


def test_dual_coordinate_descent_reaches_the_optimum():
    rnd = np.random.default_rng(4)
    width, n = 12, 40
    rows = [np.sort(rnd.choice(width, 5, replace=False)) for _ in range(n)]
    scaled = [rnd.normal(size=5) for _ in range(n)]
    y, box = np.where(rnd.random(n) < 0.4, 1.0, -1.0), np.full(n, 0.7)
    w, alpha = quality_classifier.descend(rows, scaled, y, box, width, 2000)
    margins = np.array([w[r] @ x for r, x in zip(rows, scaled)])
    primal = w @ w / 2 + (box * np.maximum(0, 1 - y * margins)).sum()
    dual = alpha.sum() - w @ w / 2
    assert ((0 <= alpha) & (alpha <= box)).all() and primal - dual < 1e-6 * primal


def test_rules_posterior_equals_em_over_documents(spark):
    rows = [(i, t + ".") for i, t in corpus(14, 150)] + [(900 + i, "| # % " * i + "word " * 3 + f"and t{i}") for i in range(12)]
    rows += [(950, " ".join(f"w{i}" for i in range(40)) + " # | % * # | end.")]
    votes = [f"v_{k}" for k in quality_rules.RULES]
    got = quality_rules.quality_rules(make(spark, rows)).collect()
    v = np.array([[r[c] for c in votes] for r in got], float)
    n, prior = len(v), 0.5
    acc = {s: np.full(v.shape[1], quality_rules.RIGHT[s]) for s in (1, -1)}
    for _ in range(3000):
        like_good = np.where(v > 0, acc[1], np.where(v < 0, 1 - acc[-1], 1)).prod(1)
        like_bad = np.where(v > 0, 1 - acc[1], np.where(v < 0, acc[-1], 1)).prod(1)
        good = prior * like_good / (prior * like_good + (1 - prior) * like_bad)
        worth = quality_rules.BELIEF * n
        prior = (good.sum() + quality_rules.SHARE * n / 2) / (n + quality_rules.SHARE * n)
        for s, agree in ((1, good), (-1, 1 - good)):
            on = v == s
            acc[s] = np.maximum(0.5, ((agree[:, None] * on).sum(0) + worth * quality_rules.RIGHT[s]) / (on.sum(0) + worth))
    assert np.allclose(good, [r["p_quality"] for r in got], atol=1e-6)
    assert all(r["kept"] == (not r["base_failed"] and r["p_quality"] >= 0.5) for r in got)
    assert any(r["kept"] and min(r[c] for c in votes) < 0 for r in got) and any(not r["kept"] and not r["base_failed"] for r in got)


def test_long_words_merge_as_short_ones():
    word, rnd = word_bpe(vocabulary("word_bpe_49k.json")), random.Random(5)
    for _ in range(200):
        w = "".join(rnd.choice("abeinorstu") for _ in range(rnd.randint(49, 200)))
        parts = [*w[:-1], w[-1] + word.end]
        while True:
            ranks = [(word.rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in word.rank]
            if not ranks:
                break
            _, i = min(ranks)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert word.merge(w) == [word.vocab[p] for p in parts]
    began = time.time()
    word.merge("thequickbrownfox" * 20_000)
    assert time.time() - began < 30


def test_packing_of_odd_rows(spark):
    path = vocabulary("byte_bpe_50k.json")
    got = packing.pack(make(spark, ODD), path).collect()
    starts = Counter(r["doc_id"] for r in got if r["start"] == 0)
    assert starts == Counter(i for i, _ in ODD)
    assert packing.pack(make(spark, []), path).collect() == []


def test_remove_known_with_nothing(spark):
    docs, none = make(spark, [(1, "a b"), (2, None)]), spark.createDataFrame([], "text string")
    assert {r["doc_id"]: r["kept"] for r in substring_dedup.remove_known(docs, none).collect()} == {1: "a b", 2: ""}
    assert substring_dedup.remove_known(docs.limit(0), docs.select("text")).collect() == []


def test_deduplicate_keeps_columns_and_first_rows(spark):
    rows = corpus(6, 40) + [(None, "x y z a b c"), (None, "x y z a b c"), (7, "another text of seven")]
    docs = make(spark, rows)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    groups = {}
    for r in simhash.near_duplicates(docs).join(docs.select("doc_id").distinct(), "doc_id").collect():
        groups.setdefault(r["component_id"], r["component_id"])
    got = kept.collect()
    assert {r["doc_id"] for r in got} >= set(groups)
    assert sum(r["doc_id"] is None for r in got) == 1 and len({(r["doc_id"], r["text"]) for r in got}) == len(got)


def test_crowded_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr(_io, "CROWD", 5)
    rows = spark.createDataFrame([(i, "a" if i % 3 else f"k{i % 5}" if i % 4 else None) for i in range(200)], "id long, k string")
    found = spark.createDataFrame([("a", 1), ("k0", 2), ("k1", 3)], "k string, v int")
    for how in ("inner", "left"):
        want = Counter(map(tuple, rows.join(found, "k", how).select("id", "v").collect()))
        assert Counter(map(tuple, _io.spread(rows, found, "k", how).select("id", "v").collect())) == want
    assert rows.filter(F.col("k") == "a").count() > 5
