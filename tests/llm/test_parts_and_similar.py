"""Parts of several files, runs of one unit, and near-duplicates by whole sets of shingles."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_operators import ODD, corpus, make

from lathework.llm import _io, _parts, fingerprints, license_scan, simhash, substring_dedup, suffix_array_dedup
from lathework.llm._windows import segments


def shingles(text, k=5):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))) if words else frozenset()


def firsts(sets):
    """The smallest ids of the groups of sets that share four fifths of what either has."""
    up = {i: i for i in sets}
    top = lambda i: i if up[i] == i else top(up[i])
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and (x == y or 5 * len(x & y) >= 4 * len(x | y)):
                i, j = sorted((top(a), top(b)))
                up[j] = i
    return {i for i in ids if top(i) == i}


def rows_of(df):
    return Counter(tuple(str(x) for x in r) for r in df.collect())


@pytest.mark.parametrize("per_file, bits", [(1, 15), (10, 15), (0, 3)])
def test_parts_of_several_files_lose_nothing(spark, monkeypatch, per_file, bits):
    docs = make(spark, corpus(8, 24)[:-2] + ODD).coalesce(2)
    runs = (substring_dedup.substring_dedup, suffix_array_dedup.suffix_array_dedup, simhash.deduplicate, simhash.deduplicate_similar)
    want = [rows_of(f(docs)) for f in runs[: 2 if per_file else 4]]
    spark.conf.set("spark.sql.files.maxRecordsPerFile", str(per_file))
    monkeypatch.setattr(_parts, "PART_BITS", bits)
    try:
        assert [rows_of(f(docs)) for f in runs[: len(want)]] == want
        parts = _parts.write_parts(docs, "doc_id", "text")
        assert parts.single == (bits == 15) and parts.files.count() == parts.n
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_runs_of_one_unit_are_few_segments():
    u = np.r_[np.full(200_000, 7, np.uint64), np.arange(50, dtype=np.uint64)]
    m, first, n, places = segments(u, np.array([len(u)]), 100, 24)
    assert len(m) < 60 and n.sum() == len(u) - 99 and places.sum() > 190_000


def brute(texts, length):
    seen, out = set(), {}
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        out[i] = (len(t), int(gone.sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_runs_of_bytes_of_mixed_length(spark):
    rnd = random.Random(4)
    run = lambda: rnd.choice("ab- ") * rnd.choice([1, 2, 50, 99, 100, 101, 150, 199, 200, 201, 202, 420])
    rows = [(i, "".join(run() for _ in range(rnd.randint(1, 12)))) for i in range(30)] + [(40, "ab" * 700), (41, "ab" * 300), (42, "x" * 16_000)]
    got = suffix_array_dedup.suffix_array_dedup(make(spark, rows)).collect()
    want = brute([(i, t.encode()) for i, t in rows], 100)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got} == want


def test_a_million_of_one_byte_takes_seconds(spark):
    began = time.time()
    rows = [(1, "-" * 1_000_000), (2, " " * 400_000 + "end " * 3), (3, "-" * 300_000 + "\n" + "=" * 90)]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], len(r["kept"])) for r in suffix_array_dedup.suffix_array_dedup(make(spark, rows)).collect()}
    assert time.time() - began < 40
    assert got[1] == (999_999, 1, 1) and got[2] == (399_999, 1, 13) and got[3] == (300_000, 1, 91)


def near_copies(seed, groups=12, copies=6):
    """Texts of which copies lose or change some words, so that similarities lie on both sides of 0.8."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rnd.choice([6, 30, 80, 300]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 30))):
                at = rnd.randrange(len(w))
                w[at : at + 1] = rnd.choice([[], [word()], [w[at], word()], [w[at].upper()]])
            rows.append(" ".join(w))
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("bucket", [16384, 5])
def test_similar_documents_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    for seed in (1, 2):
        rows = near_copies(seed) + [(500, ""), (501, None), (502, " \n"), (503, "one"), (504, "One"), (505, "one two")]
        docs = make(spark, rows)
        kept = simhash.deduplicate_similar(docs)
        assert kept.columns == docs.columns
        got, want = {r["doc_id"] for r in kept.collect()}, firsts({i: shingles(t) for i, t in rows})
        assert len(got ^ want) <= 1 and want - got == set()


def test_similar_rows_of_odd_ids_and_none(spark):
    got = simhash.deduplicate_similar(make(spark, ODD)).collect()
    assert len(got) == 6 and sum(r["doc_id"] is None for r in got) == 1
    assert simhash.deduplicate_similar(make(spark, [])).collect() == []


@pytest.mark.parametrize("common", [64, 2])
def test_no_similar_pair_is_left_out(spark, monkeypatch, common):
    """Forests of one bucket whose nearest pairs are not similar, and documents that share no bucket."""
    monkeypatch.setattr(simhash, "COMMON", common, raising=False)
    for keys in (lambda s: np.zeros(12, np.uint64), lambda s: np.full(12, s[0] if len(s) else 0, np.uint64) + np.arange(12, dtype=np.uint64)):
        monkeypatch.setattr(simhash, "_keys", keys)
        for seed in range(3, 6):
            rows = near_copies(seed)
            kept = simhash.deduplicate_similar(make(spark, rows)).collect()
            assert {r["doc_id"] for r in kept} == firsts({i: shingles(t) for i, t in rows})


def test_first_shingles_and_parities_of_similar_sets():
    rnd = np.random.default_rng(5)
    for _ in range(300):
        n = int(rnd.integers(1, 200))
        x = np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.r_[x[rnd.random(len(x)) < 0.9], rnd.integers(0, 2**63, int(rnd.integers(0, 2 + n // 9)), dtype=np.uint64)])
        shared = len(np.intersect1d(x, y))
        common = rnd.permutation(np.r_[x[::3], rnd.integers(0, 2**63, 5, dtype=np.uint64)])
        differ = np.bitwise_count(np.frombuffer(simhash._parity(x), np.uint8) ^ np.frombuffer(simhash._parity(y), np.uint8)).sum()
        assert differ <= len(x) + len(y) - 2 * shared
        if shared >= 0.8 * (len(x) + len(y) - shared):
            for order in (None, common):
                assert len(np.intersect1d(simhash._first_shingles(x, 0.8, order), simhash._first_shingles(y, 0.8, order)))


COUNTS = {"the": 9000, "of": 8000, "and": 7000, "to": 7000, "in": 6000, "this": 3000, "is": 5000, "license": 50, "under": 400, "work": 300, "version": 30, "licensed": 20}


def test_licences_that_come_close_are_told_apart():
    match = license_scan.Matcher(20_000, COUNTS)
    for name, texts in license_scan.TEMPLATES.items():
        for text in texts:
            assert match.judge(f"words before it\n{text}\nand other words behind it")[0] == name
            assert match.judge(text)[0] == name and match.judge(text)[2]
    for text in (
        "This work is licensed under the GNU General Public License.",  # of which version?
        "This work is licensed under the GNU General Public License, version 1",
        "The contents of this file are subject to the Mozilla Public License Version 1.1",
        license_scan._GNU.format(work="program", kind="European Union Public Licence", version=9),
        "Permission is given to no one to use this software.", "license version " * 50, "",
    ):
        assert match.judge(text)[0] is None
    for name, title in license_scan.TITLES.items():
        text = "\n   " + title.replace(" Version", "\n  Version") + "\n\n" + "Terms of a long text that goes on. " * 500
        assert match.judge(text) == (name, 1.0, True)
        assert match.judge("one\n" * 10 + title)[1:] != (1.0, True) or name == "Apache-2.0"
    assert license_scan.Matcher(20_000, COUNTS, {"MIT": "Released under the MIT License"}).judge(license_scan.TITLES["GPL-3.0"])[0] is None


def test_cosine_of_a_stretch_equals_brute_force():
    match, rnd = license_scan.Matcher(20_000, COUNTS), random.Random(3)
    for template in match.templates:
        pool = list(template.vector) + ["unknown"]
        for _ in range(20):
            words = [rnd.choice(pool) for _ in range(rnd.randint(1, 30))]
            lines = [words[i : i + 7] for i in range(0, len(words), 7)]
            stretch = license_scan.Stretch(template, match, Counter(lines[0]))
            for line in lines[1:]:
                stretch.add(Counter(line))
            known = {t: words.count(t) * match.idf[t] for t in set(words) - {"unknown"}}
            square = sum(w * w for w in known.values()) + words.count("unknown") * match.other
            assert abs(stretch.cosine() - sum(w * template.vector[t] for t, w in known.items()) / square**0.5) < 1e-9


def test_licensed_files_are_not_joined(spark):
    rows = [(i, f"lib/d{i % 3}/f{i}", "MIT" if i % 2 else None, 0.9, i % 50 == 1) for i in range(400)] + [(900, None, None, 0.0, False), (901, None, "ISC", 1.0, True)]
    scanned = spark.createDataFrame(rows, "doc_id long, path string, own_license string, likeness double, is_license_file boolean")
    got = {r["doc_id"]: (r["license"], r["from_dir"]) for r in license_scan.inherit(scanned).collect()}
    assert len(got) == 402 and got[900] == (None, None) and got[901] == ("ISC", None)
    assert all(got[i] == (("MIT", None) if i % 2 else ("MIT", f"lib/d{i % 3}")) for i in range(400))


def test_equal_rows_of_a_crowded_key_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(_io, "CROWD", 100)
    rows = _io.stash(spark.createDataFrame([(None, 0)] * 3000 + [(1, 1)], "doc_id long, f long"), "rows")
    found = spark.createDataFrame([(0, "zero"), (1, "one")], "f long, v string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = _io.spread(rows, found, "f")
        sizes = sorted(len(p) for p in out.rdd.glom().collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 3001 and sizes[-1] < 1500


def test_null_ids_fall_into_ranges_of_their_own(spark, monkeypatch):
    rows = [(None if i % 3 == 0 else i, f"text {i} " + "of some words " * (i % 5)) for i in range(600)] + [(None, "twice"), (None, "twice"), (None, None)]
    read = lambda: Counter((r["doc_id"], r["n_chars"], r["edited"]) for r in fingerprints.fingerprints(make(spark, rows)).collect())
    want = read()
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 20)
    assert read() == want
    parts = fingerprints.next_by_id(make(spark, rows), "doc_id", "text")[0].groupBy("_part").count().collect()
    assert len(parts) > 25 and max(r["count"] for r in parts) < 80


def test_parities_of_large_sets_fold_and_allow_what_is_similar():
    """The parities of sets of different widths are compared, and no pair at the similarity is dropped."""
    rnd = np.random.default_rng(6)
    for _ in range(40):
        n = int(rnd.integers(900, 6000))
        x = np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64))
        share = rnd.choice([0.5, 0.85, 0.9, 0.95])
        y = np.unique(np.r_[x[rnd.random(len(x)) < share], rnd.integers(0, 2**63, n // 25, dtype=np.uint64)])
        shared = len(np.intersect1d(x, y))
        bits = [simhash._wide(z) or simhash._parity(z) for z in (x, y)]
        columns = {"a": [1], "b": [2], "r": [3], "to": [4], "x": [bits[0]], "y": [bits[1]], "m": [len(x)], "n": [len(y)]}
        kept = sum(b.num_rows for b in simhash._may(iter(pa.table(columns).to_batches()), 0.8))
        assert kept or shared < 0.8 * (len(x) + len(y) - shared)
        assert not kept or share > 0.5


def test_first_shingles_are_dealt_without_the_bits(spark, monkeypatch):
    """What is dealt out for each first shingle holds no parities; those join what different roots share."""
    schemas, beside = [], _parts.Parts.beside
    monkeypatch.setattr(_parts.Parts, "beside", lambda self, run, schema, about=None: schemas.append(schema) or beside(self, run, schema, about))
    parts = _parts.write_parts(make(spark, near_copies(3)), "doc_id", "text")
    nodes = spark.createDataFrame([(1, 0, 1, 9, b"")], "s long, r long, root long, n long, bits binary")
    simhash.crossing_links(parts, nodes, 0.8, 5)
    assert [s for s in schemas if "token" in s] == ["token long, count long", "token long, r long, root long"]
