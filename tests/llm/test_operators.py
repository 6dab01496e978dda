"""The operators against brute force, on small fixtures with copies, near copies and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathework.llm import fingerprints as fp
from lathework.llm import license_scan, packing, quality_classifier, quality_rules, simhash, substring_dedup, suffix_array_dedup, warc
from lathework.llm._bpe import byte_bpe, vocabulary, word_bpe
from lathework.llm._graph import components
from lathework.llm.bpe_codec import decode, encode

SCHEMA = "doc_id long, text string, d long, h string, n_words string, kept string, spans int, score string, own_license string, path string"


def make(spark, rows):
    """Documents with extra columns whose names clash with those of results and inner tables."""
    return spark.createDataFrame([(i, t, 7, "h", "x", "y", 1, "s", "l", f"r/a/{i}.txt") for i, t in rows], SCHEMA)


def corpus(seed=0, n=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    text = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    passage, rows = text(60), []
    for i in range(n):
        t = text(rnd.randint(1, 220))
        if i % 4 == 0:
            t = t + "\n" + passage + " " + text(10)
        if i % 7 == 0 and i:
            t = rows[i // 2][1]
        if i % 9 == 0 and i:
            t = rows[i - 1][1].replace("a", "b", 3)
        rows.append((i, t))
    rows += [(n, ""), (n + 1, " \t\n"), (n + 2, "a " * 300), (n + 3, text(30_000)), (n + 4, rows[3][1])]
    return rows


ODD = [(None, "a null id " * 8), (1, None), (2, ""), (3, "word " * 50), (3, "word " * 50), (3, "other text of the same id"), (4, "x"), (5, "\n\n\n"), (None, None), (6, "é́ \x00  中文 İ <|endoftext|> " * 5)]

RUNS = {
    "substring_dedup": lambda d: substring_dedup.substring_dedup(d),
    "suffix_array_dedup": lambda d: suffix_array_dedup.suffix_array_dedup(d),
    "simhash": lambda d: simhash.near_duplicates(d),
    "fingerprints": lambda d: fp.fingerprints(d),
    "quality_rules": lambda d: quality_rules.quality_rules(d),
    "encode": lambda d: encode(d, vocabulary("word_bpe_49k.json")),
    "license": lambda d: license_scan.inherit(license_scan.scan(d)),
    "classifier": lambda d: quality_classifier.score(d, quality_classifier.fit(d, d.sparkSession.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int"))),
    "warc": lambda d: warc.payload_sizes(warc.read(warc.write(d, "doc_id", "path", "text", 20))).withColumnRenamed("page_id", "doc_id"),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows_come_through(spark, name):
    out = RUNS[name](make(spark, ODD)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in ODD)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, name):
    assert RUNS[name](make(spark, [])).collect() == []


def brute_spans(units, length):
    seen, out = set(), {}
    for i in sorted(units):
        u = units[i]
        gone = np.zeros(len(u), bool)
        for s in range(len(u) - length + 1):
            w = tuple(u[s : s + length]) if isinstance(u, list) else u[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        out[i] = gone
    return out


@pytest.mark.parametrize("hot", [2, 2000])
def test_substring_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr("lathework.llm._windows.HOT", hot)
    rows = corpus(1)
    units = {i: t.encode().split() for i, t in rows}
    want = brute_spans(units, 20)
    for r in substring_dedup.substring_dedup(make(spark, rows)).collect():
        u, gone = units[r["doc_id"]], want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"]) == (len(u), int(gone.sum()))
        assert r["kept"].encode() == b" ".join(w for w, g in zip(u, gone) if not g)
        assert sum(b - a for a, b in r["spans"]) == r["n_removed"]


def test_long_texts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("lathework.llm._windows.BLOCK", 300)
    rows = corpus(2, 20)
    want = brute_spans({i: t.encode().split() for i, t in rows}, 20)
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(make(spark, rows)).collect()}
    assert got == {i: int(g.sum()) for i, g in want.items()}


@pytest.mark.parametrize("hot", [2, 2000])
def test_suffix_array_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr("lathework.llm._windows.HOT", hot)
    monkeypatch.setattr("lathework.llm.suffix_array_dedup.SHARD", 2000)
    rows = corpus(3)
    units = {i: t.encode() for i, t in rows}
    want = brute_spans(units, 100)
    for r in suffix_array_dedup.suffix_array_dedup(make(spark, rows)).collect():
        u, gone = units[r["doc_id"]], want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"]) == (len(u), int(gone.sum()))
        assert bytes(r["kept"]) == bytes(b for b, g in zip(u, gone) if not g)


def test_remove_known(spark):
    known = " ".join(f"w{i}" for i in range(25))
    docs = make(spark, [(1, f"a b {known} c"), (2, "a b c"), (3, None)])
    ref = spark.createDataFrame([(f"x {known} y",), (None,)], "text string")
    got = {r["doc_id"]: (r["kept"], r["n_removed"]) for r in substring_dedup.remove_known(docs, ref).collect()}
    assert got == {1: ("a b c", 25), 2: ("a b c", 0), 3: ("", 0)}


def test_suffix_arrays_and_queues_on_disk(monkeypatch):
    rnd = random.Random(4)
    monkeypatch.setattr(suffix_array_dedup.BucketQueue.__init__, "__defaults__", (16,))
    for _ in range(150):
        x = [rnd.randint(1, rnd.randint(1, 4)) for _ in range(rnd.randint(0, 80))] + [0]
        got = suffix_array_dedup.suffix_array(np.array(x, np.uint16)).tolist()
        assert got == sorted(range(len(x)), key=lambda i: x[i:])


def reference_simhash(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not w:
        return 0
    g = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(f, radius):
    ids, parent = list(f), {}
    top = lambda i: i if parent.get(i, i) == i else top(parent[i])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (f[a] ^ f[b]).bit_count() <= radius:
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("bucket", [4, 16384])
def test_simhash(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rows = corpus(5)
    rows += [(200 + i, rows[1][1] + " " + " ".join(f"z{j}" for j in range(i))) for i in range(1, 12)]
    f = {i: reference_simhash(t) for i, t in rows}
    want = components_of(f, 4)
    got = simhash.near_duplicates(make(spark, rows)).collect()
    assert {r["doc_id"]: r["f"] % 2**64 for r in got} == f
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_simhash_links_of_random_fingerprints():
    rnd = np.random.default_rng(0)
    base = rnd.integers(0, 2**63, 40, dtype=np.int64).astype(np.uint64)
    f = np.unique(np.concatenate([base ^ (np.uint64(1) << rnd.integers(0, 64, 40, dtype=np.uint64)) for _ in range(12)]))
    found = simhash._forest(f, 4)
    joined = components_of({int(x): int(x) for x in f}, 4)
    parent = {}
    top = lambda i: i if parent.get(i, i) == i else top(parent[i])
    for a, b in found:
        x, y = sorted((top(a % 2**64), top(b % 2**64)))
        parent[y] = x
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert groups({int(x): top(int(x)) for x in f}) == groups(joined)
    assert len(found) < len(f)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_fingerprints(spark):
    rows = dict(corpus(6))
    order = sorted(rows, reverse=True)
    for r in fp.fingerprints(make(spark, list(rows.items()))).select("*", fp.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near"), fp.distinct_count(F.col("sketch")).alias("n"), fp.containment(F.col("sketch"), F.col("edited_sketch")).alias("c")).collect():
        t, nxt = rows[r["doc_id"]], rows[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        cut = len(t) // 3
        assert r["edited"] == t[: len(t) - cut] + nxt[:cut]
        a, b = shingles(t), shingles(r["edited"])
        assert abs(r["near"] - (len(a & b) / len(a | b) if a | b else 1)) < 0.2
        assert abs(r["n"] - len(a)) <= 0.35 * len(a)
        assert abs(r["c"] - (len(a & b) / len(a) if a else 1)) < 0.25


def test_sketches_merge(spark):
    a, b = " ".join(f"a{i}" for i in range(500)), " ".join(f"b{i}" for i in range(300))
    df = spark.createDataFrame([("g", a), ("g", b)], "g string, t string").withColumn("sketch", fp.sketch(F.col("t")))
    parts = [r["sketch"] for r in df.collect()]
    whole = sorted(set(parts[0]) | set(parts[1]))[: fp.K]
    assert fp.merge_all(df, ["g"]).first()["sketch"] == whole
    pair = spark.createDataFrame([tuple(parts)], "x array<long>, y array<long>")
    assert pair.select(fp.merge(F.col("x"), F.col("y")).alias("m")).first()["m"] == whole


def test_quality_rules(spark):
    rows = corpus(7) + [(300, "a b c d e f\n" * 6), (301, "one two three"), (302, " | ".join(f"w{i}" for i in range(60))), (303, "one two three. " * 3 + "and so on it goes.")]
    for r in quality_rules.quality_rules(make(spark, rows)).collect():
        t = dict(rows)[r["doc_id"]]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        in_repeat = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(in_repeat))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 10 or 100 * len(in_repeat) > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_little_variety_at_any_length(spark):
    rnd = random.Random(13)
    sizes = (19, 20, 1900, 2000, 2001, 2100, 30_000)
    few, many = (lambda n: [f"word{rnd.randint(1, 60)}" for _ in range(n)]), (lambda n: [f"word{i % 1900}" for i in range(n)])
    texts = [(n, draw(n)) for n in sizes for draw in (few, many)]
    rows = [(i, " ".join(w)) for i, (_, w) in enumerate(texts)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(make(spark, rows)).collect()}
    for i, (n, w) in enumerate(texts):
        varied = sum(len(set(w[a : a + 2000])) for a in range(0, n, 2000))
        assert got[i]["n_varied"] == varied
        if i % 2 == 0 and n > 100:
            assert got[i]["v_repetition"] == -1 and got[i]["n_repeat_words"] < 0.2 * n


def test_em_trusts_rules_that_agree():
    patterns = [((1, 1, 1), 900), ((-1, -1, 1), 80), ((-1, 0, 1), 10), ((0, 1, -1), 10)]
    prior, table = quality_rules.fit(patterns)
    assert 0.8 < prior < 0.99
    assert quality_rules.posterior(prior, table, (1, 1, 1)) > 0.9 > 0.1 > quality_rules.posterior(prior, table, (-1, -1, 1))
    assert quality_rules.fit([]) == (0.5, [])


def test_classifier_on_held_out_rows(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = quality_classifier.score(docs, quality_classifier.fit(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95


def test_words_count_whole():
    of = lambda t: set(quality_classifier.features(t).tolist())
    assert of("fromtheahash,") != of("fromtheablest") and of("\u4e2d\u6587\u7684\u4e00") != of("\u4e2d\u6587\u7684\u4e8c")
    assert of("x" * 1000 + "a") != of("x" * 1000 + "b")


def test_packing(spark):
    path, rows = vocabulary("byte_bpe_50k.json"), corpus(8)
    got = packing.pack(make(spark, rows), path, max_segments=8).collect()
    bpe, seqs, docs = byte_bpe(path), defaultdict(list), defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append(r)
        docs[r["doc_id"]].append(r)
    for i, t in rows:
        ids, pieces = bpe.encode([t])[0] + b"\1\0\0\0", sorted(docs[i], key=lambda r: r["start"])
        assert b"".join(bytes(p["ids"]) for p in pieces) == ids
        assert [p["start"] for p in pieces] == [0, *np.cumsum([p["length"] for p in pieces])[:-1].tolist()]
        assert all(p["doc_tokens"] == len(ids) // 4 for p in pieces)
    padding = 0
    for pieces in seqs.values():
        pieces.sort(key=lambda r: r["offset"])
        size = sum(p["length"] for p in pieces)
        assert [p["offset"] for p in pieces] == [0, *np.cumsum([p["length"] for p in pieces])[:-1].tolist()]
        assert size <= 2048 and len(pieces) <= 8
        padding += 0 if size & (size - 1) == 0 else 2048 - size
    assert padding <= 0.05 * sum(len(p["ids"]) // 4 for p in got)


def test_packing_limits_loss():
    rnd, p = random.Random(9), packing._Packer(0, 64, 5, 40)
    total = 0
    for i in range(800):
        n = rnd.randint(1, 150)
        total += n
        p.add(i, np.full(n, i, "<u4").tobytes(), rnd.randint(0, 20))
    p.finish()
    by = defaultdict(list)
    for row in p.out:
        by[row[5]].append(row)
    assert sum(r[2] for r in p.out) == total
    assert all(sum(r[2] for r in s) <= 64 and len(s) <= 5 and sum(r[7] for r in s) <= 40 for s in by.values())


ODD_TEXTS = ["", "  a  b\t\tc\n\n d ", "Hello<|endoftext|>World <|startoftext|>", "İstanbul ΣΑΣ ǅ ﬁ  x　y \x1cz", "don't we'll I'M 'S 123 4५ 😀😀 ab\x00c", "a" * 300, "a ́b", " \n", "x  ", "é́"]


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    rnd = random.Random(10)
    texts = ODD_TEXTS + ["".join(rnd.choice("ab' \n\t é<|12.,'sthein") for _ in range(400)) for _ in range(100)] + [t for _, t in corpus(11)]
    word, lib = word_bpe(vocabulary("word_bpe_49k.json")), Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for t, (n, ids, text) in zip(texts, word.encode(texts)):
        want = lib.encode(t, add_special_tokens=False).ids
        assert (n, ids, text) == (len(want), " ".join(map(str, want)), lib.decode(want, skip_special_tokens=False))
    lib = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for t, ids in zip(texts, byte_bpe(vocabulary("byte_bpe_50k.json")).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def test_speculation_is_verified():
    word = word_bpe(vocabulary("word_bpe_49k.json"))
    rnd = random.Random(12)
    for _ in range(2000):
        w = "".join(rnd.choice("abeinorstu") for _ in range(rnd.randint(1, 14)))
        guess = word.propose(w)
        pairs = np.array(guess)
        stays = len(guess) < 2 or bool(word.stay(pairs[:-1], pairs[1:]).all())
        assert stays == (guess == word.merge(w))


def test_decode(spark):
    df = spark.createDataFrame([(1, [320, 5]), (2, None)], "doc_id long, ids array<int>")
    word = word_bpe(vocabulary("word_bpe_49k.json"))
    assert {r["doc_id"]: r["decoded"] for r in decode(df, vocabulary("word_bpe_49k.json")).collect()} == {1: word.text[320] + " " + word.text[5], 2: ""}


def test_license_scan_inherits(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/x.py", "some code of no licence\nat all"), ("a/b/c/y.py", "more\ncode"),
        ("a/b/LICENSE", "Licensed under the Apache License, Version 2.0."), ("d/z.py", "This work is licensed under the GNU General Public License, version 3.\n" + "code " * 40),
        ("d/w.py", "words"), (None, "nothing"),
    ]
    docs = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["license"], r["from_dir"]) for r in license_scan.inherit(license_scan.scan(docs)).collect()}
    assert got == {0: ("MIT", None), 1: ("MIT", "a"), 2: ("Apache-2.0", "a/b"), 3: ("Apache-2.0", None), 4: ("GPL-3.0", None), 5: (None, None), 6: (None, None)}


def test_license_of_the_root_reaches_all(spark):
    deep = "/".join(f"d{i}" for i in range(70))
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [("LICENSE", mit), ("x.py", "code"), ("src/x.py", "code"), (f"{deep}/x.py", "code"), ("e/LICENSE", apache), (f"e/{deep}/x.py", "code"), ("/f/x.py", "code"), (None, "code")]
    docs = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["license"], r["from_dir"]) for r in license_scan.inherit(license_scan.scan(docs)).collect()}
    assert got == {0: ("MIT", None), 1: ("MIT", ""), 2: ("MIT", ""), 3: ("MIT", ""), 4: ("Apache-2.0", None), 5: ("Apache-2.0", "e"), 6: ("MIT", ""), 7: (None, None)}


def test_warc_round_trip(spark):
    big = "<p>é" * 400
    rows = [(1, "u1", big), (2, "u2", big), (3, "u\n3", "small"), (4, None, "small"), (5, "u5", None), (None, "u6", big), (7, "u7", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write(pages)
    assert index.count() == len(rows)
    records = {r["record_id"]: r for r in warc.read(index).collect()}
    assert bytes(records[7]["payload"]).decode() == big and bytes(records[1]["payload"]) == b""
    got = {r["page_id"]: r for r in warc.payload_sizes(warc.read(index)).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        last = 7 if html == big else None
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", last) if last and i != last else ("response", None))
    one = warc.read(index.filter("record_id = 3")).collect()
    assert [bytes(r["payload"]) for r in one] == [b"small"]


def commented(text, mark, width):
    import textwrap

    return "\n".join(f"{mark} {x}" for x in textwrap.wrap(text, width))


def test_licence_files_and_wrapped_headers(spark):
    t = license_scan.TEMPLATES
    code = "\n".join(f"x{i} = compute(y{i}, z{i})" for i in range(60))
    mit = f"MIT License\n\nCopyright (c) 2020 A. Body\n\n{commented(t['MIT'][1], '', 72)}\n"
    bsd = f"Copyright (c) 2021, A. Body\nAll rights reserved.\n\n{commented(t['BSD-3-Clause'][1], '', 60)}"
    rows = [
        ("m/LICENSE", mit), ("m/a/x.py", code), ("b/COPYING", bsd), ("b/y.py", code),
        ("c/h.c", commented(t["GPL-2.0"][1], " *", 50) + "\n" + code), ("c/i.c", commented(t["GPL-3.0"][1], "#", 64) + "\n" + code),
        ("c/j.c", code + "\n" + commented(t["Apache-2.0"][1], "//", 40) + "\n" + code), ("c/k.c", commented(t["MPL-2.0"][1], "//", 30) + "\n" + code),
        ("c/l.c", "# This work is licensed under the\n# GNU General Public License,\n# version 3\n" + code), ("c/m.c", code),
        ("p/n.md", "The public may copy this file for the purpose of use without warranty.\n" * 30), ("p/o.md", "license\n" * 2000 + "version " * 2000),
    ]
    docs = spark.createDataFrame([(i, p, x) for i, (p, x) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r["path"]: (r["license"], r["is_license_file"], r["from_dir"]) for r in license_scan.inherit(license_scan.scan(docs)).collect()}
    assert got == {
        "m/LICENSE": ("MIT", True, None), "m/a/x.py": ("MIT", False, "m"), "b/COPYING": ("BSD-3-Clause", True, None), "b/y.py": ("BSD-3-Clause", False, "b"),
        "c/h.c": ("GPL-2.0", False, None), "c/i.c": ("GPL-3.0", False, None), "c/j.c": ("Apache-2.0", False, None), "c/k.c": ("MPL-2.0", False, None),
        "c/l.c": ("GPL-3.0", False, None), "c/m.c": (None, False, None), "p/n.md": (None, False, None), "p/o.md": (None, False, None),
    }


def test_what_cannot_reach_the_least_cosine_is_all_that_is_left_out():
    """Brute force: every run of lines of small texts, held against every template."""
    rnd = random.Random(3)
    pool = sorted({w for _, x in license_scan._texts(license_scan.TEMPLATES) for w in license_scan.terms(x)}) + [f"w{i}" for i in range(40)]
    frequency = {w: rnd.randint(0, 500) for w in pool}
    match = license_scan.Matcher(1000, frequency)
    notices = [x for _, x in license_scan._texts(license_scan.TEMPLATES) if len(license_scan.terms(x)) < 20]
    for _ in range(60):
        lines = [" ".join(rnd.choices(pool, k=rnd.randint(1, 6))) for _ in range(rnd.randint(0, 5))]
        for x in rnd.sample(notices, rnd.randint(0, 2)):
            words = x.split()
            cut = rnd.randint(1, len(words))
            at = rnd.randint(0, len(lines))
            lines[at:at] = [y for y in (" ".join(words[:cut]), " ".join(words[cut:])) if y]
        runs = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines) + 1)]
        most = 0.0
        for a, b in runs:
            count = Counter(license_scan.terms(" ".join(lines[a:b])))
            for template in match.templates:
                stretch = license_scan.Stretch(template, match, count)
                if stretch.cosine() >= license_scan.LEAST and stretch.counts():
                    most = max(most, stretch.cosine())
                    assert template.telling & set(count) and template.reachable(frozenset(count)) >= license_scan.LEAST
        name, cosine, _ = match.judge("\n".join(lines))
        assert (name is None) == (most == 0.0) and cosine <= most + 1e-9
        assert cosine >= most - 0.05
