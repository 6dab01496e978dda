"""Periodic runs, token counts and the filter audit against brute force."""

import hashlib
import random
import time
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import pytest
from test_operators import ODD, corpus, make

from lathework.llm import filter_audit as fa
from lathework.llm import queries
from lathework.llm._bpe import vocabulary, word_bpe
from lathework.llm.periodic_runs import lyndon, periodic_runs, runs
from lathework.llm.token_counts import merges, token_counts

VOCABULARY = "word_bpe_49k.json"


def brute_runs(t, least=6, times=4):
    out = []
    for q in range(1, len(t) // times + 1):
        i = 0
        while i + q < len(t):
            j = i
            while j + q < len(t) and t[j] == t[j + q]:
                j += 1
            length = j - i + q
            smaller = (d for d in range(1, q) if all(t[x] == t[x + d] for x in range(i, i + length - d)))
            if j > i and length >= max(least, times * q) and next(smaller, None) is None:
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least, times", [(6, 4), (2, 2), (6, 3)])
def test_runs_of_small_alphabets(least, times):
    rnd = random.Random(7)
    for _ in range(400):
        texts = []
        for _ in range(rnd.randint(1, 4)):
            t = [rnd.randrange(rnd.choice([1, 2, 3, 5])) for _ in range(rnd.randint(0, 40))]
            texts.append(t[:5] + (t[: rnd.randint(1, 40)] * 8)[: rnd.randint(0, 120)] + t[-3:])
        assert runs(texts, least, times) == [brute_runs(t, least, times) for t in texts]


class Letters(list):
    """Counts how often a letter is read."""

    read = 0

    def __getitem__(self, i):
        Letters.read += 1
        return list.__getitem__(self, i)


@pytest.mark.parametrize("kind", ["one", "two", "fibonacci", "doubled", "thue", "random"])
def test_lyndon_arrays_read_a_bounded_number_of_letters_a_word(kind):
    def text(n):
        if kind == "fibonacci":
            a, b = [1], [1, 2]
            while len(b) < n:
                a, b = b, b + a
            return b[:n]
        if kind == "doubled":
            w = [1]
            while len(w) < n:
                w = w + w[:-1] + [w[-1] + 1]
            return w[:n]
        of = {"one": lambda i: 1, "two": lambda i: i % 2, "thue": lambda i: bin(i).count("1") % 2, "random": lambda i: zlib.crc32(b"%d" % i) % 3}
        return [of[kind](i) for i in range(n)]

    for n in (2_000, 16_000):
        Letters.read = 0
        lyndon(Letters([*text(n), -1]))
        assert Letters.read < 14 * n


def test_smaller_suffixes_and_shared_letters():
    rnd = random.Random(3)
    for _ in range(200):
        t = [rnd.randrange(3) for _ in range(rnd.randint(0, 30))] + [-1]
        nss, shared = lyndon(t)
        for i in range(len(t)):
            want = next((j for j in range(i + 1, len(t)) if t[j:] < t[i:]), len(t))
            assert nss[i] == want
            if want < len(t):
                k = 0
                while t[i + k] == t[want + k]:
                    k += 1
                assert shared[i] == k


def periodic(i, text):
    """Words of the text as the query has them, by its definition."""
    words = (text or "").encode().split()
    if i is not None and words:
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            return [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
    return words


def digest(data):
    return hashlib.sha256(data).hexdigest()


def test_query_of_runs(spark, tmp_path):
    rows = [(i + 100 * k, t) for k in range(3) for i, t in corpus(k)]
    rows += [(1000 + i, "x y z " * i + "q " + "a b\n" * (i // 2)) for i in range(40)] + [(None, "n " * 12), (None, None), (2000, ""), (2001, "é é " * 9)]
    make(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in rows:
        words = periodic(i, text)
        found = brute_runs(words) if len(words) < 2000 else runs([words])[0]
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        gone = {j for s, n, q in found for j in range(s + q, s + n)}
        want.append((i, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join("%d,%d,%d\n" % r for r in found).encode()), digest(b" ".join(w for j, w in enumerate(words) if j not in gone))))
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter(want)
    assert sum(r["n_runs"] > 0 for r in got) > 40 and any(r["n_runs"] > 1 for r in got)


def test_texts_of_one_word_and_very_long_ones(spark):
    rows = [(1, "w " * 400_000), (2, " ".join(f"w{i % 977}" for i in range(300_000))), (3, "one"), (4, "a" * 2_000_000)]
    began = time.time()
    out = {r["doc_id"]: r for r in periodic_runs(make(spark, rows)).collect()}
    assert time.time() - began < 60
    assert [tuple(x) for x in out[1]["runs"]] == [(0, 400_000, 1)] and out[1]["collapsed"] == "w"
    assert tuple(out[2]["strongest"]) == (0, 300_000, 977) and len(out[2]["collapsed"].split()) == 977
    assert out[3]["runs"] == [] and out[3]["strongest"] is None and out[4]["n_words"] == 1


def test_odd_rows_of_runs_and_empty_tables(spark):
    out = periodic_runs(make(spark, ODD)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in ODD)
    assert sorted(r["collapsed"] for r in out if r["doc_id"] == 3) == ["other text of the same id", "word", "word"]
    assert periodic_runs(make(spark, [])).collect() == []


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary(VOCABULARY))
    tok.no_truncation()
    rows = corpus(5) + ODD + [(70, "<|startoftext|>Hello<|endoftext|> we'll İstanbul ΣΑΣ don't 12345 \r\n\t x" * 3), (71, "ab" * 30_000), (72, "é ́ ﬁ 𝟘 " * 400)]
    got = token_counts(make(spark, rows), vocabulary(VOCABULARY)).collect()
    want = [(i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows]
    assert Counter(map(tuple, got)) == Counter(want)
    assert any(r["over_limit"] for r in got)
    assert token_counts(make(spark, []), vocabulary(VOCABULARY)).collect() == []


def test_merges_by_heap_leave_as_many_symbols_as_the_library():
    from tokenizers import Tokenizer

    bpe, tok, rnd = word_bpe(vocabulary(VOCABULARY)), Tokenizer.from_file(vocabulary(VOCABULARY)), random.Random(2)
    for _ in range(3000):
        w = "".join(rnd.choice("aaeinorstth") for _ in range(rnd.choice([1, 2, 5, 12, 40, 90])))
        assert len(w) - merges([*w[:-1], w[-1] + bpe.end], bpe.rank) == len(tok.encode(w, add_special_tokens=False).ids)


def brute_audit(rows, labels):
    def bits(t):
        w = t.encode().split()
        return {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t)}

    key = lambda i: float("inf") if i is None else i
    docs = []
    for i, text, part in rows:
        t = text or ""
        e = any(key(j) < key(i) and (u or "") == t for j, u, _ in rows)
        marks = [(q == 1, x == 1) for j, q, x in labels if j == i and i is not None]
        docs.append((part or "", bits(t) | {"E": e}, any(m[0] for m in marks), any(m[1] for m in marks)))
    out = set()
    for part in {d[0] for d in docs}:
        own, shapley, found = [d for d in docs if d[0] == part], Counter(), []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                fails = sum(d[1][f] for d in own)
                left = [d for d in left if not d[1][f]]
                shapley[f] += len(gone)
                found.append((part, "".join(order), step, len(left), len(gone), fails - len(gone), sum(sum(d[1].values()) == 1 and d[1][f] for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)))
        out |= {(*r, shapley[r[1][r[2] - 1]]) for r in found}
    return out


AUDITED = "doc_id long, text string, source string, mask int, n long, part string, d long"


def audited(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "p", 3) for r in rows], AUDITED)


def test_audit_equals_brute_force(spark):
    rnd = random.Random(11)
    texts = [t for _, t in corpus(2)][:40] + [None, "", "A B C", "x # y " * 30, "plain words that differ " + " ".join(f"w{i}" for i in range(60)), "Loud " * 60]
    rows = [(rnd.choice([*range(80), None]), rnd.choice(texts), rnd.choice(["web", "book", None, ""])) for _ in range(300)]
    labels = [(rnd.choice([*range(80), None]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(60)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute_audit(rows, labels)
    for held, part_bytes in ((fa.HELD_BYTES, fa.PART_BYTES), (500, 2_000)):
        fa.HELD_BYTES, before = held, fa.HELD_BYTES
        got = fa.filter_audit(audited(spark, rows), marks, part_bytes=part_bytes).collect()
        fa.HELD_BYTES = before
        assert len(got) == 120 * 5 * 3 and set(map(tuple, got)) == want
    assert fa.filter_audit(audited(spark, []), marks).collect() == []


def test_chains_tell_texts_of_one_fingerprint_apart():
    rows = [(9, 5, "p", "a"), (9, 3, "p", "b"), (9, 4, "q", "a"), (9, 4, "p", "a"), (9, None, "p", "b"), (9, 7, "q", "a")]
    found = list(fa._receive(x for _, x in enumerate(fa._send(iter(rows), 1 << 20))))
    assert Counter((d if d != fa.LAST else None, part, bool(m & fa.REPEAT)) for d, part, m, n in found for _ in range(n)) == Counter(
        [(5, "p", True), (3, "p", False), (4, "q", False), (4, "p", False), (None, "p", True), (7, "q", True)]
    )


def test_a_group_of_copies_comes_to_a_partition_once_for_each_task(spark):
    rows = audited(spark, [(i, "copy " * 60 if i % 3 else f"own {i}", "web") for i in range(3000)]).repartition(6)
    sent = rows.rdd.mapPartitions(lambda it: fa._send(((1, r["doc_id"], r["source"], r["text"]) for r in it), 1 << 20)).collect()
    assert sum(len(x[1]) == 3 and x[1][0].startswith("copy") for x in sent) == 6
    assert fa.masks(rows).groupBy("mask").sum("n").count() > 1


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op13_filter_audit"])
def test_query_equals_its_sql(spark, name):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    got = queries.QUERIES[name](spark, data)
    assert Counter(map(tuple, got.collect())) == Counter(con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL[name]})").fetchall())
