"""The pipeline on the smallest tables, stage by stage."""

from test_parts_and_similar import firsts, shingles

import corpus_pipeline as cp
from lathework.llm._io import stash

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, labels = docs.columns, {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    before = docs
    for name, stage in cp.STAGES:
        docs = stash(stage(spark, before, DATA), "test")
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in before.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == columns
        if name == "quality classifier":
            good = {i for i, q in labels.items() if q == 1}
            kept = {i for i in ids if labels.get(i) == 1}
            assert len(kept) >= 0.9 * len(good) and not [i for i in ids if labels.get(i) == 0]
        if name == "simhash near-dedup":
            sets = {r["doc_id"]: shingles(r["text"]) for r in before.collect()}
            assert ids == firsts(sets)
        before = docs


def test_odd_rows_and_an_empty_table(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, "some words of a text that is long enough to be kept here.", None, None, None), (1, None, "en", "s", 0), (2, "", None, None, None), (3, "a b", "en", "s", 3), (3, "a b", "en", "s", 3)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in cp.STAGES:
            docs = stash(stage(spark, docs, DATA), "test")
        assert docs.count() == 0  # the rules or the classifier reject all of these
    docs, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    assert sorted(r["doc_id"] or 0 for r in cp.near_dedup(spark, docs, DATA).collect()) == [0, 1, 3]
    assert cp.substrings(spark, docs, DATA).count() == 5
    assert {r["doc_id"] for r in cp.packing(spark, docs, DATA).collect()} == {None, 1, 2, 3}
    assert not any(stage(spark, none, DATA).count() for _, stage in cp.STAGES)


def test_documents_are_told_apart_by_id_and_text(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = lambda k: " ".join(f"{k}word{i * i % 97}{k}x{i}" for i in range(40)) + "."
    junk, passage = "# | # | " * 30, " ".join(f"p{i}" for i in range(25))
    docs = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    good = [(i, text(k)) for i, k in ((None, "a"), (None, "b"), (7, "c"), (7, "d"), (8, "e"))]
    assert pairs(cp.rules(spark, docs(good + [(None, junk), (7, junk)]), DATA)) == sorted(good, key=repr)
    assert pairs(cp.near_dedup(spark, docs(good + good[:3] + [(9, text("e"))]), DATA)) == sorted(good, key=repr)
    rows = [(1, passage + " z"), (7, text("c")), (7, passage + " y"), (None, text("a")), (None, passage + " x"), (None, passage + " x")]
    got = pairs(cp.substrings(spark, docs(rows), DATA))
    assert got == sorted([(1, passage + " z"), (7, text("c")), (7, "y"), (None, text("a")), (None, "x"), (None, "x")], key=repr)
