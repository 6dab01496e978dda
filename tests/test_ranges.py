"""Bursts and breakers over hot keys, in ranges, against one key after the other."""

import random

import pytest
from pyspark.sql import functions as F

from lathework.operators import cluster, netpolicy, ranges
from lathework.streaming.policies import breaker_stream

EVENTS = "run_id long, seq long, outcome string"


def plain_breaker(rows, threshold, before=None):
    out, state = [], dict(before or {})
    for run, seq, outcome in sorted(rows, key=lambda r: r[1]):
        n, is_open = state.get(run, (0, False))
        n = n + 1 if outcome == "exhausted" else 0
        state[run] = n, is_open or n >= threshold
        out.append((run, seq, *state[run]))
    return sorted(out, key=lambda r: r[1])


def events(rnd, n, bad):
    return [(rnd.choice([1, 1, 1, 1, 1, 1, None, 2, rnd.randint(3, 40)]), i, rnd.choices(["exhausted", "ok", None], [bad, 1, 0.1])[0]) for i in range(n)]


@pytest.mark.parametrize("seed, bad, threshold, parts", [(1, 1, 5, 7), (2, 8, 5, 16), (3, 30, 40, 16), (4, 200, 60, 5), (5, 8, 1, 3)])
def test_breaker_in_ranges(spark, seed, bad, threshold, parts):
    rnd = random.Random(seed)
    rows = events(rnd, 400, bad)
    given = {1: (rnd.randint(0, threshold), False), 2: (0, True), 99: (3, True)}
    before = spark.createDataFrame([(k, *v) for k, v in given.items()], "run_id long, consecutive long, open boolean")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        for start in (None, before):
            for split in (True, False):
                df = spark.createDataFrame(rows, EVENTS).repartition(3)
                got = netpolicy.breaker(df, threshold=threshold, split=split, before=start).select("run_id", "seq", "consecutive", "open").collect()
                assert sorted(map(tuple, got), key=lambda r: r[1]) == plain_breaker(rows, threshold, given if start else None)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_run_of_all_events_is_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranges, "WHOLE", 100)
    df = spark.createDataFrame([(1, i, "exhausted" if i % 7 else "ok") for i in range(4000)], EVENTS)
    assert ranges.crowded(df, ["run_id"]) and not ranges.crowded(df.limit(50), ["run_id"])
    sizes = [r["count"] for r in ranges.in_ranges(df, [F.col("run_id"), F.col("seq")], "t").groupBy("_part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000
    got = netpolicy.breaker(df).agg(F.sum("consecutive"), F.count_if("open")).first()
    want = plain_breaker([tuple(r) for r in df.collect()], 5)
    assert tuple(got) == (sum(r[2] for r in want), sum(r[3] for r in want))
    stopped = netpolicy.early_stop(netpolicy.breaker(df)).first()
    assert tuple(stopped) == (1, 6, 3994)


def test_breaker_of_no_events(spark):
    none = spark.createDataFrame([], EVENTS)
    assert netpolicy.breaker(none, split=True).collect() == [] and netpolicy.breaker(none).collect() == []


def test_a_stream_goes_on_with_the_state_of_the_batch_before(spark, tmp_path):
    rows, source, out = events(random.Random(9), 600, 6), str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        part = spark.createDataFrame(rows[k * 200 : (k + 1) * 200], EVENTS)
        part.coalesce(1).write.mode("append").parquet(source)
        breaker_stream(spark.readStream.schema(EVENTS).parquet(source), out, f"{out}/at", split=k % 2 == 0).awaitTermination()
    got = spark.read.parquet(f"{out}/rows").select("run_id", "seq", "consecutive", "open").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == plain_breaker(rows, 5)


@pytest.mark.parametrize("seed", range(3))
def test_bursts_of_a_hot_key_in_ranges(spark, seed):
    rnd = random.Random(seed)
    frames = [(i, rnd.choice([None, rnd.randint(0, 3000)]), rnd.choice([None, "a", "b"]), rnd.choice([None, i]), rnd.choice(["hot"] * 6 + [None, "x", f"k{rnd.randint(0, 30)}"])) for i in range(500)]
    df = spark.createDataFrame(frames, "key long, s long, stack string, sel_index long, k string").withColumn("time", F.timestamp_seconds("s"))
    run = lambda split: sorted(map(tuple, cluster.bursts(df, 4_000_000, use_stacks=seed != 1, by=["k"], split=split).select("key", "anchor_key", "is_anchor").collect()))
    assert run(True) == run(False)
    two = lambda split: sorted(map(tuple, cluster.bursts(df, 4_000_000, by=["k", "stack"], split=split).select("key", "anchor_key", "is_anchor").collect()))
    assert two(True) == two(False)
