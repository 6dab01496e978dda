"""Committed batches, file sinks, run state, sweeps and images from folders, where things fail half-way."""

import os
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathework.functions import image
from lathework.functions.values import fixed2
from lathework.plans import report
from lathework.plans.write_plan import append
from lathework.sources import batches, files, fs, state
from lathework.streaming.policies import commit_stream

PLAN = "photo_key long, name string"


def names(spark, target):
    return sorted((r["photo_key"], r["name"]) for r in batches.committed(spark, target).collect())


def test_a_failing_name_is_kept_out_and_makes_an_error(spark, tmp_path):
    target = str(tmp_path / "t")
    plan = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b, c"), (2, "d?"), (3, None), (3, " "), (4, "e")], PLAN)
    done = batches.apply(plan, target, "one")
    assert (done.status, done.planned, done.added, done.errors) == ("error", 6, 2, 4)
    assert done.failed == '"b, c" | "d?" | null | " "'
    assert names(spark, target) == [(1, "a"), (4, "e")]
    again = batches.apply(spark.createDataFrame([(9, "z")], PLAN), target, "one")
    assert again == done and names(spark, target) == [(1, "a"), (4, "e")]
    whole = batches.apply(spark.createDataFrame([(5, "good"), (5, "bad?")], PLAN), target, "two", whole=True)
    assert (whole.status, whole.added, whole.attempt) == ("error", 0, None)
    assert names(spark, target) == [(1, "a"), (4, "e")]
    assert batches.apply(plan.filter("name = 'a'"), target, "three").status == "noop"
    assert batches.apply(plan.limit(0), target, "four").status == "noop"
    assert {r["batch"]: r["status"] for r in batches.log(spark, target).collect()} == {"one": "error", "two": "error"}
    with pytest.raises(ValueError):
        batches.apply(plan, target, "../x")


def test_at_most_fifteen_failed_names_are_told(spark, tmp_path):
    done = batches.apply(spark.createDataFrame([(i, f"n{i:02}?") for i in range(40)], PLAN), str(tmp_path), "b")
    assert done.failed.split(" | ") == [f'"n{i:02}?"' for i in range(15)] and done.errors == 40 and done.attempt is None


def test_a_batch_that_dies_leaves_no_rows_and_can_be_tried_again(spark, tmp_path):
    target = str(tmp_path / "t")
    plan = spark.createDataFrame([(i, f"n{i}") for i in range(100)], PLAN).repartition(4)
    dying = plan.withColumn("name", F.when(F.col("photo_key") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("name")))
    done = batches.apply(dying, target, "b")
    assert done.status == "error" and done.error and names(spark, target) == []
    # What a driver that was lost before the manifest leaves behind:
    plan.write.parquet(f"{target}/batch=b/attempt=lost")
    plan.write.parquet(f"{target}/batch=c/attempt=lost")
    assert names(spark, target) == []
    assert batches.apply(plan, target, "b").status == "executed"
    assert len(names(spark, target)) == 100


def test_of_two_writers_of_a_batch_one_commits(spark, tmp_path):
    target, out = str(tmp_path / "t"), []
    plans = [spark.createDataFrame([(i, w) for i in range(20)], PLAN) for w in ("x", "y")]
    threads = [threading.Thread(target=lambda p=p: out.append(batches.apply(p, target, "b"))) for p in plans]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert out[0] == out[1] and len(names(spark, target)) == 20 and len({n for _, n in names(spark, target)}) == 1
    same = spark.createDataFrame([(1, "both")], PLAN)
    folder = f"{target}/batch=other/attempt=k"
    assert batches.apply(same, target, "first").status == "executed"
    same.write.parquet(folder)  # a writer that had planned before the first one committed
    assert fs.publish(spark, f"{target}/_log/other.json", '{"batch": "other", "attempt": "k", "status": "executed"}')
    assert names(spark, target).count((1, "both")) == 1


def test_a_stream_commits_each_batch_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], PLAN).write.parquet(source)
    run = lambda at: commit_stream(spark.readStream.schema(PLAN).parquet(source), target, str(tmp_path / at)).awaitTermination()
    run("at")
    spark.createDataFrame([(2, "b"), (3, "c")], PLAN).write.mode("append").parquet(source)
    run("at")
    assert names(spark, target) == [(1, "a"), (2, "b"), (3, "c")]
    run("lost-checkpoint")  # all batches come again
    assert names(spark, target) == [(1, "a"), (2, "b"), (3, "c")]
    assert append(spark.createDataFrame([(3, "c")], PLAN), target) == "noop"


def test_publish_puts_a_file_once(spark, tmp_path):
    at = str(tmp_path / "x" / "f")
    assert fs.read(spark, at) is None and fs.names(spark, str(tmp_path / "x")) == []
    assert fs.publish(spark, at, "é1") and not fs.publish(spark, at, "2") and fs.read(spark, at) == "é1"
    assert fs.publish(spark, at, "3", replace=True) and fs.read(spark, at) == "3"
    assert [n for n in os.listdir(tmp_path / "x") if not n.endswith(".crc")] == ["f"]


def test_files_of_rows(spark, tmp_path):
    at = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"f{i}.bin", bytes([i, 255])) for i in range(50)] + [("empty", None), ("small", b"s"), ("a/b.txt", b"deep")], "name string, content binary").repartition(5)
    files.write_files(rows, at)
    got = {r["name"]: bytes(r["content"]) for r in files.read_files(spark, at).collect()}
    assert got == {f"f{i}.bin": bytes([i, 255]) for i in range(50)} | {"small": b"s"}
    assert os.path.getsize(f"{at}/empty") == 0  # written, but Spark lists no file without content
    assert open(f"{at}/a/b.txt", "rb").read() == b"deep"
    assert os.path.exists(f"{at}/_SUCCESS") and not [n for n in os.listdir(at) if n.startswith("_waiting")]
    assert {r["name"] for r in files.read_files(spark, at, most=1).collect()} == {"small"}
    for name in ("../up", "_hidden", "", None):
        with pytest.raises(Exception):
            files.write_files(spark.createDataFrame([(name, b"x")], "name string, content binary"), str(tmp_path / "bad"))
    assert not [n for n in os.listdir(tmp_path / "bad") if n[0] not in "._"]


def test_a_task_that_fails_leaves_no_file_of_its_own(spark, tmp_path):
    at = str(tmp_path / "out")
    rows = spark.range(40).coalesce(1).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") == 39, F.raise_error(F.lit("x"))).otherwise("c").cast("binary").alias("content"))
    with pytest.raises(Exception):
        files.write_files(rows, at)
    assert not [n for n in os.listdir(at) if n[0] == "f"] and not os.path.exists(f"{at}/_SUCCESS")


def test_state_of_a_run(spark, tmp_path):
    at = str(tmp_path / "s")
    row = lambda *r: spark.createDataFrame(list(r), state.SCHEMA)
    read = lambda df: sorted(map(tuple, df.collect()))
    assert read(state.load(spark, at)) == [] and not state.clear(spark, at)
    assert state.save(row(("a", "written"), (None, "written"), ("", "existing"), ("b", "odd"), ("c", "errored")), at) == 2
    old = state.load(spark, at)
    state.save(row(("d", "cancelled")), at)
    assert read(old) == [("a", "written"), ("c", "errored")] and read(state.load(spark, at)) == [("d", "cancelled")]
    state.save(row(("e", "cancelled")), at)
    assert len([n for n in os.listdir(at) if n.startswith("state-")]) == 2
    row(("half", "written")).write.parquet(f"{at}/state-half")  # a save that never got to move the pointer
    assert read(state.load(spark, at)) == [("e", "cancelled")]
    assert state.clear(spark, at) and read(state.load(spark, at)) == []


def test_sweep_spares_own_young_and_unknown_folders(spark, tmp_path):
    for name, age in (("run-a", 7 * 3600), ("run-own", 7 * 3600), ("run-young", 3000), ("report-b", 4000), ("report-new", 10), ("other", 10**6), ("run-x y", 10**6)):
        os.makedirs(tmp_path / "t" / name / "deep")
        (tmp_path / "t" / name / "deep" / "f").write_text("x")
        stamp = os.path.getmtime(tmp_path / "t" / name / "deep" / "f") - age
        os.utime(tmp_path / "t" / name / "deep" / "f", (stamp, stamp))
    os.makedirs(tmp_path / "t" / "run-empty")
    (tmp_path / "t" / "loose").write_text("x")
    at = str(tmp_path / "t")
    dry = {r["name"]: r["stale"] for r in files.sweep(spark, at, ["run-own"]).collect()}
    assert dry == {"run-a": True, "run-young": False, "report-b": True, "report-new": False, "other": False, "run-x y": False}
    assert len(os.listdir(at)) == 9
    files.sweep(spark, at, ["run-own"], dry_run=False).collect()
    assert sorted(os.listdir(at)) == ["loose", "other", "report-new", "run-empty", "run-own", "run-x y", "run-young"]


def test_ages_and_numbers_with_two_digits(spark):
    df = spark.createDataFrame([(5.0, 2.0), (5.0, None), (float("nan"), 1.0)], "a double, b double")
    assert [r[0] for r in df.select(files.age_seconds(F.col("a"), F.col("b"))).collect()] == [3.0, None, None]
    values = [0.0, 1.0, 0.125, 0.375, 0.015, 0.045, 1.005, 0.995, 0.555, 2.675, 10.235, 0.1] + [i / 1000 for i in range(1000)]
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", fixed2(F.col("x")).alias("s")).collect()
    assert [r["s"] for r in got] == ["%.2f" % r["x"] for r in got]
    one = spark.range(1).select(report.report_name(F.lit(7)).alias("a"), report.report_name(F.lit(1234567)).alias("b"), report.raster_uri(F.lit("data:image/png;base64,xx")).alias("c"), report.raster_uri(F.lit("http://x")).alias("d")).first()
    assert tuple(one) == ("report-00007.svg", "report-1234567.svg", "data:image/png;base64,xx", None)


# A writer of baseline JPEGs with random coefficients, for the decoder.
DC = ([0, 1, 5, 1, 1, 1, 1, 1, 1] + [0] * 7, list(range(12)))
AC = ([0, 1, 1, 1, 1, 1, 2, 4, 8, 10, 12, 20, 1, 0, 0, 0], [0x00, 0xF0] + [r << 4 | s for r in range(15) for s in (1, 2, 5, 10)])


def codes(counts, symbols):
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = format(code, f"0{length}b")
            code += 1
        at, code = at + n, 2 * code
    return out


def jpeg(w, h, sampling, interval, rnd):
    """(bytes, DC levels of the first component)."""
    dc, ac = codes(*DC), codes(*AC)
    across, down = -(-w // (8 * max(a for a, _ in sampling))), -(-h // (8 * max(b for _, b in sampling)))
    lh, lv = sampling[0]
    field, scan, bits, before = np.zeros((down * lv, across * lh)), b"", [], [0] * len(sampling)

    def packed():
        text = "".join(bits)
        text += "1" * (-len(text) % 8)
        return int("1" + text, 2).to_bytes(len(text) // 8 + 1)[1:].replace(b"\xff", b"\xff\x00")

    for m in range(across * down):
        if interval and m and m % interval == 0:
            scan += packed() + bytes([0xFF, 0xD0 + (m // interval - 1) % 8])
            bits, before = [], [0] * len(sampling)
        for c, (ch, cv) in enumerate(sampling):
            for y in range(cv):
                for x in range(ch):
                    v = rnd.randint(-900, 900)
                    d, before[c] = v - before[c], v
                    size = abs(d).bit_length()
                    bits.append(dc[size] + (format(d if d > 0 else d + (1 << size) - 1, f"0{size}b") if size else ""))
                    if c == 0:
                        field[m // across * lv + y, m % across * lh + x] = v
                    k, full = 1, rnd.random() < 0.1
                    while k < 64:
                        s = 1 if full else rnd.choice(AC[1])
                        if k + (s >> 4) + 1 > (63 if s == 0xF0 else 64):
                            s = 0
                        bits.append(ac[s] + "".join(rnd.choice("01") for _ in range(s & 15)))
                        k += 64 if s == 0 else (s >> 4) + 1
    scan += packed()
    part = lambda m, p: bytes([0xFF, m]) + (len(p) + 2).to_bytes(2) + p
    n = bytes([len(sampling)])
    head = b"\xff\xd8" + part(0xE1, b"\xff\xd8\xff\xc0 a picture inside") + part(0xC0, bytes([8]) + h.to_bytes(2) + w.to_bytes(2) + n + b"".join(bytes([i + 1, a << 4 | b, 0]) for i, (a, b) in enumerate(sampling)))
    tables = part(0xC4, bytes([0, *DC[0], *DC[1]])) + part(0xC4, bytes([16, *AC[0], *AC[1]])) + (part(0xDD, interval.to_bytes(2)) if interval else b"")
    return head + tables + part(0xDA, n + b"".join(bytes([i + 1, 0]) for i in range(len(sampling))) + bytes([0, 63, 0])) + scan + b"\xff\xd9", field


def means(field, rows=8, cols=8):
    h, w = field.shape
    cut = lambda i, n, k: slice(i * n // k, max((i + 1) * n // k, i * n // k + 1))
    return [float(field[cut(y, h, rows), cut(x, w, cols)].mean()) for y in range(rows) for x in range(cols)]


def test_luma_of_images_with_all_coefficients_and_restarts():
    rnd = random.Random(5)
    for _ in range(60):
        sampling = rnd.choice([[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 1)] * 3])
        w, h = rnd.randint(1, 150), rnd.randint(1, 150)
        data, field = jpeg(w, h, sampling, rnd.choice([0, 0, 1, 3, 7, 1000]), rnd)
        assert image.dims(data) == (w, h, None)
        assert np.allclose(image.grid(data), means(field), rtol=0, atol=1e-9)
        assert image.grid(data[:-12]) is None and image.grid(data.replace(b"\xff\xc0\x00", b"\xff\xc2\x00")) is None
    data, _ = jpeg(64, 64, [(1, 1)], 4, rnd)
    at = data.index(b"\xff\xd0")
    assert image.grid(data[:at] + b"\x55" + data[at:]) is None  # more than the interval holds
    assert image.grid(data[:at] + b"\xff\xff" + data[at:]) is not None  # fill bytes


def test_box_means_of_any_size():
    rnd = np.random.default_rng(1)
    for h, w, rows, cols in ((1, 1, 8, 8), (3, 20, 8, 8), (64, 65, 8, 8), (17, 5, 4, 9), (200, 111, 16, 16)):
        field = rnd.integers(-1000, 1000, (h, w)).astype(float)
        assert np.allclose(image.box_means(field, rows, cols).ravel(), means(field, rows, cols), rtol=0, atol=1e-9)


def test_inline_bytes_come_before_a_file(spark, monkeypatch):
    monkeypatch.setattr(image, "MAX_BYTES", 4)
    rows = [(b"own", b"file"), (b"", b"file"), (None, b"12345"), (None, b""), (None, None), (b"longer than the cap", None)]
    got = spark.createDataFrame(rows, "a binary, b binary").select(image.inline(F.col("a"), F.col("b"))).collect()
    assert [r[0] and bytes(r[0]) for r in got] == [b"own", b"file", None, None, None, b"longer than the cap"]


def test_folders_are_listed_without_a_task_for_each(spark, tmp_path):
    """Three hundred folders are listed by few tasks; empty and hidden files do not count."""
    for k in range(300):
        (tmp_path / f"run-{k}" / "in").mkdir(parents=True)
        (tmp_path / f"run-{k}" / "in" / "a.txt").write_text("x" if k % 3 else "")
        (tmp_path / f"run-{k}" / "_b.txt").write_text("x")
    found = files.folders(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert "binaryFile" not in found._jdf.queryExecution().toString()
    assert {(r["name"], r["files"]) for r in found.collect()} == {(f"run-{k}", 1) for k in range(300) if k % 3}
