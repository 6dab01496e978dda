import random

import pytest
from pyspark.sql import functions as F

from lathework.functions import image, text, values
from lathework.operators import cluster, contract, decide, netpolicy
from lathework.plans import write_plan as wp


def one(spark, column, **data):
    kinds = ", ".join(f"{k} {t}" for k, (t, _) in data.items())
    return spark.createDataFrame([tuple(v for _, v in data.values())], kinds).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, stored",
    [
        ("Northern Cardinal (Cardinalis cardinalis)", "Northern Cardinal (Cardinalis cardinalis)"),
        ("Cardinalis sp.?", "Cardinalis sp. (uncertain)"),
        ("A, B?", "A B (uncertain)"),
        ("Foo,Bar", "Foo Bar"),
        ("A?,", "A (uncertain)"),
        (",", ","),
        ("?", "?"),
        ("Common (Scientific)??", "Common (Scientific) (uncertain)"),
        ("Common (Scientific) ?", "Common (Scientific) (uncertain)"),
        ("Cardinalis sp. (uncertain)", "Cardinalis sp. (uncertain)"),
        (None, None),
    ],
)
def test_writable_name(spark, raw, stored):
    assert one(spark, text.writable_name(F.col("s")), s=("string", raw)) == stored


@pytest.mark.parametrize(
    "line, safe",
    [
        ("key sk-ant-abc_1 x", f"key sk-{text.MASK}{text.MASK} x"),  # the shorter form takes the head of the longer one again
        ("foo=token=abc", "foo=token=abc"),
        ("token=abc, x", f"token={text.MASK}, x"),
        ("at 47.12345", f"at {text.MASK}"),
        ("https://u:p@h/x", f"https://{text.MASK}@h/x"),
        ("", ""),
        (None, None),
    ],
)
def test_redact(spark, line, safe):
    assert one(spark, text.redact(F.col("s")), s=("string", line)) == safe


@pytest.mark.parametrize(
    "path, region",
    [("/Users/Volumes/Canada/x", "Canada"), ("/Users/Canada/x", ""), ("//h/Spain", ""), ("/a/ USA /b", "United States"), (None, ""), ("", "")],
)
def test_region_hint(spark, path, region):
    assert one(spark, values.region_hint(F.col("p")), p=("string", path)) == region


def test_half_goes_up(spark):
    assert one(spark, values.half_up(F.col("x")), x=("double", -0.5)) == 0


def test_not_a_number_is_not_confident(spark):
    assert one(spark, decide.confident(F.col("c")), c=("double", float("nan"))) is False
    assert one(spark, decide.confident(F.col("c")), c=("double", 0.6)) is True


@pytest.mark.parametrize(
    "box, want", [([200, 300, 700, 800], [0.3, 0.2, 0.8, 0.7]), ([0, 0, 1000, 1000], [0, 0, 1, 1]), ([0, 0, 1001, 5], None), ([0, 0, 200.5, 5], None), ([1, 2], None)]
)
def test_box_reorder(spark, box, want):
    assert one(spark, contract.box_reorder(F.col("b")), b=("array<double>", [float(x) for x in box])) == want


def test_response_with_a_bad_alternative(spark):
    good = '{"bbox":[0.1,0.2,0.3,0.4],"common_name":"a","scientific_name":"b","identified_rank":"genus","rank_name":"c","alternatives":[%s]}'
    alt = '{"common_name":"a","scientific_name":"b","confidence":0.5,"identified_rank":"genus","rank_name":"%s"}'
    body = '{"bird_present":true,"detections":[%s]}'
    for a, err in ((alt % "x", None), (alt % "nil", "alt-rank_name@1"), ('{"colour":1}', "unexpected-alt-key:colour@1")):
        assert one(spark, contract.response_error(F.col("j")), j=("string", body % (good % a))) == err


def test_retry_delays(spark):
    got = lambda a, s, r: one(spark, netpolicy.next_delay(F.col("a"), F.col("s"), F.col("r")), a=("int", a), s=("int", s), r=("double", r))
    assert [got(1, 429, None), got(3, 503, None), got(4, 503, None), got(1, 400, None), got(1, 429, 31.0), got(1, 429, 0.5)] == [1.0, 4.0, None, None, None, 0.5]


def test_retry_after(spark):
    got = lambda m, v: one(spark, netpolicy.retry_after(F.col("m"), F.col("v"), F.lit(784111776)), m=("string", m), v=("string", v))
    assert got("1500", "9") == 1.5
    assert got("-1", "9") is None
    assert got(None, "Sun, 06 Nov 1994 08:49:37 GMT") == 1.0
    assert got(None, "Sun, 06 Nov 1994 08:49:37 PST") is None
    assert got(None, "Tue, 30 Feb 1994 08:49:37 GMT") is None


def frames(spark, rows):
    return spark.createDataFrame(rows, "key string, t double, stack string, sel_index long").withColumn("time", F.timestamp_seconds("t"))


def test_bursts_are_the_same_for_any_order_and_partitioning(spark):
    rnd = random.Random(5)
    rows, t = [], 0.0
    for i in range(300):
        t += rnd.choice([0.0, 0.5, 1.0, 3.0])
        rows.append((f"k{i:03d}", None if rnd.random() < 0.1 else t, rnd.choice([None, "a", "b"]), i))
    want = {}
    ordered = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[3]))
    anchor = None
    for p, c in zip([None, *ordered], ordered):
        near = p and ((p[1] is not None and c[1] is not None and 0 <= c[1] - p[1] < 1) or (p[2] is not None and p[2] == c[2]))
        anchor = anchor if near else c[0]
        want[c[0]] = anchor
    rnd.shuffle(rows)
    got = cluster.bursts(frames(spark, rows), 1_000_000).collect()
    assert {r["key"]: r["anchor_key"] for r in got} == want
    one_part = frames(spark, rows).withColumn("g", F.lit(1))
    assert {r["key"]: r["anchor_key"] for r in cluster.bursts(one_part, 1_000_000, by=["g"]).collect()} == want


def test_write_plan_applied_twice_adds_nothing(spark):
    lab = spark.createDataFrame(
        [(1, "p", 1, "A (B)", False, "species", 0.9, True), (1, "p", 2, "a (b)", False, "species", 0.8, True), (2, "p", 1, "C sp.?", True, "genus", None, True)],
        "rec_idx long, photo_key string, det_idx long, rendered string, uncertain boolean, rank string, confidence double, has_response boolean",
    )
    none = spark.createDataFrame([], "rec_idx long, name string")
    found = wp.candidates(lab)
    added = wp.additions(found, none)
    assert sorted(r["name"] for r in added.collect()) == ["A (B)", "C sp. (uncertain)"]
    have = added.select("name").crossJoin(lab.select("rec_idx").distinct())
    assert wp.additions(found, have).count() == 0
    recs = lab.select("rec_idx", "photo_key", "has_response").distinct()
    row = wp.photo_summary(recs, lab, found, added).first()
    assert (row["found"], row["identified"], row["uncertain"], row["skipped"], row["add_count"]) == (2, 1, 1, 0, 2)


def test_append_is_idempotent(spark, tmp_path):
    plan = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "a")], "photo_key string, name string")
    target = str(tmp_path / "t")
    assert [wp.append(plan, target), wp.append(plan, target), wp.append(plan, target, dry_run=True)] == ["executed", "noop", "noop"]
    assert spark.read.parquet(target).count() == 2
    assert wp.run_status(["executed", "error", "executed"]) == "error"


def test_jpeg():
    assert image.dims(b"") == (None, None, "not-a-jpeg")
    assert image.dims(b"GIF89a") == (None, None, "no-soi")
    assert image.dims(bytes.fromhex("FFD8FFDA0008")) == (None, None, "sos-before-sof")
    inner = bytes.fromhex("FFD8FFC0000B080010002001011100FFD9")
    outer = b"\xff\xd8\xff\xe1" + (len(inner) + 2).to_bytes(2) + inner + bytes.fromhex("FFC2000B0801E0028001011100")
    assert image.dims(outer) == (640, 480, None)
    assert image.grid(outer) is None


def test_negative_levels_are_decoded():
    # One block whose DC difference is -2: category 2, bits 01.
    dc = "FFC4" + "0017" + "00" + "00030100" + "00" * 12 + "00010203"
    ac = "FFC4" + "0014" + "10" + "01" + "00" * 15 + "00"
    head = "FFD8" + "FFC0" + "000B08" + "00080008" + "01" + "011100" + dc + ac + "FFDA" + "0008" + "01" + "0100" + "003F00"
    scan = format(int("10" + "01" + "0" + "111", 2), "02X")
    assert image.grid(bytes.fromhex(head + scan + "FFD9")) == [-2.0] * 64
