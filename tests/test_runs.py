"""Failover over key slots, requests and the parts of a run."""

import json

from pyspark.sql import functions as F

from lathework.operators import netpolicy as net
from lathework.operators import requests as req
from lathework.operators import runs

ITEM = "run_id long, seq long, now double, answers map<int,array<struct<outcome:string,status:int,retry_after:double>>>"
OK, SLOW, BAD_KEY, BAD_ASK = ("ok", 200, None), ("retry", 429, None), ("auth-fatal", 401, None), ("request-fatal", 400, None)


def tried(spark, items, order):
    df = net.failover(spark.createDataFrame([(1, i, float(now), a) for i, (now, a) in enumerate(items)], ITEM), order)
    return [tuple(r)[2:] for r in df.orderBy("seq").collect()]


def test_failover_goes_by_priority_at_once_and_a_cooled_slot_comes_back(spark):
    good = {1: [OK], 2: [OK], 3: [OK]}
    assert tried(spark, [(0, good)], (2, 1, 3)) == [("ok", 2, 1, 0.0)]
    assert tried(spark, [(0, good | {2: [SLOW]}), (0.5, good), (1, good)], (2, 1, 3)) == [("ok", 1, 2, 0.0), ("ok", 1, 1, 0.0), ("ok", 2, 1, 0.0)]


def test_a_bad_key_is_retired_and_a_bad_request_changes_nothing(spark):
    assert tried(spark, [(0, {1: [BAD_KEY], 2: [OK]}), (99, {1: [OK], 2: [OK]})], (1, 2)) == [("ok", 2, 2, 0.0), ("ok", 2, 1, 0.0)]
    assert tried(spark, [(0, {1: [BAD_ASK], 2: [OK]}), (0, {1: [OK]})], (1, 2)) == [("request-fatal", 1, 1, 0.0), ("ok", 1, 1, 0.0)]


def test_no_healthy_slot_defers(spark):
    assert tried(spark, [(0, {1: [BAD_KEY], 2: [SLOW]}), (0, {1: [OK], 2: [OK]}), (1, {2: [OK]})], (1, 2)) == [("defer", 0, 2, 0.0), ("defer", 0, 0, 0.0), ("ok", 2, 1, 0.0)]
    assert tried(spark, [(0, None)], (1, 2)) == [("defer", 0, 2, 0.0)]


def test_a_lone_slot_waits_until_it_is_used_up(spark):
    assert tried(spark, [(0, {7: [SLOW, SLOW, OK]})], (7,)) == [("ok", 7, 3, 3.0)]
    assert tried(spark, [(0, {7: [SLOW]}), (500, {7: [OK]})], (7,)) == [("defer", 0, 4, 7.0), ("defer", 0, 0, 0.0)]
    assert tried(spark, [(0, {7: [("retry", 429, 31.0)]})], (7,)) == [("defer", 0, 1, 0.0)]
    assert tried(spark, [(0, {7: [("retry", 503, 0.0), OK]})], (7,)) == [("ok", 7, 2, 0.0)]


def test_keyring_health(spark):
    events = [(0, "ok"), (0, "cooldown"), (0.5, "retire"), (1, "request-error"), (1, "cooldown"), (2, "cooldown"), (2.5, "ok"), (3, "cooldown"), (8, "cooldown"), (100, "ok")]
    df = spark.createDataFrame([(1, i, float(now), o) for i, (now, o) in enumerate(events)], "run_id long, seq long, now double, outcome string")
    got = [(r["selected"], r["healthy"]) for r in net.keyring(df).orderBy("seq").collect()]
    assert got == [(1, 3), (1, 3), (2, 2), (1, 2), (1, 2), (3, 1), (0, 0), (1, 2), (1, 2), (3, 1)]


def test_schemas(spark):
    names = ["common_name", "scientific_name", "confidence", "identified_rank", "rank_name"]
    for schema, box in ((req.SCHEMA_A, "bbox"), (req.SCHEMA_B, "bbox"), (req.SCHEMA_C, "box_2d")):
        item = schema["properties"]["detections"]["items"]
        assert item["required"] == [box, *names, "alternatives"] and set(item["properties"]) == set(item["required"])
        assert item["properties"]["alternatives"]["items"]["required"] == names and schema["required"] == ["bird_present", "detections"]
        assert item["properties"]["identified_rank"]["enum"] == ["species", "genus", "family", "order", "class"]
        assert item.get("additionalProperties") is (False if box == "bbox" else None)
    assert [s["properties"]["detections"]["items"]["properties"]["confidence"] for s in (req.SCHEMA_A, req.SCHEMA_B, req.SCHEMA_C)] == [
        {"type": ["number", "null"]}, {"anyOf": [{"type": "number"}, {"type": "null"}]}, {"type": "number"},
    ]


def test_requests_of_odd_texts(spark):
    row = spark.range(1).select(F.lit('a "b"\n/ü').alias("p"), F.lit(None).cast("string").alias("n"))
    a, b, c = row.select(req.request_a(F.col("p"), F.lit("u"), F.col("n"), F.lit("m")), req.request_b(F.col("p"), F.lit("x"), F.col("n"), F.lit("m")), req.request_c(F.col("p"), F.lit("x"), F.col("n"))).first()
    assert json.loads(a)["messages"][0]["content"] == [{"type": "text", "text": 'a "b"\n/ü'}, {"type": "image_url", "image_url": {"url": "u"}}]
    assert json.loads(b)["messages"][0]["content"][1]["source"] == {"type": "base64", "media_type": "image/jpeg", "data": "x"}
    assert json.loads(c)["contents"][0]["parts"] == [{"text": 'a "b"\n/ü'}, {"inline_data": {"mime_type": "image/jpeg", "data": "x"}}]


def test_a_run_without_rows_and_a_log(spark, tmp_path):
    empty = spark.createDataFrame([], "key long, anchor_key long")
    assert tuple(runs.cluster_counts(empty).first()) == (0, 0)
    assert tuple(runs.dry_run_totals(spark.createDataFrame([], "photo_key long, add_keywords array<string>")).first()) == (0, 0)
    assert runs.dispatch(True, lambda: "serial", lambda: "features") == "serial" and runs.dispatch(False, lambda: "serial", lambda: "features") == "features"
    photos = spark.createDataFrame([(1, 1), (2, 0)], "photo long, n_detections int")
    previews = spark.createDataFrame([(1, b"x")], "photo long, preview binary")
    assert [(r["photo"], r["preview"]) for r in runs.gallery_photos(photos, previews, False).collect()] == [(1, None)]
    lines = spark.createDataFrame([("x", None)], "level string, message string").select(runs.log_line(F.col("level"), F.col("message")).alias("line"))
    for _ in range(2):
        runs.write_log(lines, str(tmp_path / "log"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "log")).collect()] == ["[INFO] nil"] * 2
