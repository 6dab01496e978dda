"""Responses, dialects and small text rules, case by case."""

import json

import pytest
from pyspark.sql import functions as F

from lathework.functions import text
from lathework.operators import cluster, contract

ALT = {"common_name": "a", "scientific_name": "b", "identified_rank": "genus", "rank_name": "c"}
DET = ALT | {"bbox": [0.1, 0.2, 0.3, 0.4]}
NATIVE = ALT | {"box_2d": [200, 100, 400, 300]}


def response(*detections, present=True, **more):
    return {"bird_present": present, "detections": list(detections)} | more


CASES = [
    (response(DET), None, "valid"),
    (response(), None, "valid"),
    (response(DET, note=None), None, "valid"),
    (response(DET | {"confidence": None, "alternatives": None}), None, "valid"),
    (response(DET | {"alternatives": [ALT | {"confidence": None}]}), None, "valid"),
    (response(None), None, "valid"),
    (response(None, DET), "detections-not-array", "degraded"),
    ({"bird_present": True, "detections": {}}, None, "valid"),
    ({"bird_present": True, "detections": {"a": 1}}, "detections-not-array", "degraded"),
    ({"bird_present": False, "detections": {"a": 1}}, "detections-not-array", "repaired"),
    ({"bird_present": False}, "detections-not-array", "repaired"),
    ({"bird_present": "true", "detections": []}, "bird_present-not-bool", "degraded"),
    (response(DET, present=False), "bird_present-false-with-detections", "repaired"),
    (response(DET, present=False, note=1), "unexpected-top-key:note", "degraded"),
    (response(DET | {"colour": 1, "bbox": [1]}), "unexpected-detection-key:colour@1", "degraded"),
    (response(DET, DET | {"bbox": [0.5, 0.9, 0.2, 0.1], "common_name": ""}), "bbox-xmin>xmax@2", "degraded"),
    (response(DET | {"bbox": [0.1, None, 0.3, 0.4]}), "bbox-not-4@1", "degraded"),
    (response(DET | {"common_name": " nil ", "identified_rank": "kingdom"}), "common_name@1", "degraded"),
    (response(DET | {"confidence": 2, "identified_rank": "kingdom"}), "confidence-out-of-[0,1]@1", "degraded"),
    (response(DET | {"alternatives": "x", "rank_name": ""}), "rank_name@1", "degraded"),
    (response(DET | {"alternatives": "x"}), "alternatives-not-array@1", "degraded"),
    (response(DET | {"alternatives": [ALT, ALT | {"confidence": -1, "rank_name": ""}]}), "alt-confidence-out-of-[0,1]@2", "degraded"),
    (response(DET | {"alternatives": [3]}), "alternative-not-table@1", "degraded"),
    (response(4), "detection-not-table@1", "degraded"),
    ([1], "resp-not-table", "degraded"),
]


def without_nulls(x):
    if isinstance(x, dict):
        return {k: without_nulls(v) for k, v in x.items() if v is not None}
    return [without_nulls(v) for v in x if v is not None] if isinstance(x, list) else x


def test_responses(spark):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, *_) in enumerate(CASES)], "i int, j string")
    j = F.col("j")
    for r in df.select("i", contract.response_error(j).alias("e"), contract.repair(j).alias("s"), contract.finalize(j).alias("f")).collect():
        body, error, state = CASES[r["i"]]
        assert (r["e"], r["s"]) == (error, state), body
        final = json.loads(r["f"])
        if state != "valid":
            assert final == {"bird_present": False, "detections": []}
        else:
            assert final == without_nulls(body) | ({"detections": []} if body["detections"] == {} else {})


@pytest.mark.parametrize(
    "answer, boxes",
    [
        (response(NATIVE), [[0.1, 0.2, 0.3, 0.4]]),
        (response(NATIVE | {"box_2d": [0, 0, 1001, 5]}, NATIVE, NATIVE | {"box_2d": [0.5, 0, 9, 5]}, ALT, 5, None), [[0.1, 0.2, 0.3, 0.4]]),
        (response(DET), []),
        ({"bird_present": True, "detections": {"a": 1}}, []),
        ({"bird_present": True, "detections": None}, []),
        (response(NATIVE | {"rank_name": "nil"}), None),
    ],
)
def test_native_boxes(spark, answer, boxes):
    raw = json.dumps(answer)
    parts = [{"text": raw[:9]}, {"text": raw[9:]}]
    for reason, want in (("STOP", boxes), ("BLOCKLIST", boxes), ("SAFETY", None)):
        body = json.dumps({"candidates": [{"finishReason": reason, "content": {"parts": parts}}]})
        got = spark.createDataFrame([(body,)], "b string").select(contract.finalize(contract.dialect_c(F.col("b"))).alias("f")).first()["f"]
        final = json.loads(got)
        assert final["bird_present"] is (want is not None)
        assert [d["bbox"] for d in final["detections"]] == (want or [])
        assert all("box_2d" not in d for d in final["detections"])


def test_redaction_has_no_marker_of_its_own(spark):
    lines = [("a\x01b token=abc c",), ("token=abc",), ("x\x01",), ("k=v \x01 password=p\x01 z",)]
    got = [r["s"] for r in spark.createDataFrame(lines, "s string").select(text.redact_keyed(F.col("s")).alias("s")).collect()]
    assert got == [f"a\x01b token={text.MASK} c", f"token={text.MASK}", "x\x01", f"k=v \x01 password={text.MASK} z"]


def test_malformed_hashes_are_far_apart(spark):
    df = spark.createDataFrame([([0] * 64, [1] * 3 + [0] * 61), ([0] * 64, [0] * 63), ([0] * 64, None)], "a array<int>, b array<int>")
    assert [r["h"] for r in df.select(cluster.hamming(F.col("a"), F.col("b")).alias("h")).collect()] == [3, 64, 64]
