"""Fixtures in place of a model, and the library functions of preferences, metadata and prompts."""

import json

import pytest
from pyspark.sql import functions as F

from lathework.functions import metadata, prefs, text
from lathework.operators import fixtures, netpolicy

ONE = {"bird_present": True, "detections": [{"bbox": [0.1, 0.2, 0.3, 0.4], "common_name": "Jay", "scientific_name": "Avis", "identified_rank": "species", "rank_name": "Avis", "confidence": None}]}
NONE = {"bird_present": False, "detections": []}


def test_fixtures_are_looked_up_and_checked(spark):
    rows = [("default", json.dumps(NONE)), ("jay", json.dumps(ONE)), ("bad", json.dumps({"bird_present": 1, "detections": []}))]
    table = spark.createDataFrame(rows, "name string, response string")
    assert [tuple(r) for r in fixtures.bad_fixtures(table).collect()] == [("bad", "bad-fixture:bad:bird_present-not-bool")]
    items = spark.createDataFrame([(1, "jay"), (2, None), (3, "owl"), (4, "bad")], "id int, name string")
    got = {r["id"]: (r["response"] and json.loads(r["response"]), r["error"]) for r in fixtures.identify(items, table).collect()}
    jay = json.loads(json.dumps(ONE))
    del jay["detections"][0]["confidence"]
    assert got == {1: (jay, None), 2: (NONE, None), 3: (NONE, None), 4: (None, "fixture-failed-validation:bad:bird_present-not-bool")}
    bare = {r["id"]: r["error"] for r in fixtures.identify(items, table.filter("name = 'jay'")).collect()}
    assert bare == {1: None, 2: "no-fixture:default", 3: "no-fixture:owl", 4: "no-fixture:bad"}


def test_preferences_have_defaults_and_bounds(spark):
    none = spark.range(1).select(prefs.normalized(F.expr("cast(map() as map<string,string>)")).alias("p")).select("p.*").first().asDict()
    assert none["confidenceThreshold"] == 0.6 and none["sendGpsDate"] and not none["usePathHint"] and none["provider"] == "openai" and len(none) == 17
    got = spark.range(1).select(prefs.normalized(F.create_map(*map(F.lit, ("maxConcurrency", "7.9", "dryRun", "yes", "clusterUseStacks", "0", "model", "m")))).alias("p")).select("p.*").first()
    assert (got["maxConcurrency"], got["dryRun"], got["clusterUseStacks"], got["model"]) == (7.0, True, False, "m")


@pytest.mark.parametrize("slot, key", [(1.0, "x_api_token"), (2.0, "x_api_token_2"), (0.0, None), (1.5, None), (None, None), (-1.0, None)])
def test_token_slots(spark, slot, key):
    assert spark.range(1).select(prefs.token_key(F.lit("x"), F.lit(slot).cast("double"))).first()[0] == key


def test_models_of_other_providers_give_way(spark):
    models = spark.createDataFrame([("a", "a2", 2), ("a", "a1", 1), ("b", "b1", 1)], "provider string, model string, place int")
    chosen = spark.createDataFrame([("a", "a2"), ("a", "b1"), ("a", ""), ("a", "mine"), ("b", None), ("c", "a1")], "provider string, model string")
    got = [tuple(r) for r in prefs.reconciled(chosen, models).collect()]
    assert sorted(got, key=repr) == sorted([("a", "a2"), ("a", "a1"), ("a", "a1"), ("a", "mine"), ("b", "b1"), ("c", None)], key=repr)


def test_metadata_without_switches_gives_nothing(spark):
    none = F.lit(None).cast("boolean")
    row = lambda send, hint, lat=1.0: tuple(spark.range(1).select(metadata.shape(F.lit(lat), F.lit(2.0), F.lit(0.0), F.lit("/a/Spain/x"), send, hint).alias("m")).select("m.*").first())
    assert row(none, none) == (None,) * 4
    assert row(F.lit(True), F.lit(True)) == (1.0, 2.0, "2001-01-01", None)
    assert row(F.lit(True), F.lit(True), float("nan")) == (None, None, "2001-01-01", "Spain")
    assert row(F.lit(False), F.lit(True)) == (None, None, None, "Spain")


def test_directives_name_the_boxes():
    assert '"bbox"' in text.directive() and "box_2d" not in text.directive()
    assert '"box_2d"' in text.directive("box_2d") and '"bbox"' not in text.directive("box_2d")


def test_quota_names_are_read_from_the_body(spark):
    bodies = ['{"error":{"type":"x","code":"insufficient_quota"}}', '{"error":{"status":"billing_not_active","type":"access_terminated"}}', '{"error":{"message":"insufficient_quota"}}', "insufficient_quota", None]
    got = spark.createDataFrame([(b,) for b in bodies], "b string").select(netpolicy.fatal_enum(F.col("b"))).collect()
    assert [r[0] for r in got] == ["insufficient_quota", "access_terminated", None, None, None]
