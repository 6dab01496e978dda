"""Queries: requests, dialects by name, single attempts, failover, and a run's records, totals and log."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import netpolicy as net
from ..operators import propagate
from ..operators import requests as req
from ..operators import runs
from . import views as v
from . import write_plan as wp
from .q_net import _ATTEMPTS, _attempts
from .q_plan import _BY, _RESULTS, HOUR, _bursts_sql, _planned, _results


def request_a(spark: SparkSession, d: str) -> DataFrame:
    detail = F.when(F.col("p_partkey") % 3 == 0, "high").when(F.col("p_partkey") % 3 == 1, "")
    body = req.request_a(F.col("p_name"), F.concat(F.lit("data:"), "p_type"), detail, F.col("p_brand"))
    return v.table(spark, d, "part").select("p_partkey", body.alias("body"))


def request_b(spark: SparkSession, d: str) -> DataFrame:
    body = req.request_b(F.col("p_name"), F.col("p_type"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(""), F.col("p_brand"))
    return v.table(spark, d, "part").select("p_partkey", body.alias("body"))


def request_c(spark: SparkSession, d: str) -> DataFrame:
    body = req.request_c(F.col("p_name"), F.col("p_type"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(""))
    return v.table(spark, d, "part").select("p_partkey", body.alias("body"))


_ANSWER = '{"bird_present":false,"detections":[]}'
_BODIES = {
    "a": json.dumps({"choices": [{"finish_reason": "stop", "message": {"content": _ANSWER}}]}),
    "b": json.dumps({"stop_reason": "tool_use", "content": [{"type": "text", "text": "so"}, {"type": "tool_use", "name": req.TOOL, "input": json.loads(_ANSWER)}]}),
    "c": json.dumps({"candidates": [{"finishReason": "STOP", "content": {"parts": [{"text": _ANSWER}]}}]}),
}


def answer_by_dialect(spark: SparkSession, d: str) -> DataFrame:
    """The same answer in a body of each dialect, under its own name, another's, an unknown one and none."""
    k, body = F.col("o_orderkey"), F.lit(None).cast("string")
    for i, text in enumerate(_BODIES.values()):
        body = F.when(k % 3 == i, F.lit(text)).otherwise(body)
    name = F.element_at(F.array(*map(F.lit, ("a", "b", "c", "x", None))), (k % 5 + 1).cast("int"))
    return v.table(spark, d, "orders").select("o_orderkey", req.answer(name, body).alias("a")).select("o_orderkey", "a.*")


def single_attempt(spark: SparkSession, d: str) -> DataFrame:
    wait = (F.col("event_id") % 50).cast("double")
    return _attempts(spark, d).select("event_id", net.single_attempt(F.col("status"), None, wait).alias("a")).select("event_id", "a.*")


def _answers(k: Column) -> Column:
    """What three slots give: by turns an overload, a good answer, a bad key and a bad request."""
    pick = lambda i: F.element_at(F.array(*(F.lit(s).cast("int") for s in (200, 429, 401, 503, 400, 200, 200))), (F.floor(k / (7**i)) % 7 + 1).cast("int"))
    one = lambda i: net.single_attempt(pick(i), None, (k % 40).cast("double"))
    give = lambda i: F.struct(*(one(i)[f].alias(f) for f in ("outcome", "status", "retry_after")))
    return F.create_map(*(x for i in range(3) for x in (F.lit(i + 1), F.array(give(i)))))


def failover(spark: SparkSession, d: str) -> DataFrame:
    """An event is an item, its user the run, its number the time; slots in the order 2, 1, 3."""
    k = F.col("event_id")
    e = _attempts(spark, d).select(F.col("user_id").alias("run_id"), "seq", k.cast("double").alias("now"), _answers(k).alias("answers"))
    return net.failover(e, (2, 1, 3))


def deep_results(spark: SparkSession, d: str) -> DataFrame:
    """Every third order has a result; the others are told by their order's status."""
    o = v.table(spark, d, "orders")
    results = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("response"), F.lit(None).cast("string").alias("error"))
    status = F.when(F.col("o_orderstatus") == "F", "cancelled").when(F.col("o_orderstatus") == "O", "deferred").otherwise("identified")
    return runs.deep_results(o.select(F.col("o_orderkey").alias("key")), results, o.select(F.col("o_orderkey").alias("key"), status.alias("status")))


def gallery_photos(spark: SparkSession, d: str) -> DataFrame:
    """Events with one or two detections; every fourth has a preview."""
    e = v.table(spark, d, "events")
    results = e.select(F.col("event_id").alias("photo"), (F.col("event_id") % 3).alias("n_detections"))
    previews = e.filter("event_id % 4 = 0").select(F.col("event_id").alias("photo"), F.encode("event_type", "UTF-8").alias("preview"))
    return runs.gallery_photos(results, previews, True).select("photo", "n_detections", F.decode("preview", "UTF-8").alias("preview"))


def cluster_counts(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "events")
    anchor = F.min("event_id").over(Window.partitionBy("user_id", "event_type"))
    return runs.cluster_counts(e.select(F.col("event_id").alias("key"), anchor.alias("anchor_key")))


def adapter_records(spark: SparkSession, d: str) -> DataFrame:
    """Events of every third number have names of their own, one of them twice."""
    e = v.table(spark, d, "events").filter("event_id % 3 = 0")
    names = e.select(F.col("event_id").alias("photo"), F.explode(F.array("event_type", F.lit("a bird"), F.lit("a bird"))).alias("name"))
    return propagate.adapter_records(_results(spark, d), names).select("photo", "response", F.array_join("existing_names", "|").alias("names"))


def dry_run_totals(spark: SparkSession, d: str) -> DataFrame:
    return runs.dry_run_totals(wp.entries(_planned(spark, d)[2]))


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """Event types and levels as levels; messages and fields that give a key away."""
    k = F.col("event_id")
    level = F.element_at(F.array(*map(F.lit, ("warn", "loud", "error", None))), (k % 4 + 1).cast("int"))
    message = F.when(k % 7 != 0, F.concat(F.lit("sent token=t"), k.cast("string")))
    fields = F.when(k % 5 != 0, F.concat(F.lit('{"n":'), k.cast("string"), F.lit(',"api_key":"k'), k.cast("string"), F.lit('"}')))
    return v.table(spark, d, "events").select("event_id", runs.log_line(level, message, fields, F.col("ts")).alias("line"))


QUERIES = {
    f.__name__: f
    for f in (request_a, request_b, request_c, answer_by_dialect, single_attempt, failover, deep_results, gallery_photos, cluster_counts, adapter_records, dry_run_totals, log_lines)
}


def _text(schema: dict) -> str:
    return json.dumps(schema, sort_keys=True, separators=(",", ":"))


_PROMPT = """'{"text":' || to_json(p_name)::VARCHAR || '"""
SQL = {
    "request_a": f"""SELECT p_partkey, '{{"model":' || to_json(p_brand)::VARCHAR || ',"messages":[{{"role":"user","content":[' || {_PROMPT},"type":"text"}},{{"image_url":{{'
        || CASE WHEN p_partkey % 3 = 0 THEN '"detail":"high",' ELSE '' END || '"url":' || to_json('data:' || p_type)::VARCHAR
        || '}},"type":"image_url"}}]}}],"response_format":{{"type":"json_schema","json_schema":{{"name":"bird_identification","strict":true,"schema":{_text(req.SCHEMA_A)}}}}}}}' AS body FROM part""",
    "request_b": f"""SELECT p_partkey, '{{"model":' || to_json(p_brand)::VARCHAR || ',"max_tokens":2048,"tool_choice":{{"type":"tool","name":"{req.TOOL}"}},"tools":[{{"name":"{req.TOOL}",'
        || '"description":"{req.TOOL_SAYS}","strict":true,"input_schema":{_text(req.SCHEMA_B)}}}],"messages":[{{"role":"user","content":[' || {_PROMPT},"type":"text"}},{{"source":{{'
        || CASE WHEN p_partkey % 3 = 0 THEN '"file_id":' || to_json(p_brand)::VARCHAR || ',"type":"file"' ELSE '"data":' || to_json(p_type)::VARCHAR || ',"media_type":"image/jpeg","type":"base64"' END
        || '}},"type":"image"}}]}}]}}' AS body FROM part""",
    "request_c": f"""SELECT p_partkey, '{{"contents":[{{"parts":[' || {_PROMPT}}},{{'
        || CASE WHEN p_partkey % 3 = 0 THEN '"file_data":{{"file_uri":' || to_json(p_brand)::VARCHAR || ',"mime_type":"image/jpeg"}}'
                ELSE '"inline_data":{{"data":' || to_json(p_type)::VARCHAR || ',"mime_type":"image/jpeg"}}' END
        || '}}]}}],"generationConfig":{{"responseMimeType":"application/json","responseSchema":{_text(req.SCHEMA_C)}}}}}' AS body FROM part""",
    "answer_by_dialect": f"""WITH n AS (SELECT o_orderkey, o_orderkey % 3 AS body, ['a', 'b', 'c', 'x', NULL][(o_orderkey % 5 + 1)::INT] AS name FROM orders)
        SELECT o_orderkey, CASE WHEN name = ['a', 'b', 'c'][(body + 1)::INT] THEN '{_ANSWER}' END AS answer,
               CASE WHEN name IS NULL THEN 'no-provider-name' WHEN name = 'x' THEN 'provider-not-implemented:x' END AS error FROM n""",
    "single_attempt": f"""WITH {_ATTEMPTS} SELECT event_id, status,
        CASE WHEN status = 200 THEN 'ok' WHEN status IS NULL OR status IN (429, 503) THEN 'retry' WHEN status = 401 THEN 'auth-fatal' ELSE 'request-fatal' END AS outcome,
        CASE WHEN status IS NULL OR status IN (429, 503) THEN (event_id % 50)::DOUBLE END AS retry_after,
        CASE WHEN status IS NULL THEN 'transport-error' WHEN status = 429 THEN 'rate-limited-429' WHEN status = 503 THEN 'server-error-503'
             WHEN status = 401 THEN 'auth-failed-401 (check API key)' END AS error FROM attempts""",
    "deep_results": """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS response,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'cancelled' WHEN o_orderstatus = 'O' THEN 'deferred' ELSE 'not-processed' END AS error FROM orders""",
    "gallery_photos": """SELECT event_id AS photo, event_id % 3 AS n_detections, CASE WHEN event_id % 4 = 0 THEN event_type END AS preview FROM events WHERE event_id % 3 > 0""",
    "cluster_counts": """SELECT count(DISTINCT (user_id, event_type)) AS anchors, count(*) - count(DISTINCT (user_id, event_type)) AS followers FROM events""",
    "adapter_records": f"""WITH {v.FRAMES}, {_bursts_sql(str(6 * HOUR), False, _BY)}, {_RESULTS}
        SELECT photo, resp AS response, CASE WHEN photo % 3 = 0 THEN 'a bird|' || (SELECT any_value(event_type) FROM events WHERE event_id = photo) ELSE '' END AS names
        FROM res WHERE status = 'identified'""",
    "dry_run_totals": f"WITH {v.PLAN} SELECT count(DISTINCT photo_key) AS photos, count(*) AS total_adds FROM added",
    "log_lines": """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [' || ['WARN', 'INFO', 'ERROR', 'INFO'][(event_id % 4 + 1)::INT] || '] '
        || CASE WHEN event_id % 7 = 0 THEN 'nil' ELSE 'sent token=***REDACTED***' END
        || CASE WHEN event_id % 5 = 0 THEN '' ELSE ' | {"n":' || event_id || ',"api_key":"***REDACTED***"}' END AS line FROM events""",
}
