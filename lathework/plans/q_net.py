"""Queries: HTTP policy, state machines, contract checks and response dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import let
from ..operators import contract, netpolicy as net
from . import views as v

_STATUS = {"view": 200, "signup": 429, "click": 503, "error": None, "purchase": 401}


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    """An event is an HTTP attempt; four of a user make an item."""
    e = v.table(spark, d, "events")
    status = F.lit(None).cast("int")
    for kind, s in _STATUS.items():
        status = F.when(F.col("event_type") == kind, F.lit(s).cast("int")).otherwise(status)
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.withColumn("n", n).select(
        "event_id", "user_id", F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.col("n") / 4).cast("string")).alias("item"),
        (F.col("n") % 4 + 1).cast("int").alias("attempt"), status.alias("status"), "value", F.col("n").cast("long").alias("seq"),
    )


_ATTEMPTS = """n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
attempts AS (
    SELECT event_id, user_id, user_id || '-' || (n // 4) AS item, (n % 4 + 1)::INT AS attempt, value, n AS seq,
           CASE event_type WHEN 'view' THEN 200 WHEN 'signup' THEN 429 WHEN 'click' THEN 503 WHEN 'purchase' THEN 401 END AS status FROM n)"""

_ENUMS = ("", "insufficient_quota", "rate_limit_exceeded")


def http_classify(spark: SparkSession, d: str) -> DataFrame:
    a = _attempts(spark, d)
    enum = F.element_at(F.array(*map(F.lit, _ENUMS)), (F.col("event_id") % 3 + 1).cast("int"))
    return a.select("event_id", net.classify(F.col("status"), enum).alias("outcome"), net.status_label(F.col("status")).alias("label"))


def _after(c: str = "event_id"):
    return F.when(F.col(c) % 3 == 0, F.col(c) % 50 * 1.0)


def backoff_delay(spark: SparkSession, d: str) -> DataFrame:
    return _attempts(spark, d).select("event_id", net.next_delay(F.col("attempt"), F.col("status"), _after()).alias("delay"))


def retry_terminal_row(spark: SparkSession, d: str) -> DataFrame:
    return net.terminal_attempt(_attempts(spark, d)).select("item", "attempt", "outcome")


_DATE_TAILS = (" GMT", " UTC", " PST", "")


def http_date_delay(spark: SparkSession, d: str) -> DataFrame:
    """Order dates as HTTP dates, some in other zones or not there at all."""
    o = v.table(spark, d, "orders")
    tail = F.element_at(F.array(*map(F.lit, _DATE_TAILS)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    day = F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("Mon, 30 Feb "), F.date_format("o_orderdate", "yyyy"), F.lit(" 00:00:00"))).otherwise(
        F.date_format("o_orderdate", "E, dd MMM yyyy HH:mm:ss")
    )
    return o.select("o_orderkey", net.http_date_seconds(F.concat(day, tail), F.lit(883612800)).alias("delay"))


def retry_after_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    headers = F.array(
        F.struct(F.lit("X-Other").alias("field"), F.lit("1").alias("value")),
        F.struct(F.when(k % 3 == 0, "Retry-After-Ms").otherwise("x").alias("field"), F.concat((k % 7 * 500 - 500).cast("string")).alias("value")),
        F.struct(F.lit("RETRY-AFTER").alias("field"), F.when(k % 5 == 0, "soon").otherwise((k % 9 - 2).cast("string")).alias("value")),
    )
    got = let(headers, lambda h: net.retry_after(net.header(h, "retry-after-ms"), net.header(h, "Retry-After"), F.lit(0)))
    return v.table(spark, d, "events").select("event_id", got.alias("seconds"))


_DELAYS = ("30s", "1.5s", ".5s", "-3s", "3", "1s2s")


def google_retry_delay(spark: SparkSession, d: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, _DELAYS)), (F.col("event_id") % 6 + 1).cast("int"))
    body = F.concat(F.lit('{"error":{"details":[{"@type":"x/google.rpc.Help"},{"@type":"type.googleapis.com/google.rpc.RetryInfo","retryDelay":"'), text, F.lit('"}]}}'))
    return v.table(spark, d, "events").select("event_id", net.google_retry_delay(body).alias("seconds"))


_QUOTA = ("insufficient_quota", "rate_limit_error", "server_error", "billing_not_active", "tokens", "access_terminated", "none")


def _error_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Attempts with bodies of three names each; some are no JSON, or hold a number or no error."""
    k = F.col("event_id")
    name = lambda n: F.concat(F.lit('"'), F.element_at(F.array(*map(F.lit, _QUOTA)), (F.floor(k / n) % len(_QUOTA) + 1).cast("int")), F.lit('"'))
    known = F.concat(F.lit('{"error":{"type":'), name(2), F.lit(',"code":'), F.when(k % 4 == 0, F.lit("7")).otherwise(name(5)), F.lit(',"status":'), name(3), F.lit("}}"))
    body = F.when(k % 11 == 0, "insufficient_quota").when(k % 13 == 0, '{"error":"insufficient_quota"}').when(k % 3 < 2, known).otherwise('{"error":{"type":"tokens"}}')
    return _attempts(spark, d).withColumn("body", body)


def http_classify_body(spark: SparkSession, d: str) -> DataFrame:
    a, enum = _error_bodies(spark, d), net.fatal_enum(F.col("body"))
    return a.select("event_id", enum.alias("enum"), net.classify(F.col("status"), enum).alias("outcome"))


def wait_of_answer(spark: SparkSession, d: str) -> DataFrame:
    """Delays in headers, in bodies, in both and in none, for each dialect."""
    k = F.col("event_id")
    dialect = F.element_at(F.array(*map(F.lit, "abc")), (k % 3 + 1).cast("int"))
    headers = F.array(F.struct(F.lit("Retry-After").alias("field"), F.when(k % 4 > 0, (k % 20).cast("string")).alias("value")))
    said = F.concat(F.lit('{"error":{"details":[{"@type":"x/google.rpc.RetryInfo","retryDelay":"'), (k % 30).cast("string"), F.lit('s"}]}}'))
    got = net.wait_of(dialect, headers, F.when(k % 5 > 1, said).when(k % 5 == 1, "{}"), F.lit(0))
    return v.table(spark, d, "events").select("event_id", got.alias("seconds"))


def degraded_items(spark: SparkSession, d: str) -> DataFrame:
    """Users are runs; their items of four attempts each succeed, fail for good, or open the breaker after two in a row."""
    a = _attempts(spark, d)
    status = F.when(F.floor(F.col("seq") / 4) % 3 > 0, F.when(F.col("status") == 401, 503).when(F.col("status") == 200, 429).otherwise(F.col("status"))).otherwise(F.col("status"))
    a = a.select(F.col("user_id").alias("run_id"), "item", "attempt", status.alias("status"), F.floor(F.col("seq") / 4).alias("seq"))
    return net.degraded_items(a, threshold=2).select("item", "outcome", F.col("calls").cast("int").alias("calls"))


def _breaker_events(spark: SparkSession, d: str) -> DataFrame:
    bad = F.when(F.col("status").isin(429, 503) | F.col("status").isNull(), "exhausted").otherwise("ok")
    return _attempts(spark, d).select(F.col("user_id").alias("run_id"), "seq", bad.alias("outcome"), "event_id")


def breaker_state(spark: SparkSession, d: str) -> DataFrame:
    return net.breaker(_breaker_events(spark, d)).select("event_id", F.col("consecutive").cast("long").alias("consecutive"), "open")


def early_stop(spark: SparkSession, d: str) -> DataFrame:
    """Of each run, what came before its breaker opened, and how many were put off after."""
    return net.early_stop(net.breaker(_breaker_events(spark, d)))


def _one_run(spark: SparkSession, d: str) -> DataFrame:
    """All events as one run."""
    return _breaker_events(spark, d).select(F.lit(1).alias("run_id"), F.col("event_id").alias("seq"), "outcome", "event_id")


def breaker_one_run(spark: SparkSession, d: str) -> DataFrame:
    """The breaker over a run of all events, in ranges."""
    return net.breaker(_one_run(spark, d), split=True).select("event_id", F.col("consecutive").cast("long").alias("consecutive"), "open")


def breaker_few_runs(spark: SparkSession, d: str) -> DataFrame:
    """The breaker over three runs, of which one has most events; it opens after three in a row."""
    runs = F.when(F.col("event_id") % 10 < 8, F.lit(None).cast("long")).otherwise(F.col("event_id") % 2)
    e = _one_run(spark, d).withColumn("run_id", runs)
    return net.breaker(e, threshold=3, split=True).select("event_id", F.col("consecutive").cast("long").alias("consecutive"), "open")


def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    """A token an hour, at most two; ids as the clock."""
    e = _attempts(spark, d).select(F.col("user_id").alias("run_id"), "seq", (F.col("event_id") / 100).alias("now"))
    return net.token_bucket(e, rate=0.5, capacity=2.0).select("run_id", "seq", "granted")


def keyring_failover(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("status") == 200, "ok").when(F.col("status") == 401, "retire").when(F.col("status").isNull(), "request-error").otherwise("cooldown")
    e = _attempts(spark, d).select(F.col("user_id").alias("run_id"), "seq", F.col("event_id").cast("double").alias("now"), kind.alias("outcome"))
    return net.keyring(e)


def gate_status(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    got = net.gate(k % 7 == 0, k % 11 != 0, k % 5 == 0, F.when(k % 3 == 0, "fatal"), F.when(k % 2 == 0, "r"))
    return v.table(spark, d, "events").select("event_id", got.alias("status"))


def preview_decide(spark: SparkSession, d: str) -> DataFrame:
    """A user's first view or click is the first callback."""
    e = v.table(spark, d, "events")
    first = F.min_by("event_type", F.when(F.col("event_type").isin("view", "click"), F.struct("ts", "event_id")))
    per = e.groupBy("user_id").agg(first.alias("first"), F.count("*").alias("n"))
    event = F.when(F.col("user_id") % 3 == 0, F.lit(None)).when(F.col("first") == "view", "ready").otherwise("failed")
    return per.select("user_id", net.preview_verdict(F.col("user_id") % 13 == 0, event, F.col("n") * 500).alias("verdict"))


def chunk_status(spark: SparkSession, d: str) -> DataFrame:
    """Status of a run over its chunks: error if one failed, else that of the last."""
    o = v.table(spark, d, "orders").withColumn("run", F.col("o_custkey") % 97)
    ok = F.when(F.col("o_orderstatus") == "F", "executed").when((F.col("o_orderstatus") == "O") | (F.col("o_orderkey") % 40 != 0), "noop").otherwise("error")
    got = F.when(F.bool_or(ok == "error"), "error").otherwise(F.max_by(ok, "o_orderkey"))
    return o.groupBy("run").agg(got.alias("status"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """Four coordinates of a vector as a box; some cut short or broken."""
    e = F.col("embedding").cast("array<double>")
    k = F.col("vec_id")
    box = F.when(k % 9 == 0, F.slice(e, 1, 3)).when(k % 3 == 0, F.array(e[0] / 4 + 0.3, e[1] / 4 + 0.3, e[0] / 4 + 0.6, e[1] / 4 + e[2])).otherwise(F.slice(e, 1, 4))
    return v.table(spark, d, "embeddings").select("vec_id", box.alias("b"))


_BOXES = """boxes AS (SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN e[1:3] WHEN vec_id % 3 = 0 THEN [e[1] / 4 + 0.3::DOUBLE, e[2] / 4 + 0.3::DOUBLE, e[1] / 4 + 0.6::DOUBLE, e[2] / 4 + e[3]] ELSE e[1:4] END AS b
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))"""


def validate_bbox(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(spark, d).select("vec_id", contract.bbox_error(F.col("b")).alias("err"))


def box_reorder(spark: SparkSession, d: str) -> DataFrame:
    p = v.table(spark, d, "part")
    k = F.col("p_partkey")
    raw = F.array(k % 1003, k % 211, k % 997 + F.when(k % 13 == 0, 0.5).otherwise(0.0), k % 50).cast("array<double>")
    return p.select("p_partkey", F.array_join(F.transform(contract.box_reorder(raw), lambda x: F.round(x * 1000).cast("long").cast("string")), ",").alias("box"))


def validate_image(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    kind = F.element_at(F.array(F.lit("bytes"), F.lit("file"), F.lit("other")), (k % 3 + 1).cast("int"))
    width = F.when(k % 17 == 0, F.lit(float("nan"))).when(k % 19 == 0, F.lit(float("inf"))).otherwise(k % 23 * 1.0)
    path = F.when(k % 7 != 0, F.col("url"))
    return v.table(spark, d, "pages").select("page_id", contract.image_error(kind, k % 4, path, width, F.lit(3.0)).alias("err"))


def _responses(spark: SparkSession, d: str) -> DataFrame:
    """Responses in JSON built from parts: good ones, and one for each way to be wrong."""
    q, k = F.lit('"'), F.col("p_partkey") % 12
    name = lambda x: F.concat(q, x, q)
    rank = F.when(k == 1, "kingdom").otherwise("genus")
    conf = F.when(k == 2, "1.5").when(k == 3, "null").otherwise("0.75")
    extra = F.when(k == 4, ',"colour":"red"').otherwise("")
    box = F.when(k == 5, "[0.5,0.1,0.2,0.9]").when(k == 6, "[0.1,0.2]").otherwise("[0.1,0.2,0.3,0.4]")
    common = F.when(k == 7, " ").otherwise(F.col("p_name"))
    det = F.concat(
        F.lit('{"bbox":'), box, F.lit(',"common_name":'), name(common), F.lit(',"scientific_name":'), name(F.col("p_brand")), F.lit(',"confidence":'), conf,
        F.lit(',"identified_rank":'), name(rank), F.lit(',"rank_name":'), name(F.col("p_type")), extra, F.lit("}"),
    )
    present = F.when(k == 8, "false").when(k == 9, '"yes"').otherwise("true")
    top = F.when(k == 10, ',"note":1').otherwise("")
    good = F.concat(F.lit('{"bird_present":'), present, F.lit(',"detections":['), det, F.lit("]"), top, F.lit("}"))
    return v.table(spark, d, "part").select("p_partkey", F.when(k == 11, "not json").otherwise(good).alias("json"))


_ERRORS = """CASE p_partkey % 12 WHEN 1 THEN 'bad-rank@1' WHEN 2 THEN 'confidence-out-of-[0,1]@1' WHEN 4 THEN 'unexpected-detection-key:colour@1'
    WHEN 5 THEN 'bbox-xmin>xmax@1' WHEN 6 THEN 'bbox-not-4@1' WHEN 7 THEN 'common_name@1' WHEN 8 THEN 'bird_present-false-with-detections'
    WHEN 9 THEN 'bird_present-not-bool' WHEN 10 THEN 'unexpected-top-key:note' WHEN 11 THEN 'resp-not-table' END"""


def validate_response(spark: SparkSession, d: str) -> DataFrame:
    return _responses(spark, d).select("p_partkey", contract.response_error(F.col("json")).alias("err"))


def repair_or_degrade(spark: SparkSession, d: str) -> DataFrame:
    return _responses(spark, d).select("p_partkey", contract.repair(F.col("json")).alias("state"))


def _quoted(json):
    return F.replace(F.replace(json, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def map_dialect_a(spark: SparkSession, d: str) -> DataFrame:
    """The answer as a text inside choices; some refused, cut off, or fenced."""
    k = F.col("p_partkey") % 5
    content = F.when(k == 1, F.concat(F.lit("```json "), "json", F.lit(" ```"))).otherwise(F.col("json"))
    tail = F.when(k == 2, '"stop"').when(k == 3, '"length"').otherwise('"stop"')
    refusal = F.when(k == 4, ',"refusal":"no"').otherwise("")
    body = F.concat(F.lit('{"choices":[{"finish_reason":'), tail, F.lit(',"message":{"content":"'), _quoted(content), F.lit('"'), refusal, F.lit("}}]}"))
    return _responses(spark, d).select("p_partkey", contract.repair(contract.dialect_a(body)).alias("state"))


def map_dialect_b(spark: SparkSession, d: str) -> DataFrame:
    """The answer as the input of a tool block; some of another tool, or cut off."""
    k = F.col("p_partkey") % 4
    tool = F.when(k == 1, "other").otherwise("report")
    stop = F.when(k == 2, "max_tokens").otherwise("tool_use")
    value = F.when(F.col("json") == "not json", '"not json"').otherwise(F.col("json"))
    body = F.concat(
        F.lit('{"stop_reason":"'), stop, F.lit('","content":[{"type":"text","text":"x"},{"type":"tool_use","name":"'), tool, F.lit('","input":'), value, F.lit("}]}")
    )
    return _responses(spark, d).select("p_partkey", contract.repair(contract.dialect_b(body, "report")).alias("state"))


def map_dialect_c(spark: SparkSession, d: str) -> DataFrame:
    """The answer in text parts of a candidate; some blocked or not ended by themselves."""
    k = F.col("p_partkey") % 4
    json = F.col("json")
    for box, native in (("[0.1,0.2,0.3,0.4]", "[200,100,400,300]"), ("[0.5,0.1,0.2,0.9]", "[100,500,900,200]"), ("[0.1,0.2]", "[100,200]")):
        json = F.replace(json, F.lit(f'"bbox":{box}'), F.lit(f'"box_2d":{native}'))
    half = (F.length(json) / 2).cast("int")
    left, right = F.substring(json, F.lit(1), half), F.substring(json, half + 1, F.length(json))
    reason = F.when(k == 1, "SAFETY").otherwise("STOP")
    block = F.when(k == 2, ',"promptFeedback":{"blockReason":"OTHER"}').otherwise("")
    body = F.concat(
        F.lit('{"candidates":[{"finishReason":"'), reason, F.lit('","content":{"parts":[{"text":"'), _quoted(left), F.lit('"},{"text":"'), _quoted(right),
        F.lit('"}]}}]'), block, F.lit("}"),
    )
    answers = _responses(spark, d).select("p_partkey", contract.dialect_c(body).alias("answer"))
    judged = answers.select("p_partkey", "answer", contract.repair(F.col("answer")).alias("state"))
    box = F.get_json_object(contract.finalize(F.col("answer"), F.col("state")), "$.detections[0].bbox")
    return judged.select("p_partkey", "state", F.from_json(box, "array<double>")[0].alias("x_min"))


def fake_provider(spark: SparkSession, d: str) -> DataFrame:
    """A fixture by name, else the default one."""
    fixtures = spark.createDataFrame([("widget", "one widget"), ("bolt", "one bolt")], "name string, answer string")
    p = v.table(spark, d, "part").withColumn("name", F.element_at(F.split("p_name", " "), -1))
    return p.join(F.broadcast(fixtures), "name", "left").select("p_partkey", F.coalesce("answer", F.lit("default")).alias("answer"))


_QUOTA_SQL = "[" + ", ".join(f"'{n}'" for n in _QUOTA) + f"][(event_id // {{0}} % {len(_QUOTA)} + 1)::INT]"
_ONE_RUN = """b AS (SELECT event_id, {0} AS run, (status IS NULL OR status IN (429, 503)) AS bad FROM attempts),
    i AS (SELECT *, sum((NOT bad)::INT) OVER (PARTITION BY run ORDER BY event_id) AS isl FROM b),
    c AS (SELECT *, (sum(bad::INT) OVER (PARTITION BY run, isl ORDER BY event_id))::BIGINT AS consecutive FROM i)"""
_STATE = "CASE WHEN p_partkey % 12 IN (0, 3) THEN 'valid' WHEN p_partkey % 12 = 8 THEN 'repaired' ELSE 'degraded' END"
QUERIES = {
    f.__name__: f
    for f in (
        http_classify, backoff_delay, retry_terminal_row, http_date_delay, retry_after_parse, google_retry_delay, breaker_state, early_stop, breaker_one_run, breaker_few_runs, http_classify_body, wait_of_answer, degraded_items, token_bucket,
        keyring_failover, gate_status, preview_decide, chunk_status, validate_bbox, box_reorder, validate_image, validate_response, repair_or_degrade,
        map_dialect_a, map_dialect_b, map_dialect_c, fake_provider,
    )
}
SQL = {
    "http_classify": f"""WITH {_ATTEMPTS} SELECT event_id, CASE WHEN status IS NULL THEN 'retry' WHEN status = 200 THEN 'ok' WHEN status = 401 OR event_id % 3 = 1 THEN 'fatal'
        ELSE 'retry' END AS outcome, CASE status WHEN 200 THEN 'http-200' WHEN 429 THEN 'rate-limited-429' WHEN 503 THEN 'server-error-503'
        WHEN 401 THEN 'auth-failed-401 (check API key)' ELSE 'transport-error' END AS label FROM attempts""",
    "backoff_delay": f"""WITH {_ATTEMPTS} SELECT event_id, CASE WHEN status IN (429, 503) AND attempt < 4 THEN CASE WHEN event_id % 3 = 0
        THEN CASE WHEN event_id % 50 <= 30 THEN (event_id % 50)::DOUBLE END ELSE least(30.0::DOUBLE, power(2.0::DOUBLE, attempt - 1)) END END AS delay FROM attempts""",
    "retry_terminal_row": f"""WITH {_ATTEMPTS}, c AS (SELECT item, attempt, CASE WHEN status IS NULL OR status IN (429, 503) THEN 'retry' WHEN status = 200 THEN 'ok' ELSE 'fatal' END AS o FROM attempts)
        SELECT item, attempt, CASE WHEN o <> 'retry' THEN o WHEN attempt = 4 THEN 'exhausted' ELSE 'pending' END AS outcome FROM c
        QUALIFY row_number() OVER (PARTITION BY item ORDER BY (o = 'retry' AND attempt < 4), attempt) = 1""",
    "http_date_delay": """SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 4 < 2
        THEN greatest(0.0::DOUBLE, epoch(o_orderdate) - 883612800) END AS delay FROM orders""",
    "retry_after_parse": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 7 >= 1 THEN (event_id % 7 * 500 - 500) / 1000.0::DOUBLE END
        WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 9 >= 2 THEN (event_id % 9 - 2)::DOUBLE END AS seconds FROM events""",
    "google_retry_delay": "SELECT event_id, [30.0, 1.5, 0.5, NULL, NULL, NULL][(event_id % 6 + 1)::INT]::DOUBLE AS seconds FROM events",
    "breaker_state": f"""WITH {_ATTEMPTS}, b AS (SELECT *, (status IS NULL OR status IN (429, 503)) AS bad FROM attempts),
        i AS (SELECT *, sum((NOT bad)::INT) OVER (PARTITION BY user_id ORDER BY seq) AS isl FROM b),
        c AS (SELECT *, (sum(bad::INT) OVER (PARTITION BY user_id, isl ORDER BY seq))::BIGINT AS consecutive FROM i)
        SELECT event_id, consecutive, bool_or(consecutive >= 5) OVER (PARTITION BY user_id ORDER BY seq) AS open FROM c""",
    "early_stop": f"""WITH {_ATTEMPTS}, b AS (SELECT *, (status IS NULL OR status IN (429, 503)) AS bad FROM attempts),
        i AS (SELECT *, sum((NOT bad)::INT) OVER (PARTITION BY user_id ORDER BY seq) AS isl FROM b),
        c AS (SELECT *, sum(bad::INT) OVER (PARTITION BY user_id, isl ORDER BY seq) AS n FROM i),
        s AS (SELECT user_id, coalesce(bool_or(n >= 5) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM c)
        SELECT user_id AS run_id, count(*) FILTER (NOT stopped) AS done, count(*) FILTER (stopped) AS deferred FROM s GROUP BY user_id""",
    "http_classify_body": f"""WITH {_ATTEMPTS}, nn AS (SELECT *, {_QUOTA_SQL.format(2)} AS t, {_QUOTA_SQL.format(5)} AS c, {_QUOTA_SQL.format(3)} AS s FROM attempts),
        b AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN 'insufficient_quota' WHEN event_id % 13 = 0 THEN '{{"error":"insufficient_quota"}}'
            WHEN event_id % 3 < 2 THEN '{{"error":{{"type":"' || t || '","code":' || CASE WHEN event_id % 4 = 0 THEN '7' ELSE '"' || c || '"' END || ',"status":"' || s || '"}}}}'
            ELSE '{{"error":{{"type":"tokens"}}}}' END AS body FROM nn),
        j AS (SELECT event_id, status, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM b),
        e AS (SELECT event_id, status, list_filter([j ->> '$.error.type', j ->> '$.error.code', j ->> '$.error.status'],
            lambda x: x IN ('insufficient_quota', 'billing_hard_limit_reached', 'billing_not_active', 'access_terminated'))[1] AS enum FROM j)
        SELECT event_id, enum, CASE WHEN status IS NULL THEN 'retry' WHEN status = 200 THEN 'ok' WHEN status IN (429, 503) AND enum IS NULL THEN 'retry' ELSE 'fatal' END AS outcome FROM e""",
    "wait_of_answer": """SELECT event_id, CASE WHEN event_id % 3 = 2 AND event_id % 5 > 1 THEN (event_id % 30)::DOUBLE WHEN event_id % 4 > 0 THEN (event_id % 20)::DOUBLE END AS seconds FROM events""",
    "degraded_items": f"""WITH {_ATTEMPTS}, a AS (SELECT user_id, item, attempt, seq // 4 AS k, CASE WHEN seq // 4 % 3 > 0 THEN CASE status WHEN 401 THEN 503 WHEN 200 THEN 429 ELSE status END ELSE status END AS status FROM attempts),
        c AS (SELECT *, CASE WHEN status IS NULL OR status IN (429, 503) THEN 'retry' WHEN status = 200 THEN 'ok' ELSE 'fatal' END AS o FROM a),
        t AS (SELECT user_id, item, k, attempt, CASE WHEN o <> 'retry' THEN o WHEN attempt = 4 THEN 'exhausted' ELSE 'pending' END AS outcome FROM c
            QUALIFY row_number() OVER (PARTITION BY item ORDER BY (o = 'retry' AND attempt < 4), attempt) = 1),
        x AS (SELECT *, outcome = 'exhausted' AND coalesce(lag(outcome) OVER (PARTITION BY user_id ORDER BY k) = 'exhausted', false) AS opens FROM t),
        y AS (SELECT *, coalesce(bool_or(opens) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS closed FROM x)
        SELECT item, CASE WHEN closed OR outcome = 'exhausted' THEN 'degraded' ELSE outcome END AS outcome, CASE WHEN closed THEN 0 ELSE attempt END AS calls FROM y""",
    "breaker_one_run": f"""WITH {_ATTEMPTS}, {_ONE_RUN.format("1")} SELECT event_id, consecutive, bool_or(consecutive >= 5) OVER (ORDER BY event_id) AS open FROM c""",
    "breaker_few_runs": f"""WITH {_ATTEMPTS}, {_ONE_RUN.format("CASE WHEN event_id % 10 >= 8 THEN event_id % 2 END")}
        SELECT event_id, consecutive, bool_or(consecutive >= 3) OVER (PARTITION BY run ORDER BY event_id) AS open FROM c""",
    "token_bucket": f"""WITH RECURSIVE {_ATTEMPTS}, e AS (SELECT user_id AS run_id, seq, event_id / 100.0::DOUBLE AS now FROM attempts),
        f AS (SELECT run_id, seq, now, 2.0::DOUBLE AS t FROM e WHERE seq = 0
              UNION ALL
              SELECT e.run_id, e.seq, e.now, least(2.0::DOUBLE, (CASE WHEN f.t >= 1 THEN f.t - 1 ELSE f.t END) + greatest(0.0::DOUBLE, e.now - f.now) * 0.5::DOUBLE)
              FROM f JOIN e ON e.run_id = f.run_id AND e.seq = f.seq + 1)
        SELECT run_id, seq, t >= 1 AS granted FROM f""",
    "gate_status": """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'deferred' WHEN event_id % 7 = 0 THEN 'cancelled' WHEN event_id % 5 = 0 THEN 'deferred'
        WHEN event_id % 2 = 0 THEN 'identified' WHEN event_id % 3 = 0 THEN 'fatal' ELSE 'deferred' END AS status FROM events""",
    "preview_decide": """WITH f AS (SELECT user_id, arg_min(event_type, (ts, event_id)) FILTER (event_type IN ('view', 'click')) AS f, count(*) AS n FROM events GROUP BY user_id)
        SELECT user_id, CASE WHEN user_id % 13 = 0 THEN 'cancelled' WHEN user_id % 3 = 0 THEN CASE WHEN n * 500 >= 30000 THEN 'timeout' ELSE 'pending' END
        WHEN f = 'view' THEN 'ready' ELSE 'failed' END AS verdict FROM f""",
    "chunk_status": """WITH s AS (SELECT o_custkey % 97 AS run, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'executed' WHEN o_orderstatus = 'O' OR o_orderkey % 40 <> 0 THEN 'noop' ELSE 'error' END AS s FROM orders)
        SELECT run, CASE WHEN bool_or(s = 'error') THEN 'error' ELSE arg_max(s, o_orderkey) END AS status FROM s GROUP BY run""",
    "validate_bbox": f"""WITH {_BOXES} SELECT vec_id, CASE WHEN len(b) <> 4 THEN 'bbox-not-4' WHEN list_min(b) < 0 OR list_max(b) > 1 THEN 'bbox-out-of-[0,1]'
        WHEN b[1] >= b[3] THEN 'bbox-xmin>xmax' WHEN b[2] >= b[4] THEN 'bbox-ymin>ymax' END AS err FROM boxes""",
    "box_reorder": """SELECT p_partkey, CASE WHEN p_partkey % 1003 <= 1000 AND p_partkey % 13 <> 0 THEN
        concat_ws(',', p_partkey % 211, p_partkey % 1003, p_partkey % 50, p_partkey % 997) END AS box FROM part""",
    "validate_image": """SELECT page_id, CASE WHEN page_id % 3 = 0 AND page_id % 4 = 0 THEN 'bytes-missing-data' WHEN page_id % 3 = 1 AND page_id % 7 = 0 THEN 'file-missing-path'
        WHEN page_id % 3 = 2 THEN 'bad-kind' WHEN page_id % 17 = 0 OR page_id % 19 = 0 OR page_id % 23 = 0 THEN 'bad-width' END AS err FROM pages""",
    "validate_response": f"SELECT p_partkey, {_ERRORS} AS err FROM part",
    "repair_or_degrade": f"SELECT p_partkey, {_STATE} AS state FROM part",
    "map_dialect_a": f"SELECT p_partkey, CASE WHEN p_partkey % 5 IN (3, 4) THEN 'degraded' ELSE {_STATE} END AS state FROM part",
    "map_dialect_b": f"SELECT p_partkey, CASE WHEN p_partkey % 4 IN (1, 2) THEN 'degraded' ELSE {_STATE} END AS state FROM part",
    # A detection whose native box is no box (rest 6) is dropped, which leaves a valid response without any.
    "map_dialect_c": f"""SELECT p_partkey, CASE WHEN p_partkey % 4 IN (1, 2) THEN 'degraded' WHEN p_partkey % 12 = 6 THEN 'valid' ELSE {_STATE} END AS state,
        CASE WHEN p_partkey % 4 NOT IN (1, 2) AND p_partkey % 12 IN (0, 3) THEN 0.1::DOUBLE END AS x_min FROM part""",
    "fake_provider": """SELECT p_partkey, CASE WHEN p_name LIKE '% widget' THEN 'one widget' WHEN p_name LIKE '% bolt' THEN 'one bolt' ELSE 'default' END AS answer FROM part""",
}
