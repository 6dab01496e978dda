"""Queries: labels, write plan, clusters, propagation and run state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import norm_name, writable_name
from ..operators import cluster, decide, propagate
from ..sources.shared import stash
from . import views as v
from . import write_plan as wp

HOUR = 3_600_000_000


def keyword_decide_render(spark: SparkSession, d: str) -> DataFrame:
    return v.labels(spark, d).select("rec_idx", "det_idx", F.col("d.action").alias("action"), "uncertain", "rendered", F.col("name").alias("stored"))


def best_alternative(spark: SparkSession, d: str) -> DataFrame:
    """The other lines of an order are the alternatives of its first line."""
    det = v.detections(spark, d)
    alt = F.struct(
        "det_idx", F.col("common").alias("common_name"), F.col("scientific").alias("scientific_name"), "confidence",
        F.col("rank").alias("identified_rank"), "rank_name",
    )
    rest = det.filter("det_idx > 1").groupBy("rec_idx").agg(F.array_sort(F.collect_list(alt)).alias("alternatives"))
    best = decide.best_alternative(F.col("alternatives"))
    return rest.select("rec_idx", best.alias("b")).filter("b IS NOT NULL").select(
        "rec_idx", F.col("b.det_idx").alias("det_idx"), F.col("b.identified_rank").alias("rank"), F.col("b.confidence").alias("confidence")
    )


def single_keyword_per_photo(spark: SparkSession, d: str) -> DataFrame:
    return wp.candidates(v.labels(spark, d), single=True).select("rec_idx", "det_idx", "name")


def norm_names(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "documents").select("doc_id", norm_name(F.col("text")).alias("norm"))


def writable_names(spark: SparkSession, d: str) -> DataFrame:
    """Names with commas, question marks and blanks in all places."""
    p = v.table(spark, d, "part")
    tails = F.array(*map(F.lit, ("", "?", "??", " ?", ",", "?,", ", B?", " (family)?")))
    return p.select("p_partkey", F.concat("p_name", F.element_at(tails, (F.col("p_partkey") % 8 + 1).cast("int"))).alias("raw")).select(
        "p_partkey", writable_name(F.col("raw")).alias("name")
    )


def _planned(spark: SparkSession, d: str):
    lab = v.labels(spark, d).select("rec_idx", "photo_key", "det_idx", "rendered", "uncertain", "name", "norm", "left_name", "left_norm", "l_linestatus")
    lab = stash(lab, "labels")  # read three times or more below
    found = stash(wp.candidates(lab).drop("rendered", "left_name", "left_norm", "l_linestatus"), "candidates")
    return lab, found, wp.additions(found, v.existing(lab))


def write_plan_entries(spark: SparkSession, d: str) -> DataFrame:
    added = _planned(spark, d)[2]
    return wp.entries(added).select("photo_key", "first_rec", F.array_join("add_keywords", " | ").alias("add_keywords"))


def write_plan_summary_photo(spark: SparkSession, d: str) -> DataFrame:
    lab, found, added = _planned(spark, d)
    return wp.photo_summary(v.records(lab), lab, found, added)


def write_plan_summary_run(spark: SparkSession, d: str) -> DataFrame:
    lab, found, added = _planned(spark, d)
    return wp.run_summary(v.records(lab), wp.photo_summary(v.records(lab), lab, found, added))


def chunk_slices(spark: SparkSession, d: str) -> DataFrame:
    recs = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("rec_idx"))
    return wp.chunk_ids(recs, 25).select("rec_idx", "chunk_id")


def batched_flush(spark: SparkSession, d: str) -> DataFrame:
    """Orders of one customer share a photo; every third chunk does not commit."""
    orders = v.table(spark, d, "orders")
    lab = v.labels(spark, d).drop("photo_key").join(orders.select(F.col("o_orderkey").alias("rec_idx"), F.col("o_custkey").alias("photo_key")), "rec_idx")
    chunks = orders.select(F.col("o_orderkey").alias("rec_idx"), F.floor(F.col("o_orderkey") / 500).alias("chunk_id"))
    ok = chunks.select("chunk_id").distinct().withColumn("ok", F.col("chunk_id") % 3 != 2)
    return wp.batched_additions(wp.candidates(lab), v.existing(lab), chunks, ok)


def burst_cluster_time(spark: SparkSession, d: str) -> DataFrame:
    return cluster.bursts(v.frames(spark, d), 6 * HOUR, use_stacks=False, by=["user_id"]).select("key", "anchor_key", "is_anchor")


def burst_cluster_stack(spark: SparkSession, d: str) -> DataFrame:
    return cluster.bursts(v.frames(spark, d), 2 * HOUR, by=["user_id"]).select("key", "anchor_key", "is_anchor")


def burst_cluster_sim(spark: SparkSession, d: str) -> DataFrame:
    grid = v.table(spark, d, "embeddings").select("vec_id", cluster.average_hash(F.col("embedding").cast("array<double>")).alias("hash"))
    f = v.frames(spark, d).join(grid, F.col("key") == F.col("vec_id"), "left")
    return cluster.bursts(f, 12 * HOUR, by=["user_id"], hash_col="hash", threshold=32).select("key", "anchor_key", "is_anchor")


def burst_cluster_global(spark: SparkSession, d: str) -> DataFrame:
    return cluster.bursts(v.frames(spark, d), HOUR // 15, use_stacks=False).select("key", "anchor_key", "is_anchor")


def burst_cluster_hot(spark: SparkSession, d: str) -> DataFrame:
    """Three keys, of which one has most frames and one is null, in ranges."""
    f = v.frames(spark, d).withColumn("k", F.when(F.col("key") % 10 > 1, F.lit(7)).when(F.col("key") % 10 == 1, F.lit(8)))
    return cluster.bursts(f, HOUR // 15, by=["k"], split=True).select("key", "anchor_key", "is_anchor")


def ahash_bits(spark: SparkSession, d: str) -> DataFrame:
    h = cluster.average_hash(F.col("embedding").cast("array<double>"))
    return v.table(spark, d, "embeddings").select("vec_id", F.array_join(h.cast("array<string>"), "").alias("bits"))


def ahash_hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each vector against the one with the next id."""
    e = v.table(spark, d, "embeddings").select("vec_id", cluster.average_hash(F.col("embedding").cast("array<double>")).alias("h"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("g"))
    return e.join(other, "vec_id").select("vec_id", cluster.hamming(F.col("h"), F.col("g")).cast("long").alias("distance"), cluster.similar(F.col("h"), F.col("g"), 30).alias("similar"))


def _results(spark: SparkSession, d: str) -> DataFrame:
    f = cluster.bursts(v.frames(spark, d), 6 * HOUR, use_stacks=False, by=["user_id"])
    status = F.element_at(F.array(*map(F.lit, ("identified", "fatal", "cancelled", "error", "identified"))), (F.col("key") % 5 + 1).cast("int"))
    response = F.when(F.col("key") % 7 != 0, F.concat(F.lit("r"), F.col("key").cast("string")))
    anchors = f.filter("is_anchor").select(F.col("key").alias("anchor_key"), status.alias("status"), response.alias("response"))
    return propagate.results(f.select(F.col("key").alias("photo"), "sel_index"), f.select("key", "anchor_key"), anchors)


def propagate_status(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).select("photo", "status", "response", "inherited_from")


def adapter_entries(spark: SparkSession, d: str) -> DataFrame:
    return propagate.adapter_counts(_results(spark, d))


_OUTCOMES = ("written", "existing", "no-bird", "no-detection", "deferred", "timed-out", "errored", "cancelled", "odd")


def _states(spark: SparkSession, d: str) -> DataFrame:
    o = v.table(spark, d, "orders")
    at = (F.col("o_orderkey") % 9 + 1).cast("int")
    photo = F.when(F.col("o_orderkey") % 50 == 0, "").otherwise(F.col("o_custkey").cast("string"))
    return o.select(F.col("o_orderkey").alias("idx"), photo.alias("photo_id"), F.element_at(F.array(*map(F.lit, _OUTCOMES)), at).alias("outcome"))


_STATES = f"""states AS (
    SELECT o_orderkey AS idx, CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE o_custkey::VARCHAR END AS photo_id,
           {list(_OUTCOMES)}[(o_orderkey % 9 + 1)::INT] AS outcome FROM orders)"""


def outcome_classify(spark: SparkSession, d: str) -> DataFrame:
    o = v.table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "identified").when(F.col("o_orderstatus") == "O", "timed-out").otherwise("odd")
    got = propagate.outcome(status, F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 3, F.col("o_orderkey") % 4 - 2)
    return o.select("o_orderkey", got.alias("outcome"), got.isin(*propagate.TERMINAL).alias("terminal"))


def retry_incomplete(spark: SparkSession, d: str) -> DataFrame:
    return propagate.incomplete(_states(spark, d))


def state_projection(spark: SparkSession, d: str) -> DataFrame:
    return propagate.project_state(_states(spark, d)).groupBy("photo_id", "outcome").agg(F.count("*").alias("n"))


def planned_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcome of each photo by what the whole run planned for it, whatever was committed."""
    lab, _, added = _planned(spark, d)
    n = added.groupBy("photo_key").agg(F.count("*").alias("wrote"))
    rows = lab.groupBy("photo_key").agg(F.count("*").alias("dets")).join(n, "photo_key", "left")
    return rows.select("photo_key", propagate.outcome(F.lit("identified"), F.lit(True), F.col("dets"), F.coalesce("wrote", F.lit(0))).alias("outcome"))


def failed_names(spark: SparkSession, d: str) -> DataFrame:
    """Of each brand's suppliers in debt, at most 15 names, quoted, in order."""
    s = v.table(spark, d, "supplier").filter("s_acctbal < 0")
    first = s.withColumn("n", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))).filter("n <= 15")
    quoted = F.array_sort(F.collect_list(F.struct("n", F.concat(F.lit('"'), "s_name", F.lit('"')).alias("q"))))
    return first.groupBy("s_nationkey").agg(F.array_join(F.transform(quoted, lambda x: x["q"]), " | ").alias("names"))


def _bursts_sql(gap: str, stack: bool, by: str, sim: bool = False, extra: str = "") -> str:
    near = f"coalesce(date_diff('microsecond', lag(time) OVER w, time) >= 0 AND date_diff('microsecond', lag(time) OVER w, time) < {gap}, false)"
    if stack:
        near = f"({near} OR coalesce(lag(stack) OVER w = stack, false))"
    if sim:
        near += " AND coalesce(list_sum([(a <> b)::INT FOR a, b IN list_zip(lag(hash) OVER w, hash)]) <= 32, false)"
        near = near.replace("[(a <> b)::INT FOR a, b IN list_zip(lag(hash) OVER w, hash)]", "list_transform(list_zip(lag(hash) OVER w, hash), lambda x: (x[1] <> x[2])::INT)")
    return f"""m AS (
        SELECT *, NOT ({near}) AS is_anchor FROM {extra or 'frames'} WINDOW w AS ({by} ORDER BY time ASC NULLS LAST, sel_index ASC NULLS LAST, key)
    ), b AS (
        SELECT key, sel_index, last_value(CASE WHEN is_anchor THEN key END IGNORE NULLS) OVER ({by} ORDER BY time ASC NULLS LAST, sel_index ASC NULLS LAST, key
               ROWS UNBOUNDED PRECEDING) AS anchor_key, is_anchor FROM m)"""


_HASH = "list_transform({0}::DOUBLE[], lambda x: (x > list_sum({0}::DOUBLE[]) / 64)::INT)"
_BY = "PARTITION BY user_id"
_RESULTS = f"""r AS (
    SELECT f.key AS photo, f.anchor_key, ['identified', 'fatal', 'cancelled', 'error', 'identified'][(f.anchor_key % 5 + 1)::INT] AS raw,
           CASE WHEN f.anchor_key % 7 <> 0 THEN 'r' || f.anchor_key END AS resp FROM b f
), res AS (
    SELECT photo, CASE WHEN raw = 'identified' AND resp IS NOT NULL THEN 'identified' WHEN raw = 'cancelled' THEN 'cancelled' ELSE 'deferred' END AS status,
           resp, CASE WHEN anchor_key <> photo THEN anchor_key END AS inherited_from FROM r)"""

QUERIES = {
    "keyword_decide_render": keyword_decide_render,
    "best_alternative": best_alternative,
    "single_keyword_per_photo": single_keyword_per_photo,
    "norm_name": norm_names,
    "writable_name": writable_names,
    "write_plan_entries": write_plan_entries,
    "write_plan_summary_photo": write_plan_summary_photo,
    "write_plan_summary_run": write_plan_summary_run,
    "chunk_slices": chunk_slices,
    "batched_flush": batched_flush,
    "burst_cluster_time": burst_cluster_time,
    "burst_cluster_stack": burst_cluster_stack,
    "burst_cluster_sim": burst_cluster_sim,
    "burst_cluster_global": burst_cluster_global,
    "burst_cluster_hot": burst_cluster_hot,
    "ahash_bits": ahash_bits,
    "ahash_hamming_pairs": ahash_hamming_pairs,
    "propagate_status": propagate_status,
    "adapter_entries": adapter_entries,
    "outcome_classify": outcome_classify,
    "retry_incomplete": retry_incomplete,
    "state_projection": state_projection,
    "planned_outcomes": planned_outcomes,
    "failed_names": failed_names,
}

SQL = {
    "keyword_decide_render": f"""WITH {v.LAB} SELECT rec_idx, det_idx, CASE WHEN writes THEN 'write' ELSE 'skip' END AS action, uncertain, rendered,
        {v.WRITABLE.format("rendered")} AS stored FROM lab""",
    "best_alternative": f"""WITH {v.DET} SELECT rec_idx, det_idx, rank, confidence FROM det
        WHERE det_idx > 1 AND rank IN ('genus', 'family') AND confidence >= 0.6 AND trim(rank_name) NOT IN ('', 'nil')
        QUALIFY row_number() OVER (PARTITION BY rec_idx ORDER BY (rank = 'genus') DESC, confidence DESC, det_idx) = 1""",
    "single_keyword_per_photo": f"""WITH {v.LAB} SELECT rec_idx, det_idx, {v.WRITABLE.format("rendered")} AS name FROM lab WHERE rendered IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY rec_idx ORDER BY CASE rank WHEN 'species' THEN 3 WHEN 'genus' THEN 2 ELSE 1 END DESC,
                                   coalesce(confidence, -1) DESC, det_idx) = 1""",
    "norm_name": f"SELECT doc_id, {v.NORM.format('text')} AS norm FROM documents",
    "writable_name": """WITH r AS (SELECT p_partkey, p_name || ['', '?', '??', ' ?', ',', '?,', ', B?', ' (family)?'][(p_partkey % 8 + 1)::INT] AS raw FROM part),
        c AS (SELECT p_partkey, CASE WHEN contains(raw, ',') THEN trim(regexp_replace(replace(raw, ',', ' '), '\\s+', ' ', 'g')) ELSE raw END AS s FROM r)
        SELECT p_partkey, CASE WHEN regexp_matches(s, '\\?$') THEN regexp_replace(s, '\\s*\\?+$', '') || ' (uncertain)' ELSE s END AS name FROM c""",
    "write_plan_entries": f"""WITH {v.PLAN} SELECT photo_key, min(rec_idx) AS first_rec, string_agg(name, ' | ' ORDER BY rec_idx, det_idx) AS add_keywords
        FROM added GROUP BY photo_key""",
    "write_plan_summary_photo": f"WITH {v.PLAN} SELECT * FROM summ",
    "write_plan_summary_run": f"""WITH {v.PLAN} SELECT sum(found)::BIGINT AS found, sum(identified)::BIGINT AS identified, sum(uncertain)::BIGINT AS uncertain,
        sum(errors)::BIGINT AS errors, sum(skipped)::BIGINT AS skipped, (SELECT count(DISTINCT rec_idx) FROM lab) AS photos FROM summ""",
    "chunk_slices": "SELECT o_orderkey AS rec_idx, (row_number() OVER (ORDER BY o_orderkey) - 1) // 25 AS chunk_id FROM orders",
    "batched_flush": f"""WITH {v.PLAN}, f AS (
        SELECT o_orderkey // 500 AS chunk_id, o_custkey AS photo_key, name, norm, fresh.rec_idx, det_idx FROM fresh JOIN orders ON o_orderkey = fresh.rec_idx
    ), o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY chunk_id, photo_key, norm ORDER BY rec_idx, det_idx) = 1)
    SELECT chunk_id, photo_key, name FROM o
    WHERE NOT EXISTS (SELECT 1 FROM o p WHERE p.photo_key = o.photo_key AND p.norm = o.norm AND p.chunk_id < o.chunk_id AND p.chunk_id % 3 <> 2)""",
    "burst_cluster_time": f"WITH {v.FRAMES}, {_bursts_sql(str(6 * HOUR), False, _BY)} SELECT key, anchor_key, is_anchor FROM b",
    "burst_cluster_stack": f"WITH {v.FRAMES}, {_bursts_sql(str(2 * HOUR), True, _BY)} SELECT key, anchor_key, is_anchor FROM b",
    "burst_cluster_sim": f"""WITH {v.FRAMES}, g AS (SELECT frames.*, {_HASH.format("embedding")} AS hash FROM frames LEFT JOIN embeddings ON vec_id = key),
        {_bursts_sql(str(12 * HOUR), True, _BY, True, "g")} SELECT key, anchor_key, is_anchor FROM b""",
    "burst_cluster_global": f"WITH {v.FRAMES}, {_bursts_sql(str(HOUR // 15), False, '')} SELECT key, anchor_key, is_anchor FROM b",
    "burst_cluster_hot": f"""WITH {v.FRAMES}, h AS (SELECT *, CASE WHEN key % 10 > 1 THEN 7 WHEN key % 10 = 1 THEN 8 END AS k FROM frames),
        {_bursts_sql(str(HOUR // 15), True, 'PARTITION BY k', extra='h')} SELECT key, anchor_key, is_anchor FROM b""",
    "ahash_bits": f"SELECT vec_id, array_to_string({_HASH.format('embedding')}, '') AS bits FROM embeddings",
    "ahash_hamming_pairs": f"""WITH h AS (SELECT vec_id, {_HASH.format("embedding")} AS h FROM embeddings), p AS (
        SELECT a.vec_id, list_sum(list_transform(list_zip(a.h, b.h), lambda x: (x[1] <> x[2])::INT))::BIGINT AS distance FROM h a JOIN h b ON b.vec_id = a.vec_id + 1)
        SELECT vec_id, distance, distance <= 30 AS similar FROM p""",
    "propagate_status": f"""WITH {v.FRAMES}, {_bursts_sql(str(6 * HOUR), False, _BY)}, {_RESULTS}
        SELECT photo, status, CASE WHEN status = 'identified' THEN resp END AS response, inherited_from FROM res""",
    "adapter_entries": f"""WITH {v.FRAMES}, {_bursts_sql(str(6 * HOUR), False, _BY)}, {_RESULTS}
        SELECT count(*) FILTER (status = 'identified') AS identified, count(*) FILTER (status = 'deferred') AS deferred,
               count(*) FILTER (status = 'cancelled') AS cancelled, 0::BIGINT AS errored FROM res""",
    "outcome_classify": """WITH o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 4 > 2 THEN 'written'
            WHEN o_orderkey % 5 = 0 THEN 'no-bird' WHEN o_orderkey % 3 = 0 THEN 'no-detection' ELSE 'existing' END WHEN 'O' THEN 'timed-out' END AS outcome FROM orders)
        SELECT o_orderkey, outcome, outcome IN ('written', 'existing', 'no-bird', 'no-detection') AS terminal FROM o""",
    "retry_incomplete": f"""WITH {_STATES} SELECT photo_id, min(idx) AS idx FROM states
        WHERE photo_id <> '' AND outcome NOT IN ('written', 'existing', 'no-bird', 'no-detection') GROUP BY photo_id""",
    "state_projection": f"WITH {_STATES} SELECT photo_id, outcome, count(*) AS n FROM states WHERE photo_id <> '' AND outcome <> 'odd' GROUP BY ALL",
    "planned_outcomes": f"""WITH {v.PLAN} SELECT l.photo_key, CASE WHEN coalesce(a.n, 0) > 0 THEN 'written' ELSE 'existing' END AS outcome
        FROM (SELECT DISTINCT photo_key FROM lab) l LEFT JOIN (SELECT photo_key, count(*) AS n FROM added GROUP BY 1) a ON a.photo_key = l.photo_key""",
    "failed_names": """SELECT s_nationkey, string_agg('"' || s_name || '"', ' | ' ORDER BY s_suppkey) AS names FROM (
        SELECT * FROM supplier WHERE s_acctbal < 0 QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) <= 15) GROUP BY s_nationkey""",
}
