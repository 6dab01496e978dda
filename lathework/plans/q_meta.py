"""Queries: capture times, stacks, folders, slices, switches and error labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import capture
from ..operators import netpolicy as net
from . import views as v


def capture_time(spark: SparkSession, d: str) -> DataFrame:
    """Prices stand for dates, some missing, some not a number."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice").cast("double")
    original = F.when(k % 7 == 0, F.lit(float("nan"))).when(k % 3 != 0, p)
    got = capture.capture_time(original, F.when(k % 2 == 0, p + 1), F.when(k % 5 != 0, p + 2))
    return v.table(spark, d, "orders").select("o_orderkey", got.alias("taken"))


def stack_id(spark: SparkSession, d: str) -> DataFrame:
    """A part's brand is the top of its stack, its size the first member."""
    k = F.col("p_partkey")
    top = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.col("p_brand"))
    members = F.when(k % 5 == 0, F.array().cast("array<int>")).when(k % 5 != 1, F.array(F.col("p_size").cast("int"), F.lit(7)))
    return v.table(spark, d, "part").select("p_partkey", capture.stack_id(top, members).alias("stack"))


def run_folders(spark: SparkSession, d: str) -> DataFrame:
    """Run and report folders and file names of parts, by brand with and without its #."""
    run = F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).when(F.col("p_partkey") % 4 == 1, F.lit("../x")).otherwise(F.replace("p_brand", F.lit("#"), F.lit("_")))
    names = capture.temp_names(F.when(F.col("p_partkey") % 9 != 0, F.col("p_partkey") * 1.5))
    return v.table(spark, d, "part").select("p_partkey", capture.run_dir(run).alias("run_dir"), capture.run_dir(run, "report").alias("report_dir"), names["crop"].alias("crop"), names["err"].alias("err"))


def quarter_slices(spark: SparkSession, d: str) -> DataFrame:
    """The customers of a nation and segment in four slices, in order."""
    per = Window.partitionBy("c_nationkey", "c_mktsegment")
    at, n = F.row_number().over(per.orderBy("c_custkey")) - 1, F.count("*").over(per)
    return v.table(spark, d, "customer").select("c_custkey", capture.slice_of(at, n).alias("slice"))


def features_off(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    got = capture.features_off(F.when(k % 4 != 0, k % 3), F.when(k % 5 != 0, k % 2 == 0), F.when(k % 7 != 0, k % 11 == 0))
    return v.table(spark, d, "customer").select("c_custkey", got.alias("off"))


_NAMES = ("rate_limit_error", "server_error", "secret-value", "UNAVAILABLE", "insufficient_quota")


def error_label(spark: SparkSession, d: str) -> DataFrame:
    """Error bodies with three names each, some of which may not be shown."""
    k = F.col("event_id")
    name = lambda i: F.element_at(F.array(*map(F.lit, _NAMES)), (i % len(_NAMES) + 1).cast("int"))
    body = F.concat(F.lit('{"error":{"type":"'), name(k), F.lit('","code":"'), name(F.floor(k / 3)), F.lit('","status":"'), name(F.floor(k / 7)), F.lit('"}}'))
    return v.table(spark, d, "events").select("event_id", net.error_label(F.when(k % 13 != 0, body).otherwise("no json")).alias("label"))


QUERIES = {f.__name__: f for f in (capture_time, stack_id, run_folders, quarter_slices, features_off, error_label)}
_SHOWN = "('rate_limit_error', 'server_error', 'UNAVAILABLE')"
_LIST = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"
SQL = {
    "capture_time": """WITH r AS (SELECT o_orderkey AS k, o_totalprice::DOUBLE AS p FROM orders),
        c AS (SELECT k, coalesce(CASE WHEN k % 7 = 0 THEN 'NaN'::DOUBLE WHEN k % 3 <> 0 THEN p END, CASE WHEN k % 2 = 0 THEN p + 1 END, CASE WHEN k % 5 <> 0 THEN p + 2 END) AS d FROM r)
        SELECT k AS o_orderkey, CASE WHEN NOT isnan(d) THEN d END AS taken FROM c""",
    "stack_id": """SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN 'top:' || p_brand WHEN p_partkey % 5 > 1 THEN 'members:' || p_size::INT::VARCHAR END AS stack FROM part""",
    "run_folders": """WITH r AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN '../x' ELSE replace(p_brand, '#', '_') END AS run,
            CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE floor(p_partkey * 1.5::DOUBLE) END::BIGINT AS n FROM part),
        s AS (SELECT k, CASE WHEN regexp_full_match(run, '[A-Za-z0-9_-]+') THEN run END AS id, CASE WHEN n < 100000 THEN lpad(n::VARCHAR, 5, '0') ELSE n::VARCHAR END AS digits FROM r)
        SELECT k AS p_partkey, 'run-' || id AS run_dir, 'report-' || id AS report_dir, 'crop-' || digits || '.jpg' AS crop, 'err-' || digits AS err FROM s""",
    "quarter_slices": """SELECT c_custkey, least(3, (row_number() OVER w - 1) // greatest(1, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) // 4))::INT AS slice
        FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey)""",
    "features_off": """SELECT c_custkey, (c_custkey % 4 = 0 OR c_custkey % 3 = 1) AND NOT (c_custkey % 5 <> 0 AND c_custkey % 2 = 0) AND NOT (c_custkey % 7 <> 0 AND c_custkey % 11 = 0) AS off
        FROM customer""",
    "error_label": f"""WITH b AS (SELECT event_id, {_LIST}[(event_id % 5 + 1)::INT] AS t, {_LIST}[(event_id // 3 % 5 + 1)::INT] AS c, {_LIST}[(event_id // 7 % 5 + 1)::INT] AS s FROM events)
        SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN nullif(concat_ws('/', CASE WHEN t IN {_SHOWN} THEN t END, CASE WHEN c IN {_SHOWN} AND c <> t THEN c END,
            CASE WHEN s IN {_SHOWN} AND s NOT IN (t, c) THEN s END), '') END AS label FROM b""",
}
