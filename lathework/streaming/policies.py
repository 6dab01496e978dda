"""The policies as stateful streams: the breaker, the token bucket, and commits in micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.netpolicy import BREAKER, breaker, take_token
from ..plans.write_plan import append
from ..sources import fs
from ..sources.batches import committed
from ..sources.shared import shared_path


def breaker_stream(events: DataFrame, out: str, checkpoint: str, threshold: int = BREAKER, split: bool | None = None):
    """Writes (run_id, seq, outcome, consecutive, open) after each event of a stream (run_id, seq, outcome) to ``out``/rows; starts it.

    Each micro-batch goes through the batch breaker, which splits large runs, from the state (a row for each run) that the batch before
    left. Rows and state are folders of their batch's number, so a batch that comes again replaces its own.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = [int(n[6:]) for n in fs.names(spark, f"{out}/state") if n.startswith("batch=") and int(n[6:]) < number]
        before = spark.read.parquet(f"{out}/state/batch={max(done)}") if done else None
        rows = breaker(batch.select("run_id", "seq", "outcome"), threshold=threshold, split=split, before=before)
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        rows = spark.read.schema(rows.schema).parquet(f"{out}/rows/batch={number}")
        state = rows.groupBy("run_id").agg(F.max_by(F.struct("consecutive", "open"), F.struct("seq", "consecutive")).alias("s")).select("run_id", "s.*")
        if before is not None:
            state = state.unionByName(before.join(state, before["run_id"].eqNullSafe(state["run_id"]), "left_anti"))
        state.write.mode("overwrite").parquet(f"{out}/state/batch={number}")
        for n in sorted(done)[:-1]:
            fs.remove(spark, f"{out}/state/batch={n}")

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def token_bucket_stream(events: DataFrame, rate: float, capacity: float = 1.0) -> DataFrame:
    """(run_id, seq, granted) of a stream (run_id, seq, now)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity, None)
        rows = []
        for seq, now in sorted((r.seq, r.now) for b in batches for r in b.itertuples(index=False)):
            (tokens, last), ok, _ = take_token((tokens, last), now, rate, capacity)
            rows.append((key[0], seq, ok))
        state.update((tokens, last))
        yield pd.DataFrame(rows, columns=["run_id", "seq", "granted"])

    return events.groupBy("run_id").applyInPandasWithState(
        step, "run_id long, seq long, granted boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout
    )


def commit_stream(plan: DataFrame, target: str, checkpoint: str):
    """Commits each micro-batch of (photo_key, name) rows that the target lacks under the batch's number; a repeated batch adds nothing."""

    def commit(batch: DataFrame, number: int) -> None:
        append(batch, target, batch=f"stream-{number}")

    return plan.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there now and read what it wrote."""
    out, at = shared_path(spark, name), shared_path(spark, f"{name}-at")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def event_stream(spark: SparkSession, sf_dir: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The driver's events as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def stream_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when(F.col("event_type").isin("signup", "click", "error"), "exhausted").otherwise("ok")
    out = shared_path(spark, "breaker")
    events = event_stream(spark, sf_dir, lambda e: e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), bad.alias("outcome")))
    breaker_stream(events, out, f"{out}/at").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("run_id", "seq", "consecutive", "open")


def stream_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_stream(spark, sf_dir, lambda e: e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), (F.col("event_id") / 100).alias("now")))
    return drain(spark, token_bucket_stream(events, 0.5, 2.0), "bucket")


def commit_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' names as labels of their nation's photo, committed twice; the second time adds nothing."""
    target = shared_path(spark, "committed")
    plan = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("photo_key"), F.col("s_name").alias("name"))
    append(plan, target)
    append(plan.union(plan), target)
    return committed(spark, target).groupBy("photo_key").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (stream_breaker, stream_token_bucket, commit_batches)}
SQL = {
    "stream_breaker": """WITH b AS (SELECT user_id, event_id, event_type IN ('signup', 'click', 'error') AS bad FROM events),
        i AS (SELECT *, sum((NOT bad)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS isl FROM b),
        c AS (SELECT *, (sum(bad::INT) OVER (PARTITION BY user_id, isl ORDER BY event_id))::BIGINT AS n FROM i)
        SELECT user_id AS run_id, event_id AS seq, n AS consecutive, bool_or(n >= 5) OVER (PARTITION BY user_id ORDER BY event_id) AS open FROM c""",
    "stream_token_bucket": """WITH RECURSIVE e AS (SELECT user_id AS run_id, event_id AS seq, event_id / 100.0::DOUBLE AS now,
              row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
        f AS (SELECT run_id, seq, n, now, 2.0::DOUBLE AS t FROM e WHERE n = 1
              UNION ALL
              SELECT e.run_id, e.seq, e.n, e.now, least(2.0::DOUBLE, (CASE WHEN f.t >= 1 THEN f.t - 1 ELSE f.t END) + greatest(0.0::DOUBLE, e.now - f.now) * 0.5::DOUBLE)
              FROM f JOIN e ON e.run_id = f.run_id AND e.n = f.n + 1)
        SELECT run_id, seq, t >= 1 AS granted FROM f""",
    "commit_batches": "SELECT s_nationkey AS photo_key, count(*) AS n FROM (SELECT DISTINCT s_nationkey, s_name FROM supplier) GROUP BY s_nationkey",
}
