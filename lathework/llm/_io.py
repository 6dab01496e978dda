"""Shared-folder tables between the phases of an operator, and small column helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in tests.
LOCAL_DEFAULT = "/tmp/checkpoints/lathework"

#: The white space that parts words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors see."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or LOCAL_DEFAULT


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Cuts the lineage, so that a lost executor costs a reread and not the phases before.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store(path: str):
    """A file system and the path in it, for any address that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, h, text): the id with null last in the order, the text's hash, and the text with null as empty.

    Rows of one id but different texts stay apart by ``h``; equal rows are one document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("d"), F.xxhash64(text).alias("h"), text.alias("text")
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for a row, also where the body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


#: Rows of a key from which on ``spread`` deals them to ``SALTS`` tasks; of so many keys at most, the most frequent first.
CROWD, SALTS, MOST_CROWDED = 1000, 64, 10_000


def spread(rows: DataFrame, found: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``found`` (a row for each key) by ``key``; the rows of crowded keys are dealt to many tasks, by their place, as they may all be equal.

    ``rows`` should be a written table, whose rows keep their places when they are read again.
    """
    count = rows.filter(F.col(key).isNotNull()).groupBy(key).count().filter(F.col("count") > CROWD)
    crowded = F.broadcast(count.orderBy(F.desc("count"), key).limit(MOST_CROWDED).select(key, F.lit(SALTS).alias("_salts")))
    salt = F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.col("_place"), F.col("_salts")).cast("int"))
    placed = rows.withColumn("_place", F.monotonically_increasing_id())
    left = placed.join(crowded, key, "left").withColumn("_salt", salt).drop("_salts", "_place")
    right = found.join(crowded, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")
