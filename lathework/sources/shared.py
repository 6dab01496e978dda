"""Tables in the shared folder: written once, read again by all executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder, as in tests.
LOCAL_DEFAULT = "/tmp/checkpoints/lathework"


def shared_path(spark: SparkSession, name: str) -> str:
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or LOCAL_DEFAULT
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
