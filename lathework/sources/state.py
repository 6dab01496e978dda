"""The state of a run, saved whole: each save is a folder of its own, and a pointer that one rename moves tells which counts.

A reader that has loaded the state before a save goes on with the folder it was given; that folder stays until
the save after the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.propagate import project_state
from . import fs

POINTER = "current"
SCHEMA = "photo_id string, outcome string"


def save(rows: DataFrame, path: str) -> int:
    """Saves the rows (photo_id, outcome) that have an id and a known outcome; returns how many."""
    spark, version = rows.sparkSession, f"state-{uuid.uuid4().hex}"
    before = fs.read(spark, f"{path}/{POINTER}")
    kept = project_state(rows).select(F.col("photo_id").cast("string"), F.col("outcome").cast("string"))
    kept.write.option("compression", "zstd").parquet(f"{path}/{version}")
    n = spark.read.schema(SCHEMA).parquet(f"{path}/{version}").count()
    fs.publish(spark, f"{path}/{POINTER}", version, replace=True)
    for name in fs.names(spark, path):
        if name.startswith("state-") and name not in (version, before):
            fs.remove(spark, f"{path}/{name}")
    return n


def load(spark: SparkSession, path: str) -> DataFrame:
    """The state that counts now, checked again; empty where none was saved or it was cleared."""
    version = fs.read(spark, f"{path}/{POINTER}")
    if version is None:
        return spark.createDataFrame([], SCHEMA)
    return project_state(spark.read.schema(SCHEMA).parquet(f"{path}/{version}"))


def clear(spark: SparkSession, path: str) -> bool:
    """Forgets the state; false if there was none. The folder it named stays for its readers until the next saves."""
    return fs.remove(spark, f"{path}/{POINTER}")
