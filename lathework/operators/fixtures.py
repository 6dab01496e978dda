"""Answers from a table of fixtures instead of a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contract import finalize, response_error

DEFAULT = "default"


def bad_fixtures(fixtures: DataFrame) -> DataFrame:
    """(name, error) of the fixtures (name, response) that are no valid responses."""
    judged = fixtures.select("name", response_error(F.col("response")).alias("e")).filter("e IS NOT NULL")
    return judged.select("name", F.concat(F.lit("bad-fixture:"), "name", F.lit(":"), "e").alias("error"))


def identify(items: DataFrame, fixtures: DataFrame) -> DataFrame:
    """``items`` (name, ...) with ``response`` and ``error``: the fixture of the name, else the default one; one that is not there or not valid is an error.

    ``fixtures`` has each name once. A null name is the default one.
    """
    judged = fixtures.select("name", "response", response_error(F.col("response")).alias("_e"))
    spare = judged.filter(F.col("name") == DEFAULT).select(F.struct("response", "_e")).scalar()
    named = items.withColumn("_asked", F.coalesce("name", F.lit(DEFAULT)))
    own = judged.select(F.col("name").alias("_asked"), F.struct("response", "_e").alias("_own"))
    got = named.join(own, "_asked", "left").withColumn("_f", F.coalesce("_own", spare))
    error = F.when(F.col("_f").isNull(), F.concat(F.lit("no-fixture:"), "_asked")).when(
        F.col("_f._e").isNotNull(), F.concat(F.lit("fixture-failed-validation:"), "_asked", F.lit(":"), "_f._e")
    )
    return got.select(*items.columns, F.when(error.isNull(), finalize(F.col("_f.response"))).alias("response"), error.alias("error"))
