"""An add-only table of names in committed batches.

Rows of a batch are written to a folder of their own attempt; they count only once a manifest, put in place by one
rename into ``_log``, names that attempt. A batch that dies half-way, or whose manifest another writer put first, leaves
no rows that anyone reads. A batch id that has a manifest adds nothing again.

Names that the target can't hold are kept out one by one: the others of the batch are added and the batch's
status is ``error``; with ``whole`` nothing of such a batch is added.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from . import fs

#: Names that a manifest tells of those that failed.
SHOWN = 15
LOG = "batch string, attempt string, status string, planned long, added long, errors long, failed string, error string"


def refused(name: Column) -> Column:
    """Whether a target of keywords refuses a name: blank, with a comma, or with a question mark at its end."""
    return F.coalesce((F.trim(name) == "") | name.contains(",") | name.rlike(r"\?\s*$"), F.lit(True))


def log(spark: SparkSession, target: str) -> DataFrame:
    """A row for each batch that has a manifest; ``attempt`` is null where nothing was added."""
    if not fs.exists(spark, f"{target}/_log"):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).json(f"{target}/_log")


def committed(spark: SparkSession, target: str, key_type: str = "long") -> DataFrame:
    """(photo_key, name, batch) of all committed batches; a name that two writers added at once counts for the first by id."""
    if not any(n.startswith("batch=") for n in fs.names(spark, target)):
        return spark.createDataFrame([], f"photo_key {key_type}, name string, batch string")
    rows = spark.read.schema(f"photo_key {key_type}, name string, batch string, attempt string").parquet(target)
    good = log(spark, target).filter("attempt IS NOT NULL").select("batch", "attempt")
    return rows.join(good, ["batch", "attempt"]).groupBy("photo_key", "name").agg(F.min("batch").alias("batch"))


def _done(spark: SparkSession, target: str, batch: str) -> Row | None:
    text = fs.read(spark, f"{target}/_log/{batch}.json")
    return Row(**json.loads(text)) if text else None


def apply(plan: DataFrame, target: str, batch: str | None = None, refuses=refused, whole: bool = False, dry_run: bool = False) -> Row:
    """Adds the plan's (photo_key, name) rows that the target lacks, as one batch; returns its manifest.

    The status is executed, error, or noop where nothing was to be added or ``dry_run`` is set. A failure of the write itself
    is an error too, without rows and without a manifest, so the batch can be tried again. Null names fail.
    """
    spark, batch = plan.sparkSession, batch or uuid.uuid4().hex
    if not all(c.isalnum() or c in "-_" for c in batch) or batch.startswith("_"):
        raise ValueError(f"not a batch id: {batch!r}")
    found = _done(spark, target, batch)
    if found is not None:
        return found
    attempt = uuid.uuid4().hex
    folder = f"{target}/batch={batch}/attempt={attempt}"
    kind = plan.schema["photo_key"].dataType.simpleString()
    rows = plan.select("photo_key", "name").distinct().join(committed(spark, target, kind), ["photo_key", "name"], "left_anti")
    marked = rows.withColumn("_bad", F.coalesce(refuses(F.col("name")), F.lit(True)))
    done = {"batch": batch, "attempt": attempt, "status": "noop", "planned": 0, "added": 0, "errors": 0, "failed": None, "error": None}
    nothing = Row(**done | {"attempt": None})
    if dry_run:
        return nothing
    seen = Observation()
    watched = marked.observe(seen, F.count("*").alias("planned"), F.count_if("_bad").alias("errors"))
    try:
        watched.filter("NOT _bad").select("photo_key", "name").write.option("compression", "zstd").parquet(folder)
    except (PySparkException, Py4JJavaError) as e:  # the run goes on; the batch has no manifest, so its rows do not count
        fs.remove(spark, folder)
        return Row(**done | {"attempt": None, "status": "error", "error": type(e).__name__})
    counts = seen.get
    done |= {"planned": counts["planned"], "errors": counts["errors"], "added": counts["planned"] - counts["errors"]}
    if not done["planned"]:
        fs.remove(spark, folder)
        return nothing
    done["status"] = "executed"
    if done["errors"]:
        first = marked.filter("_bad").orderBy("photo_key", "name").limit(SHOWN).collect()
        done |= {"status": "error", "failed": " | ".join(json.dumps(r["name"], ensure_ascii=False) for r in first)}
    if whole and done["errors"] or not done["added"]:
        fs.remove(spark, folder)
        done |= {"attempt": None, "added": 0}
    if not fs.publish(spark, f"{target}/_log/{batch}.json", json.dumps(done)):
        fs.remove(spark, folder)
        return _done(spark, target, batch)
    return Row(**done)
