"""From anchors to followers, and from results to outcomes that a later run can resume from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("written", "existing", "no-bird", "no-detection")
RETRYABLE = ("deferred", "timed-out", "errored", "cancelled")


def effective(status: Column) -> Column:
    """identified, cancelled and deferred stay; all else, null too, is deferred."""
    return F.when(status.isin("identified", "cancelled", "deferred"), status).otherwise("deferred")


def results(selection: DataFrame, clusters: DataFrame, anchors: DataFrame) -> DataFrame:
    """(photo, status, response, inherited_from): every selected key once, followers with their anchor's result.

    ``selection`` (photo, sel_index), ``clusters`` (key, anchor_key), ``anchors`` (anchor_key, status, response).
    An identified anchor without a response is deferred.
    """
    once = selection.groupBy("photo").agg(F.min("sel_index").alias("sel_index"))
    placed = once.join(clusters, F.col("photo") == F.col("key"), "left").withColumn("_anchor", F.coalesce("anchor_key", "photo")).drop("key", "anchor_key")
    joined = placed.join(anchors, F.col("_anchor") == F.col("anchor_key"), "left")
    status = effective(F.when((F.col("status") == "identified") & F.col("response").isNull(), "deferred").otherwise(F.col("status")))
    return joined.select(
        "photo",
        "sel_index",
        status.alias("status"),
        F.when(status == "identified", F.col("response")).alias("response"),
        F.when(F.col("_anchor") != F.col("photo"), F.col("_anchor")).alias("inherited_from"),
    )


def adapter_counts(found: DataFrame) -> DataFrame:
    """One row: identified, deferred, cancelled and errored (always 0) results."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return found.agg(count("identified"), count("deferred"), count("cancelled"), F.lit(0).cast("long").alias("errored"))


def adapter_records(found: DataFrame, existing: DataFrame) -> DataFrame:
    """(photo, response, existing_names) of identified results, with the names that ``existing`` (photo, name) has for the photo itself.

    An anchor's names are not its followers'. Names come once, in order; a photo without any has an empty list.
    """
    names = existing.groupBy("photo").agg(F.array_sort(F.collect_set("name")).alias("existing_names"))
    kept = found.filter("status = 'identified'").select("photo", "response").join(names, "photo", "left")
    return kept.withColumn("existing_names", F.coalesce("existing_names", F.array().cast("array<string>")))


def outcome(status: Column, present: Column, n_detections: Column, n_wrote: Column) -> Column:
    """written, no-bird, no-detection or existing for identified photos; retryable statuses stay; others are null."""
    return (
        F.when((status == "identified") & (n_wrote > 0), "written")
        .when((status == "identified") & ~present, "no-bird")
        .when((status == "identified") & (n_detections == 0), "no-detection")
        .when(status == "identified", "existing")
        .when(status.isin(*RETRYABLE), status)
    )


def project_state(rows: DataFrame) -> DataFrame:
    """(photo_id, outcome) of rows with an id and a known outcome."""
    return rows.filter((F.col("photo_id") != "") & F.col("outcome").isin(*TERMINAL, *RETRYABLE)).select("photo_id", "outcome")


def incomplete(prior: DataFrame, order: str = "idx") -> DataFrame:
    """(photo_id, idx) to try again: ids with a record whose outcome is not terminal, once, in order."""
    open_ = prior.filter((F.col("photo_id") != "") & ~F.coalesce(F.col("outcome").isin(*TERMINAL), F.lit(False)))
    return open_.groupBy("photo_id").agg(F.min(order).alias(order))
