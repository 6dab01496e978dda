"""A run as a whole: its parts, its records and its log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import redact

LEVELS = ("info", "warn", "error", "trace")


def dispatch(off: bool, serial: Callable[[], DataFrame], features: Callable[[], DataFrame]) -> DataFrame:
    """The plan of a run: serial where all features are off (see ``capture.features_off``), else with features."""
    return serial() if off else features()


def cluster_counts(clusters: DataFrame) -> DataFrame:
    """One row: anchors and followers of (key, anchor_key); a key is a follower where its anchor is another key."""
    own = F.col("key") == F.col("anchor_key")
    return clusters.agg(F.count(F.when(own, 1)).alias("anchors"), F.count(F.when(~own, 1)).alias("followers"))


def deep_results(items: DataFrame, results: DataFrame, statuses: DataFrame) -> DataFrame:
    """(key, response, error) of each item: its result, or why it has none: cancelled, deferred or not-processed.

    ``items`` (key), ``results`` (key, response, error), ``statuses`` (key, status); the last two hold a key at most once.
    """
    status = F.when(F.col("status").isin("cancelled", "deferred"), F.col("status")).otherwise("not-processed")
    joined = items.select("key").join(results.select("key", "response", "error", F.lit(True).alias("_has")), "key", "left").join(statuses.select("key", "status"), "key", "left")
    return joined.select("key", "response", F.when(F.col("_has"), F.col("error")).otherwise(status).alias("error"))


def gallery_photos(results: DataFrame, previews: DataFrame, report: bool) -> DataFrame:
    """Results (photo, n_detections) with detections, and the ``preview`` each photo itself had; without one its boxes stand alone.

    An anchor's preview is not its followers'. Without a report no preview is read.
    """
    shown = results.filter("n_detections > 0")
    if not report:
        return shown.withColumn("preview", F.lit(None).cast("binary"))
    return shown.join(previews.select("photo", "preview"), "photo", "left")


def dry_run_totals(entries: DataFrame) -> DataFrame:
    """One row: photos and names that entries (photo_key, add_keywords) would write."""
    return entries.agg(F.count("*").alias("photos"), F.coalesce(F.sum(F.size("add_keywords")), F.lit(0)).cast("long").alias("total_adds"))


def log_line(level: Column, message: Column, fields: Column | None = None, at: Column | None = None) -> Column:
    """``time [LEVEL] message | fields``, with secrets masked in the whole line.

    An unknown or missing level is info, a missing message ``nil``; ``fields`` is a JSON text, left out where null.
    """
    known = F.upper(F.when(level.isin(*LEVELS), level).otherwise("info"))
    time = F.coalesce(F.date_format(at, "yyyy-MM-dd HH:mm:ss "), F.lit("")) if at is not None else F.lit("")
    tail = F.coalesce(F.concat(F.lit(" | "), fields), F.lit("")) if fields is not None else F.lit("")
    return redact(F.concat(time, F.lit("["), known, F.lit("] "), F.coalesce(message, F.lit("nil")), tail))


def write_log(lines: DataFrame, path: str) -> None:
    """Appends lines (line) to a folder of text files."""
    lines.select("line").write.mode("append").text(path)
