"""The add-only write plan: what each photo gains, in one pass of joins, windows and sums.

Inputs are ``labels``, one row for each detection (rec_idx, photo_key, det_idx, rendered, uncertain,
rank, confidence), ``records`` (rec_idx, photo_key, has_response) and ``existing`` (rec_idx, name). Labels
that bring their ``name`` and ``norm``, and names that bring their ``norm``, keep them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_name, writable_name
from ..operators.decide import single_per_record
from ..operators.ranges import in_ranges, over_ranges
from ..sources import batches


def _normed(existing: DataFrame) -> DataFrame:
    """(rec_idx, norm) of the names on the records."""
    norm = F.col("norm") if "norm" in existing.columns else norm_name(F.col("name"))
    return existing.select("rec_idx", norm.alias("norm")).distinct()


def candidates(labels: DataFrame, single: bool = False) -> DataFrame:
    """Stored names of the rendered labels, each exact name once per record, first seen first."""
    named = labels.filter(F.col("rendered").isNotNull())
    if single:
        named = single_per_record(named, ["rec_idx"])
    if not {"name", "norm"} <= set(named.columns):
        named = named.withColumn("name", writable_name(F.col("rendered"))).withColumn("norm", norm_name(F.col("name")))
    first = Window.partitionBy("rec_idx", "name").orderBy("det_idx")
    return named.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def additions(found: DataFrame, existing: DataFrame) -> DataFrame:
    """(photo_key, name, norm, rec_idx, det_idx) to add: not on the record yet by normal form, once per photo."""
    have = _normed(existing)
    fresh = found.join(have, ["rec_idx", "norm"], "left_anti")
    first = Window.partitionBy("photo_key", "norm").orderBy("rec_idx", "det_idx")
    return fresh.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("photo_key", "name", "norm", "rec_idx", "det_idx")


def entries(added: DataFrame) -> DataFrame:
    """(photo_key, first_rec, add_keywords): names in order of first sight."""
    placed = F.array_sort(F.collect_list(F.struct("rec_idx", "det_idx", "name")))
    return added.groupBy("photo_key").agg(placed.alias("p")).select(
        "photo_key", F.col("p")[0]["rec_idx"].alias("first_rec"), F.transform("p", lambda x: x["name"]).alias("add_keywords")
    )


def photo_summary(records: DataFrame, labels: DataFrame, found: DataFrame, added: DataFrame) -> DataFrame:
    """Per photo: found, identified, uncertain, errors, skipped and add_count."""
    counted = labels.groupBy("rec_idx").agg(F.count("*").alias("dets"), F.count("rendered").alias("rendered"))
    base = records.join(counted, "rec_idx", "left").groupBy("photo_key").agg(
        F.count(F.when(F.col("dets") > 0, 1)).alias("found"),
        F.count(F.when(~F.col("has_response"), 1)).alias("errors"),
        F.count(F.when(F.col("has_response") & (F.coalesce("rendered", F.lit(0)) == 0), 1)).alias("skipped"),
    )
    first = Window.partitionBy("photo_key", "norm").orderBy("rec_idx", "det_idx")
    kinds = found.withColumn("_n", F.row_number().over(first)).filter("_n = 1").groupBy("photo_key").agg(
        F.count(F.when(~F.col("uncertain"), 1)).alias("identified"), F.count(F.when(F.col("uncertain"), 1)).alias("uncertain")
    )
    adds = added.groupBy("photo_key").agg(F.count("*").alias("add_count"))
    out = base.join(kinds, "photo_key", "left").join(adds, "photo_key", "left")
    return out.na.fill(0, ["identified", "uncertain", "add_count"])


def run_summary(records: DataFrame, per_photo: DataFrame) -> DataFrame:
    """One row for the run; ``photos`` counts records."""
    names = ("found", "identified", "uncertain", "errors", "skipped")
    both = per_photo.select(*names, F.lit(0).alias("photos")).unionByName(records.select(*(F.lit(0).alias(c) for c in names), F.lit(1).alias("photos")))
    return both.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*names, "photos")))


def chunk_ids(records: DataFrame, size: int | None, order: str = "rec_idx") -> DataFrame:
    """Adds ``chunk_id``: consecutive slices of ``size`` records; without a size of at least 1 all is one chunk.

    Row numbers come from counts per range of the order, so no task numbers all rows.
    """
    if not size or size < 1:
        return records.withColumn("chunk_id", F.lit(0).cast("long"))
    ranged = in_ranges(records, [F.asc(order)], "chunk-ranges")
    before = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(over_ranges().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    out = numbered.join(F.broadcast(before.select("_part", "_before")), "_part")
    return out.withColumn("chunk_id", F.floor((F.col("_before") + F.col("_row") - 1) / size)).drop("_part", "_row", "_before")


def batched_additions(found: DataFrame, existing: DataFrame, chunks: DataFrame, committed: DataFrame) -> DataFrame:
    """(chunk_id, photo_key, name): what each chunk offers when it is planned with what was committed before it.

    ``committed`` (chunk_id, ok) tells which chunks were executed. A name is offered until a chunk that
    holds it commits; a chunk that does not commit leaves its names to be offered again.
    """
    have = _normed(existing)
    fresh = found.join(have, ["rec_idx", "norm"], "left_anti").join(chunks.select("rec_idx", "chunk_id"), "rec_idx")
    first = Window.partitionBy("chunk_id", "photo_key", "norm").orderBy("rec_idx", "det_idx")
    offered = fresh.withColumn("_n", F.row_number().over(first)).filter("_n = 1").join(committed, "chunk_id")
    earlier = Window.partitionBy("photo_key", "norm").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max(F.col("ok").cast("int")).over(earlier), F.lit(0))
    return offered.withColumn("_done", done).filter("_done = 0").select("chunk_id", "photo_key", "name")


def append(plan: DataFrame, target: str, dry_run: bool = False, batch: str | None = None) -> str:
    """Add the plan's (photo_key, name) rows that the table at ``target`` lacks, as one committed batch; returns noop, executed or error.

    Running it twice adds nothing the second time, nor does a batch id that was committed before. Every name is taken but null and blank ones.
    """
    return batches.apply(plan, target, batch, refuses=lambda name: F.trim(name) == "", dry_run=dry_run).status


def run_status(statuses: list[str]) -> str:
    """Of the chunks' statuses: error if any is, else the last; nothing is a noop."""
    return "error" if "error" in statuses else statuses[-1] if statuses else "noop"
