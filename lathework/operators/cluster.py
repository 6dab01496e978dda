"""Bursts of frames: gap sessions with an OR-ed key arm and a likeness gate, and perceptual hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import SO_FAR, crowded, in_ranges, over_ranges, place


def average_hash(grid: Column) -> Column:
    """64 bits, row by row: a cell above the mean is 1. Null unless the grid has 64 cells, none null."""
    mean = F.aggregate(grid, F.lit(0.0), lambda a, x: a + x) / 64
    good = (F.size(grid) == 64) & ~F.exists(grid, lambda x: x.isNull())
    return F.when(good, F.transform(F.array(mean), lambda m: F.transform(grid, lambda x: (x > m).cast("int")))[0])


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two hashes differ; 64 where one is missing or has not 64 bits."""
    whole = (F.size(a) == 64) & (F.size(b) == 64)
    bits = F.aggregate(F.zip_with(a, b, lambda x, y: (~x.eqNullSafe(y)).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(whole, bits).otherwise(64)


def similar(a: Column, b: Column, threshold: int) -> Column:
    """Whether two hashes differ in at most ``threshold`` bits; false where one is missing."""
    return F.coalesce(hamming(a, b) <= threshold, F.lit(False))


def bursts(
    frames: DataFrame,
    max_gap_us: int = 0,
    use_stacks: bool = True,
    by: list[str] | None = None,
    hash_col: str | None = None,
    threshold: int = 10,
    split: bool | None = None,
) -> DataFrame:
    """Adds ``anchor_key`` and ``is_anchor`` to frames (key, time, stack, sel_index).

    A frame joins the one before it if both have times less than ``max_gap_us`` apart, or equal stacks,
    and, with ``hash_col``, if their hashes are near. Frames go by time, those without last, then by
    selection. ``by`` names columns that part the frames; frames without them, and keys too large for a task (or
    all, with ``split``), are ordered by range partitions whose borders are stitched, so no task sees all of them.
    """
    if by is None or (crowded(frames, by) if split is None else split):
        return _stitched(frames, max_gap_us, use_stacks, hash_col, threshold, by or [])
    order = [F.asc_nulls_last("time"), F.asc_nulls_last("sel_index"), F.asc("key")]
    w = Window.partitionBy(*by).orderBy(*order)
    marked = frames.withColumn("_new", _opens(lambda c: F.lag(c).over(w), max_gap_us, use_stacks, hash_col, threshold))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = marked.withColumn("anchor_key", F.last(F.when(F.col("_new"), F.col("key")), ignorenulls=True).over(run))
    return out.withColumn("is_anchor", F.col("_new")).drop("_new")


def _opens(before, max_gap_us: int, use_stacks: bool, hash_col: str | None, threshold: int) -> Column:
    gap = F.timestamp_diff("MICROSECOND", before("time"), F.col("time"))
    near = F.coalesce((gap >= 0) & (gap < max_gap_us), F.lit(False))
    if use_stacks:
        near = near | F.coalesce(before("stack") == F.col("stack"), F.lit(False))
    if hash_col:
        near = near & similar(before(hash_col), F.col(hash_col), threshold)
    return ~near


def _stitched(frames: DataFrame, max_gap_us: int, use_stacks: bool, hash_col: str | None, threshold: int, by: list[str]) -> DataFrame:
    """Ranges of key, time and selection, each clustered alone; then the first run of each range is stitched on.

    Whether a frame opens a cluster depends on the frame of its key before it alone, and the anchor is the last opener, so
    one border row per range is all that has to be known outside it.
    """
    order = [F.asc_nulls_last("time"), F.asc_nulls_last("sel_index"), F.asc("key")]
    ranged = in_ranges(frames, [*(F.asc_nulls_last(c) for c in by), *order], "frame-ranges")
    w = Window.partitionBy("_part", *by).orderBy(*order)
    own = dict.fromkeys((*by, "time", "stack", *([hash_col] if hash_col else [])))
    at = place(*by, "time", "sel_index", "key")
    edge = ranged.groupBy("_part").agg(F.max_by(F.struct(*own), at).alias("_edge"))
    edge = edge.withColumn("_edge", F.lag("_edge").over(over_ranges()))
    joined = ranged.join(F.broadcast(edge), "_part")
    goes_on = F.row_number().over(w) == 1
    for c in by:
        goes_on = goes_on & F.col(f"_edge.{c}").eqNullSafe(F.col(c))
    before = lambda c: F.when(goes_on, F.col(f"_edge.{c}")).otherwise(F.lag(c).over(w))
    marked = joined.withColumn("_new", _opens(before, max_gap_us, use_stacks, hash_col, threshold))
    local = marked.withColumn("_anchor", F.last(F.when(F.col("_new"), F.col("key")), ignorenulls=True).over(w.rowsBetween(*SO_FAR)))
    last = local.groupBy("_part").agg(F.max_by("_anchor", at).alias("_last"))
    # A key's first frame opens a cluster, so a range without an opener of its last key goes on with the last one found before it.
    carry = last.withColumn("_carry", F.last("_last", ignorenulls=True).over(over_ranges().rowsBetween(Window.unboundedPreceding, -1)))
    out = local.join(F.broadcast(carry.select("_part", "_carry")), "_part")
    return out.withColumn("anchor_key", F.coalesce("_anchor", "_carry")).withColumn("is_anchor", F.col("_new")).select(*frames.columns, "anchor_key", "is_anchor")
