"""Capture times, stacks, run folders and switches as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def raw_date(original: Column, digitized: Column, plain: Column) -> Column:
    """The first date that is there: taken, digitised, any."""
    return F.coalesce(original, digitized, plain)


def capture_time(original: Column, digitized: Column, plain: Column) -> Column:
    """That date as a number; null where it is not a number, also if a later one would be."""
    d = raw_date(original, digitized, plain)
    return F.when(~F.isnan(d), d)


def stack_id(top: Column, members: Column) -> Column:
    """``top:`` and the top of the stack if it is named, else ``members:`` and the first member, else null."""
    return F.when(top != "", F.concat(F.lit("top:"), top)).otherwise(F.concat(F.lit("members:"), F.get(members, F.lit(0)).cast("string")))


def safe_id(run: Column) -> Column:
    """A run id of ASCII letters, digits, - and _ alone; null for any other."""
    return F.when(run.rlike(r"\A[A-Za-z0-9_-]+\z"), run)


def run_dir(run: Column, kind: str = "run") -> Column:
    """The folder of a run (or ``report``); null for an unsafe id."""
    return F.concat(F.lit(f"{kind}-"), safe_id(run))


def temp_names(index: Column) -> Column:
    """The file names of an item, numbered with at least five digits; what is no number counts as 0."""
    n = F.coalesce(F.floor(index), F.lit(0)).cast("long")
    digits = F.when(n.between(0, 99_999), F.lpad(n.cast("string"), 5, "0")).otherwise(n.cast("string"))
    return F.struct(*(F.concat(F.lit(f"{k}-"), digits, F.lit(end)).alias(k) for k, end in (("export", ".jpg"), ("crop", ".jpg"), ("err", ""))))


def slice_of(position: Column, total: Column, slices: int = 4) -> Column:
    """The slice of an item (both from 0): equal slices, of at least one item, and the last takes the rest."""
    per = F.greatest(F.lit(1), F.floor(total / slices))
    return F.least(F.lit(slices - 1), F.floor(position / per)).cast("int")


def features_off(concurrency: Column, cluster: Column, report: Column) -> Column:
    """Whether a run is serial and uses neither clustering nor reports; what is missing counts as off."""
    return (F.coalesce(concurrency, F.lit(1)) == 1) & ~F.coalesce(cluster, F.lit(False)) & ~F.coalesce(report, F.lit(False))
