"""Order-sensitive work over keys of any size: ranges of (key, order) that are worked on alone, and borders that are stitched.

A key with many rows lies in several ranges, so no task sees all of it. What a range has to know of the ones
before it is one row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.shared import stash

#: Rows of one key up to which a task takes it whole.
WHOLE = 1_000_000


def crowded(rows: DataFrame, by: list[str]) -> bool:
    """Whether some key has more rows than a task should take."""
    return not rows.groupBy(*by).count().filter(F.col("count") > WHOLE).isEmpty()


def in_ranges(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with the number of their range, ``_part``; written, as borders come from samples and may move when they are drawn again."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stash(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), name)


def place(*columns: str) -> Column:
    """Columns as one value that sorts nulls last and equals itself."""
    return F.struct(*(x for i, c in enumerate(columns) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}"))))


def over_ranges() -> WindowSpec:
    """A window over one row for each range."""
    return Window.orderBy("_part")


SO_FAR = (Window.unboundedPreceding, 0)
