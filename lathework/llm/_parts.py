"""Texts written once in parts, and tasks that stream one part beside the rows about it.

A part is a file of at most ``PART_ROWS`` rows; a writing task may make several. Rows carry their place ``r``
(task and row number), so later phases deal out only short rows about texts, by part, and never the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._io import shared_path, stash, store

#: Stands for a null id in the order of ids: the last one.
NULL_ID = 2**63 - 1
#: Rows of a part that are read at once, and of a part, as a power of two.
ROWS = 256
PART_BITS = 15


class Reader:
    """Streams chosen columns of a part's file, in the order of its rows."""

    def __init__(self, file: str):
        self.file = file

    def batches(self, columns: list[str], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet

        disk, path = store(self.file)
        with disk.open_input_file(path) as f:
            for batch in parquet.ParquetFile(f).iter_batches(batch_size=rows, columns=columns):
                if batch.num_rows:
                    yield batch.select(columns)


@dataclass
class Parts:
    """Written texts: ``files`` is a table (task, chunk, p, file) of ``n`` parts; ``single``: no task wrote more than one, and p is the task."""

    files: DataFrame
    n: int
    single: bool = True
    bits: int = PART_BITS

    def _placed(self, about: DataFrame) -> DataFrame:
        """The rows with their part ``_p``."""
        task = F.shiftright("r", 33).cast("int")
        if self.single:
            return about.withColumn("_p", task)
        first = F.broadcast(self.files.filter("chunk = 0").select(F.col("task").alias("_task"), F.col("p").alias("_first")))  # a short row for each task
        chunk = F.shiftright(F.col("r").bitwiseAND((1 << 33) - 1), self.bits).cast("int")
        return about.withColumn("_task", task).join(first, "_task").withColumn("_p", F.col("_first") + chunk).drop("_task", "_first")

    def beside(self, run: Callable[[Reader, pa.Table], Iterator[pa.RecordBatch]], schema: str | StructType, about: DataFrame | None = None) -> DataFrame:
        """What ``run`` yields for each part from its reader and the rows of ``about`` (place ``r`` and more) on it."""
        rows = self.files.select(F.col("p").alias("_p"), F.col("file").alias("_file"))
        if about is not None:
            rows = rows.unionByName(self._placed(about), allowMissingColumns=True)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = list(batches)  # the rows about one part
            if not got:
                return
            table = pa.Table.from_batches(got)
            named = pc.is_valid(table["_file"])
            (file,) = table.filter(named)["_file"].to_pylist()  # rows about a part without a file, or with two, are an error
            yield from run(Reader(file), table.filter(pc.invert(named)))

        return rows.repartitionById(self.n, F.col("_p")).mapInArrow(task, schema)


def write_parts(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = (), bits: int | None = None) -> Parts:
    """Write (r, doc_id, d, h, sha, text, void, carry): ``d`` is the id with null last, ``h`` and ``sha`` are hashes of the text, a null text is empty and ``void``.

    A file takes at most 2^``bits`` rows (``PART_BITS``), whatever the session says about files.
    """
    bits = PART_BITS if bits is None else bits
    spark, path = docs.sparkSession, shared_path(docs.sparkSession, "texts")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc_id = F.col(id_col).cast("long")
    rows = docs.select(
        doc_id.alias("doc_id"),
        F.coalesce(doc_id, F.lit(NULL_ID)).alias("d"),
        F.xxhash64(text).alias("h"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
        text.cast("binary").alias("text"),
        F.col(text_col).isNull().alias("void"),
        F.struct(*(F.col(c) for c in carry) if carry else (F.lit(0).alias("none"),)).alias("carry"),
    )
    rows.withColumn("r", F.monotonically_increasing_id()).write.option("compression", "zstd").option("maxRecordsPerFile", 1 << bits).parquet(path)
    places = spark.read.schema("r long").parquet(path).groupBy(F.col("_metadata.file_path").alias("file"))
    found = places.agg(F.min("r").alias("a"), F.max("r").alias("b"), F.count("*").alias("rows"))
    row = F.col("a").bitwiseAND((1 << 33) - 1)
    listed = stash(found.select(F.shiftright("a", 33).cast("int").alias("task"), F.shiftright(row, bits).cast("int").alias("chunk"), "file", (row % (1 << bits)).alias("from"), (F.col("b") - F.col("a") + 1 - F.col("rows")).alias("lost")), "listed")
    top = listed.agg(F.max("task"), F.max("chunk"), F.max("from"), F.max("lost"), F.count("*"), F.count_distinct("task", "chunk")).first()
    if top[2] or top[3] or top[4] != top[5]:
        raise RuntimeError("the files of the written texts do not hold their rows in order")
    if not top[1]:
        return Parts(listed.withColumn("p", F.col("task")), (top[0] or 0) + 1, True, bits)
    # The files of a task follow each other; a row for each task is numbered.
    tasks = listed.groupBy("task").agg(F.count("*").alias("n"))
    tasks = tasks.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).cast("int").alias("first"))
    files = stash(listed.join(tasks, "task").select("task", "chunk", "file", (F.col("first") + F.col("chunk")).alias("p")), "parts")
    return Parts(files, top[4], False, bits)
