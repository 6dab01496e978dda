"""One file a row, a listing of folders with their ages, and images from a folder.

``row_files`` is a sink: each task writes the files of its rows into a waiting folder and moves them in place
when it has written all, and the job adds ``_SUCCESS``. What a task or job leaves half done is never under a file's
name. A name may have folders before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.values import finite


def store(path: str):
    """A file system and the path in it, for any address that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.waiting = path.rstrip("/"), f"_waiting-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        disk, root = store(self.path)
        own, put = f"{root}/{self.waiting}/{uuid.uuid4().hex}", []
        for batch in iterator:
            if batch.num_rows and not put:
                disk.create_dir(own, recursive=True)
            for name, data in zip(batch.column("name").to_pylist(), batch.column("content")):
                if not name or any(not x or x[0] in "._" for x in name.split("/")):
                    raise ValueError(f"not a file name: {name!r}")
                for at in (own, root) if "/" in name else ():
                    disk.create_dir(f"{at}/{name.rpartition('/')[0]}", recursive=True)
                with disk.open_output_stream(f"{own}/{name}", compression=None) as f:
                    f.write(data.as_py() or b"")
                put.append(name)
        for name in put:
            disk.move(f"{own}/{name}", f"{root}/{name}")
        return WriterCommitMessage()

    def _clean(self):
        disk, root = store(self.path)
        disk.create_dir(f"{root}/{self.waiting}", recursive=True)
        disk.delete_dir(f"{root}/{self.waiting}")
        return disk, root

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        disk, root = self._clean()
        disk.open_output_stream(f"{root}/_SUCCESS").close()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean()


class RowFiles(DataSource):
    """The sink ``row_files``: a file ``name`` with ``content`` for each row."""

    @classmethod
    def name(cls) -> str:
        return "row_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def write_files(rows: DataFrame, path: str) -> None:
    """Writes each row (name, content) as a file in a folder; a name that is there is replaced. Null content is an empty file."""
    rows.sparkSession.dataSource.register(RowFiles)
    rows.select(F.col("name").cast("string"), F.col("content").cast("binary")).write.format("row_files").mode("append").option("path", path).save()


def read_files(spark: SparkSession, path: str, most: int | None = None, pattern: str = "*") -> DataFrame:
    """(name, length, modified, content) of a folder's files that have content; those over ``most`` bytes are left out unread."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    if most is not None:
        rows = rows.filter(F.col("length") <= most)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"), "content")


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def folders(spark: SparkSession, root: str) -> DataFrame:
    """(name, modified, files): the folders in a folder, with the time of the youngest file in each; contents are not read.

    A folder without content has no age and does not appear. One task lists the names; folders are dealt out and each is listed by one task, so
    that many folders are no job of a task each.
    """

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        disk, path = store(root)
        for batch in batches:
            if batch.num_rows:
                found = disk.get_file_info(fs.FileSelector(path))
                names = [x.base_name for x in found if x.type == fs.FileType.Directory and not _hidden(x.base_name)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        disk, path = store(root)
        path = path.rstrip("/")
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                # A folder that is swept meanwhile is not there.
                found = disk.get_file_info(fs.FileSelector(f"{path}/{name}", recursive=True, allow_not_found=True))
                shown = [x for x in found if x.type == fs.FileType.File and x.size and not any(map(_hidden, x.path[len(f"{path}/{name}/") :].split("/")))]
                if shown:
                    rows.append((name, max(x.mtime_ns for x in shown) // 1_000_000 * 1000, len(shown)))
            names, times, counts = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(times, pa.int64()), pa.array(counts, pa.int64())], ["name", "us", "files"])

    dealt = spark.range(1, numPartitions=1).mapInArrow(tops, "name string").repartition(4 * spark.sparkContext.defaultParallelism, "name")
    return dealt.mapInArrow(inside, "name string, us long, files long").select("name", F.timestamp_micros("us").alias("modified"), "files")


#: Seconds from which on folders of reports and of runs are left over.
REPORT_AGE, RUN_AGE = 3600, 6 * 3600


def is_own_run(name: Column) -> Column:
    return F.coalesce(name.rlike(r"\Arun-[A-Za-z0-9_-]+\z"), F.lit(False))


def is_own_report(name: Column) -> Column:
    return F.coalesce(name.rlike(r"\Areport-[A-Za-z0-9_-]+\z"), F.lit(False))


def age_seconds(now: Column, modified: Column) -> Column:
    """How old something is, by two clocks of one epoch; null if either is missing or no number."""
    age = now.cast("double") - modified.cast("double")
    return F.when(~F.isnan(age), age)


def stale(name: Column, age: Column, report_age: float = REPORT_AGE, run_age: float = RUN_AGE) -> Column:
    """Whether a folder of ours is old enough to go; an unknown age is not."""
    old = F.when(is_own_report(name), age >= report_age).when(is_own_run(name), age >= run_age)
    return F.coalesce(finite(age) & old, F.lit(False))


def sweep(spark: SparkSession, root: str, own: list[str], now: Column | None = None, dry_run: bool = True) -> DataFrame:
    """(name, age, stale) of a folder's folders but one's ``own``; unless ``dry_run``, stale ones are deleted by the tasks that judge them."""
    at = F.current_timestamp() if now is None else now
    age = age_seconds(at.cast("double"), F.col("modified").cast("double"))
    judged = folders(spark, root).filter(~F.col("name").isin(own)) if own else folders(spark, root)
    judged = judged.select("name", age.alias("age")).withColumn("stale", stale(F.col("name"), F.col("age")))
    if dry_run:
        return judged

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, path = store(root)
        for batch in batches:
            for name, gone in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if gone:
                    try:
                        disk.delete_dir(f"{path.rstrip('/')}/{name}")
                    except FileNotFoundError:  # another run's sweep, or an earlier try of this task
                        pass
            yield batch

    return judged.mapInArrow(delete, judged.schema)
