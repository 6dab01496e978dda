"""Small files and folders through the session's own file systems, so that any address Spark reads will do."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _context(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())


def system(spark: SparkSession, path: str):
    """(file system, path in it) of an address."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = system(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a file, or a folder with all in it; false if there is none."""
    fs, at = system(spark, path)
    return fs.delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    fs, at = system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def read(spark: SparkSession, path: str) -> str | None:
    """A small file's text; null if there is none."""
    fs, at = system(spark, path)
    if not fs.exists(at):
        return None
    with_data = fs.open(at)
    try:
        return bytes(with_data.readAllBytes()).decode()
    finally:
        with_data.close()


def publish(spark: SparkSession, path: str, text: str, replace: bool = False) -> bool:
    """Puts a small file in place whole, by a rename; unless it may ``replace``, false where there is one already."""
    jvm, at, context = _context(spark, path)
    fs, _ = system(spark, path)
    waiting = jvm.org.apache.hadoop.fs.Path(at.getParent(), f"_{uuid.uuid4().hex}")
    out = fs.create(waiting, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE if replace else kind.NONE
    try:
        context.rename(waiting, at, how)
        return True
    except Py4JJavaError as e:
        fs.delete(waiting, False)
        if not replace and "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
