"""Folders of tables, by Hadoop's file systems, so any store that Spark reads will do."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ReadError


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def ensure_directory(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    if not fs.mkdirs(p):
        raise ReadError(f"cannot make {path}")


def file_size(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise ReadError(f"no such file: {path}")
    return fs.getFileStatus(p).getLen()


def directory_size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder; 0 if there is none."""
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def list_segments(spark: SparkSession, path: str) -> list[int]:
    """Numbers of a log's segment folders, in order."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"segment=(\d+)", n)))


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files below a folder, read as a table."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length"))


def temp_path(path: str) -> str:
    """A name beside ``path`` to write to before `commit_temp`."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/_temporary-{uuid.uuid4().hex}-{name}"


def commit_temp(spark: SparkSession, temp: str, path: str) -> None:
    """Put what was written to ``temp`` in the place of ``path``: readers see the old or the new."""
    fs, p = _fs(spark, path)
    source = _fs(spark, temp)[1]
    if not fs.exists(source):
        raise ReadError(f"no such file: {temp}")
    if fs.exists(p):
        fs.delete(p, True)
    if not fs.rename(source, p):
        raise ReadError(f"cannot put {temp} in the place of {path}")


def delete_path(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.delete(p, True)


def remove_stale(spark: SparkSession, path: str, older_than_s: float = 3600) -> int:
    """Delete leftovers of writes that never committed (``_temporary...`` folders); how many went."""
    fs, p = _fs(spark, path)
    gone, limit = 0, (time.time() - older_than_s) * 1000
    if not fs.exists(p):
        return 0
    for s in fs.listStatus(p):
        inner = s.getPath()
        if s.isDirectory() and inner.getName().startswith("_temporary"):
            gone += bool(s.getModificationTime() <= limit and fs.delete(inner, True))
        elif s.isDirectory():
            gone += remove_stale(spark, inner.toString(), older_than_s)
    return gone
