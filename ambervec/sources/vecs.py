"""Files of float and integer vectors (repeated [int32 size][size * 4 bytes]).

``spark.read.format("fvecs").load(path)`` gives (node_id, embedding), ``ivecs``
gives ARRAY<INT> and lets sizes differ. Records of one size are read in ranges,
so one large file makes many tasks; ids are positions in the file.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import InvalidArgument, ReadError
from .files import _fs

MAX_DIMENSION = 10_000
RECORDS_PER_TASK = 200_000


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path


class _Range(InputPartition):
    def __init__(self, path: str, first: int, count: int, size: int):
        self.path, self.first, self.count, self.size = path, first, count, size


class _VecsReader(DataSourceReader):
    def __init__(self, path: str, limit: int, integers: bool):
        self.path, self.limit, self.integers = _local(path), limit, integers

    def partitions(self) -> list[InputPartition]:
        try:
            total = os.path.getsize(self.path)
            with open(self.path, "rb") as f:
                head = f.read(4)
        except OSError as e:
            raise ReadError(f"cannot read {self.path}: {e}") from e
        if not head:
            return []
        if len(head) < 4:
            raise InvalidArgument(f"{self.path}: truncated header")
        size = int(np.frombuffer(head, "<i4")[0])
        low = 0 if self.integers else 1
        if not low <= size <= MAX_DIMENSION:
            raise InvalidArgument(f"{self.path}: dimension {size} is not in {low}..{MAX_DIMENSION}")
        record = 4 + 4 * size
        if total % record:
            if not self.integers:
                raise InvalidArgument(f"{self.path}: its size is no multiple of its record size")
            return [_Range(self.path, 0, -1, -1)]
        n = total // record if not self.limit else min(self.limit, total // record)
        if self.integers and self._ragged(record, size, total // record):
            return [_Range(self.path, 0, -1, -1)]
        return [_Range(self.path, at, min(RECORDS_PER_TASK, n - at), size) for at in range(0, n, RECORDS_PER_TASK)]

    def _ragged(self, record: int, size: int, n: int) -> bool:
        sizes = np.memmap(self.path, "<i4", "r").reshape(n, record // 4)[:, 0]
        return bool((sizes != size).any())

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        kind = "<i4" if self.integers else "<f4"
        arrow = pa.int32() if self.integers else pa.float32()
        name = "ids" if self.integers else "embedding"
        if part.size < 0:
            yield from self._read_ragged(part, arrow, name)
            return
        width = part.size + 1
        with open(part.path, "rb") as f:
            f.seek(part.first * width * 4)
            done = 0
            while done < part.count:
                n = min(10_000, part.count - done)
                raw = np.frombuffer(f.read(n * width * 4), "<i4").reshape(n, width)
                if (raw[:, 0] != part.size).any():
                    raise InvalidArgument(f"{part.path}: records of different dimension")
                values = np.ascontiguousarray(raw[:, 1:]).view(kind).ravel()
                lists = pa.ListArray.from_arrays(np.arange(0, n * part.size + 1, part.size, dtype=np.int32) if part.size else np.zeros(n + 1, np.int32), pa.array(values, arrow))
                ids = pa.array(np.arange(part.first + done, part.first + done + n))
                yield pa.RecordBatch.from_arrays([ids, lists], ["node_id", name])
                done += n

    def _read_ragged(self, part: _Range, arrow, name: str) -> Iterator[pa.RecordBatch]:
        with open(part.path, "rb") as f:
            k = 0
            while head := f.read(4):
                n = int(np.frombuffer(head, "<i4")[0]) if len(head) == 4 else -1
                body = f.read(4 * n) if n >= 0 else b""
                if n < 0 or len(body) < 4 * n:
                    raise InvalidArgument(f"{part.path}: truncated record {k}")
                if self.limit and k >= self.limit:
                    return
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.frombuffer(body, "<i4").tolist()], pa.list_(arrow))], ["node_id", name])
                k += 1


class FvecsSource(DataSource):
    """format("fvecs"); option ``limit`` reads the first records only."""

    integers = False

    @classmethod
    def name(cls) -> str:
        return "fvecs"

    def schema(self) -> str:
        return "node_id long, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _VecsReader(self.options["path"], int(self.options.get("limit", 0)), self.integers)


class IvecsSource(FvecsSource):
    integers = True

    @classmethod
    def name(cls) -> str:
        return "ivecs"

    def schema(self) -> str:
        return "node_id long, ids array<int>"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FvecsSource)
    spark.dataSource.register(IvecsSource)


def _in_store(path: str) -> bool:
    """Whether a path names a store that only Hadoop's file systems reach."""
    return "://" in path and not path.startswith("file://")


def read_fvecs(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """(node_id, embedding) of a file that every machine sees at this path, or of one in
    any store that Spark reads (``scheme://...``)."""
    if _in_store(path):
        return read_by_hadoop(spark, path, limit)
    register(spark)
    return spark.read.format("fvecs").option("limit", limit).load(path)


def read_ivecs(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    if _in_store(path):
        return read_by_hadoop(spark, path, limit, True)
    register(spark)
    return spark.read.format("ivecs").option("limit", limit).load(path)


def read_by_hadoop(spark: SparkSession, path: str, limit: int = 0, integers: bool = False) -> DataFrame:
    """The records through Hadoop's file systems: those of one size in splits, as
    fixed-length records with their numbers; a file of integer lists (ground truth) as
    a whole, since its sizes may differ."""
    name, kind = ("ids", "<i4") if integers else ("embedding", "<f4")
    schema = f"node_id long, {name} array<{'int' if integers else 'float'}>"
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise ReadError(f"cannot read {path}: no such file")
    total = fs.getFileStatus(p).getLen()
    if not total:
        return spark.createDataFrame([], schema)
    if integers:
        whole = spark.read.format("binaryFile").load(path).select("content")
        rows = whole.mapInArrow(lambda batches: (r for b in batches for c in b.column("content") for r in _records(c.as_py(), path)), schema)
        return rows.where(F.col("node_id") < limit) if limit else rows
    if total < 4:
        raise InvalidArgument(f"{path}: truncated header")
    stream = fs.open(p)
    try:
        size = spark.sparkContext._jvm.java.lang.Integer.reverseBytes(stream.readInt())
    finally:
        stream.close()
    if not 1 <= size <= MAX_DIMENSION:
        raise InvalidArgument(f"{path}: dimension {size} is not in 1..{MAX_DIMENSION}")
    record = 4 + 4 * size
    if total % record:
        raise InvalidArgument(f"{path}: its size is no multiple of its record size")
    read = spark.sparkContext.newAPIHadoopFile(
        path, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable",
        conf={"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(record)},
    )

    def decode(batches):
        for b in batches:
            if not b.num_rows:
                continue
            raw = np.frombuffer(b"".join(b.column("raw").to_pylist()), "<i4").reshape(b.num_rows, size + 1)
            if (raw[:, 0] != size).any():
                raise InvalidArgument(f"{path}: records of different dimension")
            values = np.ascontiguousarray(raw[:, 1:]).view(kind).ravel()
            yield pa.RecordBatch.from_arrays([b.column("node_id"), pa.ListArray.from_arrays(np.arange(0, len(values) + 1, size, dtype=np.int32), pa.array(values))], ["node_id", name])

    rows = spark.createDataFrame(read, "node_id long, raw binary")
    return (rows.where(F.col("node_id") < limit) if limit else rows).mapInArrow(decode, schema)


def _records(raw: bytes, path: str) -> Iterator[pa.RecordBatch]:
    at, out = 0, []
    while at < len(raw):
        n = int(np.frombuffer(raw, "<i4", 1, at)[0]) if at + 4 <= len(raw) else -1
        if n < 0 or at + 4 + 4 * n > len(raw):
            raise InvalidArgument(f"{path}: truncated record {len(out)}")
        out.append(np.frombuffer(raw, "<i4", n, at + 4))
        at += 4 + 4 * n
    for lo in range(0, len(out), 10_000):
        part = out[lo : lo + 10_000]
        lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(x) for x in part]))).astype(np.int32), pa.array(np.concatenate(part)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(part))), lists], ["node_id", "ids"])


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, rk, node_id) with ranks from 1."""
    rows = read_ivecs(spark, path).select(F.col("node_id").alias("query_id"), F.posexplode("ids").alias("pos", "id"))
    return rows.select("query_id", (F.col("pos") + 1).alias("rk"), F.col("id").cast("long").alias("node_id"))


def vecs_stats(spark: SparkSession, path: str) -> DataFrame:
    """(vectors, dimension) of a file of equal records, from its length and first header."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    head = read_fvecs(spark, path, 1).select(F.size("embedding").alias("dimension"))
    return files.crossJoin(head).select("path", F.floor(F.col("length") / (4 + 4 * F.col("dimension"))).alias("vectors"), "dimension")  # one row a file


def read_or_empty(spark: SparkSession, path: str, kind: str = "fvecs", limit: int = 0) -> DataFrame:
    """The file's rows; none if it is missing or broken."""
    source = (FvecsSource if kind == "fvecs" else IvecsSource)({"path": path})
    try:
        if not _in_store(path):
            _VecsReader(path, limit, kind == "ivecs").partitions()
        return read_fvecs(spark, path, limit) if kind == "fvecs" else read_ivecs(spark, path, limit)
    except (ReadError, InvalidArgument):
        return spark.createDataFrame([], source.schema())


def write_vecs(rows, path: str, integers: bool = False, spark: SparkSession | None = None) -> None:
    """Write a small list of vectors (for tests and exports of results); with a session, to
    any store that Spark writes."""
    body = b"".join(np.int32(len(x)).tobytes() + x.tobytes() for x in (np.asarray(r, "<i4" if integers else "<f4") for r in rows))
    if spark is not None and _in_store(path):
        fs, p = _fs(spark, path)
        stream = fs.create(p, True)
        stream.write(body)
        stream.close()
        return
    with open(_local(path), "wb") as f:
        f.write(body)
