"""Helpers shared by the operators: scratch tables, Arrow text buffers, word
arrays and the packed exchange of per-partition facts."""

from __future__ import annotations

import atexit
import re
import tempfile
import threading
import uuid
import zlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# ---------------------------------------------------------------- scratch


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``), this
    application's part of it; it is deleted when the driver ends.

    Only where everything runs on one machine (tests) and the session names none, a
    temporary folder is made and set as the session's checkpoint folder; a cluster
    without one is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="ambervec-")
        sc.setCheckpointDir(made)
        base = "file://" + made
    path = f"{base.rstrip('/')}/ambervec-{sc.applicationId}"
    if path not in _CLEANED:
        _CLEANED.add(path)
        atexit.register(_delete, spark, path)
    return path


_CLEANED: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None and not sc._jsc.sc().isStopped():
        folder = sc._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


class _Freeing:
    """The session frees shuffle files after each query while any write is inside."""

    def __init__(self):
        self.lock, self.inside, self.before = threading.Lock(), 0, None

    @contextmanager
    def on(self, spark: SparkSession):
        with self.lock:
            if not self.inside:
                self.before = spark.conf.get(_FREE, None)
                spark.conf.set(_FREE, "true")
            self.inside += 1
        try:
            yield
        finally:
            with self.lock:
                self.inside -= 1
                if not self.inside:
                    spark.conf.unset(_FREE) if self.before is None else spark.conf.set(_FREE, self.before)


_freeing = _Freeing()


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    This cuts the lineage with files that outlive any executor; a later stage
    that is computed again rereads them instead of recomputing ``df``. The
    shuffle files of the write are freed as soon as it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with _freeing.on(spark):
        df.select("*").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files behind staged tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    mine = "/ambervec-"
    for df in frames:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if mine in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parts_for(df: DataFrame) -> int:
    """Number of input splits: grows with the bytes of the input."""
    return max(1, df.rdd.getNumPartitions())


# ------------------------------------------------------------ Arrow texts


def text_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without making Python strings.

    Null texts become empty ones.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):  # no chunk at all
        col = pa.array([], pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def batch_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20):
    """Cut a batch into runs of rows of at most ``max_bytes`` of text (one row at least)."""
    n = batch.num_rows
    if n == 0:
        return
    _, off = text_buffer(batch.column(column))
    at = 0
    while at < n:
        to = int(np.searchsorted(off, off[at] + max_bytes, "right")) - 1
        to = min(n, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to


# ------------------------------------------------------------ word arrays

_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_R = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_RI = U64(pow(int(_R), -1, 1 << 64))


def _bytes_table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


_T1, _T2 = _bytes_table(11), _bytes_table(29)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the SplitMix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = U64(1)
        np.multiply.accumulate(out, out=out)
    return out


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of many texts as arrays.

    doc[i], start[i], end[i]: text number and byte span of word i;
    first[d]: number of the first word of text d (first[-1] = all words).
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.off = off
        sep = np.ones(len(data) + 1, bool)
        np.take(_SEP, data, out=sep[:-1])
        before = np.ones(len(data) + 1, bool)
        before[1:] = sep[:-1]
        cut = off[:-1][off[:-1] < len(data)]
        before[cut] = True  # a text begins
        self.start = np.flatnonzero(before[:-1] & ~sep[:-1])
        after = sep[1:].copy()
        ends = off[1:] - 1
        after[ends[ends >= 0]] = True
        self.end = np.flatnonzero(after & ~sep[:-1]) + 1
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, seed: int = 1) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hash(self.data, self.start, self.end, _T1 if seed == 1 else _T2)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hash of the byte spans by differences of a polynomial prefix sum, in blocks."""
    out = np.empty(len(start), np.uint64)
    block = 1 << 20
    at = 0
    while at < len(start):
        lo = start[at]
        to = max(at + 1, int(np.searchsorted(end, lo + block, "right")))
        hi = int(end[to - 1])
        part = table[data[lo:hi]]
        pw = powers(_R, hi - lo)
        pre = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(part * pw, out=pre[1:])
        s, e = start[at:to] - lo, end[at:to] - lo
        inv = powers(_RI, hi - lo)
        out[at:to] = mix((pre[e] - pre[s]) * inv[s] + (e - s).astype(np.uint64))
        at = to
    return out


def window_hash(wh: np.ndarray, width: int, seed: int = 1, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the runs of ``width`` consecutive values that start ``at`` these places (default: all)."""
    n = max(0, len(wh) - width + 1) if at is None else len(at)
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    mul = U64((0xD1342543DE82EF95 if seed == 1 else 0xAF251AF3B0F025B5))
    for k in range(width):
        acc = (acc + (wh[k : k + n] if at is None else wh[at + k])) * mul
        acc ^= acc >> U64(29)
    return mix(acc)


def whole_runs(first: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the words at which a run of ``width`` words of one text starts."""
    n = int(first[-1])
    if n < width:
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])


# --------------------------------------------- packed exchange of facts


def pack(*cols: np.ndarray) -> bytes:
    """Integer arrays of one length as one blob; 64-bit signed ones as compressed differences."""
    out = [np.int64(len(cols[0])).tobytes()]
    for c in cols:
        raw = np.ascontiguousarray(c)
        if raw.dtype == np.int64:
            z = zlib.compress(np.diff(raw, prepend=np.int64(0)).tobytes(), 1)
            out += [np.int64(len(z)).tobytes(), z]
        else:
            out.append(raw.tobytes())
    return b"".join(out)


def unpack(blob: bytes, *dtypes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    at, out = 8, []
    for d in map(np.dtype, dtypes):
        if d == np.int64:
            size = int(np.frombuffer(blob, np.int64, 1, at)[0])
            out.append(np.cumsum(np.frombuffer(zlib.decompress(blob[at + 8 : at + 8 + size]), np.int64)))
            at += 8 + size
        else:
            out.append(np.frombuffer(blob, d, n, at))
            at += n * d.itemsize
    return out


def low48(keys: np.ndarray) -> np.ndarray:
    """The low 48 bits as rows of six bytes."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def from48(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each well-mixed key, from its high bits (so in the keys' order)."""
    return ((keys >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def bucket_runs(sorted_keys: np.ndarray, buckets: int):
    """(bucket, from, to) of each bucket's run in sorted keys."""
    b = bucket_of(sorted_keys, buckets)
    cut = np.flatnonzero(np.diff(b)) + 1
    edge = np.concatenate(([0], cut, [len(b)])) if len(b) else np.zeros(1, np.int64)
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
        yield int(b[lo]), lo, hi


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate: for a table, the bytes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


PARTS_A_BUCKET = 4


def in_parts(docs: DataFrame, part_bytes: int) -> tuple[DataFrame, int, int]:
    """(pid, doc_id, text), the number of parts and that of the buckets they ask:
    stable parts of about ``part_bytes`` of the stored table, drawn from id and text
    so that neither null nor repeated ids crowd in one part. (Rows of equal id and
    text share a part.)

    A part sends one message to each bucket that it has a question for, so messages
    are at most parts times buckets, and never more than the different keys of the
    parts, which grow with the corpus. There is a bucket for four parts: what it
    reads is a fixed multiple of what a part asks, at any size.
    """
    parts = int(min((1 << 31) - 1, max(1, -(-size_in_bytes(docs) // part_bytes))))
    rows = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("pid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows, parts, -(-parts // PARTS_A_BUCKET)


def in_order(table: pa.Table) -> pa.Table:
    """A part's rows in an order that every run of the task finds again."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


WORD = re.compile(rb"[^\x20\x09-\x0D]+")
