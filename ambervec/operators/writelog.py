"""The write log: upserts and tombstones, segments, lookups and compaction.

A log row is (node_id, embedding, ts, seq, is_deleted). The current state takes the
row of greatest (ts, seq) for each id, so neither the rows' order nor the files
they lie in matter.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import LogConfig
from ..errors import InvalidArgument, MemoryLimitExceeded
from ..functions import vectors as V
from ..functions.bloom import bloom_agg, might_contain

LOG = "node_id long, embedding array<float>, ts timestamp, seq long, is_deleted boolean"
ENTRY_BYTES = 4 + 4 + 512 + 1


def latest(log: DataFrame, key: str = "node_id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """The newest row of each key, tombstones included; merged before the shuffle."""
    rest = [c for c in log.columns if c != key]
    newest = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return newest.select(key, *(F.col(f"row.{c}").alias(c) for c in rest)).select(*log.columns)


def live(log: DataFrame, key: str = "node_id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """The newest rows that aren't tombstones."""
    return latest(log, key, order).where(~F.col("is_deleted"))


def tombstones(log: DataFrame, key: str = "node_id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    return latest(log, key, order).where("is_deleted")


def contains(log: DataFrame, node_id: int) -> bool:
    """Whether the id has an entry; a tombstone is one."""
    return bool(log.where(F.col("node_id") == node_id).limit(1).count())


def get(log: DataFrame, node_id: int) -> DataFrame:
    """The live row of an id, or none; a tombstone hides all older rows."""
    return live(log.where(F.col("node_id") == node_id))


def in_range(log: DataFrame, lo, hi, key: str = "node_id") -> DataFrame:
    """Entries of ids lo..hi (inclusive), tombstones included."""
    return log.where(F.col(key).between(lo, hi))


def with_ids(vectors: DataFrame, first: int = 0) -> DataFrame:
    """Number rows without ids consecutively from ``first``, by (ts, seq).

    Ranks are taken within each minute and offset by the counts of the minutes
    before, so only the counts meet in one task.
    """
    rows = vectors.withColumn("__m", F.date_trunc("minute", "ts"))
    counts = rows.groupBy("__m").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__m", F.coalesce(F.sum("__n").over(W.orderBy("__m").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    ranked = rows.withColumn("__r", F.row_number().over(W.partitionBy("__m").orderBy("ts", "seq"))).join(before, "__m")
    return ranked.select((F.col("__base") + F.col("__r") - 1 + F.lit(first)).alias("node_id"), *vectors.columns)


def check_capacity(rows: int, most_rows: int, used: int = 0, most_bytes: int | None = None) -> None:
    if rows > most_rows or (most_bytes is not None and used > most_bytes):
        raise MemoryLimitExceeded(f"{rows} rows, {used} bytes")


# --------------------------------------------------------------- segments


def segmented(log: DataFrame, rows_per_segment: int, seq: str = "seq") -> DataFrame:
    """Add segment_id: consecutive runs of sequence numbers, as a log is rotated when full."""
    if rows_per_segment < 1:
        raise InvalidArgument("rows_per_segment must be positive")
    return log.withColumn("segment_id", F.floor(F.col(seq) / rows_per_segment))


def manifest(segments: DataFrame, key: str = "node_id", level: Column | None = None) -> DataFrame:
    """(segment_id, level, num_entries, min_node_id, max_node_id, size_bytes, bloom) of each segment."""
    return segments.groupBy("segment_id").agg(
        (F.lit(0) if level is None else F.max(level)).alias("level"), F.count(F.lit(1)).alias("num_entries"),
        F.min(key).alias("min_node_id"), F.max(key).alias("max_node_id"), (F.count(F.lit(1)) * ENTRY_BYTES).alias("size_bytes"),
        bloom_agg(F.col(key)).alias("bloom"),
    )


def segment_stats(segments: DataFrame, key: str = "node_id", norm: Column | None = None) -> DataFrame:
    """(segment_id, entries, tombstones, min_node_id, max_node_id, rms_norm of the live rows)."""
    norm = V.norm("embedding") if norm is None else norm
    alive = ~F.col("is_deleted")
    squares = F.sum(F.when(alive, norm * norm))
    return segments.groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("is_deleted")).alias("tombstones"),
        F.min(key).alias("min_node_id"), F.max(key).alias("max_node_id"),
        F.coalesce(F.sqrt(F.try_divide(squares, F.count_if(alive))), F.lit(0.0)).alias("rms_norm"),
    )


def sparse_index(segments: DataFrame, key: str = "node_id", every: int = 64, entry_bytes: Column | None = None) -> DataFrame:
    """(segment_id, pos, node_id, offset): every 64th entry by id, with its byte offset
    behind a header of 16 bytes."""
    size = F.lit(ENTRY_BYTES) if entry_bytes is None else entry_bytes
    w = W.partitionBy("segment_id").orderBy(key, "seq")
    rows = segments.withColumn("pos", F.row_number().over(w) - 1).withColumn("offset", F.coalesce(F.sum(size).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + 16)
    return rows.where(F.col("pos") % every == 0).select("segment_id", "pos", F.col(key).alias("node_id"), "offset")


def candidate_segments(ids: DataFrame, segments: DataFrame) -> DataFrame:
    """(node_id, segment_id) where an id passes the segment's range and bloom filter."""
    s = segments.select("segment_id", "min_node_id", "max_node_id", "bloom")
    return ids.join(s, F.col("node_id").between(F.col("min_node_id"), F.col("max_node_id"))).where(might_contain("bloom", "node_id")).select("node_id", "segment_id")


def segment_lookup(ids: DataFrame, segments: DataFrame, rows: DataFrame, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Live rows of ids, read from the segments that may hold them; newest wins over all segments."""
    cand = candidate_segments(ids, segments)
    return live(rows.join(cand, ["node_id", "segment_id"]), order=order)


def totals(segments: DataFrame) -> DataFrame:
    """(level, tables, entries, bytes) of a manifest."""
    return segments.groupBy("level").agg(F.count(F.lit(1)).alias("tables"), F.sum("num_entries").alias("entries"), F.sum("size_bytes").alias("bytes"))


def valid_segment(rows: DataFrame, most: int = 4096) -> DataFrame:
    """(segment_id, valid): not empty, and every live vector of 1 to ``most`` elements."""
    ok = F.col("is_deleted") | F.coalesce(F.size("embedding").between(1, most), F.lit(False))
    return rows.groupBy("segment_id").agg(F.bool_and(ok).alias("valid"))


# ------------------------------------------------------------- compaction


def merged(rows: DataFrame, drop_tombstones: bool, key: str = "node_id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """One row an id. Tombstones go only when nothing older is left outside the merge."""
    out = latest(rows, key, order)
    return out.where(~F.col("is_deleted")) if drop_tombstones else out


def size_tiered_choice(segments: DataFrame, level: int, config: LogConfig = LogConfig()) -> DataFrame:
    """segment_ids that a level's compaction merges: its oldest ones, at most
    ``most_tables``; none if there are fewer than ``tables_to_compact``."""
    at = segments.where(F.col("level") == level).select("segment_id")
    n = at.count()
    return at.orderBy("segment_id").limit(config.most_tables if n >= config.tables_to_compact else 0)


def level_tiered_choice(segments: DataFrame, config: LogConfig = LogConfig()) -> int | None:
    """The first level whose bytes pass level_bytes * factor ** level and that has two tables or more."""
    over = totals(segments).where((F.col("bytes") > config.level_bytes * F.pow(F.lit(float(config.level_factor)), "level")) & (F.col("tables") >= 2))
    return over.agg(F.min("level")).first()[0]


def compact(rows: DataFrame, segments: DataFrame, chosen: DataFrame, level: int, new_id: int) -> DataFrame:
    """Log rows after the chosen segments became one segment of the next level.

    New ids always grow, so no id is used twice. Tombstones are dropped only if all
    segments take part.
    """
    picked = chosen.select("segment_id")
    full = segments.join(picked, "segment_id", "left_anti").limit(1).count() == 0
    out = merged(rows.join(picked, "segment_id", "left_semi").drop("segment_id", "level"), full)
    rest = rows.join(picked, "segment_id", "left_anti")
    out = out.withColumns({"segment_id": F.lit(new_id).cast("long"), "level": F.lit(level + 1)})
    return rest.unionByName(out, allowMissingColumns=True)


# ------------------------------------------------------------------ files


class LogTable:
    """A log of Parquet segments in a folder: append, view, compact.

    Every append is one segment folder, written by Spark's committer, so a failed
    write leaves nothing that a reader sees.
    """

    def __init__(self, spark: SparkSession, path: str, config: LogConfig = LogConfig()):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config

    def append(self, rows: DataFrame, segment_id: int, level: int = 0) -> None:
        out = rows.withColumns({"segment_id": F.lit(segment_id).cast("long"), "level": F.lit(level)})
        ordered = out.repartition("node_id").sortWithinPartitions("node_id")
        writer = ordered.write.option("parquet.bloom.filter.enabled#node_id", "true")
        writer.mode("overwrite").parquet(f"{self.path}/segment={segment_id}")

    def _exists(self) -> bool:
        fs, p = _fs(self.spark, self.path)
        return fs.exists(p) and len(fs.listStatus(p)) > 0

    def rows(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], LOG + ", segment_id long, level int")
        return self.spark.read.option("basePath", self.path).option("mergeSchema", "true").parquet(self.path).drop("segment")

    def next_id(self, merged: bool = False) -> int:
        """An unused segment number greater than all others: even for written rows, odd
        for a compaction's, so a stream's batches (twice their number) and compactions
        never name the same segment."""
        last = self.rows().agg(F.max("segment_id")).first()[0]
        at = 0 if last is None else last + 1
        return at + (at % 2 != int(merged))

    def drop(self, segment_id: int) -> bool:
        """Delete one segment; whether it was there."""
        fs, p = _fs(self.spark, f"{self.path}/segment={segment_id}")
        return fs.exists(p) and fs.delete(p, True)

    def view(self) -> DataFrame:
        return live(self.rows().drop("segment_id", "level"))

    def manifest(self) -> DataFrame:
        return manifest(self.rows(), level=F.col("level"))

    def compact(self, final: bool = False) -> int | None:
        """Merge the chosen segments of the first level that needs it; the new segment's id, or None.

        Tombstones stay, since rows older than they may still arrive; ``final`` drops
        them if all segments are merged.
        """
        known = self.manifest()
        level = level_tiered_choice(known, self.config)
        level = 0 if level is None else level
        chosen = [r.segment_id for r in size_tiered_choice(known, level, self.config).collect()]  # at most most_tables
        if not chosen:
            return None
        new_id = self.next_id(merged=True)
        rows = self.rows()
        mine = rows.where(F.col("segment_id").isin(chosen))
        full = final and rows.where(~F.col("segment_id").isin(chosen)).limit(1).count() == 0
        out = merged(mine.drop("segment_id", "level"), full)
        self.append(out, new_id, level + 1)
        for s in chosen:
            self.drop(s)
        return new_id


class Compactor:
    """Compaction beside the writers: a thread that merges a table's segments.

    ``start`` and ``stop`` begin and end it, ``pause`` and ``resume`` hold it between two
    merges, ``pending`` counts the segments that wait in levels a merge would take,
    ``on_done`` is called with each new segment's number, and ``bytes_per_s`` makes it
    wait after a merge as long as its bytes take at that rate.
    """

    def __init__(self, table: LogTable, every_s: float = 1.0, bytes_per_s: float | None = None, on_done: Callable[[int], None] | None = None):
        self.table, self.every_s, self.bytes_per_s, self.on_done = table, every_s, bytes_per_s, on_done
        self.done = 0
        self.compacting = False
        self.error: Exception | None = None
        self._halt, self._go = threading.Event(), threading.Event()
        self._go.set()
        self._thread: threading.Thread | None = None

    @property
    def running(self) -> bool:
        return self._thread is not None and self._thread.is_alive()

    @property
    def paused(self) -> bool:
        return not self._go.is_set()

    def start(self) -> None:
        if not self.running:
            self._halt.clear()
            self._thread = threading.Thread(target=self._run, daemon=True)
            self._thread.start()

    def stop(self) -> None:
        """End after the merge that is running."""
        self._halt.set()
        self._go.set()
        if self._thread is not None:
            self._thread.join()

    def pause(self) -> None:
        self._go.clear()

    def resume(self) -> None:
        self._go.set()

    def pending(self) -> int:
        n = self.table.manifest().groupBy("level").agg(F.count(F.lit(1)).alias("n"))
        return n.where(F.col("n") >= self.table.config.tables_to_compact).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def needs(self) -> bool:
        """Whether some level has as many segments as a merge takes."""
        return self.pending() > 0

    def set_rate(self, bytes_per_s: float | None) -> None:
        self.bytes_per_s = bytes_per_s

    def run_once(self) -> int | None:
        """One merge where there is something to merge; its segment's number."""
        self.compacting = True
        try:
            made = self.table.compact()
        finally:
            self.compacting = False
        if made is not None:
            self.done += 1
            if self.on_done:
                self.on_done(made)
        return made

    def _run(self) -> None:
        while not self._halt.is_set():
            self._go.wait()
            if self._halt.is_set():
                return
            try:
                made = self.run_once()
            except Exception as e:  # kept for the caller; the log is whole, since merges commit before they delete
                self.error = e
                return
            wait = self.every_s
            if made is not None and self.bytes_per_s:
                size = self.table.manifest().where(F.col("segment_id") == made).agg(F.coalesce(F.max("size_bytes"), F.lit(0))).first()[0]
                wait = max(wait, size / self.bytes_per_s)
            self._halt.wait(wait)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p
