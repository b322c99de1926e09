"""Streams of writes into a log of segments, and views that match the batch ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.writelog import LOG, LogTable


def read_log_files(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files of log rows."""
    reader = spark.readStream.schema(LOG)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def ingest(stream: DataFrame, table: LogTable, checkpoint: str, compact_every: int = 0, **trigger) -> StreamingQuery:
    """Append every micro-batch as one segment (its number is the batch's).

    A batch that runs again after a failure overwrites its own segment, so rows are
    in the log exactly once. Late rows need no watermark: the newest (ts, seq) wins
    whenever they come.
    """

    def write(rows: DataFrame, batch: int) -> None:
        if rows.isEmpty():
            return
        table.append(rows, batch * 2)  # odd numbers are left to compaction
        if compact_every and batch and batch % compact_every == 0:
            table.compact()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_writes(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, writes, deletes) of tumbling windows, for monitoring a log's stream."""
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", width))
    return rows.agg(F.count(F.lit(1)).alias("writes"), F.count_if("is_deleted").alias("deletes")).select(F.col("window.start").alias("start"), "writes", "deletes")
