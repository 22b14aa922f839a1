"""Incremental ingest: one row per key across micro-batches, and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str, schema, per_batch: int = 4) -> DataFrame:
    """A folder of Parquet files as a stream; ``per_batch`` files at a time bound what is under way."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def ingest_once(stream: DataFrame, out: str, checkpoint: str, key: str, watermark: tuple[str, str] | None = None) -> None:
    """Writes each key once to ``out`` and stops when the input is used up; a restart goes on where it stopped.

    With a watermark (column, delay) the state of old keys is dropped; without, it grows with the keys.
    """
    if watermark:
        rows = stream.withWatermark(*watermark).dropDuplicatesWithinWatermark([key])
    else:
        rows = stream.dropDuplicates([key])
    query = (rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).outputMode("append").start())
    query.awaitTermination()


def ingest_every(stream: DataFrame, out: str, checkpoint: str, key: str, every: str = "2 seconds", late: tuple[str, str] | None = None):
    """As ingest_once(), but going on: what came in is written every ``every``. Returns the running query."""
    rows = stream.withWatermark(*late).dropDuplicatesWithinWatermark([key]) if late else stream.dropDuplicates([key])
    return (rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .trigger(processingTime=every).outputMode("append").start())


def windows_of_stream(events: DataFrame, out: str, checkpoint: str, **how) -> None:
    """windowed() over a stream to Parquet until its input is used up; a window is written once its watermark has passed."""
    # a watermark needs a time with a zone: the session's
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = windowed(timed, **how).select(F.col("w.start").alias("start"), "event_type", "n", "total")
    (rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).outputMode("append").start().awaitTermination())


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event-time window and type; the same on a stream and on a table."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
