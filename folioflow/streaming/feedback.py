"""Streams: feedback files to a Parquet table, and late-data tolerant counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.sources.files import feedback_problem

FEEDBACK_SCHEMA = "id bigint, analysis_id string, accepted int, corrected_text string, created_at string"


def feedback_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Valid feedback rows of JSON Lines files as they arrive, with the instant they were made.

    ``created_at`` is ISO 8601 with any offset. Rows delivered again within the watermark are dropped by id.
    """
    rows = spark.readStream.schema(FEEDBACK_SCHEMA).json(folder)
    valid = rows.filter(feedback_problem(F.col("analysis_id"), F.col("accepted"), F.col("corrected_text")).isNull())
    return valid.withColumn("made_at", F.try_to_timestamp("created_at")).withWatermark("made_at", "1 day").dropDuplicatesWithinWatermark(["id"])


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, each row once: the sink's log and the checkpoint commit together."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, kind, n, total) per window; windows close ``late`` after their end. Works on batches and streams, on
    instants and on zone-less times."""
    kind_of_time = events.schema[time].dataType.simpleString()
    # A watermark needs instants; zone-less times of a stream are taken in the session's zone and given back in it.
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late) if events.isStreaming else events.withColumn("_t", F.col(time))
    counted = timed.groupBy(F.window("_t", width), kind).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return counted.select(F.col("window.start").cast(kind_of_time).alias("start"), kind, "n", "total")
