"""Structured Streaming with built-in operators: append output, one watermark per query, no revisions.

The watermark here moves between micro-batches and late rows are judged by the one before; where each event must be judged
by its own, use :mod:`tidemark.streaming.replay`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aggregates import Mergeable, aggregate
from ..functions.windows import Sessions, Sliding, Tumbling, pane_width

SCHEMA = "event_id long, event_time long, key string, user_id long, value double, ingest_time long, is_retry int"


def read(spark: SparkSession, folder: str, files_per_batch: int = 1, schema: str = SCHEMA) -> DataFrame:
    """Parquet files of arrivals as a stream, some files to a batch, with the time of the event as ts."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return stream.withColumn("ts", F.timestamp_seconds("event_time"))


def deduplicated(stream: DataFrame, ttl: int) -> DataFrame:
    """The stream without arrivals whose event_id came before, remembered for ``ttl`` seconds of event time."""
    return stream.withWatermark("ts", f"{ttl} seconds").dropDuplicatesWithinWatermark(["event_id"])


def windowed(stream: DataFrame, windows: Tumbling | Sliding | Sessions, lag: int, how: str | Mergeable = "count") -> DataFrame:
    """key, window_start, window_end, value, events, once the watermark has passed the window."""
    agg = aggregate(how)
    if isinstance(windows, Sessions):
        w = F.session_window("ts", f"{windows.gap} seconds")
    else:
        w = F.window("ts", f"{windows.size} seconds", f"{windows.step} seconds")
    done = stream.withWatermark("ts", f"{lag} seconds").groupBy("key", w.alias("w")).agg(*agg.of_rows(), F.count(F.lit(1)).alias("events"))
    out = done.select("key", F.unix_seconds("w.start").alias("window_start"), F.unix_seconds("w.end").alias("window_end"), agg.value().alias("value"), "events")
    return out.where("window_start >= 0")


def windowed_by_panes(stream: DataFrame, windows: Sliding, lag: int, how: str | Mergeable = "count") -> DataFrame:
    """The same by way of panes: one state update per event, panes merged into windows by a second aggregation."""
    agg, pane = aggregate(how), pane_width(windows.size, windows.step)
    panes = stream.withWatermark("ts", f"{lag} seconds").groupBy("key", F.window("ts", f"{pane} seconds").alias("p")).agg(*agg.of_rows(), F.count(F.lit(1)).alias("events"))
    w = F.window(F.window_time("p"), f"{windows.size} seconds", f"{windows.step} seconds")
    done = panes.groupBy("key", w.alias("w")).agg(*agg.of_parts(), F.sum("events").alias("events"))
    out = done.select("key", F.unix_seconds("w.start").alias("window_start"), F.unix_seconds("w.end").alias("window_end"), agg.value().alias("value"), "events")
    return out.where("window_start >= 0")


def run(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process all there is, write it as parquet, stop. Called again with the same checkpoint it goes on from there."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
