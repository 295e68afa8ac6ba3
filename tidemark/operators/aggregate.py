"""Windowed aggregation of keyed events, plain and by panes, and what is made of its results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import SUM, Mergeable, aggregate
from ..functions.windows import Sessions, Sliding, Tumbling, pane_width


def windowed(events: DataFrame, windows: Tumbling | Sliding, how: str | Mergeable = "count", time: str = "event_time", by: tuple[str, ...] = ("key",)) -> DataFrame:
    """key, window_start, window_end, value, events: an aggregate per key and window."""
    agg = aggregate(how)
    rows = events.withColumn("window_start", F.explode(windows.starts(F.col(time))))
    done = rows.groupBy(*by, "window_start").agg(*agg.of_rows(), F.count(F.lit(1)).alias("events"))
    return done.select(*by, "window_start", (F.col("window_start") + windows.size).alias("window_end"), agg.value().alias("value"), "events")


def windowed_by_panes(events: DataFrame, windows: Tumbling | Sliding, how: str | Mergeable = "count", time: str = "event_time", by: tuple[str, ...] = ("key",)) -> DataFrame:
    """The same result as :func:`windowed` with one update per event: events are summed into panes, the widest that tile
    all windows, before panes are dealt out to windows and merged."""
    if not isinstance(windows, Sliding):
        raise ValueError("panes apply to sliding windows")
    agg, pane = aggregate(how), pane_width(windows.size, windows.step)
    start = (F.floor(F.col(time) / pane) * pane).cast("long")
    panes = events.groupBy(*by, start.alias("pane")).agg(*agg.of_rows(), F.count(F.lit(1)).alias("events"))
    parts = panes.withColumn("window_start", F.explode(windows.starts(F.col("pane"))))
    parts = parts.where(F.col("pane") + pane <= F.col("window_start") + windows.size)
    done = parts.groupBy(*by, "window_start").agg(*agg.of_parts(), F.sum("events").alias("events"))
    return done.select(*by, "window_start", (F.col("window_start") + windows.size).alias("window_end"), agg.value().alias("value"), "events")


def sessions(events: DataFrame, windows: Sessions, how: str | Mergeable = "count", by: tuple[str, ...] = ("key",)) -> DataFrame:
    """An aggregate per key and session: events at most ``gap`` seconds apart belong together, in whatever order they came."""
    agg = aggregate(how)
    stamped = events.withColumn("__ts", F.timestamp_seconds("event_time"))
    done = stamped.groupBy(*by, F.session_window("__ts", f"{windows.gap} seconds").alias("w")).agg(*agg.of_rows(), F.count(F.lit(1)).alias("events"))
    return done.select(*by, F.unix_seconds("w.start").alias("window_start"), F.unix_seconds("w.end").alias("window_end"), agg.value().alias("value"), "events")


def totals_by_window(results: DataFrame) -> DataFrame:
    """window_start, window_end, total: each key's last result for a window (by emit order), summed over keys.

    ``results``: key, window_start, window_end, value, seq, revision. A revision of the same arrival order comes later.
    """
    last = results.groupBy("key", "window_start", "window_end").agg(F.max_by("value", F.struct(F.col("seq").isNull(), "seq", "revision")).alias("value"))
    return last.groupBy("window_start", "window_end").agg(*SUM.of_rows()).select("window_start", "window_end", SUM.value().alias("total"))
