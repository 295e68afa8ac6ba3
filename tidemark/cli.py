"""Demos of the engine on generated streams: ``python -m tidemark [NAME...]``."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.lineage import shared_dir
from .functions.windows import Sessions, Sliding, Tumbling
from .operators import heavy
from .operators.aggregate import sessions, totals_by_window, windowed, windowed_by_panes
from .operators.policy import Policy, tumbling_count
from .operators.watermark import BoundedLag
from .sources import arrivals as source
from .streaming.replay import Replay


def eventtime(spark: SparkSession) -> DataFrame:
    """Counts per minute by event time and by time of arrival, against the truth."""
    stream = source.mixed_stream(spark)
    truth = windowed(source.unique_events(stream), Tumbling(60), by=()).select("window_start", F.col("value").alias("truth"))
    policy = tumbling_count(60, 20, dedup_ttl=600)
    by_event = totals_by_window(policy.run(stream).results).select("window_start", F.col("total").alias("by_event_time"))
    by_ingest = windowed(source.unique_events(stream), Tumbling(60), time="ingest_time", by=()).select("window_start", F.col("value").alias("by_ingest_time"))
    return truth.join(by_event, "window_start", "left").join(by_ingest, "window_start", "left").orderBy("window_start")


def watermark(spark: SparkSession) -> DataFrame:
    """What a longer lag saves from the side output, and how long results then wait."""
    stream, out = source.mixed_stream(spark, seed=1), None
    for lag in (0, 10, 20, 200):
        done = tumbling_count(60, lag, dedup_ttl=600).run(stream)
        waited = done.results.where("NOT revision AND seq IS NOT NULL").agg(F.avg(F.col("watermark") + lag - F.col("window_end")).alias("mean_wait"))
        row = done.stats.select(F.lit(lag).alias("lag"), "processed", "dropped_too_late").join(F.broadcast(waited))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def lateness(spark: SparkSession) -> DataFrame:
    """What grace costs in revisions and saves in drops."""
    stream, out = source.mixed_stream(spark, seed=2), None
    for grace in (0, 100, 400, 900):
        row = tumbling_count(60, 10, lateness=grace, dedup_ttl=600).run(stream).stats.select(F.lit(grace).alias("grace"), "late_but_accepted", "revisions", "dropped_too_late", "peak_state_entries")
        out = row if out is None else out.unionByName(row)
    return out


def panes(spark: SparkSession) -> DataFrame:
    """Sliding windows by panes and without: equal results."""
    events = source.unique_events(source.mixed_stream(spark, late_fraction=0.0))
    a, b = windowed(events, Sliding(60, 10), "mean"), windowed_by_panes(events, Sliding(60, 10), "mean")
    both = a.select("key", "window_start", "value").join(b.select("key", "window_start", F.col("value").alias("by_panes")), ["key", "window_start"], "full")
    return both.agg(F.count(F.lit(1)).alias("windows"), F.count(F.when(F.col("value") == F.col("by_panes"), 1)).alias("equal"))


def sessions_demo(spark: SparkSession) -> DataFrame:
    """How many sessions users have, and how long they last."""
    found = sessions(source.sessions_stream(spark), Sessions(60))
    return found.agg(F.count(F.lit(1)).alias("sessions"), F.sum("events").alias("events"), F.avg(F.col("window_end") - F.col("window_start")).alias("mean_seconds"))


def heavyhitters(spark: SparkSession) -> DataFrame:
    """Space-Saving against exact counts, by capacity."""
    stream, out = source.skewed_stream(spark), None
    for capacity in (16, 64, 256):
        row = heavy.topk_agreement(stream, heavy.space_saving(stream, capacity), 10).select(F.lit(capacity).alias("capacity"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def restart(spark: SparkSession) -> DataFrame:
    """Two halves with a restart between them, and the whole: equal results."""
    stream = source.mixed_stream(spark, n=800, duplicate_fraction=0.1).drop("bucket")
    policy, folder = Policy(Tumbling(60), BoundedLag(10), "count", 60, 600), f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    half = stream.count() // 2
    Replay(spark, policy, folder).process(stream.where(F.col("seq") <= half), 0)
    after = Replay(spark, policy, folder)
    after.process(stream.where(F.col("seq") > half), 1)
    columns = ["key", "window_start", "value", "watermark", "revision", "seq"]
    parts = after.results().unionByName(after.flushed()).select(columns)
    whole = policy.run(source.in_order(stream.drop("seq", "latest", "latest_before"))).results.select(columns)
    return whole.agg(F.count(F.lit(1)).alias("results")).join(F.broadcast(whole.exceptAll(parts).agg(F.count(F.lit(1)).alias("missing")))).join(F.broadcast(parts.exceptAll(whole).agg(F.count(F.lit(1)).alias("extra"))))  # one row each


DEMOS: dict[str, Callable[[SparkSession], DataFrame]] = {
    "eventtime": eventtime, "watermark": watermark, "lateness": lateness, "panes": panes, "sessions": sessions_demo, "heavyhitters": heavyhitters, "restart": restart,
}


def main(names: list[str]) -> int:
    """Run the demos named (none, or ``all``: all of them); 2 if there is no such demo."""
    unknown = [n for n in names if n not in DEMOS and n != "all"]
    if unknown:
        print(f"no such demo: {', '.join(unknown)}; there are {', '.join(DEMOS)}")
        return 2
    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for name in DEMOS if not names or "all" in names else names:
        print(f"\n{name}: {DEMOS[name].__doc__}")
        DEMOS[name](spark).show(20, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
