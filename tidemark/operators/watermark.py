"""Watermarks of each arrival, over all keys, its own event counted."""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import fresh
from ..functions.prefix import Running, running, running_max

#: What the watermark is before anything has passed.
NONE = -1


@dataclass(frozen=True)
class BoundedLag:
    """The latest event time so far, less a fixed lag."""

    lag: int

    def __post_init__(self):
        if self.lag < 0:
            raise ValueError("the lag must not be negative")

    def apply(self, arrivals: DataFrame) -> DataFrame:
        """``arrivals`` with wm, and wm_before: the watermark that the arrival found."""
        if not {"latest", "latest_before"} <= set(arrivals.columns):
            arrivals = running(arrivals, "bucket", ["seq"], {"latest": Running("max", "event_time"), "latest_before": Running("max", "event_time", inclusive=False)})
        at = lambda c: F.greatest(F.lit(NONE).cast("long"), F.col(c) - self.lag)
        return arrivals.withColumns({"wm": at("latest"), "wm_before": F.coalesce(at("latest_before"), F.lit(NONE).cast("long"))})


@dataclass(frozen=True)
class PercentileLag:
    """The latest event time so far, less a quantile of the last delays, never going back.

    The delays of the last ``window`` arrivals are kept sorted along parts of ``rows_per_task`` arrivals, each of which
    brings the ``window`` - 1 arrivals before it along; so the order is cut into tasks here too.
    """

    percentile: float = 0.99
    window: int = 2000
    minimum_lag: int = 1
    rows_per_task: int = 20_000

    def __post_init__(self):
        if not 0.5 <= self.percentile < 1:
            raise ValueError("the percentile must lie in [0.5, 1)")
        if self.window < 1:
            raise ValueError("the window must hold an arrival")

    def apply(self, arrivals: DataFrame, before: DataFrame | None = None) -> DataFrame:
        """``arrivals`` with estimated_lag, wm and wm_before. ``seq`` must count without gaps, from 1 or, where ``before``
        (seq, delay) holds the last arrivals before these, on from there."""
        size = max(self.rows_per_task, self.window)
        part_as, own_as, delay_as = fresh(arrivals.columns, "part", "own", "delay")
        part, follows = F.expr(f"(seq - 1) div {size}"), F.expr(f"(seq + {self.window - 1} - 1) div {size}")
        rows = arrivals.withColumn(delay_as, F.greatest(F.col("ingest_time") - F.col("event_time"), F.lit(0)).cast("long")).withColumn(own_as, F.lit(True))
        if before is not None:
            rows = rows.unionByName(before.select("seq", F.col("delay").alias(delay_as), F.lit(False).alias(own_as)), allowMissingColumns=True)
        spread = rows.withColumn(part_as, F.explode(F.array_distinct(F.array(part, follows)))).withColumn(own_as, F.col(own_as) & (F.col(part_as) == part))
        percentile, most, least = self.percentile, self.window, self.minimum_lag

        def estimate(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("seq")
            held, found = [], []
            delays = rows.column(delay_as).to_pylist()
            for i, d in enumerate(delays):  # one delay comes, one goes: the rest stays sorted
                bisect.insort(held, d)
                if i >= most:
                    del held[bisect.bisect_left(held, delays[i - most])]
                found.append(max(held[min(int(percentile * len(held)), len(held) - 1)], least))
            return rows.append_column("estimated_lag", pa.array(found, pa.int64())).filter(rows.column(own_as)).select([*names, "estimated_lag"])

        names = arrivals.columns
        lagged = spread.groupBy(part_as).applyInArrow(estimate, arrivals.withColumn("estimated_lag", F.lit(0).cast("long")).schema)
        if "latest" not in lagged.columns:
            lagged = running_max(lagged, "bucket", "seq", "event_time", "latest")
        (at_as,) = fresh(lagged.columns, "at")
        timed = lagged.withColumn(at_as, F.col("latest") - F.col("estimated_lag"))
        run = running(timed, "bucket", ["seq"], {"wm": Running("max", at_as), "wm_before": Running("max", at_as, inclusive=False)})
        none = F.lit(NONE).cast("long")
        return run.withColumns({c: F.greatest(none, F.coalesce(c, none)) for c in ("wm", "wm_before")}).drop(at_as)


WATERMARKS = {"bounded": BoundedLag, "percentile": PercentileLag}


def watermark(kind: str, **parameters) -> BoundedLag | PercentileLag:
    """A watermark by name and parameters, as a checkpoint would name it."""
    if kind not in WATERMARKS:
        raise ValueError(f"unknown watermark {kind!r}")
    return WATERMARKS[kind](**parameters)
