"""The late-data policy as relational algebra: deduplicate, fire, revise, divert.

Arrivals carry their watermark. A window of a key first fires at the arrival that is both at or past the first accepted
event and at or past the first watermark beyond the window's end; everything accepted until then makes its first result,
every accepted arrival after it a revision with the value so far. What comes when the window and its grace are over goes
to the side output, once per window. Windows that no watermark passed are flushed at the end.

Arrivals before a window's end are aggregated as they are, without order; only late ones, few by nature, are put in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import Mergeable, aggregate
from ..functions.lineage import cut
from ..functions.prefix import number, running_sum
from ..functions.windows import Sessions, Sliding, Tumbling, pane_width
from .dedup import expired, mark_kept, settle
from .sessions import SessionOutcome
from .watermark import BoundedLag, PercentileLag

RESULT = ["key", "window_start", "window_end", "value", "events", "watermark", "revision", "seq"]


@dataclass
class Policy:
    """Windows, watermark, grace and deduplication of one aggregation.

    domain: ``event`` assigns windows by event time, ``ingest`` by time of arrival; the watermark follows event time
    in both. panes: an arrival updates one pane, the widest that tile all windows, instead of every window that holds it;
    results are the same. All results are DataFrames made from one input, :meth:`run`.
    """

    windows: Tumbling | Sliding | Sessions
    watermark: BoundedLag | PercentileLag
    how: str | Mergeable = "count"
    lateness: int = 0
    dedup_ttl: int | None = None
    domain: str = "event"
    panes: bool = False

    def __post_init__(self):
        if self.panes and not isinstance(self.windows, Sliding):
            raise ValueError("panes apply to sliding windows")
        if self.domain not in ("event", "ingest"):
            raise ValueError(f"the time domain is 'event' or 'ingest', not {self.domain!r}")
        if self.lateness < 0:
            raise ValueError("allowed lateness must not be negative")

    @property
    def time(self) -> str:
        """The column of the time domain."""
        return "event_time" if self.domain == "event" else "ingest_time"

    def run(self, arrivals: DataFrame) -> Outcome | SessionOutcome:
        if self.dedup_ttl is not None and isinstance(self.watermark, PercentileLag):
            marked = settle(arrivals, self.watermark, self.dedup_ttl, self.time)
        else:
            marked = mark_kept(self.watermark.apply(arrivals), self.dedup_ttl, self.time)
        # several results need these rows, and their order costs a sort: made once
        marked = cut(marked.select("seq", "event_time", "key", "value", "event_id", "ingest_time", "wm", "wm_before", "kept"))
        if isinstance(self.windows, Sessions):  # always by event time
            return SessionOutcome(self, marked)
        kept = marked.where("kept")
        time = F.col(self.time)
        placed = kept.withColumn("window_start", F.explode(self.windows.starts(time))).withColumn("window_end", F.col("window_start") + self.windows.size)
        placed = placed.withColumn("too_late", F.col("window_end") + self.lateness <= F.col("wm")).withColumn("late", F.col("window_end") <= F.col("wm"))
        return Outcome(self, marked, placed)


def crossings(steps: DataFrame, ends: DataFrame, step: int) -> DataFrame:
    """(end, cross_seq, cross_wm): the first arrival whose watermark reaches ``end``, for each of ``ends``; null if none.

    Watermarks and ends are cut into cells; an end looks for its arrival in its own cell and, failing that, takes the
    first arrival of the next cell that has one.
    """
    cell = step * 16
    steps = steps.groupBy("wm").agg(F.min("seq").alias("seq")).select("wm", "seq", F.expr(f"wm div {cell}").alias("cell"))
    wanted = ends.distinct().withColumn("cell", F.expr(f"end div {cell}"))
    none = F.lit(None).cast("long")
    both = steps.select("cell", F.col("wm").alias("at"), "seq", F.lit(1).alias("kind"), "wm").unionByName(wanted.select("cell", F.col("end").alias("at"), none.alias("seq"), F.lit(0).alias("kind"), none.alias("wm")))
    # from the last to the first, so that each frame grows by a row: linear
    ahead = Window.partitionBy("cell").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    move = F.when(F.col("kind") == 1, F.struct("seq", "wm"))
    found = both.withColumn("next", F.last(move, ignorenulls=True).over(ahead)).where("kind = 0")
    later = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)  # one row per cell
    beyond = both.groupBy("cell").agg(F.min(move).alias("own")).select("cell", F.min("own").over(later).alias("beyond"))
    hit = found.join(beyond, "cell").select(F.col("at").alias("end"), F.coalesce("next", "beyond").alias("hit"))
    return hit.select("end", F.col("hit.seq").alias("cross_seq"), F.col("hit.wm").alias("cross_wm"))


@dataclass
class Outcome:
    policy: Policy
    marked: DataFrame  # all arrivals, with wm and kept
    placed: DataFrame  # kept arrivals, once per window, with late and too_late

    @property
    def accepted(self) -> DataFrame:
        return self.placed.where("NOT too_late")

    @property
    def side_output(self) -> DataFrame:
        """Events that came too late, once per window."""
        return self.placed.where("too_late").select("seq", "event_time", "key", "value", "event_id", "ingest_time", "window_start", "window_end")

    def _crossings(self, ends: str) -> DataFrame:
        steps = self.marked.where("kept AND (wm > wm_before OR seq = 1)").select("wm", "seq")
        return crossings(steps, self.accepted.select(F.expr(ends).alias("end")), self.policy.windows.step)

    def _on_time(self, late: DataFrame) -> DataFrame:
        """key, window_start, window_end, parts and events of what is there when the watermark first passes the window."""
        agg, p, n = aggregate(self.policy.how), self.policy, F.count(F.lit(1)).alias("events")
        by = ["key", "window_start", "window_end"]
        # where the lag shrinks, the arrival that moves the watermark past a window may itself belong to it
        moving = late.where("seq = cross_seq").groupBy(*by).agg(*agg.of_rows(), n)
        if not p.panes:
            early = self.placed.where("NOT late").groupBy(*by).agg(*agg.of_rows(), n)
        else:  # a pane per width and first window that was open then
            pane, time = pane_width(p.windows.size, p.windows.step), F.col(p.time)
            opened = F.filter(p.windows.starts(time), lambda s: s + p.windows.size > F.col("wm"))
            rows = self.marked.where("kept").withColumn("opened", opened).where(F.size("opened") > 0)
            panes = rows.groupBy("key", (F.floor(time / pane) * pane).cast("long").alias("pane"), F.get("opened", F.lit(0)).alias("from")).agg(*agg.of_rows(), n)
            starts = F.filter(p.windows.starts(F.col("pane")), lambda s: (s >= F.col("from")) & (F.col("pane") + pane <= s + p.windows.size))
            parts = panes.withColumn("window_start", F.explode(starts)).withColumn("window_end", F.col("window_start") + p.windows.size)
            early = parts.groupBy(*by).agg(*agg.of_parts(), F.sum("events").alias("events"))
        return early.unionByName(moving).groupBy(*by).agg(*agg.of_parts(), F.sum("events").alias("events"))

    @property
    def final_watermark(self) -> DataFrame:
        return self.marked.where("kept").agg(F.max("wm").alias("final_wm"))

    @property
    def results(self) -> DataFrame:
        """First results, revisions and what is flushed at the end (seq null), in no order (see :func:`in_emission_order`)."""
        agg, by = aggregate(self.policy.how), ["key", "window_start", "window_end"]
        crossed = self._crossings("window_end").withColumnRenamed("end", "window_end")
        late = self.accepted.where("late").join(crossed, "window_end")
        groups = self._on_time(late).join(crossed, "window_end", "left").join(F.broadcast(self.final_watermark))  # one row
        firsts = groups.select(*by, F.col("cross_seq").alias("seq"), F.coalesce("cross_wm", "final_wm").alias("watermark"), *[f"part_{n}" for n in agg.parts], "events")
        own = Window.partitionBy(*by).orderBy("seq")
        after = late.where("seq > cross_seq").withColumns(agg.of_each(own.rowsBetween(0, 0)))
        after = after.select(*by, "seq", F.col("wm").alias("watermark"), *[f"part_{n}" for n in agg.parts], F.lit(1).cast("long").alias("events"))
        # the first of a window's rows is its first result; a window without arrivals on time fires at its first late one
        so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = firsts.unionByName(after).withColumns({"value": agg.running(so_far), "n": F.sum("events").over(so_far), "place": F.row_number().over(own)})
        return run.select(*by, "value", F.col("n").alias("events"), "watermark", (F.col("place") > 1).alias("revision"), "seq")

    @property
    def stats(self) -> DataFrame:
        """One row of counters."""
        p = self.policy
        arrivals = self.marked.agg(F.count(F.when(F.col("kept"), 1)).alias("processed"), F.count(F.when(~F.col("kept"), 1)).alias("duplicates_dropped"))
        # with panes, an arrival that any window accepts updates one pane
        updates = F.countDistinct(F.when(~F.col("too_late"), F.col("seq"))) if p.panes else F.count(F.when(~F.col("too_late"), 1))
        places = self.placed.agg(
            F.count(F.when(F.col("late") & ~F.col("too_late"), 1)).alias("late_but_accepted"), F.count(F.when(F.col("too_late"), 1)).alias("dropped_too_late"), updates.alias("aggregator_updates")
        )
        emitted = self.results.agg(F.count(F.when(~F.col("revision"), 1)).alias("windows_fired"), F.count(F.when(F.col("revision"), 1)).alias("revisions"))
        out = arrivals
        for part in (places, emitted, expired(self.marked, p.dedup_ttl, p.time), self._peak()):
            out = out.join(F.broadcast(part))  # one row each
        return out.select("processed", "duplicates_dropped", "dedup_expired", "late_but_accepted", "dropped_too_late", "windows_fired", "revisions", "aggregator_updates", "peak_state_entries")

    def _peak(self) -> DataFrame:
        """The most windows held at once: each is there from its first accepted event until the watermark passes its grace."""
        born = self.accepted.groupBy("key", "window_start", "window_end").agg(F.min("seq").alias("seq"))
        gone = self._crossings(f"window_end + {self.policy.lateness}").withColumn("window_end", F.col("end") - self.policy.lateness)
        ends = born.join(gone, "window_end", "left").where("cross_seq is not null").select(F.col("cross_seq").alias("seq"), F.lit(-1).alias("step"))
        steps = born.select("seq", F.lit(1).alias("step")).unionByName(ends).groupBy("seq").agg(F.sum("step").alias("step"))
        run = running_sum(steps.withColumn("bucket", F.expr("seq div 65536")), "bucket", "seq", "step", "held")
        return run.agg(F.coalesce(F.max("held"), F.lit(0)).cast("long").alias("peak_state_entries"))


def in_emission_order(results: DataFrame) -> DataFrame:
    """``results`` numbered from 1 (place) as they come out: by arrival; of one arrival revisions before first results, by
    window, then key; what is flushed at the end comes last."""
    bucket = F.coalesce(F.expr("seq div 65536"), F.lit((1 << 62)))
    return number(results.withColumn("bucket", bucket), "bucket", [F.asc_nulls_last("seq"), F.desc("revision"), "window_start", "window_end", "key"], "place").drop("bucket")


def report(stats: DataFrame) -> str:
    """The counters as lines of text."""
    return "\n".join(f"{name.replace('_', ' '):>20} {value}" for name, value in stats.first().asDict().items())


def tumbling_count(size: int, lag: int, **more) -> Policy:
    """Counts in tumbling windows under a fixed lag."""
    return Policy(Tumbling(size), BoundedLag(lag), "count", **more)
