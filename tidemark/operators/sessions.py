"""Sessions under the late-data policy: they grow and merge as arrivals come, fire, and are purged.

Arrivals of a key that could ever meet lie in one island: a stretch of event time without a pause longer than the gap. Islands
come from running maxima over buckets of time, so no task holds a key; an island's arrivals then pass a task in order, as a
stream, and what is held is the parts of sessions that are not yet over. When a session fires without a new arrival of its
own is looked up afterwards, among the moves of the watermark over all keys.

Sessions know no arrival that is too late: one whose session is gone opens a session of its own, which fires at once. If
exactly that session has fired before, the arrival goes to the side output instead of overwriting a result. A session that
grows after it fired (within the grace) is a revision, and says which results it replaces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import SUM, Mergeable, aggregate
from ..functions.lineage import cut
from ..functions.prefix import bucket_width, running_sum
from .dedup import expired

#: How parts that these functions merge are merged row by row; the others are united as sets.
_MERGES = {F.sum: add, F.min: min, F.max: max}


def _merger(agg: Mergeable) -> list[Callable]:
    def either(merge: Callable) -> Callable:
        return lambda a, b: b if a is None else a if b is None else merge(a, b)

    out = []
    for name, how in agg.merge.items():
        if isinstance(how, tuple) and how[0] is F.collect_list:
            out.append(either(lambda a, b: list(dict.fromkeys([*a, *b]))))
        elif how in _MERGES:
            out.append(either(_MERGES[how]))
        else:
            raise ValueError(f"part {name!r} can't be merged arrival by arrival")
    return out


def islands(rows: DataFrame, gap: int) -> DataFrame:
    """``rows`` (key, event_time) with island: the start of the stretch of the key's event times, without a pause beyond
    ``gap``, that the row lies in."""
    width = max(gap, bucket_width(rows, "event_time"))
    rows = rows.withColumn("bucket", F.expr(f"event_time div {width}"))
    own = Window.partitionBy("key", "bucket").orderBy("event_time")
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    ends = rows.groupBy("key", "bucket").agg(F.max("event_time").alias("end")).withColumn("before", F.max("end").over(earlier)).drop("end")
    after = lambda t: F.when(F.col("event_time") - F.coalesce(t, F.lit(-(1 << 60))) > gap, F.col("event_time"))
    begun = rows.join(ends, ["key", "bucket"]).withColumn("begin", after(F.coalesce(F.lag("event_time").over(own), F.col("before")))).drop("before")
    last = begun.groupBy("key", "bucket").agg(F.max("begin").alias("begin")).withColumn("carried", F.max("begin").over(earlier)).drop("begin")
    upto = own.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return begun.join(last, ["key", "bucket"]).withColumn("island", F.coalesce(F.max("begin").over(upto), "carried")).drop("begin", "carried", "bucket")


@dataclass
class SessionOutcome:
    """What sessions give under a policy (see :mod:`tidemark.operators.policy`)."""

    policy: object
    marked: DataFrame

    def __post_init__(self):
        self._stepped = None

    @property
    def steps(self) -> DataFrame:
        """Every state of every session: key, window_start, window_end, parts, events, seq and wm of the arrival that made
        it, upto (the arrival that replaced it) and left (the watermark that one found), whether a result was there
        before, what it replaces, and whether the arrival had no place (aside)."""
        if self._stepped is None:
            self._stepped = cut(self._steps())
        return self._stepped

    def _steps(self) -> DataFrame:
        agg, gap, lateness = aggregate(self.policy.how), self.policy.windows.gap, self.policy.lateness
        merges, parts = _merger(agg), [f"part_{n}" for n in agg.parts]
        one = Window.partitionBy("seq").orderBy("seq").rowsBetween(0, 0)
        rows = self.marked.where("kept").withColumns(agg.of_each(one)).select("key", "event_time", "seq", "wm", "wm_before", *parts)
        rows = islands(rows, gap).repartition("key", "island").sortWithinPartitions("key", "island", "seq")
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        fields = {"key": kinds["key"], "window_start": "long", "window_end": "long", "seq": "long", "wm": "long", "upto": "long", "left": "long", "before": "boolean", "aside": "boolean", "replaces": "array<struct<window_start:long,window_end:long>>", "events": "long"} | {p: kinds[p] for p in parts}
        schema = ", ".join(f"`{n}` {t}" for n, t in fields.items())
        n = len(parts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, held, fired, out = None, [], set(), []
            kind_of: dict[str, pa.DataType] = {}

            def batch() -> pa.RecordBatch:
                struct = pa.list_(pa.struct([("window_start", pa.int64()), ("window_end", pa.int64())]))
                fixed = {"key": kind_of["key"], "before": pa.bool_(), "aside": pa.bool_(), "replaces": struct} | {p: kind_of[p] for p in parts}
                columns = list(zip(*out, strict=True)) or [[] for _ in fields]
                return pa.RecordBatch.from_arrays([pa.array(c, fixed.get(name, pa.int64())) for c, name in zip(columns, fields, strict=True)], names=list(fields))

            def end(s: list, seq: int | None, wm: int | None) -> None:
                # s: start, end, parts, events, seq, wm, had a result before, replaces
                out.append((place[0], s[0], s[1], s[4], s[5], seq, wm, s[6], False, [{"window_start": a, "window_end": b} for a, b in s[7]], s[3], *s[2]))

            for rows in batches:
                kind_of = {name: rows.schema.field(name).type for name in ("key", *parts)}
                names = rows.schema.names
                for row in zip(*(rows.column(i).to_pylist() for i in range(rows.num_columns)), strict=True):
                    x = dict(zip(names, row, strict=True))
                    if place != (x["key"], x["island"]):
                        for s in held:
                            end(s, None, None)
                        place, held, fired = (x["key"], x["island"]), [], set()
                    t, seq, wm, found = x["event_time"], x["seq"], x["wm"], x["wm_before"]
                    for s in [s for s in held if s[1] + lateness <= found]:  # fired since, and over
                        fired.add((s[0], s[1]))
                        held.remove(s)
                        end(s, None, None)
                    touched = [s for s in held if s[0] <= t + gap and t <= s[1]]
                    start, stop = min([t, *(s[0] for s in touched)]), max([t + gap, *(s[1] for s in touched)])
                    if not touched and (start, stop) in fired:
                        out.append((x["key"], start, stop, seq, wm, None, None, False, True, [], 0, *[x[p] for p in parts]))
                        continue
                    values, events, replaces = [x[p] for p in parts], 1, []
                    for s in touched:
                        values = [merges[i](s[2][i], values[i]) for i in range(n)]
                        events += s[3]
                        if s[1] <= found:  # its result is out
                            replaces.append((s[0], s[1]))
                        else:  # what it would have replaced is still to be replaced
                            replaces += s[7]
                        fired.discard((s[0], s[1]))
                        held.remove(s)
                        end(s, seq, found)
                    held.append([start, stop, values, events, seq, wm, bool(replaces), replaces])
                    if len(out) >= 5000:
                        yield batch()
                        out.clear()
            if place is not None:
                for s in held:
                    end(s, None, None)
            if out:
                yield batch()

        return rows.mapInArrow(run, schema)

    def _crossings(self, ends: str) -> DataFrame:
        from .policy import crossings

        moves = self.marked.where("kept AND (wm > wm_before OR seq = 1)").select("wm", "seq")
        return crossings(moves, self.steps.where("NOT aside").select(F.expr(ends).alias("end")), max(self.policy.windows.gap, 60))

    @property
    def side_output(self) -> DataFrame:
        """Arrivals whose session had fired and was gone, and would have been the same one."""
        aside = self.steps.where("aside").select("seq", "window_start", "window_end")
        return self.marked.join(aside, "seq").select("seq", "event_time", "key", "value", "event_id", "ingest_time", "window_start", "window_end")

    @property
    def results(self) -> DataFrame:
        """Results as of tumbling windows, and replaces: the windows of earlier results that this one takes the place of."""
        agg = aggregate(self.policy.how)
        crossed = self._crossings("window_end").withColumnRenamed("end", "window_end")
        rows = self.steps.where("NOT aside").join(crossed, "window_end", "left").join(F.broadcast(self.marked.where("kept").agg(F.max("wm").alias("final_wm"))))  # one row
        at_once = F.col("window_end") <= F.col("wm")  # the arrival found the watermark beyond its session's end
        later = F.col("upto").isNull() | (F.col("window_end") <= F.col("left"))
        rows = rows.where(at_once | later)
        pick = lambda now, then: F.when(at_once, now).otherwise(then)
        return rows.select(
            "key", "window_start", "window_end", agg.value().alias("value"), "events", pick(F.col("wm"), F.coalesce("cross_wm", "final_wm")).alias("watermark"),
            F.col("before").alias("revision"), pick(F.col("seq"), F.col("cross_seq")).alias("seq"), "replaces",
        )

    @property
    def stats(self) -> DataFrame:
        """One row of counters, as for other windows; sessions have no late arrivals."""
        counts = self.marked.agg(F.count(F.when(F.col("kept"), 1)).alias("processed"), F.count(F.when(~F.col("kept"), 1)).alias("duplicates_dropped"))
        steps = self.steps.agg(F.lit(0).cast("long").alias("late_but_accepted"), F.count(F.when(F.col("aside"), 1)).alias("dropped_too_late"), F.count(F.when(~F.col("aside"), 1)).alias("aggregator_updates"))
        emitted = self.results.agg(F.count(F.when(~F.col("revision"), 1)).alias("windows_fired"), F.count(F.when(F.col("revision"), 1)).alias("revisions"))
        out = counts
        for part in (steps, emitted, expired(self.marked, self.policy.dedup_ttl, self.policy.time), self._peak()):
            out = out.join(F.broadcast(part))  # one row each
        return out.select("processed", "duplicates_dropped", "dedup_expired", "late_but_accepted", "dropped_too_late", "windows_fired", "revisions", "aggregator_updates", "peak_state_entries")

    def _peak(self) -> DataFrame:
        """The most sessions held after an arrival: each from the arrival that made it until one replaced it, or the first
        whose watermark is past its grace."""
        lateness = self.policy.lateness
        gone = self._crossings(f"window_end + {lateness}").withColumn("window_end", F.col("end") - lateness).select("window_end", "cross_seq")
        held = self.steps.where("NOT aside").join(gone, "window_end", "left").select("seq", F.coalesce("upto", F.when(F.col("cross_seq").isNotNull(), F.greatest("cross_seq", "seq"))).alias("until"))
        moves = held.select("seq", F.lit(1).alias("step")).unionByName(held.where("until is not null").select(F.col("until").alias("seq"), F.lit(-1).alias("step")))
        run = running_sum(moves.groupBy("seq").agg(F.sum("step").alias("step")).withColumn("bucket", F.expr("seq div 65536")), "bucket", "seq", "step", "held")
        return run.agg(F.coalesce(F.max("held"), F.lit(0)).cast("long").alias("peak_state_entries"))


def current(results: DataFrame) -> DataFrame:
    """The results that no other replaces: of a key and window the last one."""
    gone = results.select("key", F.explode("replaces").alias("x"), F.coalesce("seq", F.lit(1 << 62)).alias("by")).select("key", "x.window_start", "x.window_end", "by")
    last = gone.groupBy("key", "window_start", "window_end").agg(F.max("by").alias("by"))
    seq: Column = F.coalesce("seq", F.lit(1 << 62))
    left = results.join(last, ["key", "window_start", "window_end"], "left").where(F.col("by").isNull() | (seq > F.col("by")) | F.exists("replaces", lambda x: (x.window_start == F.col("window_start")) & (x.window_end == F.col("window_end"))) & (seq == F.col("by")))
    return left.drop("by")


def totals(results: DataFrame) -> DataFrame:
    """key, total, events over all sessions that stand."""
    return current(results).groupBy("key").agg(*SUM.of_rows(), F.sum("events").alias("events")).select("key", SUM.value().alias("total"), "events")
