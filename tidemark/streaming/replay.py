"""The late-data policy over micro-batches, exact per event, and restartable.

What one batch leaves for the next (the latest event time and watermark, ids not yet forgotten, windows not yet over, the
last delays) is a set of small tables in a folder per batch, beside its results and counters. A batch reads its
predecessor's folder and writes its own over whatever an earlier attempt left there, so a batch that runs twice changes
nothing. The state names the policy that made it; another one can't go on from it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.aggregates import aggregate
from ..functions.prefix import Running, bucket_width, running, running_sum
from ..functions.windows import Sessions
from ..operators.dedup import nameless
from ..operators.policy import Policy, crossings
from ..operators.watermark import NONE, BoundedLag, PercentileLag

#: The layout of the state, written along with it.
VERSION = 2
_META = "latest long, arrivals long, wm long, policy string, version int, batch int"


@dataclass
class Replay:
    """A policy that is applied to one batch after another; ``folder`` holds its state and results.

    ``process(batch, batch_id)`` suits ``foreachBatch``. A new object over the same folder goes on where the last left off.
    """

    spark: SparkSession
    policy: Policy
    folder: str

    def __post_init__(self):
        if isinstance(self.policy.windows, Sessions):
            raise ValueError("batches carry windows that stay what they are: sessions need Policy.run")
        if self.policy.dedup_ttl is not None and (self.policy.domain == "ingest" or isinstance(self.policy.watermark, PercentileLag)):
            raise ValueError("batches deduplicate by event time under a bounded lag: else use Policy.run")

    # -- state --

    def _path(self, name: str, batch_id: int) -> str:
        return f"{self.folder.rstrip('/')}/{name}/batch={batch_id}"

    def _meta(self, before: int) -> Row | None:
        """What the last batch before ``before`` left: its number, the latest event time, the watermark, arrivals so far."""
        try:
            rows = self.spark.read.schema(_META).parquet(f"{self.folder.rstrip('/')}/meta").where(F.col("batch") < before)
            last = rows.orderBy(F.desc("batch")).first()  # one row per batch
        except Exception as e:  # no batch has been written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        if last is not None and (last.version != VERSION or last.policy != self._named()):
            raise ValueError(f"the state in {self.folder} is of version {last.version} and policy {last.policy}")
        return last

    def _named(self) -> str:
        p = self.policy
        how = p.how if isinstance(p.how, str) else f"parts {', '.join(p.how.parts)}"
        return f"{p.windows}, {p.watermark}, {how}, lateness {p.lateness}, ids {p.dedup_ttl}, {p.domain}"

    def _read(self, name: str, last: Row | None, schema: str) -> DataFrame:
        if last is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(name, last.batch))

    # -- one batch --

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Judge the arrivals of a batch in order of ingest_time, event_id, is_retry; write results, side output, counters
        and state."""
        p, agg = self.policy, aggregate(self.policy.how)
        last = self._meta(batch_id)
        count = 0 if last is None else last.arrivals
        rows = batch.select("event_id", "event_time", "key", "value", "ingest_time", "is_retry")
        wanted = {"place": Running("count"), "seen": Running("max", "event_time"), "seen_before": Running("max", "event_time", inclusive=False)}
        rows = running(rows.withColumn("bucket", F.expr(f"ingest_time div {bucket_width(rows, 'ingest_time')}")), "bucket", ["ingest_time", "event_id", "is_retry"], wanted).withColumn("seq", F.col("place") + count)
        rows = self._timed(rows, last).persist()
        now = rows.agg(F.max("seen").alias("latest"), F.max("wm").alias("wm"), F.count(F.lit(1)).alias("n")).first()
        if not now.n:
            rows.unpersist()
            if last is not None:
                self._carry(batch_id, last)
            return
        latest = now.latest if last is None else max(last.latest, now.latest)
        kept, forgotten = self._kept(rows, last, batch_id, now.wm)

        kept = kept.persist()
        placed = kept.withColumn("window_start", F.explode(p.windows.starts(F.col(p.time)))).withColumn("window_end", F.col("window_start") + p.windows.size)
        placed = placed.withColumn("too_late", F.col("window_end") + p.lateness <= F.col("wm"))
        side = placed.where("too_late").select("seq", "event_time", "key", "value", "event_id", "ingest_time", "window_start", "window_end")
        side.write.mode("overwrite").parquet(self._path("side", batch_id))

        by, parts = ["key", "window_start", "window_end"], [f"part_{n}" for n in agg.parts]
        floor, one = NONE if last is None else last.wm, F.lit(1).cast("long").alias("events")
        accepted = placed.where("NOT too_late")
        early = accepted.where("window_end > wm").groupBy(*by).agg(*agg.of_rows(), F.count(F.lit(1)).alias("events"))
        held = self._open(last, early)
        steps = kept.select("wm", "seq").groupBy("wm").agg(F.min("seq").alias("seq"))
        ends = held.select(F.col("window_end").alias("end")).unionByName(accepted.select(F.col("window_end").alias("end")))
        crossed = crossings(steps, ends, p.windows.step).withColumnRenamed("end", "window_end")
        # as in one run: what is there when the watermark passes a window makes its first result, what is late comes after
        late = accepted.where("window_end <= wm").join(crossed, "window_end").withColumn("moving", (F.col("seq") == F.col("cross_seq")) & (F.col("window_end") > floor))
        moving = late.where("moving").groupBy(*by).agg(*agg.of_rows(), F.count(F.lit(1)).alias("events"))
        fresh = early.unionByName(moving).withColumn("fired", F.lit(False))
        firsts = held.unionByName(fresh).groupBy(*by).agg(*agg.of_parts(), F.sum("events").alias("events"), F.max("fired").alias("done")).join(crossed, "window_end", "left")
        firsts = firsts.select(*by, F.lit(0).alias("order"), F.col("cross_seq").alias("seq"), F.col("cross_wm").alias("watermark"), *parts, "events", "done")
        own = Window.partitionBy(*by).orderBy("order", "seq")
        after = late.where("NOT moving").withColumn("order", F.lit(1)).withColumns(agg.of_each(own.rowsBetween(0, 0)))
        after = after.select(*by, "order", "seq", F.col("wm").alias("watermark"), *parts, one, F.lit(False).alias("done"))
        both = firsts.unionByName(after).persist()

        so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = both.withColumns({"value": agg.running(so_far), "n": F.sum("events").over(so_far), "place": F.row_number().over(own)})
        out = run.where("order = 1 OR NOT done AND seq IS NOT NULL")
        out = out.select(*by, "value", F.col("n").alias("events"), "watermark", (F.col("place") > 1).alias("revision"), "seq")
        out.write.mode("overwrite").parquet(self._path("results", batch_id))

        left = both.groupBy(*by).agg(*agg.of_parts(), F.sum("events").alias("events"), F.max(F.col("done") | F.col("seq").isNotNull()).alias("fired"))
        left = left.where(F.col("window_end") + p.lateness > now.wm).select(*[F.col(f.name).cast(f.dataType) for f in early.schema.fields], "fired")
        left.write.mode("overwrite").parquet(self._path("open", batch_id))
        self._count(batch_id, kept, placed, forgotten, self._peak(accepted, steps, held), now.n)
        self._write_meta(batch_id, latest, count + now.n, now.wm)
        for held_rows in (both, kept, rows):
            held_rows.unpersist()

    def _timed(self, rows: DataFrame, last: Row | None) -> DataFrame:
        """``rows`` with wm and wm_before, which go on from what the last batch left."""
        mark = self.policy.watermark
        floor = F.lit(NONE if last is None else last.wm).cast("long")
        if isinstance(mark, BoundedLag):
            wm = lambda c: F.greatest(floor, F.col(c) - mark.lag)
            return rows.withColumn("wm", wm("seen")).withColumn("wm_before", F.coalesce(wm("seen_before"), floor))
        before = self._read("delays", last, "seq long, delay long")
        seen = F.col("seen") if last is None else F.greatest("seen", F.lit(last.latest))
        timed = mark.apply(rows.withColumn("latest", seen), before)
        return timed.withColumn("wm", F.greatest(floor, "wm")).withColumn("wm_before", F.greatest(floor, "wm_before"))

    def _kept(self, rows: DataFrame, last: Row | None, batch_id: int, after: int) -> tuple[DataFrame, DataFrame | None]:
        """The arrivals that are no duplicates, and the ids (one row each time) that the batch forgets; writes what later
        batches need of ids and delays."""
        if isinstance(self.policy.watermark, PercentileLag):
            most = self.policy.watermark.window - 1
            delays = rows.select("seq", F.greatest(F.col("ingest_time") - F.col("event_time"), F.lit(0)).cast("long").alias("delay"))
            delays.unionByName(self._read("delays", last, "seq long, delay long")).orderBy(F.desc("seq")).limit(most).write.mode("overwrite").parquet(self._path("delays", batch_id))
        ttl = self.policy.dedup_ttl
        if ttl is None:
            return rows, None
        schema = f"event_id {rows.schema['event_id'].dataType.simpleString()}, event_time long"
        before = self._read("ids", last, schema)
        known = before.select("event_id", F.lit(True).alias("known"))
        cutoff = F.col("wm_before") - ttl
        first = F.row_number().over(Window.partitionBy("event_id").orderBy("seq")) == 1
        marked = rows.join(known, "event_id", "left").withColumn("first", first)
        kept = marked.where(nameless() | (F.col("first") & F.col("known").isNull()) | ((cutoff >= 0) & (F.col("event_time") < cutoff))).drop("known", "first")
        held = before.unionByName(kept.where(~nameless()).select("event_id", "event_time"))
        end = after - ttl
        gone = F.lit(end >= 0) & (F.col("event_time") < end)
        held.distinct().where(~gone).write.mode("overwrite").parquet(self._path("ids", batch_id))
        return kept, held.where(gone)

    def _peak(self, accepted: DataFrame, steps: DataFrame, held: DataFrame) -> DataFrame:
        """(peak): the most windows held during the batch."""
        grace, by = self.policy.lateness, ["key", "window_start", "window_end"]
        new = accepted.groupBy(*by).agg(F.min("seq").alias("born")).join(held.select(*by), by, "left_anti")
        windows = new.unionByName(held.select(*by, F.lit(-1).cast("long").alias("born")))
        gone = crossings(steps, windows.select((F.col("window_end") + grace).alias("end")), self.policy.windows.step).select((F.col("end") - grace).alias("window_end"), F.col("cross_seq").alias("gone"))
        moves = windows.join(gone, "window_end", "left")
        born = moves.where("born >= 0").select(F.col("born").alias("seq"), F.lit(1).alias("step"))
        ended = moves.where("gone is not null").select(F.greatest("gone", "born").alias("seq"), F.lit(-1).alias("step"))
        each = born.unionByName(ended).groupBy("seq").agg(F.sum("step").alias("step")).withColumn("bucket", F.expr("seq div 65536"))
        most = running_sum(each, "bucket", "seq", "step", "held").agg(F.coalesce(F.max("held"), F.lit(0)).alias("most"))
        start = held.agg(F.count(F.lit(1)).alias("start"))
        return most.join(F.broadcast(start)).select((F.col("start") + F.greatest("most", F.lit(0))).cast("long").alias("peak_state_entries"))  # one row each

    def _count(self, batch_id: int, kept: DataFrame, placed: DataFrame, forgotten: DataFrame | None, peak: DataFrame, n: int) -> None:
        one = kept.agg(F.count(F.lit(1)).alias("processed"), (F.lit(n) - F.count(F.lit(1))).cast("long").alias("duplicates_dropped"))
        late = F.col("window_end") <= F.col("wm")
        windows = placed.agg(
            F.count(F.when(late & ~F.col("too_late"), 1)).alias("late_but_accepted"), F.count(F.when(F.col("too_late"), 1)).alias("dropped_too_late"), F.count(F.when(~F.col("too_late"), 1)).alias("aggregator_updates")
        )
        out = self.spark.read.parquet(self._path("results", batch_id))
        emitted = out.agg(F.count(F.when(~F.col("revision"), 1)).alias("windows_fired"), F.count(F.when(F.col("revision"), 1)).alias("revisions"))
        gone = self.spark.range(1).select(F.lit(0).cast("long").alias("dedup_expired")) if forgotten is None else forgotten.agg(F.count(F.lit(1)).alias("dedup_expired"))
        for part in (windows, emitted, gone, peak):
            one = one.join(F.broadcast(part))  # one row each
        one.write.mode("overwrite").parquet(self._path("stats", batch_id))

    def _open(self, last: Row | None, like: DataFrame) -> DataFrame:
        """Windows that the last batch left: their parts, and whether they have fired."""
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields)
        return self._read("open", last, f"{schema}, fired boolean")

    def _carry(self, batch_id: int, last: Row) -> None:
        """An empty batch leaves what it found."""
        for name in ("open", "ids", "delays"):
            try:
                self.spark.read.parquet(self._path(name, last.batch)).write.mode("overwrite").parquet(self._path(name, batch_id))
            except Exception as e:  # without deduplication there are no ids, without a quantile no delays
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        self._write_meta(batch_id, last.latest, last.arrivals, last.wm)

    def _write_meta(self, batch_id: int, latest: int, count: int, wm: int) -> None:
        made = [F.lit(latest).cast("long").alias("latest"), F.lit(count).cast("long").alias("arrivals"), F.lit(wm).cast("long").alias("wm"), F.lit(self._named()).alias("policy"), F.lit(VERSION).alias("version")]
        self.spark.range(1).select(*made).write.mode("overwrite").parquet(self._path("meta", batch_id))

    # -- what has come out --

    def results(self) -> DataFrame:
        """All first results and revisions so far."""
        return self.spark.read.parquet(f"{self.folder.rstrip('/')}/results").drop("batch")

    def side_output(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.rstrip('/')}/side").drop("batch")

    def flushed(self) -> DataFrame:
        """What closing the stream would add: windows that no watermark has passed (seq null)."""
        last, agg = self._meta(1 << 30), aggregate(self.policy.how)
        held = self.spark.read.parquet(self._path("open", last.batch)).where("NOT fired")
        return held.select("key", "window_start", "window_end", agg.value().alias("value"), "events", F.lit(last.wm).cast("long").alias("watermark"), F.lit(False).alias("revision"), F.lit(None).cast("long").alias("seq"))

    def stats(self) -> DataFrame:
        """One row of counters over all batches, as if the stream closed now."""
        names = ["processed", "duplicates_dropped", "dedup_expired", "late_but_accepted", "dropped_too_late", "windows_fired", "revisions", "aggregator_updates"]
        all_batches = self.spark.read.parquet(f"{self.folder.rstrip('/')}/stats").agg(*[F.sum(n).alias(n) for n in names], F.max("peak_state_entries").alias("peak_state_entries"))
        flushed = self.flushed().agg(F.count(F.lit(1)).alias("open"))
        return all_batches.join(F.broadcast(flushed)).withColumn("windows_fired", F.col("windows_fired") + F.col("open")).drop("open")  # one row each


def start(stream: DataFrame, replay: Replay, checkpoint: str):
    """Run ``replay`` over all that ``stream`` has; returns the query."""
    return stream.writeStream.foreachBatch(replay.process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
