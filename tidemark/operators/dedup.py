"""Deduplication by event_id, for good or for a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.prefix import Running, bucket_width, running


def nameless() -> Column:
    """Whether a row has no id."""
    return F.col("event_id").isNull() | (F.col("event_id").cast("string") == "")


def mark_kept(arrivals: DataFrame, ttl: int | None, time: str = "event_time") -> DataFrame:
    """``arrivals`` (with wm_before) with kept: whether the arrival is not a duplicate.

    Without ``ttl`` all are kept. With it, an id is forgotten once the watermark has passed its ``time`` by more than
    ``ttl``; an arrival is kept if it is the first of its id or its id has been forgotten. Arrivals of an id share their
    event time and so cannot move the watermark; by event time, this makes the rule one expression per row. By another
    time it depends on which arrival was kept last: an id's arrivals then pass a task in order, as a stream. Rows without
    an id (null or empty) are always kept.
    """
    if ttl is None:
        return arrivals.withColumn("kept", F.lit(True))
    if ttl < 0:
        raise ValueError("the time to live must not be negative")
    if time != "event_time":
        return _kept_in_order(arrivals, ttl, time)
    first = F.row_number().over(Window.partitionBy("event_id").orderBy("seq")) == 1
    cutoff = F.col("wm_before") - ttl
    return arrivals.withColumn("kept", nameless() | first | ((cutoff >= 0) & (F.col("event_time") < cutoff)))


def _kept_in_order(arrivals: DataFrame, ttl: int, time: str) -> DataFrame:
    names = arrivals.columns
    at = {n: i for i, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = None, None
        for batch in batches:
            kept = []
            for ident, t, found in zip(*(batch.column(at[c]).to_pylist() for c in ("event_id", time, "wm_before")), strict=True):
                fresh = ident is None or ident == "" or ident != own or (found - ttl >= 0 and last < found - ttl)
                if fresh:
                    own, last = ident, t
                kept.append(fresh)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.bool_())], names=[*names, "kept"])

    lone = F.when(nameless(), F.col("seq")).otherwise(0)  # rows without an id need no order
    dealt = arrivals.repartition("event_id", lone).sortWithinPartitions("event_id", "seq")
    return dealt.mapInArrow(run, arrivals.withColumn("kept", F.lit(True)).schema)


def settle(arrivals: DataFrame, watermark, ttl: int, time: str = "event_time") -> DataFrame:
    """``arrivals`` with wm, wm_before and kept, where duplicates do not count in the watermark, and which are duplicates
    depends on the watermark.

    From a guess at what is kept follows a watermark, and from that what is kept. Since the watermark an arrival finds
    depends on earlier arrivals alone, each round is right at least up to the first row that was wrong in the round
    before: when nothing changes any more, all rows are what one pass in order would give.
    """
    first = F.row_number().over(Window.partitionBy("event_id").orderBy("seq")) == 1
    now = cut(arrivals.withColumn("kept", nameless() | first))
    width = bucket_width(arrivals, "seq", 1 << 20)
    before = None
    while True:
        plain = now.where("kept").select("seq", "event_time", "ingest_time")
        numbered = running(plain.withColumn("bucket", F.expr(f"seq div {width}")), "bucket", ["seq"], {"place": Running("count")})
        marks = watermark.apply(numbered.select(F.col("place").alias("seq"), F.col("seq").alias("arrival"), "event_time", "ingest_time", "bucket"))
        both = now.drop("wm", "wm_before", "kept").join(marks.select(F.col("arrival").alias("seq"), F.col("wm").alias("moved")), "seq", "left").withColumn("bucket", F.expr(f"seq div {width}"))
        # the watermark never goes back: what an arrival finds is the largest so far
        run = running(both, "bucket", ["seq"], {"wm": Running("max", "moved"), "wm_before": Running("max", "moved", inclusive=False)})
        none = F.lit(-1).cast("long")
        filled = run.withColumns({"wm": F.coalesce("wm", none), "wm_before": F.coalesce("wm_before", none)}).drop("moved")
        now = cut(mark_kept(filled, ttl, time))
        got = now.agg(F.count(F.when(F.col("kept"), 1)), F.sum(F.when(F.col("kept"), F.col("seq"))), F.expr("bit_xor(CASE WHEN kept THEN xxhash64(seq) END)")).first()
        if got == before:
            return now
        before = got


def expired(kept: DataFrame, ttl: int | None, time: str = "event_time") -> DataFrame:
    """(dedup_expired): how many ids were forgotten by the end, counted each time."""
    if ttl is None:
        return kept.sparkSession.range(1).select(F.lit(0).cast("long").alias("dedup_expired"))
    last = F.max("wm") - ttl
    times = F.col(time)
    # ids forgotten: kept arrivals whose event time lies below the last cutoff; one pass over counts per event time
    per_time = kept.where("kept").where(~nameless()).groupBy(times.alias("t")).agg(F.count(F.lit(1)).alias("n"))
    end = kept.where("kept").agg(last.alias("cutoff"))
    hit = (F.col("cutoff") >= 0) & (F.col("t") < F.col("cutoff"))
    return per_time.join(F.broadcast(end)).agg(F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).cast("long").alias("dedup_expired"))  # end: one row
