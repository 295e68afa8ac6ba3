"""Streams of arrivals: the table ``events`` as it would arrive, and streams generated with known truth.

Columns: seq (place in the order of arrival), event_time, ingest_time (seconds), key, user_id, value, event_id, is_retry.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.aggregates import SUM
from ..functions.prefix import Running, bucket_width, running
from .tables import table

#: Keys of a generated law up to which its table is broadcast.
MOST_KEYS = 100_000


def in_order(rows: DataFrame, bucket_seconds: int | None = None) -> DataFrame:
    """``rows`` numbered by ingest_time, event_id, is_retry (seq), with the latest event time up to and before each
    (latest, latest_before), which watermarks are made of. Time buckets are numbered apart, about a million rows each
    unless their seconds are named; no task holds all rows."""
    bucket_seconds = bucket_seconds or bucket_width(rows, "ingest_time")
    order = ["ingest_time", "event_id", "is_retry"]
    wanted = {"seq": Running("count"), "latest": Running("max", "event_time"), "latest_before": Running("max", "event_time", inclusive=False)}
    return running(rows.withColumn("bucket", F.expr(f"ingest_time div {bucket_seconds}")), "bucket", order, wanted)


def checked(rows: DataFrame) -> DataFrame:
    """``rows``, failing on times that cannot be: negative ones, and arrivals before the event (ingest_time 0: unset)."""
    bad = F.when(F.col("event_time") < 0, F.raise_error(F.lit("event times are seconds and not negative"))).when(
        (F.col("ingest_time") != 0) & (F.col("ingest_time") < F.col("event_time")), F.raise_error(F.lit("ingested before it happened: clocks disagree"))
    )
    return rows.withColumn("event_time", F.coalesce(bad.cast("long"), F.col("event_time")))


def delay() -> Column:
    return F.greatest(F.col("ingest_time") - F.col("event_time"), F.lit(0))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``events`` with delays of up to half an hour, 2 % of 12 to 24 hours, and 3 % sent twice, all by event_id."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("event_time"), F.col("event_type").alias("key"), "user_id", "value")
    late = F.when((F.col("event_id") * 7919 + 104729) % 1000 < 20, 43200 + (F.col("event_id") * 31) % 43200).otherwise((F.col("event_id") * 1237) % 1801)
    first = e.withColumn("ingest_time", F.col("event_time") + late).withColumn("is_retry", F.lit(0))
    again = first.where((F.col("event_id") * 3571 + 17) % 1000 < 30).withColumn("ingest_time", F.col("ingest_time") + 1 + (F.col("event_id") * 53) % 1800).withColumn("is_retry", F.lit(1))
    return in_order(first.unionByName(again))


def _unit(salt: str, *columns: Column | str) -> Column:
    """A number in (0, 1) that follows from a salt and columns."""
    return (F.pmod(F.xxhash64(F.lit(salt), *columns), F.lit(1 << 30)) + 0.5) / (1 << 30)


def mixed_stream(
    spark: SparkSession, n: int = 4000, keys: tuple[str, ...] = ("checkout", "search", "signup", "refund"), horizon: int = 600, typical_delay: int = 4,
    max_delay: int = 20, late_fraction: float = 0.02, late_delay: int = 400, duplicate_fraction: float = 0.03, seed: int = 0,
) -> DataFrame:
    """Keyed events with exponential delays, some very late and some sent twice; the key ``refund`` takes money away."""
    if not 0 <= late_fraction < 1:
        raise ValueError("late_fraction must lie in [0, 1)")
    u = lambda what: _unit(f"{seed}:{what}", "id")
    kinds = F.array(*[F.lit(k) for k in keys])
    typical = F.least((-F.log(u("delay")) * typical_delay).cast("long"), F.lit(max_delay).cast("long"))
    late = (late_delay + F.floor(u("late") * (late_delay + 1))).cast("long")
    rows = spark.range(n).select(
        F.col("id").alias("event_id"),
        F.floor(u("time") * horizon).cast("long").alias("event_time"),
        F.element_at(kinds, (F.floor(u("key") * len(keys)) + 1).cast("int")).alias("key"),
        (u("is late") < late_fraction).alias("is_late"),
        F.when(u("is late") < late_fraction, late).otherwise(typical).alias("delay"),
        F.round(1 + u("value") * 49, 2).alias("gain"), F.round(-1 - u("value") * 29, 2).alias("loss"),
        (u("again") < duplicate_fraction).alias("again"), (1 + F.floor(u("gap") * 30)).cast("long").alias("gap"),
    )
    rows = rows.select("*", F.col("event_id").alias("user_id"), F.when(F.col("key") == "refund", F.col("loss")).otherwise(F.col("gain")).alias("value"))
    copies = F.when(F.col("again"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    sent = rows.withColumn("is_retry", F.explode(copies)).withColumn("ingest_time", F.col("event_time") + F.col("delay") + F.col("is_retry") * F.col("gap"))
    return in_order(sent.select("event_id", "event_time", "key", "user_id", "value", "ingest_time", "is_retry", "is_late"), max(60, horizon // 16))


def sessions_stream(spark: SparkSession, users: int = 40, horizon: int = 3600, gap: int = 60, seed: int = 0) -> DataFrame:
    """Users who act in bursts: steps within a burst stay far below ``gap``, pauses between bursts beyond it."""
    u = lambda what, *columns: _unit(f"{seed}:{what}", "id", *columns)
    bursts = spark.range(users).select("id", F.explode(F.sequence(F.lit(1), (1 + F.floor(u("bursts") * 4)).cast("int"))).alias("burst"))
    acts = bursts.select("id", "burst", F.explode(F.sequence(F.lit(1), (2 + F.floor(u("acts", "burst") * 7)).cast("int"))).alias("act"))
    step = 1 + F.floor(u("step", "burst", "act") * max(gap // 4, 2))
    pause = F.when((F.col("act") == 1) & (F.col("burst") > 1), gap + 5 + F.floor(u("pause", "burst") * (gap - 4))).otherwise(0)
    start = F.floor(u("start") * (horizon / 2))
    so_far = Window.partitionBy("id").orderBy("burst", "act").rowsBetween(Window.unboundedPreceding, 0)
    timed = acts.withColumn("event_time", (start + F.sum(step + pause).over(so_far)).cast("long")).where(F.col("event_time") <= horizon)
    late = F.least((-F.log(u("delay", "burst", "act")) * 2).cast("long"), F.lit(5).cast("long"))
    rows = timed.select(
        (F.col("id") * 1000 + F.col("burst") * 100 + F.col("act")).alias("event_id"), "event_time", F.format_string("user%03d", "id").alias("key"), F.col("id").alias("user_id"),
        F.lit(1.0).alias("value"), (F.col("event_time") + late).alias("ingest_time"), F.lit(0).alias("is_retry"),
    )
    return in_order(rows, max(60, horizon // 16))


def skewed_stream(spark: SparkSession, n: int = 20000, distinct_keys: int = 5000, exponent: float = 1.1, seed: int = 0) -> DataFrame:
    """Keys by a Zipf law, one arrival a second: each draw is looked up in the law's cumulative shares."""
    total = list(accumulate(1 / (k + 1) ** exponent for k in range(distinct_keys)))
    cells = 4096  # the shares as a table, cut into equal cells so that each draw meets few candidates
    cdf = spark.createDataFrame([(k, (total[k - 1] if k else 0.0) / total[-1], t / total[-1]) for k, t in enumerate(total)], "k int, low double, high double")
    cdf = cdf.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))))
    drawn = spark.range(n).withColumn("u", _unit(f"{seed}:zipf", "id")).withColumn("cell", F.floor(F.col("u") * cells))
    cdf = F.broadcast(cdf) if distinct_keys <= MOST_KEYS else cdf  # a few rows per key
    keyed = drawn.join(cdf, (drawn.cell == cdf.cell) & (drawn.u >= cdf.low) & (drawn.u < cdf.high)).select("id", "k")
    rows = keyed.select(F.col("id").alias("event_id"), F.col("id").alias("event_time"), F.format_string("k%05d", "k").alias("key"), F.col("id").alias("user_id"), F.lit(1.0).alias("value"), F.col("id").alias("ingest_time"), F.lit(0).alias("is_retry"))
    return in_order(rows, max(1, n // 16))


STREAMS = {"mixed": mixed_stream, "sessions": sessions_stream, "skewed": skewed_stream}


def unique_events(stream: DataFrame) -> DataFrame:
    """The first arrival of each event_id."""
    return stream.groupBy("event_id").agg(F.min_by(F.struct(*stream.columns), "seq").alias("x")).select("x.*")


def true_total(stream: DataFrame, key: str | None = None) -> DataFrame:
    """(total): the sum of value over unique events, of one key if named."""
    rows = unique_events(stream)
    rows = rows if key is None else rows.where(F.col("key") == key)
    return rows.agg(*SUM.of_rows()).select(SUM.value().alias("total"))


def summary(stream: DataFrame) -> DataFrame:
    """Arrivals, unique events, duplicates, upper median and largest delay: one row, from counts per delay."""
    per_delay = stream.groupBy(delay().alias("delay")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("delay").rowsBetween(Window.unboundedPreceding, 0)  # one row per delay
    ranked = per_delay.select("delay", F.sum("n").over(order).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("arrivals"))
    delays = ranked.agg(F.min(F.when(F.col("upto") > F.expr("arrivals div 2"), F.col("delay"))).alias("median_delay"), F.max("delay").alias("max_delay"))
    counts = stream.agg(F.count(F.lit(1)).alias("arrivals"), F.countDistinct("event_id").alias("unique_events"))
    return counts.join(F.broadcast(delays)).select("arrivals", "unique_events", (F.col("arrivals") - F.col("unique_events")).alias("duplicates"), "median_delay", "max_delay")  # one row each
