"""Heavy hitters: exact counts, and Space-Saving in order or merged from parts."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_topk(arrivals: DataFrame, k: int, key: str = "key") -> DataFrame:
    """key, count, rank of the ``k`` most frequent keys; ties go to the smaller key."""
    counts = arrivals.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("count"))
    top = counts.orderBy(F.desc("count"), "key").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "key")).cast("int"))  # k rows


class SpaceSaving:
    """At most ``capacity`` counters over a stream. A key without one takes over the smallest (ties: the smaller key) and
    inherits its count, which bounds by how much it may be too high."""

    def __init__(self, capacity: int = 64):
        if capacity < 1:
            raise ValueError("the capacity must be at least 1")
        self.capacity, self.total = capacity, 0
        self.counters: dict[str, list[int]] = {}
        self._heap: list[tuple[int, str]] = []

    def observe(self, key: str, times: int = 1) -> None:
        self.total += times
        own = self.counters.get(key)
        if own is not None:
            own[0] += times
            return
        count = error = 0
        if len(self.counters) >= self.capacity:
            while True:  # entries of counters that have grown since are put back where they belong
                least, loser = self._heap[0]
                if self.counters[loser][0] == least:
                    heapq.heappop(self._heap)
                    break
                heapq.heapreplace(self._heap, (self.counters[loser][0], loser))
            count = error = self.counters.pop(loser)[0]
        self.counters[key] = [count + times, error]
        heapq.heappush(self._heap, (count + times, key))

    @property
    def epsilon(self) -> float:
        return 1 / self.capacity

    @property
    def min_count(self) -> float:
        """Keys more frequent than this are sure to have a counter."""
        return self.epsilon * self.total

    def top(self, k: int) -> list[tuple[str, int, int]]:
        return [(key, c, e) for key, (c, e) in sorted(self.counters.items(), key=lambda x: (-x[1][0], x[0]))[:k]]

    def guaranteed_top(self, k: int) -> list[tuple[str, int, int]]:
        """Those of the top ``k`` that are surely frequent; so there may be fewer."""
        return [x for x in self.top(k) if x[1] - x[2] >= self.min_count]

    def state(self) -> dict:
        return {"capacity": self.capacity, "total": self.total, "counters": [[k, c, e] for k, (c, e) in sorted(self.counters.items())]}

    @classmethod
    def restore(cls, state: dict) -> SpaceSaving:
        new = cls(state["capacity"])
        new.total = state["total"]
        new.counters = {k: [c, e] for k, c, e in state["counters"]}
        new._heap = [(c, k) for k, (c, _) in new.counters.items()]
        heapq.heapify(new._heap)
        return new

    def merge(self, other: SpaceSaving) -> SpaceSaving:
        """The summary of both streams: a key that one side lacks may have had that side's smallest count there."""
        full = lambda s: min(c for c, _ in s.counters.values()) if len(s.counters) >= s.capacity else 0
        low, new = {id(s): full(s) for s in (self, other)}, SpaceSaving(self.capacity)
        for key in {*self.counters, *other.counters}:
            parts = [s.counters.get(key, [low[id(s)], low[id(s)]]) for s in (self, other)]
            new.counters[key] = [parts[0][0] + parts[1][0], parts[0][1] + parts[1][1]]
        new.counters = {k: list(v) for k, v in sorted(new.counters.items(), key=lambda x: (-x[1][0], x[0]))[: self.capacity]}
        new._heap = [(c, k) for k, (c, _) in new.counters.items()]
        heapq.heapify(new._heap)
        new.total = self.total + other.total
        return new


_SKETCH = "key string, count long, error long, total long"


def _rows(sketch: SpaceSaving) -> pd.DataFrame:
    out = pd.DataFrame([(k, c, e, sketch.total) for k, c, e in sketch.top(sketch.capacity)], columns=["key", "count", "error", "total"])
    return out.astype({"count": "int64", "error": "int64", "total": "int64"})


def space_saving(arrivals: DataFrame, capacity: int, key: str = "key") -> DataFrame:
    """key, count, error, total: the counters after all arrivals in order of seq.

    The state after each arrival depends on the one before, so the arrivals pass one task, in order, as a stream; it
    holds ``capacity`` counters. Use :func:`mergeable_sketch` where bounds will do.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = SpaceSaving(capacity)
        for batch in batches:
            for x in batch["key"]:
                sketch.observe(x)
        yield _rows(sketch)

    in_order = arrivals.select(F.col(key).cast("string").alias("key"), "seq").repartition(1).sortWithinPartitions("seq")
    return in_order.select("key").mapInPandas(run, _SKETCH)


def mergeable_sketch(arrivals: DataFrame, capacity: int, key: str = "key", fan_in: int = 64, parts: int = 4096) -> DataFrame:
    """key, count, error, total: a summary of the same bounds (count - error <= true <= count) from summaries of parts.

    Each task summarises its rows; summaries, of which there are ``parts`` kinds at most, are merged ``fan_in`` kinds at a
    time until one is left. Tasks beyond ``parts`` share a kind, and those are merged first.
    """

    def part(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = SpaceSaving(capacity)
        for batch in batches:
            for x, n in batch["key"].value_counts(sort=False).items():
                sketch.observe(x, int(n))
        yield _rows(sketch)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for _, own in group.groupby(["part", "maker"]):
            sketch = SpaceSaving.restore({"capacity": capacity, "total": int(own["total"].iloc[0]), "counters": own[["key", "count", "error"]].values.tolist()})
            whole = sketch if whole is None else whole.merge(sketch)
        return _rows(whole).assign(part=int(group["part"].iloc[0]) // fan_in, maker=0).astype({"maker": "int32"})

    sketches = arrivals.select(F.col(key).cast("string").alias("key")).mapInPandas(part, _SKETCH)
    sketches = sketches.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(parts)).cast("long")).withColumn("maker", F.spark_partition_id())
    while parts > 1:  # the number of rounds follows from ``parts`` alone, not from how the input happens to be cut
        sketches = sketches.groupBy(F.expr(f"part div {fan_in}")).applyInPandas(merge, f"{_SKETCH}, part long, maker int")
        parts = -(-parts // fan_in)
    return sketches.drop("part", "maker")


def top_of(sketch: DataFrame, k: int) -> DataFrame:
    return sketch.orderBy(F.desc("count"), "key").limit(k)


def guaranteed_top(sketch: DataFrame, capacity: int, k: int) -> DataFrame:
    return top_of(sketch, k).where(F.col("count") - F.col("error") >= F.col("total") / F.lit(capacity))


def topk_agreement(arrivals: DataFrame, sketch: DataFrame, k: int, key: str = "key") -> DataFrame:
    """overlap, worst_relative_error, distinct_keys: the sketch's top ``k`` held against the true one."""
    counts = arrivals.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("true"))
    best = counts.orderBy(F.desc("true"), "key").limit(k).withColumn("best", F.lit(1))
    seen = top_of(sketch, k).select("key", "count").join(counts, "key", "left").join(best.select("key", "best"), "key", "left")
    found = seen.agg(F.count("best").alias("hits"), F.max(F.when(F.col("true") > 0, F.abs(F.col("count") - F.col("true")) / F.col("true"))).alias("worst"))
    size = best.agg(F.count(F.lit(1)).alias("k"))
    distinct = counts.agg(F.count(F.lit(1)).alias("distinct_keys"))
    one = found.join(F.broadcast(size)).join(F.broadcast(distinct))  # one row each
    return one.select((F.col("hits") / F.greatest("k", F.lit(1))).alias("overlap"), F.coalesce("worst", F.lit(0.0)).alias("worst_relative_error"), "distinct_keys")
