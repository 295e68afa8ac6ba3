"""Running values over a total order without one task that holds all rows.

Rows are cut into buckets along the order; each bucket is summed up, the few summaries are run over, and what lies before a
bucket is joined to its rows, which are already dealt by bucket. The bucket must rise with the order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import fresh


@dataclass(frozen=True)
class Running:
    """A running count (no value), sum or max of a column, with or without the row itself."""

    kind: str
    value: str | None = None
    inclusive: bool = True

    def over(self, window) -> Column:
        return {"count": lambda: F.count(F.lit(1)), "sum": lambda: F.sum(self.value), "max": lambda: F.max(self.value)}[self.kind]().over(window)

    def whole(self) -> Column:
        return {"count": lambda: F.count(F.lit(1)), "sum": lambda: F.sum(self.value), "max": lambda: F.max(self.value)}[self.kind]()

    def combine(self, own: Column, before: Column) -> Column:
        return F.greatest(own, before) if self.kind == "max" else F.coalesce(own, F.lit(0)) + F.coalesce(before, F.lit(0))

    def of_summaries(self, column: str, window) -> Column:
        return (F.max(column) if self.kind == "max" else F.sum(column)).over(window)


def running(df: DataFrame, bucket: str, order: list, wanted: dict[str, Running]) -> DataFrame:
    """``df`` with running values; one shuffle, by bucket, and one sort for all of them. Names of ``df``'s columns that are
    wanted anew are replaced, other columns stay whatever their names."""
    names = fresh([*df.columns, *wanted], *[f"{x}_{n}" for n in wanted for x in ("all", "before", "own")])
    whole_as, before_as, own_as = ({n: names[3 * i + k] for i, n in enumerate(wanted)} for k in range(3))
    earlier = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    whole = df.groupBy(bucket).agg(*[r.whole().alias(whole_as[n]) for n, r in wanted.items()])
    offsets = whole.select(bucket, *[r.of_summaries(whole_as[n], earlier).alias(before_as[n]) for n, r in wanted.items()])
    frame = lambda r: Window.partitionBy(bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if r.inclusive else -1)
    rows = df.withColumns({own_as[n]: r.over(frame(r)) for n, r in wanted.items()}).join(offsets, bucket)
    done = rows.withColumns({n: r.combine(F.col(own_as[n]), F.col(before_as[n])) for n, r in wanted.items()})
    return done.drop(*own_as.values(), *before_as.values())


def bucket_width(df: DataFrame, time: str, most_rows: int = 1 << 20) -> int:
    """Seconds of ``time`` that hold about ``most_rows`` rows, or fewer so that every core has buckets to work on."""
    got = df.agg(F.count(time).alias("n"), F.min(time).alias("low"), F.max(time).alias("high")).first()
    if not got.n:
        return 1
    buckets = max(got.n // most_rows, 2 * df.sparkSession.sparkContext.defaultParallelism)
    return max(1, (got.high - got.low) // buckets)


def number(df: DataFrame, bucket: str, order: list, name: str = "seq") -> DataFrame:
    """``df`` with its place in the order, from 1."""
    return running(df, bucket, order, {name: Running("count")})


def running_max(df: DataFrame, bucket: str, order: str, value: str, name: str, inclusive: bool = True) -> DataFrame:
    """``df`` with the largest ``value`` so far (null before the first row, if the row itself doesn't count)."""
    return running(df, bucket, [order], {name: Running("max", value, inclusive)})


def running_sum(df: DataFrame, bucket: str, order: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` so far."""
    return running(df, bucket, [order], {name: Running("sum", value)})
