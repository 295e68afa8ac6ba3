"""Mergeable aggregates as expressions: parts from rows, parts from parts, the value from parts, and running values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mergeable:
    """An aggregate whose parts over disjoint rows merge into the parts over all of them.

    parts: name -> expression over rows, given a guard (rows where it is false don't count).
    merge: name -> how parts of that name combine: an aggregate, or an aggregate and what finishes its outcome.
    result: the value, from columns of those names.
    """

    parts: dict[str, Callable[[Column], Column]]
    merge: dict[str, Callable[[Column], Column] | tuple[Callable[[Column], Column], Callable[[Column], Column]]]
    result: Callable[[Callable[[str], Column]], Column]

    def of_rows(self, guard: Column | None = None) -> list[Column]:
        guard = F.lit(True) if guard is None else guard
        return [make(guard).alias(f"part_{n}") for n, make in self.parts.items()]

    def merged(self, name: str, over: Window | None = None) -> Column:
        """Parts of one name combined, over a group or a frame."""
        how = self.merge[name]
        combine, finish = how if isinstance(how, tuple) else (how, lambda c: c)
        found = combine(F.col(f"part_{name}"))
        return finish(found if over is None else found.over(over))

    def of_parts(self) -> list[Column]:
        return [self.merged(n).alias(f"part_{n}") for n in self.merge]

    def value(self) -> Column:
        return self.result(lambda n: F.col(f"part_{n}")).cast("double")

    def of_each(self, over: Window) -> dict[str, Column]:
        """Parts by column name over a frame; over a frame of one row, that row's parts."""
        return {f"part_{n}": make(F.lit(True)).over(over) for n, make in self.parts.items()}

    def running(self, over: Window) -> Column:
        """The value of parts so far; ``over`` is a frame from the first row to this one."""
        return self.result(lambda n: self.merged(n, over)).cast("double")


def _exact(value: Column) -> Column:
    """What ten decimals can hold of a value below 10^15, as a decimal: sums of it do not depend on the order of rows."""
    return F.coalesce(value.try_cast("decimal(25,10)"), F.lit(0).cast("decimal(25,10)"))


#: A sum in two parts: the exact one, and as doubles what it leaves out (0 for money and the like).
_SUM = {
    "total": lambda g: F.sum(F.when(g & F.col("value").isNotNull(), _exact(F.col("value")))),
    "rest": lambda g: F.sum(F.when(g, F.col("value").cast("double") - _exact(F.col("value")).cast("double"))),
}


def _total(p: Callable[[str], Column]) -> Column:
    return F.coalesce(p("total").cast("double") + p("rest"), F.lit(0.0))


def _count(guard: Column) -> Column:
    return F.count(F.when(guard, F.lit(1)))


COUNT = Mergeable({"n": _count}, {"n": F.sum}, lambda p: p("n"))
SUM = Mergeable(_SUM, {"total": F.sum, "rest": F.sum}, _total)
MEAN = Mergeable(
    _SUM | {"n": _count}, {"total": F.sum, "rest": F.sum, "n": F.sum},
    lambda p: F.when(p("n") > 0, _total(p) / p("n").cast("double")).otherwise(0.0),
)
RANGE = Mergeable(
    {"low": lambda g: F.min(F.when(g, F.col("value"))), "high": lambda g: F.max(F.when(g, F.col("value")))}, {"low": F.min, "high": F.max},
    lambda p: F.coalesce(p("high") - p("low"), F.lit(0.0)),
)
#: Different keys, as a set that merges by union. Within one key it is 1; it says more across keys.
DISTINCT = Mergeable(
    {"keys": lambda g: F.collect_set(F.when(g, F.col("key")))}, {"keys": (F.collect_list, lambda c: F.array_distinct(F.flatten(c)))},
    lambda p: F.size(p("keys")),
)

AGGREGATES = {"count": COUNT, "sum": SUM, "mean": MEAN, "minmax": RANGE, "distinct": DISTINCT}


def aggregate(name: str | Mergeable) -> Mergeable:
    """An aggregate by name, or one's own."""
    if isinstance(name, Mergeable):
        return name
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name!r}; there are {', '.join(AGGREGATES)}")
    return AGGREGATES[name]


def merge_parts(frames: list[DataFrame], by: list[str], name: str | Mergeable) -> DataFrame:
    """The parts of several frames of parts, merged by key."""
    if not frames:
        raise ValueError("nothing to merge")
    return reduce(DataFrame.unionByName, frames).groupBy(*by).agg(*aggregate(name).of_parts())
