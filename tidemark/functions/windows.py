"""Event-time windows over integer seconds, half open and aligned to 0."""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tumbling:
    """Windows of ``size`` seconds, end to end."""

    size: int

    def __post_init__(self):
        if self.size <= 0:
            raise ValueError(f"a tumbling window needs a positive size, not {self.size}")

    @property
    def step(self) -> int:
        return self.size

    @property
    def multiplicity(self) -> int:
        return 1

    def starts(self, time: Column) -> Column:
        """The starts of all windows that hold ``time``, ascending."""
        return F.array((F.floor(time / self.size) * self.size).cast("long"))


@dataclass(frozen=True)
class Sliding:
    """Windows of ``size`` seconds that begin every ``step`` seconds, none before 0."""

    size: int
    step: int

    def __post_init__(self):
        if self.size <= 0 or self.step <= 0:
            raise ValueError(f"windows of {self.size} seconds every {self.step} cannot be made")
        if self.step > self.size:
            raise ValueError(f"step {self.step} beyond size {self.size} leaves gaps between windows")

    @property
    def multiplicity(self) -> int:
        """Windows that an event is in at most."""
        return -(-self.size // self.step)

    def starts(self, time: Column) -> Column:
        last = (F.floor(time / self.step) * self.step).cast("long")
        first = ((F.floor((time - self.size) / self.step) + 1) * self.step).cast("long")
        return F.sequence(F.greatest(first, F.lit(0).cast("long")), last, F.lit(self.step).cast("long"))


@dataclass(frozen=True)
class Sessions:
    """Windows of one key that grow while events come at most ``gap`` seconds apart."""

    gap: int

    def __post_init__(self):
        if self.gap <= 0:
            raise ValueError(f"sessions need a positive gap, not {self.gap}")


def pane_width(size: int, step: int) -> int:
    """The widest pane that tiles every window of ``size`` beginning at a multiple of ``step``."""
    if size <= 0 or step <= 0:
        raise ValueError(f"no pane tiles windows of {size} every {step}")
    return gcd(size, step)


def panes_of(start: int, end: int, pane: int) -> list[tuple[int, int]]:
    """The panes that tile [start, end)."""
    if end <= start:
        raise ValueError("the window is empty or inverted")
    if pane <= 0 or (end - start) % pane:
        raise ValueError(f"panes of {pane} do not tile a window of {end - start}")
    return [(s, s + pane) for s in range(start, end, pane)]


def holds(time: Column, start: Column | str = "window_start", end: Column | str = "window_end") -> Column:
    """Whether the half-open window holds ``time``."""
    start, end = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    return (time >= start) & (time < end)
