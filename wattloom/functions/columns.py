"""Small column functions: missing values, activity, minutes, scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


@dataclass(frozen=True)
class Axis:
    """Which columns name a series and which order its samples. Ties in time fall back to `tie`."""

    key: tuple[str, ...] = ("device",)
    time: str = "t"
    tie: tuple[str, ...] = ()

    def window(self, *more: str) -> WindowSpec:
        return Window.partitionBy(*self.key, *more).orderBy(self.time, *self.tie)


def known(c: str | Column) -> Column:
    """NaN as NULL, so that aggregates skip it."""
    return F.nanvl(c, F.lit(None).cast("double"))


def active(signal: str, threshold: float) -> Column:
    """On: at or over the threshold. A missing sample is off."""
    return F.coalesce(known(F.col(signal).cast("double")) >= threshold, F.lit(False))


def clipped(signal: str, threshold: float = 3.0) -> Column:
    """The signal where it is over the threshold, else 0."""
    return F.when(F.col(signal) > threshold, F.col(signal)).otherwise(0.0)


def minutes(a: str, b: str) -> Column:
    """Minutes from a to b, with fractions."""
    return F.timestamp_diff("MICROSECOND", F.col(a), F.col(b)) / 60e6


def inverse_score(c: Column) -> Column:
    """1 / (1 + x): 1 for no error, towards 0 for a large one; a missing error counts as endless."""
    return F.coalesce(1 / (1 + c), F.lit(0.0))


def percent(c: Column) -> Column:
    return c * 100


def power_estimate(factor: list[str], current: list[str], volt: list[str]) -> tuple[Column, Column]:
    """Real and reactive power (kW, kvar) of three phases from the mean power factor, current and voltage.

    A missing value in any input makes both missing; so does a power factor over 1 for the reactive power.
    """

    def mean(names: list[str]) -> Column:
        return sum((known(F.col(c).cast("double")) for c in names[1:]), known(F.col(names[0]).cast("double"))) / len(names)

    pf, base = mean(factor), 3 * mean(current) * mean(volt) / 1000
    return pf * base, F.when(pf <= 1, F.sqrt(F.greatest(1 - pf * pf, F.lit(0.0))) * base)
