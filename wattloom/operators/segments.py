"""Runs of active samples as events, with their pulses and kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.functions.columns import Axis, active, known, minutes
from wattloom.functions.session import with_checkpoints
from wattloom.operators import scans

#: Bins of a round of selection.
BINS = 1024


def runs(samples: DataFrame, axis: Axis, signal: str, threshold: float) -> DataFrame:
    """The active samples with `seg`, the number of their run in the series. A run that lasts to the series' end is unfinished and dropped.

    Series are scanned by 30 days (operators/scans.py), so that no task holds more of one, however long it is.
    """
    found = scans.with_runs(samples, list(axis.key), [axis.time, *axis.tie], active(signal, threshold), "seg")
    return found.where("_on and not _open").drop("_on", "_was", "_open")


def segments(samples: DataFrame, axis: Axis, signal: str, threshold: float, more_minutes: float = 10.0, factors: tuple[str, ...] = ()) -> DataFrame:
    """(key, seg, t_start, t_end, duration_min, n, variance): events longer than `more_minutes`.

    An event is dropped if one of the `factors` (power factor columns) is 1 throughout.
    """
    stuck = [F.bool_and(F.coalesce(F.col(c) == 1, F.lit(False))).alias(f"_stuck{k}") for k, c in enumerate(factors)]
    found = runs(samples, axis, signal, threshold).groupBy(*axis.key, "seg").agg(
        F.min(axis.time).alias("t_start"), F.max(axis.time).alias("t_end"), F.count(F.lit(1)).alias("n"), F.var_pop(known(F.col(signal).cast("double"))).alias("variance"), *stuck
    )
    found = found.withColumn("duration_min", minutes("t_start", "t_end")).where(F.col("duration_min") > more_minutes)
    for k in range(len(factors)):
        found = found.where(~F.col(f"_stuck{k}"))
    return found.select(*axis.key, "seg", "t_start", "t_end", "duration_min", "n", "variance")


def pulses(event_samples: DataFrame, axis: Axis, signal: str, height: float = 5.0) -> DataFrame:
    """(key, seg, pulses): local maxima at or over `height`; a plateau counts once, a sample at an event's edge never."""
    w = axis.window("seg")
    steps = event_samples.withColumn("_before", F.lag(signal).over(w)).where(f"_before is null or {signal} <> _before")
    peak = (F.col(signal) > F.col("_before")) & (F.col(signal) > F.lead(signal).over(w)) & (F.col(signal) >= height)
    return steps.withColumn("_peak", F.coalesce(peak, F.lit(False))).groupBy(*axis.key, "seg").agg(F.count_if("_peak").alias("pulses"))


def classified(events: DataFrame, counted: DataFrame, axis: Axis, variance: float = 1.0) -> DataFrame:
    """events with pulses and is_mono: little variance or a single pulse."""
    both = events.join(counted, [*axis.key, "seg"], "left").withColumn("pulses", F.coalesce("pulses", F.lit(0)))
    return both.withColumn("is_mono", (F.col("variance") < variance) | (F.col("pulses") == 1))


def in_ranges(samples: DataFrame, ranges: DataFrame, time: str = "t") -> DataFrame:
    """Samples within (name, range_start, range_end), both ends included; ranges is a short list of fixed length."""
    return samples.join(ranges, F.col(time).between(F.col("range_start"), F.col("range_end")))


def pump_bound(samples: DataFrame, axis: Axis, signal: str) -> DataFrame:
    """(key, levels): distinct levels of the signal that lie more than 1 apart, at least 1."""
    w = Window.partitionBy(*axis.key).orderBy(signal)
    gaps = samples.where(known(F.col(signal).cast("double")).isNotNull()).withColumn("_gap", F.col(signal) - F.lag(signal).over(w))
    return gaps.groupBy(*axis.key).agg((F.count_if(F.coalesce(F.col("_gap") > 1, F.lit(False))) + 1).alias("levels"))


def most_pumps(event_samples: DataFrame, axis: Axis, signal: str) -> DataFrame:
    """(key, levels): the most levels that the signal has in one event of a series; axis.key is the series and, last, the event."""
    return pump_bound(event_samples, axis, signal).groupBy(*axis.key[:-1]).agg(F.max("levels").alias("levels"))


def quantiles(rows: DataFrame, by: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    """(by, low, high, q1 ..): exact quantiles, linear between neighbours, by selection in rounds; missing values are skipped.

    A round counts a group's values in BINS bins between the bounds of each rank that is sought, and keeps the bounds of
    the bin that holds it; no buffer holds a group's values. Rounds end when all bounds have met.
    """
    with_checkpoints(rows.sparkSession)
    base = rows.select(*by, known(F.col(value).cast("double")).alias("_v")).where("_v is not null")
    ends = base.groupBy(*by).agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.count(F.lit(1)).alias("_n"))
    at = lambda k: F.lit(shares[k]) * (F.col("_n") - 1)
    ranks = F.array(*(F.struct(F.lit(k).alias("_k"), F.lit(up).alias("_up"), (F.floor(at(k)) + up).alias("_r")) for k in range(len(shares)) for up in (0, 1)))
    sought = ends.select(*by, "_n", F.col("low").alias("_a"), F.col("high").alias("_b"), F.lit(0).cast("long").alias("_below"), F.inline(ranks))
    sought = sought.withColumn("_r", F.least("_r", F.col("_n") - 1)).checkpoint()
    bounds = [*by, "_a", "_b", "_below"]
    while not (left := sought.where("_a < _b")).isEmpty():
        inside = base.join(left.select(*bounds).distinct(), by).where("_v between _a and _b")
        bin_ = F.least(F.floor((F.col("_v") / 2 - F.col("_a") / 2) / (F.col("_b") / 2 - F.col("_a") / 2) * BINS), F.lit(BINS - 1))
        counts = inside.groupBy(*bounds, bin_.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = Window.partitionBy(*bounds).orderBy("_bin")
        counts = counts.withColumn("_first", F.col("_below") + F.sum("_c").over(upto) - F.col("_c"))
        found = left.join(counts, bounds).where((F.col("_r") >= F.col("_first")) & (F.col("_r") < F.col("_first") + F.col("_c")))
        found = found.select(*by, "_n", F.col("_lo").alias("_a"), F.col("_hi").alias("_b"), F.col("_first").alias("_below"), "_k", "_up", "_r")
        sought = sought.where("_a >= _b").unionByName(found).checkpoint()
    share = lambda k: at(k) - F.floor(at(k))
    of = lambda k, up: F.max(F.when((F.col("_k") == k) & (F.col("_up") == up), F.col("_a")))
    found = sought.groupBy(*by, "_n").agg(*(of(k, up).alias(f"_q{k}_{up}") for k in range(len(shares)) for up in (0, 1)))
    lines = [(F.col(f"_q{k}_0") + (F.col(f"_q{k}_1") - F.col(f"_q{k}_0")) * share(k)).alias(f"q{k + 1}") for k in range(len(shares))]
    return found.select(*by, *lines).join(ends.drop("_n"), by)


def quartiles(events: DataFrame, by: list[str], value: str) -> DataFrame:
    """Exact quartiles and extremes of a value."""
    return quantiles(events, by, value, (0.25, 0.5, 0.75)).select(*by, "low", "q1", "q2", "q3", "high")
