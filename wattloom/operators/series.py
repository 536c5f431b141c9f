"""Minute series from events, resampling, working power, and truth events from a counter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.functions.columns import Axis, known
from wattloom.operators import scans

#: Microseconds of a minute, minutes of a day.
MINUTE, DAY = 60_000_000, 1440


def gap(a: str | Column, b: str | Column) -> Column:
    """Microseconds from a to b."""
    return F.timestamp_diff("MICROSECOND", F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def minute_series(records: DataFrame, powers: DataFrame, cluster: str = "clusterId", start: str = "starttime", end: str = "endtime") -> DataFrame:
    """(cluster, minute, signal): each cluster's events add its power on a minute grid that starts at its first start.

    Both ends count. A sweep by day: one step up and one down for each event; what runs at a day's start is carried from
    the days before, so that no task holds more than a day of a cluster, and events are counted before power is multiplied.
    """
    rows = records.join(powers.select(F.col("cluster").alias(cluster)), cluster)
    ends = rows.groupBy(cluster).agg(F.min(start).alias("first"), F.max(end).alias("last"))
    both = rows.join(ends, cluster)
    up = F.ceil(gap("first", start) / MINUTE).cast("long")
    down = F.floor(gap("first", end) / MINUTE).cast("long") + 1
    steps = both.select(cluster, F.explode(F.array(F.struct(up.alias("k"), F.lit(1).alias("n")), F.struct(down.alias("k"), F.lit(-1).alias("n")))).alias("s"))
    day = F.floor(F.col("k") / DAY).cast("long")
    steps = steps.groupBy(cluster, F.col("s.k").alias("k")).agg(F.sum("s.n").alias("n")).withColumn("day", day)
    minutes = F.floor(gap("first", "last") / MINUTE).cast("long")
    days = ends.select(cluster, "first", minutes.alias("minutes"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(minutes / DAY).cast("long"))).alias("day"))
    earlier = Window.partitionBy(cluster).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.join(steps.groupBy(cluster, "day").agg(F.sum("n").alias("n")), [cluster, "day"], "left")
    days = days.withColumn("carried", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    inside = F.sequence(F.col("day") * DAY, F.least(F.col("day") * DAY + (DAY - 1), F.col("minutes")))
    grid = days.select(cluster, "first", "day", "carried", F.explode(inside).alias("k"))
    w = Window.partitionBy(cluster, "day").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(steps, [cluster, "day", "k"], "left").withColumn("running", F.col("carried") + F.sum(F.coalesce("n", F.lit(0))).over(w))
    filled = filled.join(powers.select(F.col("cluster").alias(cluster), "power"), cluster)
    return filled.select(F.col(cluster).alias("cluster"), F.timestamp_add("MINUTE", F.col("k"), F.col("first")).alias("minute"), (F.col("running") * F.col("power")).alias("signal"))


def minute_grid(samples: DataFrame, axis: Axis) -> DataFrame:
    """(key, g): every whole minute from a series' first to its last sample, made day by day."""
    ends = samples.groupBy(*axis.key).agg(F.date_trunc("minute", F.min(axis.time)).cast("timestamp_ntz").alias("a"), F.date_trunc("minute", F.max(axis.time)).cast("timestamp_ntz").alias("b"))
    days = ends.select(*axis.key, "a", "b", F.explode(F.sequence(scans.bucket("a"), scans.bucket("b"))).alias("_day"))
    start = F.timestamp_add("DAY", F.col("_day"), F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))
    first, last = F.greatest("a", start), F.least("b", F.timestamp_add("MINUTE", F.lit(DAY - 1), start))
    minutes = F.sequence(F.lit(0), F.floor(gap(first, last) / MINUTE).cast("int"))
    return days.repartition(*axis.key, "_day").select(*axis.key, first.alias("_first"), F.explode(minutes).alias("_m")).select(*axis.key, F.timestamp_add("MINUTE", F.col("_m"), F.col("_first")).alias("g"))


def beside(samples: DataFrame, axis: Axis, signal: str) -> DataFrame:
    """(key, g, t0, x0, t1, x1): the samples at or before, and at or after, each minute; no task holds more than a day of a series."""
    at = F.struct(F.col(axis.time).alias("t"), F.col(signal).alias("x"))
    rows = samples.select(*axis.key, F.col(axis.time).alias("g"), at.alias("s"), F.lit(0).alias("grid"))
    grid = minute_grid(samples, axis).select(*axis.key, "g", F.lit(None).cast(rows.schema["s"].dataType).alias("s"), F.lit(1).alias("grid"))
    both = scans.with_neighbours(rows.unionByName(grid), list(axis.key), "g", "s").where("grid = 1")
    return both.select(*axis.key, "g", F.col("_before.t").alias("t0"), F.col("_before.x").alias("x0"), F.col("_after.t").alias("t1"), F.col("_after.x").alias("x1"))


def resample_nearest(samples: DataFrame, axis: Axis, signal: str) -> DataFrame:
    """(key, minute, value): the nearest sample to each minute, the earlier on ties."""
    b = beside(samples, axis, signal)
    later = F.col("t0").isNull() | (F.col("t1").isNotNull() & (gap("g", "t1") < gap("t0", "g")))
    return b.select(*axis.key, F.col("g").alias("minute"), F.when(later, F.col("x1")).otherwise(F.col("x0")).alias("value"))


def resample_linear(samples: DataFrame, axis: Axis, signal: str) -> DataFrame:
    """(key, minute, value): linear between the samples that lie on a whole minute; the others are lost. After the last such, its value."""
    on = samples.withColumn("_on", F.when(F.date_trunc("minute", F.col(axis.time)).cast("timestamp_ntz") == F.col(axis.time), F.col(signal)))
    marks = on.where("_on is not null").groupBy(*axis.key, F.col(axis.time).alias("g")).agg(F.max_by("_on", F.struct(*axis.tie) if axis.tie else F.lit(0)).alias("x"))
    grid = minute_grid(samples, axis).join(marks, [*axis.key, "g"], "left").withColumn("_mark", F.when(F.col("x").isNotNull(), F.struct("g", "x")))
    both = scans.with_neighbours(grid, list(axis.key), "g", "_mark")
    p, q = F.col("_before"), F.col("_after")
    line = p["x"] + (q["x"] - p["x"]) * F.coalesce(F.try_divide(gap(p["g"], F.col("g")), gap(p["g"], q["g"])), F.lit(0.0))
    return both.select(*axis.key, F.col("g").alias("minute"), F.coalesce(line, p["x"]).alias("value"))


def aligned_to_zero(pred: DataFrame, val: DataFrame, minute: str = "minute", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, minute, value) of pred on every minute of its own (by `by`) and val's extent, 0 where it has none."""
    ends = pred.groupBy(*by).agg(F.min(minute).alias("_a"), F.max(minute).alias("_b"))
    all_ = val.agg(F.min(minute).alias("_va"), F.max(minute).alias("_vb"))
    extent = ends.crossJoin(F.broadcast(all_)).select(*by, F.explode(F.array(F.least("_a", "_va"), F.greatest("_b", "_vb"))).alias(minute))  # one row
    calendar = minute_grid(extent, Axis(tuple(by), minute)).withColumnRenamed("g", minute)
    return calendar.join(pred.select(*by, minute, "value"), [*by, minute], "left").fillna(0.0, ["value"])


def working_power(counter: DataFrame, axis: Axis, quantity: str) -> DataFrame:
    """counter with power: 10 times the quantity's increase by hours passed; 0 in the first row, null without time passed."""
    rows = scans.with_lag(counter.withColumn("_row", F.struct(axis.time, quantity)), list(axis.key), [axis.time, *axis.tie], "_row", "_prior")
    before = F.col("_prior")
    rate = F.try_divide(10 * (F.col(quantity) - before[quantity]), gap(before[axis.time], F.col(axis.time)) / 3.6e9)
    return rows.withColumn("power", F.when(before.isNull(), F.lit(0.0)).otherwise(rate)).drop("_row", "_prior", "_bucket")


def truth_events(counter: DataFrame, axis: Axis, quantity: str, descending: bool = False) -> DataFrame:
    """(key, starttime, endtime): runs of rows in which the counter changed.

    A run starts at its first changed row. Ascending: missing values are skipped, a run ends at the first unchanged row,
    or at the series' last. Descending (files with the newest row first): it ends at its last changed row, and a missing
    value counts as a change.
    """
    rows = counter.withColumn(quantity, known(F.col(quantity).cast("double")))
    rows = rows if descending else rows.where(F.col(quantity).isNotNull())
    key, order = list(axis.key), [axis.time, *axis.tie]
    rows = scans.with_lag(rows.withColumn("_row", F.struct(quantity)), key, order, "_row", "_prior").drop("_row", "_bucket")
    change = F.col("_prior").isNotNull() & ~F.coalesce(F.col(quantity) == F.col("_prior")[quantity], F.lit(False))
    found = scans.with_runs(rows, key, order, change, "_run").where("_on" if descending else "_on or _was")
    return found.groupBy(*key, "_run").agg(F.min(F.when(F.col("_on"), F.col(axis.time))).alias("starttime"), F.max(axis.time).alias("endtime")).drop("_run")
