"""Scans of long series in two levels: by bucket of time, then over what the buckets leave behind.

A window over a whole series would put it into one task. Here the windows are over (key, bucket), and only a row for
each bucket is scanned along the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOUR, DAY = 3_600_000_000, 86_400_000_000
MONTH = 30 * DAY
#: Wide rows of a task, about.
TASK_ROWS = 200_000
#: The bucket of rows without a time, which stand first.
TIMELESS = -(2**62)


def micros(c: str | Column) -> Column:
    """Microseconds since a fixed time."""
    return F.timestamp_diff("MICROSECOND", F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"), F.col(c) if isinstance(c, str) else c)


def bucket(time: str | Column, width: int = DAY) -> Column:
    return F.floor(micros(time) / width).cast("long")


def tasks_for(rows: int) -> int:
    """How many tasks share rows that are wide: a number that grows with them. Left to itself, adaptive execution joins tasks by their
    compressed bytes, and many alike rows end up in few."""
    return max(1, -(-rows // TASK_ROWS))


def with_neighbours(rows: DataFrame, key: list[str], time: str, value: str, width: int = DAY, after: bool = True, tasks: int = 0) -> DataFrame:
    """rows with `_before` and (unless `after` is false) `_after`: `value` (null where a row has none) of the last row that has one at or
    before, and of the first at or after each row's time, wherever in the series they are; rows of one time see each other. Also `_bucket`. Buckets are dealt to `tasks`, if given."""
    rows = rows.withColumn("_bucket", bucket(time, width))
    rows = rows.repartition(tasks, *key, "_bucket") if tasks else rows
    has = F.col(value).isNotNull()
    sides = {"_before": (F.col(time), F.max_by, F.col("_bucket"))} | ({"_after": (F.desc(time), F.min_by, F.desc("_bucket"))} if after else {})
    inside, ends = rows, rows.groupBy(*key, "_bucket").agg(*(pick(value, F.when(has, F.col(time))).alias(f"_in{name}") for name, (_, pick, _) in sides.items()))
    for name, (order, _, along) in sides.items():
        frame = Window.partitionBy(*key, "_bucket").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)  # a frame that only grows
        inside = inside.withColumn(name, F.last(value, True).over(frame))
        ends = ends.withColumn(f"_of{name}", F.last(f"_in{name}", True).over(Window.partitionBy(*key).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)))
    both = inside.join(ends.drop(*(f"_in{name}" for name in sides)), [*key, "_bucket"])
    return both.withColumns({name: F.coalesce(name, f"_of{name}") for name in sides}).drop(*(f"_of{name}" for name in sides))


def with_lag(rows: DataFrame, key: list[str], order: list[str], value: str, name: str, width: int = MONTH) -> DataFrame:
    """rows with `name`: `value` of the row before, also where that lies in an earlier bucket; and `_bucket`. The first of `order` is the time.
    Rows without a key are one series, rows without a time its first."""
    rows = rows.withColumns({"_key": F.struct(*key), "_bucket": F.coalesce(bucket(order[0], width), F.lit(TIMELESS))})
    w = Window.partitionBy("_key", "_bucket").orderBy(*order)
    last = rows.groupBy("_key", "_bucket").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_l"))
    last = last.select("_key", "_bucket", F.lag("_l").over(Window.partitionBy("_key").orderBy("_bucket")).alias("_l"))
    inside = rows.withColumns({name: F.lag(value).over(w), "_n": F.row_number().over(w)})
    return inside.join(last, ["_key", "_bucket"]).withColumn(name, F.when(F.col("_n") == 1, F.col("_l")[value]).otherwise(F.col(name))).drop("_n", "_l", "_key")


def with_runs(rows: DataFrame, key: list[str], order: list[str], on: Column, name: str, width: int = MONTH) -> DataFrame:
    """rows with `_on` (as `on` says, which is never null), `_was` (the row before is on), `name` (how many runs of rows that are on have
    begun up to here, this row included) and `_open` (the last of these lasts to the series' end).

    A bucket leaves behind how it begins and ends and how many runs begin in it; a run that goes on from the bucket before is
    counted there. Rows without a key are one series, rows without a time its first.
    """
    rows = rows.withColumns({"_key": F.struct(*key), "_bucket": F.coalesce(bucket(order[0], width), F.lit(TIMELESS)), "_on": on})
    w = Window.partitionBy("_key", "_bucket").orderBy(*order)
    inside = rows.withColumns({"_was": F.lag("_on").over(w), "_end": F.lead("_on").over(w).isNull()})
    inside = inside.withColumn("_k", F.sum((F.col("_on") & ~F.coalesce("_was", F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = inside.groupBy("_key", "_bucket").agg(F.bool_or(F.col("_was").isNull() & F.col("_on")).alias("_a"), F.bool_or(F.col("_end") & F.col("_on")).alias("_z"), F.max("_k").alias("_n"))
    along = Window.partitionBy("_key").orderBy("_bucket")
    ends = ends.withColumn("_before", F.lag("_z", 1, False).over(along)).withColumn("_new", F.col("_n") - (F.col("_a") & F.col("_before")).cast("int"))
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.withColumns({"_base": F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"), "_last": F.when(F.last("_z").over(whole), F.sum("_new").over(whole))})
    both = inside.join(ends.select("_key", "_bucket", "_before", "_base", "_last"), ["_key", "_bucket"])
    both = both.withColumns({"_was": F.coalesce("_was", "_before"), name: F.col("_base") + F.col("_k")}).withColumn("_open", F.coalesce(F.col(name) == F.col("_last"), F.lit(False)))
    return both.drop("_key", "_bucket", "_end", "_k", "_before", "_base", "_last")
