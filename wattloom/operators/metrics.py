"""Metrics of a predicted against a measured series, and validation of events by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.functions.columns import inverse_score, known
from wattloom.functions.session import settled
from wattloom.operators import scans

WEIGHTS = {"start_detection_rate": 0.3, "end_detection_rate": 0.3, "time_accuracy": 0.2, "avg_power_pattern_similarity": 0.2}


def aligned(pred: DataFrame, val: DataFrame, by: list[str]) -> DataFrame:
    """(by, p, v): both series side by side; a missing side or a NaN is null, so that comparisons with it are not true."""
    value = known(F.col("value").cast("double"))
    return pred.select(*by, value.alias("p")).join(val.select(*by, value.alias("v")), by, "full_outer")


def parts(p: Column, v: Column) -> dict[str, Column]:
    """Sums from which all metrics of (p, v) follow; they add up over rows."""
    short, pa, va = F.coalesce(p < v, F.lit(False)), F.coalesce(p > 0, F.lit(False)), F.coalesce(v > 0, F.lit(False))
    inactive, both = F.coalesce(v <= 0, F.lit(False)), (p - v).isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return {
        "known": F.count(v), "total": total(v), "missed": total(F.when(short, v)), "short": F.count_if(short), "p": total(p),
        "np": F.count_if(pa), "nv": F.count_if(va), "either": F.count_if(pa | va), "both": F.count_if(pa & va),
        "active": total(F.when(va, F.abs(p - v))), "n_active": F.count_if(va & both), "inactive": total(F.when(inactive, F.abs(p - v))), "n_inactive": F.count_if(inactive & both),
        "square": total((p - v) * (p - v)), "off": total(F.abs(p - v)), "n": F.count_if(both),
    }


def from_parts(sums: dict[str, Column]) -> dict[str, Column]:
    """All metrics from their sums. Divisions by zero give null."""
    x = sums
    total = F.when(x["known"] > 0, x["total"])
    return {
        "inclusion": 1 - F.try_divide(x["missed"], total),
        "matching": F.try_divide(total - x["missed"], x["p"]),
        "time_inclusion": 1 - F.try_divide(x["short"], x["nv"]),
        "time_matching": F.try_divide(x["both"], x["either"]),
        "time_matching_ratio": F.try_divide(F.least(x["nv"], x["np"]), x["np"]),
        "information_ratio": F.try_divide(total, x["p"]),
        "active_error": F.try_divide(x["active"], x["n_active"]),
        "inactive_error": F.try_divide(x["inactive"], x["n_inactive"]),
        "mse": F.try_divide(x["square"], x["n"]),
        "mae": F.try_divide(x["off"], x["n"]),
    }


def metrics(pairs: DataFrame, by: list[str]) -> DataFrame:
    """All metrics of (p, v) in one aggregate. Divisions by zero give null."""
    return pairs.groupBy(*by).agg(*(c.alias(k) for k, c in from_parts(parts(F.col("p"), F.col("v"))).items()))


def keyed_metrics(pred: DataFrame, truth: DataFrame, by: list[str], minute: str = "minute") -> DataFrame:
    """All metrics of many predicted series (by, minute, value) against one true series (minute, value), on every minute of either.

    A minute that a series does not have counts as 0 there. The truth is not copied for each series: its sums against 0
    are worked out once, and corrected for the minutes that a series has. A series has a minute once.
    """
    value = known(F.col("value").cast("double"))
    true = truth.select(minute, value.alias("v"))
    mine = pred.select(*by, minute, F.coalesce(value, F.lit(0.0)).alias("p")).join(true, minute, "left")
    zero = F.lit(0.0)
    own = mine.groupBy(*by).agg(*(c.alias(f"own_{k}") for k, c in parts(F.col("p"), F.col("v")).items()), *(c.alias(f"less_{k}") for k, c in parts(zero, F.col("v")).items()))
    base = true.agg(*(c.alias(f"base_{k}") for k, c in parts(zero, F.col("v")).items()))
    sums = {k: F.col(f"base_{k}") - F.col(f"less_{k}") + F.col(f"own_{k}") for k in parts(zero, zero)}
    return own.crossJoin(F.broadcast(base)).select(*by, *(c.alias(k) for k, c in from_parts(sums).items()))  # one row


def best(scores: DataFrame, score: Column, by: list[str]) -> DataFrame:
    """The row of the highest score, the first by `by` on ties."""
    return scores.withColumn("_score", score).orderBy(F.desc_nulls_last("_score"), *by).limit(1).drop("_score")


def window_accuracy(records: DataFrame, truth: DataFrame) -> DataFrame:
    """(cluster, start_accuracy, end_accuracy, avg_accuracy, total_validation_events, correct_starts, correct_ends).

    A truth event's start is right if the cluster starts within the hour before it, its end if the cluster ends one to two
    hours before it: one look at the cluster's latest start (end) up to then answers it. truth: (vid, vs, ve); records:
    (cluster, starttime, endtime). Clusters are as many as are scored, each against all truth events.
    """
    hour = F.expr("interval 1 hour")
    marks = records.select("cluster", F.inline(F.array(F.struct(F.lit("s").alias("side"), F.col("starttime").alias("t")), F.struct(F.lit("e").alias("side"), F.col("endtime").alias("t")))))
    marks = marks.where("t is not null").groupBy("cluster", "side", "t").agg(F.lit(0).cast("long").alias("n"))
    names = records.agg(F.collect_set("cluster").alias("cluster"))  # one row
    asked = truth.select(F.inline(F.array(F.struct(F.lit("s").alias("side"), F.col("vs").alias("t")), F.struct(F.lit("e").alias("side"), (F.col("ve") - hour).alias("t")))))
    asked = asked.groupBy("side", "t").agg(F.count(F.lit(1)).alias("n"))
    asked = asked.crossJoin(F.broadcast(names)).select(F.explode("cluster").alias("cluster"), "side", "t", "n")
    rows = marks.withColumn("mark", F.struct("t")).unionByName(asked, allowMissingColumns=True)
    seen = scans.with_neighbours(rows, ["cluster", "side"], "t", "mark", after=False).where("n > 0")
    right = F.col("_before")["t"] >= F.col("t") - hour
    counts = seen.groupBy("cluster").agg(*(F.sum(F.when((F.col("side") == c) & right, F.col("n")).otherwise(0)).alias(n) for c, n in (("s", "correct_starts"), ("e", "correct_ends"))))
    total = truth.agg(F.count(F.lit(1)).alias("total_validation_events"))
    out = records.select("cluster").distinct().join(counts, "cluster", "left").fillna(0).crossJoin(F.broadcast(total))  # one row
    s, e = (F.try_divide(c, F.col("total_validation_events")) for c in ("correct_starts", "correct_ends"))
    return out.select("cluster", s.alias("start_accuracy"), e.alias("end_accuracy"), ((s + e) / 2).alias("avg_accuracy"), "total_validation_events", "correct_starts", "correct_ends")


def running_steps(signal: DataFrame, pump: str, tasks: int = 0) -> DataFrame:
    """(pump, t, mark) of each sample, from which any window of steps |value - the one before| follows by differences.

    mark: hour, the running count, sum and sum of squares of the hour's steps up to the sample and in all, those of all hours before, and
    the largest step (struct of size, earliest time) of the hour up to the sample, the same without the hour's first
    sample, and after the sample. Sums run within an hour and over hours apart, which keeps differences precise.
    """
    steps = scans.with_lag(signal.select(pump, "t", F.col("value").cast("double").alias("value")), [pump], ["t"], "value", "_p", scans.HOUR)
    steps = steps.withColumn("d", F.abs(F.col("value") - F.col("_p")))
    steps = steps.repartition(tasks, pump, "_bucket") if tasks else steps
    hour = Window.partitionBy(pump, "_bucket").orderBy("t")
    upto, whole = hour.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(pump, "_bucket")
    big = F.when(F.col("d").isNotNull(), F.struct("d", (-scans.micros("t")).alias("early"), "t"))
    d2 = F.col("d") * F.col("d")
    sums = {"n": F.count("d"), "s": F.coalesce(F.sum("d"), F.lit(0.0)), "q": F.coalesce(F.sum(d2), F.lit(0.0))}
    rows = steps.withColumns({f"{k}_at": v.over(upto) for k, v in {"n": F.count("d"), "s": F.sum("d"), "q": F.sum(d2)}.items()} | {f"{k}_all": v.over(whole) for k, v in {"n": F.count("d"), "s": F.sum("d"), "q": F.sum(d2)}.items()})
    rows = rows.fillna(0.0, ["s_at", "q_at", "s_all", "q_all"])
    rows = rows.withColumns({
        "_k": F.row_number().over(hour), "top": F.max(big).over(upto),
        "later": F.max(big).over(Window.partitionBy(pump, "_bucket").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)),
    })
    rows = rows.withColumn("inner", F.max(F.when(F.col("_k") > 1, big)).over(upto))
    hours = steps.groupBy(pump, "_bucket").agg(*(v.alias(k) for k, v in sums.items()))
    before = Window.partitionBy(pump).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select(pump, "_bucket", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_past") for k in sums))
    rows = rows.join(hours, [pump, "_bucket"])
    parts = [f"{k}_{w}" for k in "nsq" for w in ("at", "all", "past")]
    return rows.select(pump, "t", F.struct(F.col("t").alias("t"), F.col("_bucket").alias("hour"), *parts, "top", "inner", "later").alias("mark"))


def window_steps(first: Column, last: Column) -> dict[str, Column]:
    """(n, s, q) of the steps after the sample `first` up to the sample `last` (marks of running_steps)."""
    same = first["hour"] == last["hour"]

    def between(k: str) -> Column:
        across = (first[f"{k}_all"] - first[f"{k}_at"]) + (last[f"{k}_past"] - first[f"{k}_past"] - first[f"{k}_all"]) + last[f"{k}_at"]
        near = (first[f"{k}_all"] - first[f"{k}_at"]) + last[f"{k}_at"]  # neighbouring hours: no difference of long sums
        return F.when(same, last[f"{k}_at"] - first[f"{k}_at"]).when(last["hour"] == first["hour"] + 1, near).otherwise(across)

    return {k: between(k) for k in "nsq"}


def largest_step(first: Column, last: Column, at: Column) -> Column:
    """The largest step (d, early, t) after `first` up to `last`, of a window that begins `at` and lasts an hour: what is left of the hour
    that it begins in, and the beginning of the next one."""
    begins = scans.bucket(at, scans.HOUR)
    left = F.when(first["hour"] == begins, first["later"])
    right = F.when(last["hour"] > begins, F.when(first["hour"] == begins, last["top"]).otherwise(last["inner"]))
    return F.greatest(left, right)


def pump_matches(truth: DataFrame, signal: DataFrame, pump: str = "pump", threshold: float = 0.1, literal: bool = False) -> DataFrame:
    """(pump, start_detection_rate, end_detection_rate, avg_start_time_diff, avg_end_time_diff, avg_power_pattern_similarity).

    A start (end) is detected if power changes by more than the threshold within the hour up to it; its time is that of the
    largest change, or with `literal` the window's first sample. Pattern similarity: 1 less the changes' sample deviation by
    their mean within the event. Events without a sample add 0; undefined similarities count as missing ones.

    Every pump meets every event, at four times each: looks at running sums and maxima there give all windows, so that
    rows grow with samples and with events times pumps, however many samples an event has; the tasks that hold them grow in number.
    """
    hour = F.expr("interval 1 hour")
    truth = settled(truth.select("vid", "vs", "ve"))
    pumps, samples, events = *signal.agg(F.count_distinct(pump), F.count(F.lit(1))).first(), truth.count()
    marks = running_steps(signal, pump, scans.tasks_for(samples))
    asking = scans.tasks_for(samples + 4 * pumps * events)
    names = signal.agg(F.collect_set(pump).alias("pumps"))  # one row
    points = F.array(*(F.struct(F.lit(k).alias("point"), c.alias("t")) for k, c in (("a", F.col("vs") - hour), ("b", F.col("vs")), ("c", F.col("ve") - hour), ("d", F.col("ve")))))
    asked = truth.select("vid", "vs", "ve", F.inline(points)).crossJoin(F.broadcast(names)).select(F.explode("pumps").alias(pump), "t", "vid", "vs", "ve", "point")
    rows = marks.unionByName(asked, allowMissingColumns=True)
    seen = scans.with_neighbours(rows, [pump], "t", "mark", scans.HOUR, tasks=asking).where("point is not null").repartition(asking, pump, "vid")
    at = lambda point, side: F.max(F.when(F.col("point") == point, F.struct(side))).getField(side)
    each = seen.groupBy(pump, "vid").agg(F.max("vs").alias("vs"), F.max("ve").alias("ve"), *(at(p, s).alias(p + s) for p, s in (("a", "_after"), ("b", "_before"), ("b", "_after"), ("c", "_after"), ("d", "_before"))))
    out = {}
    for side, first, last, begin, end in (("s", "a_after", "b_before", F.col("vs") - hour, "vs"), ("e", "c_after", "d_before", F.col("ve") - hour, "ve")):
        inside = (F.col(first)["t"] <= F.col(last)["t"]) & (F.col(first)["t"] <= F.col(end)) & (F.col(last)["t"] >= begin)
        top = F.when(inside, largest_step(F.col(first), F.col(last), begin))
        found = F.coalesce(top["d"] > threshold, F.lit(False))
        when = F.col(first)["t"] if literal else top["t"]
        out |= {f"found_{side}": found, f"off_{side}": F.when(found, F.abs(F.timestamp_diff("MICROSECOND", when, F.col(end))) / 6e7)}
    first, last = F.col("b_after"), F.col("d_before")
    w = window_steps(first, last)
    spread = F.when(w["n"] > 1, F.sqrt(F.greatest((w["q"] - w["s"] * w["s"] / w["n"]) / (w["n"] - 1), F.lit(0.0))))
    inside = (first["t"] <= last["t"]) & (first["t"] <= F.col("ve")) & (last["t"] >= F.col("vs"))
    alike = F.when(inside, 1 - spread / (F.try_divide(w["s"], w["n"]) + 1e-6))
    counts = each.select(pump, *(c.alias(k) for k, c in out.items()), alike.alias("alike")).groupBy(pump).agg(
        F.count_if("found_s").alias("_s"), F.count_if("found_e").alias("_e"), F.avg("off_s").alias("avg_start_time_diff"), F.avg("off_e").alias("avg_end_time_diff"), F.sum("alike").alias("_alike"),
    )
    total = truth.agg(F.count(F.lit(1)).alias("_n"))
    out = signal.select(pump).distinct().join(counts, pump, "left").crossJoin(F.broadcast(total))  # one row
    rate = lambda c: F.try_divide(F.coalesce(F.col(c), F.lit(0)), F.col("_n"))
    return out.select(
        pump, rate("_s").alias("start_detection_rate"), rate("_e").alias("end_detection_rate"),
        "avg_start_time_diff", "avg_end_time_diff", rate("_alike").alias("avg_power_pattern_similarity"),
    )


def pump_scores(matches: DataFrame) -> DataFrame:
    """matches with time_accuracy and total_score; a missing time difference is endless, so its accuracy is 0."""
    accuracy = inverse_score((F.col("avg_start_time_diff") + F.col("avg_end_time_diff")) / 2)
    scored = matches.withColumn("time_accuracy", accuracy)
    return scored.withColumn("total_score", sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0)))


#: The analysed metrics: what they are called, how they are shown, from where (or up to where) they are good.
ANALYSED = {
    "start_detection_rate": ("start detection rate", "%.1f%%", 0.8, True),
    "end_detection_rate": ("end detection rate", "%.1f%%", 0.8, True),
    "avg_start_time_diff": ("mean start time difference", "%.1f minutes", 5.0, False),
    "avg_end_time_diff": ("mean end time difference", "%.1f minutes", 5.0, False),
    "avg_power_pattern_similarity": ("power pattern similarity", "%.2f", 0.7, True),
}


def analysis(matches: DataFrame) -> DataFrame:
    """matches with `analysis`: for each metric its name, its value as text, and whether it is good. A missing value needs improvement."""
    parts = []
    for c, (name, form, edge, up) in ANALYSED.items():
        value = F.col(c) * 100 if "%%" in form else F.col(c)
        good = F.coalesce(F.col(c) >= edge if up else F.col(c) <= edge, F.lit(False))
        parts.append(F.struct(F.lit(name).alias("metric"), F.when(value.isNull(), "none").otherwise(F.format_string(form, value)).alias("value"), F.when(good, "good").otherwise("needs improvement").alias("label")))
    return matches.withColumn("analysis", F.array(*parts))


#: Metrics of a report, in its order, each with its short name and unit.
REPORTED = (
    ("information_ratio", "vp_ratio", ""), ("inclusion", "inc", "%"), ("matching", "mat", "%"), ("time_inclusion", "t_inc", "%"), ("time_matching", "t_mat", "%"),
    ("active_error", "act_mae", ""), ("inactive_error", "inact_mae", ""), ("mse", "mse", ""), ("mae", "mae", ""),
)


def report_lines(scores: DataFrame, name: str) -> DataFrame:
    """(name, place, line): a heading and a line for each metric of every row; rates in percent, three digits."""
    rows = [F.struct(F.lit(0).alias("place"), F.concat(F.lit("evaluation of "), F.col(name).cast("string")).alias("line"))]
    for k, (c, short, unit) in enumerate(REPORTED, 1):
        text = F.format_string(f"  - {short}: %.3f{'%%' if unit else ''}", F.col(c) * (100 if unit else 1))
        rows.append(F.struct(F.lit(k).alias("place"), F.when(F.col(c).isNull(), F.lit(f"  - {short}: none")).otherwise(text).alias("line")))
    return scores.select(name, F.inline(F.array(*rows)))


def accuracy_lines(accuracies: DataFrame) -> DataFrame:
    """(place, cluster, line): window accuracies as a table by cluster, then the best cluster's counts (the first of equal ones)."""
    share = lambda c: F.format_string("%.2f%%", F.coalesce(c, F.lit(0.0)) * 100)
    rates = [share(F.col(c)) for c in ("start_accuracy", "end_accuracy", "avg_accuracy")]
    table = accuracies.select(F.lit(0).alias("place"), "cluster", F.concat_ws(" | ", F.col("cluster").cast("string"), *rates).alias("line"))
    top = best(accuracies, F.col("avg_accuracy"), ["cluster"])
    counts = F.concat_ws(", ", *(F.concat(F.lit(f"{n} "), F.col(c).cast("string")) for n, c in (("events", "total_validation_events"), ("starts", "correct_starts"), ("ends", "correct_ends"))))
    return table.unionByName(top.select(F.lit(1).alias("place"), "cluster", F.concat(F.lit("best: "), F.concat_ws(" | ", F.col("cluster").cast("string"), *rates), F.lit("; "), counts).alias("line")))


def verdict(matches: DataFrame) -> DataFrame:
    """matches with level (good, fair, poor), suggestions, and the analysis of each metric."""
    rate = F.least("start_detection_rate", "end_detection_rate")
    off = F.greatest(*(F.coalesce(c, F.lit(float("inf"))) for c in ("avg_start_time_diff", "avg_end_time_diff")))
    level = F.when((rate >= 0.8) & (off <= 5), "good").when((rate >= 0.6) & (off <= 10), "fair").otherwise("poor")
    tips = {
        "lower the start threshold": F.col("start_detection_rate") < 0.8,
        "lower the end threshold": F.col("end_detection_rate") < 0.8,
        "adjust the detection window": off > 5,
        "check the extracted power pattern": F.col("avg_power_pattern_similarity") < 0.7,
    }
    found = F.filter(F.array(*(F.when(c, F.lit(t)) for t, c in tips.items())), lambda t: t.isNotNull())
    return analysis(matches).withColumn("level", level).withColumn("suggestions", F.array_join(found, "; "))
