"""Change-point blocks of an event's signal, and on/off records paired from their steps."""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.functions.columns import Axis
from wattloom.functions.session import reachable

MEAN_OF = 5


def change_blocks(samples: DataFrame, axis: Axis, signal: str, threshold: float, length: int = MEAN_OF) -> DataFrame:
    """(key, block, b_start, b_end, b_mean): cut where the centred mean steps by more than the threshold.

    The row at a cut belongs to both blocks; a last block of one row is dropped. axis.key names the event.
    """
    w = axis.window()
    half = length // 2
    smooth = samples.withColumn("_sm", F.avg(signal).over(w.rowsBetween(-half, half)))
    cut = smooth.withColumn("_cut", F.coalesce(F.abs(F.col("_sm") - F.lag("_sm").over(w)) > threshold, F.lit(False)))
    numbered = cut.withColumn("_b", F.sum(F.col("_cut").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    shared = numbered.withColumn("block", F.explode(F.when(F.col("_cut"), F.array(F.col("_b") - 1, F.col("_b"))).otherwise(F.array("_b"))))
    found = shared.groupBy(*axis.key, "block").agg(F.min(axis.time).alias("b_start"), F.max(axis.time).alias("b_end"), F.avg(signal).alias("b_mean"))
    return found.where("b_start < b_end")


def block_deltas(blocks: DataFrame, axis: Axis) -> DataFrame:
    """blocks with delta: the next block's mean less this one's (0 for the last)."""
    w = Window.partitionBy(*axis.key).orderBy("block")
    return blocks.withColumn("delta", F.coalesce(F.lead("b_mean").over(w) - F.col("b_mean"), F.lit(0.0)))


def nearest_cluster(steps: DataFrame, centres: list[tuple[int, float]], delta: str = "delta") -> DataFrame:
    """steps with cluster: that of the nearest centre, the first on ties; null without centres. centres is a short list."""
    if not centres:
        return steps.withColumn("cluster", F.lit(None).cast("int"))
    pairs = F.array(*(F.struct(F.abs(F.col(delta) - p).alias("d"), F.lit(c).alias("cluster")) for c, p in sorted(centres)))
    return steps.withColumn("cluster", F.when(F.col(delta).isNotNull(), F.array_min(pairs)["cluster"]))


def on_off_records(deltas: DataFrame, axis: Axis, centres: list[tuple[int, float]]) -> DataFrame:
    """(key, emission, clusterId, starttime, endtime, aggNum): a fold over each event's steps.

    A step up opens the nearest cluster at the block's end. A step down closes the open one whose step up is nearest in
    size (the first on ties); with none open it is ignored. What is left closes at the last block's end, in order.
    aggNum: how many of the cluster stay open after a closing. A well that is on when the event starts is never opened.
    Without centres there are no records.
    """
    if not centres:
        deltas, centres = deltas.where(F.lit(False)), [(0, 0.0)]
    rows = deltas.groupBy(*axis.key).agg(F.sort_array(F.collect_list(F.struct("block", "delta", "b_end"))).alias("steps"), F.max("b_end").alias("last"))
    near = "array_min(array({}))".format(", ".join(f"named_struct('d', abs(d.delta - {p!r}D), 'k', {c})" for c, p in sorted(centres)))
    kind = deltas.schema["b_end"].dataType.simpleString()
    act, out = f"array<struct<k:int,p:double,t:{kind}>>", f"array<struct<k:int,t0:{kind},t1:{kind},agg:int>>"

    def close(j: str, at: str) -> str:
        """The state after closing the open one at index j (from 0)."""
        return f"""element_at(transform(array({j}), j -> named_struct(
            'act', filter(s.act, (a, i) -> i <> j),
            'out', concat(s.out, array(named_struct('k', s.act[j].k, 't0', s.act[j].t, 't1', {at},
                'agg', size(filter(s.act, (a, i) -> i <> j and a.k = s.act[j].k))))))), 1)"""

    fold = f"""aggregate(steps, named_struct('act', cast(array() as {act}), 'out', cast(array() as {out})), (s, d) ->
        case when d.delta > 0 then named_struct('act', concat(s.act, array(named_struct('k', {near}.k, 'p', d.delta, 't', d.b_end))), 'out', s.out)
             when d.delta < 0 and size(s.act) > 0 then {close("array_min(transform(s.act, (a, i) -> named_struct('d', abs(a.p + d.delta), 'i', i))).i", "d.b_end")}
             else s end)"""
    rest = f"aggregate(if(size(state.act) > 0, sequence(1, size(state.act)), cast(array() as array<int>)), state, (s, n) -> {close('0', 'last')}, s -> s.out)"
    done = rows.withColumn("state", F.expr(fold)).withColumn("records", F.expr(rest))
    return done.select(*axis.key, F.posexplode("records").alias("emission", "r")).select(
        *axis.key, "emission", F.col("r.k").alias("clusterId"), F.col("r.t0").alias("starttime"), F.col("r.t1").alias("endtime"), F.col("r.agg").alias("aggNum")
    )


def in_index_range(samples: DataFrame, axis: Axis, first: int = 0, last: int | None = None) -> DataFrame:
    """Samples of a series' events from index `first` up to, not including, `last` (counted from 0 in the events' order)."""
    if first < 0 or (last is not None and last < first):
        raise ValueError("a range of event indices runs from 0 upwards")
    *series, event = axis.key
    order = Window.partitionBy(*series).orderBy(event)
    index = samples.select(*axis.key).distinct().withColumn("_index", F.row_number().over(order) - 1)
    return samples.join(index.where((F.col("_index") >= first) & (F.lit(True) if last is None else F.col("_index") < last)).drop("_index"), list(axis.key), "left_semi")


def decomposed(samples: DataFrame, others: DataFrame, axis: Axis, signal: str, centres: list[tuple[int, float]], threshold: float = 10.0, second: float = 3.0, first: int = 0, last: int | None = None) -> DataFrame:
    """Records of all events, then (second pass) of the `others` again with a lower threshold, numbered in each series.

    axis.key is the series and, last, the event. The other events are those with an index from `first` up to `last`.
    """
    if first or last is not None:
        others = in_index_range(others, axis, first, last)
    passes = []
    for n, (rows, thr) in enumerate(((samples, threshold), (others, second)), 1):
        found = on_off_records(block_deltas(change_blocks(rows, axis, signal, thr), axis), axis, centres)
        passes.append(found.withColumn("pass", F.lit(n)))
    both = passes[0].unionByName(passes[1])
    order = Window.partitionBy(*axis.key[:-1]).orderBy("pass", axis.key[-1], "emission")
    return both.withColumn("recordId", F.row_number().over(order))


def cluster_power(features: DataFrame, cluster: str, feature: str) -> DataFrame:
    """(cluster, power, size): the mean of a feature in each cluster."""
    return features.groupBy(F.col(cluster).alias("cluster")).agg(F.avg(feature).alias("power"), F.count(F.lit(1)).alias("size"))


#: Combinations that are tried for each row as they are; of more, a table of different sums is looked up, or halves meet in the middle.
TRIED = 4096
#: Different sums of a table.
SUMS = 1 << 20


def half_sums(powers: list[float], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) of all combinations, by ascending counts."""
    counts = np.array(list(itertools.product(range(most + 1), repeat=len(powers))), np.int64).reshape(-1, len(powers))
    return counts, counts @ np.array(powers)


@functools.lru_cache(4)
def different_sums(powers: tuple[float, ...], most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(sums, counts) of all combinations by ascending sum, of equal ones (to nine digits) the smallest counts; None if there are more than SUMS
    different ones."""
    if (most + 1) ** len(powers) >= 1 << 62:
        return None
    sums, codes = np.zeros(1), np.zeros(1, np.int64)  # counts as digits of a number: one power after the other, the smaller number first
    for p in powers:
        sums = (sums[:, None] + np.arange(most + 1) * p).ravel()
        codes = (codes[:, None] * (most + 1) + np.arange(most + 1)).ravel()
        near = np.round(sums, 9)
        order = np.lexsort((codes, near))
        order = order[np.concatenate([[True], np.diff(near[order]) > 0])]
        sums, codes = sums[order], codes[order]
        if len(sums) > SUMS:
            return None
    counts = codes[:, None] // (most + 1) ** np.arange(len(powers) - 1, -1, -1) % (most + 1)
    return sums, counts


def from_table(x: np.ndarray, powers: list[float], sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, distance) of the sum nearest to each of x, the smallest counts on ties."""
    at = np.searchsorted(sums, x)
    low, high = counts[np.maximum(at - 1, 0)], counts[np.minimum(at, len(sums) - 1)]
    miss_low, miss_high = (np.abs(sum((c[:, k] * p for k, p in enumerate(powers[1:], 1)), c[:, 0] * powers[0]) - x) for c in (low, high))
    first = np.argmax(low != high, 1)[:, None]
    smaller = (np.take_along_axis(low, first, 1) <= np.take_along_axis(high, first, 1))[:, 0]
    take = (miss_low < miss_high) | ((miss_low == miss_high) & smaller)
    return np.where(take[:, None], low, high), np.where(take, miss_low, miss_high)


def nearest_combinations(x: np.ndarray, powers: list[float], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, distance) of the combination nearest to each of x, the smallest counts on ties: from a table where few sums are different,
    else for every sum of one half of the powers the nearest sum of the other half."""
    if (table := different_sums(tuple(powers), most)) is not None:
        return from_table(x, powers, *table)
    half = len(powers) // 2
    first, a = half_sums(powers[:half], most)
    second, b = half_sums(powers[half:], most)
    order = np.lexsort((np.arange(len(b)), np.round(b, 9)))
    once = np.concatenate([[True], np.diff(np.round(b, 9)[order]) > 0])  # of equal sums the smallest counts
    second, b = second[order][once], b[order][once]
    out, off = np.zeros((len(x), len(powers)), np.int64), np.zeros(len(x))
    exact = lambda c: np.array([sum((int(n) * p for n, p in zip(row[1:], powers[1:], strict=True)), int(row[0]) * powers[0]) for row in c])
    for k, v in enumerate(x.tolist()):
        at = np.searchsorted(b, v - a)
        near = np.stack([np.maximum(at - 1, 0), np.minimum(at, len(b) - 1)])
        d = np.abs(a + b[near] - v)
        side, i = np.nonzero(d <= d.min() + 1e-9 * (1 + abs(v)))
        c = np.concatenate([first[i], second[near[side, i]]], 1)
        miss = np.abs(exact(c) - v)
        best = min(range(len(c)), key=lambda j: (miss[j], c[j].tolist()))
        out[k], off[k] = c[best], miss[best]
    return out, off


def residual_combinations(events: DataFrame, signal: str, powers: list[float], most: int = 3) -> DataFrame:
    """events with counts (pumps of each power, up to `most` each) whose sum comes nearest to the signal, and the residual share.

    Of many powers whose sums often agree, a row is one look at a table of the different sums; else sums of one half meet sums of the
    other: (most + 1) ** (n / 2) looks a row instead of (most + 1) ** n.
    """
    if (most + 1) ** len(powers) > TRIED:
        reachable(events.sparkSession)

        @F.pandas_udf("struct<d:double,counts:array<int>>")
        def best(x: pd.Series) -> pd.DataFrame:
            v = x.to_numpy(float)
            fine = np.isfinite(v)
            counts, off = nearest_combinations(v[fine], powers, most)
            found = iter(zip(off.tolist(), counts.astype(np.int32), strict=True))
            return pd.DataFrame([next(found) if ok else (None, None) for ok in fine], columns=["d", "counts"])

        combos = F.when(F.col(signal).isNotNull(), best(F.col(signal).cast("double")))
    else:
        sets = "array(array())"
        for _ in powers:
            sets = f"flatten(transform({sets}, c -> transform(sequence(0, {most}), n -> concat(c, array(n)))))"
        total = " + ".join(f"c[{k}] * {p!r}D" for k, p in enumerate(powers))
        combos = F.expr(f"array_min(transform({sets}, c -> named_struct('d', abs({total} - {signal}), 'counts', c)))")
    return events.withColumn("_best", combos).withColumn("counts", F.col("_best.counts")).withColumn("residual", F.try_divide("_best.d", F.abs(signal))).drop("_best")


def mean_residues(events: DataFrame, by: list[str], signal: str, powers: list[float], most: int = 3) -> DataFrame:
    """(by, residual): the mean residual share of each event's samples; by names the event."""
    return residual_combinations(events, signal, powers, most).groupBy(*by).agg(F.avg("residual").alias("residual"))
