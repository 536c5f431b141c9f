"""Smoothers of a signal within an event."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window, WindowSpec

from wattloom.functions.columns import Axis, clipped
from wattloom.functions.session import reachable

#: Weights of a cubic fitted to five samples: in the middle, and at the first two places of an edge.
MIDDLE = [x / 35 for x in (-3, 12, 17, 12, -3)]
EDGE0 = [x / 70 for x in (69, 4, -6, 4, -1)]
EDGE1 = [x / 35 for x in (2, 27, 12, -8, 2)]


def weighted(signal: Column, w: WindowSpec, weights: list[float], first: int) -> Column:
    """Weighted sum of the samples from offset `first` on; null where one is missing."""
    return sum((F.lag(signal, -(first + k)).over(w) * x for k, x in enumerate(weights[1:], 1)), F.lag(signal, -first).over(w) * weights[0])


def savgol(signal: Column, w: WindowSpec) -> Column:
    """Savitzky-Golay of five samples and degree 3; the cubic of the first and last five serves the edges."""
    after = [(weighted(signal, w, EDGE0, 0), 0), (weighted(signal, w, EDGE1, -1), 1)]
    before = [(weighted(signal, w, EDGE0[::-1], -4), 0), (weighted(signal, w, EDGE1[::-1], -3), 1)]
    out = weighted(signal, w, MIDDLE, -2)
    rn = F.row_number().over(w)
    for value, k in after:
        out = F.when(rn == k + 1, value).otherwise(out)
    for value, k in before:
        is_end = (F.lead(F.lit(1), k).over(w).isNotNull() if k else F.lit(True)) & F.lead(F.lit(1), k + 1).over(w).isNull()
        out = F.when(is_end, value).otherwise(out)
    return out


def gaussian(signal: Column, w: WindowSpec, sigma: float = 0.5) -> Column:
    """Gaussian of radius four sigmas; the signal is mirrored at the edges, which repeat."""
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = F.lit(0.0)
    for k, x in zip(range(-radius, radius + 1), raw, strict=True):
        mirrored = F.lit(None)
        rn, left = F.row_number().over(w), F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.row_number().over(w) + 1
        for place in range(1, radius + 1):
            if k < 0:
                mirrored = F.when(rn == place, F.lag(signal, -(-k - 2 * place + 1)).over(w)).otherwise(mirrored)
            elif k > 0:
                mirrored = F.when(left == place, F.lag(signal, k - 2 * place + 1).over(w)).otherwise(mirrored)
        total = total + F.coalesce(F.lag(signal, -k).over(w), mirrored) * (x / sum(raw))
    return total


def moving(signal: Column, w: WindowSpec, length: int = 5) -> Column:
    """Mean of `length` samples, only where all are there (at the last of them)."""
    return F.when(F.row_number().over(w) >= length, F.avg(signal).over(w.rowsBetween(-length + 1, 0)))


def centred(signal: Column, w: WindowSpec, length: int = 5) -> Column:
    """Mean of the samples around; fewer at the edges."""
    half = length // 2
    return F.avg(signal).over(w.rowsBetween(-half, half))


#: Cases of a rule, the first that holds counts: when it holds for a window's values (one window's, or arrays of many windows'), and what it makes of one.
Rule = list[tuple[Callable, Callable[..., tuple[float, ...]]]]


class Slide:
    """Rewrites each window of `width` values in turn by `rule`; a window sees what those before it wrote. One with a missing value (NaN) stays as it is.

    Where the rule holds is looked up for all windows at once; only those that may see rewritten values are walked one by one.
    """

    def __init__(self, width: int, rule: Rule):
        self.width, self.rule, self.held = width, rule, np.empty(0)

    def push(self, values: np.ndarray) -> np.ndarray:
        """What no later window can change."""
        held = np.concatenate([self.held, values])
        n = len(held) - self.width + 1
        if n > 0:
            with np.errstate(invalid="ignore"):
                sides = [held[k : k + n] for k in range(self.width)]
                holds = np.logical_or.reduce([when(*sides) for when, _ in self.rule])
            self.walk(held, np.flatnonzero(holds).tolist(), n)
        self.held = held[max(n, 0) :]
        return held[: max(n, 0)]

    def walk(self, held: np.ndarray, starts: list[int], n: int) -> None:
        """Rewrites held from each of `starts` on, until no window sees a rewritten value."""
        k = 0
        for start in starts:
            if start < k:
                continue  # walked already
            k = last = start
            while k <= last and k < n:
                window = held[k : k + self.width].tolist()
                for when, then in self.rule:
                    if when(*window):
                        held[k : k + self.width] = then(*window)
                        last = k + self.width - 1
                        break
                k += 1

    def flush(self) -> np.ndarray:
        out, self.held = self.held, np.empty(0)
        return out


class Chain:
    """Slides one behind the other."""

    def __init__(self, passes: list[tuple[int, Rule]]):
        self.slides = [Slide(width, rule) for width, rule in passes]

    def push(self, values: np.ndarray) -> np.ndarray:
        for s in self.slides:
            values = s.push(values)
        return values

    def flush(self) -> np.ndarray:
        left = np.empty(0)
        for s in self.slides:
            left = np.concatenate([s.push(left), s.flush()])
        return left


def single(trigger: float, delta: float) -> Rule:
    return [(lambda a, b, c: (abs(c - a) < trigger) & (abs(c + a - 2 * b) > delta), lambda a, b, c: (a, a + (c - a) / 2, c))]


def double(trigger: float, delta: float) -> Rule:
    def between(a: float, b: float, c: float, d: float) -> tuple[float, ...]:
        return a, a + (d - a) / 2, a + (d - a) / 2, d

    return [(lambda a, b, c, d: (abs(d - a) < trigger) & (abs(d + a - (b + c) / 2) > delta), between)]


def triple(trigger: float, delta: float) -> Rule:
    dip = (lambda a, b, c: (b - a < -trigger) & (b - c < -trigger), lambda a, b, c: (a, c, c))
    spike = (lambda a, b, c: (b - a > trigger) & (b - c > trigger), lambda a, b, c: (a, a, c))
    flat = (lambda a, b, c: (abs(c - a) < delta) & (abs(b - a) < delta), lambda a, b, c: ((a + b + c) / 3,) * 3)
    return [dip, spike, flat]


def bridged(trigger: float) -> Rule:
    return [(lambda a, b, c, d: (abs(a - d) < trigger) & (abs(b - a) > trigger) & (abs(b - c) > trigger), lambda a, b, c, d: (a, (a + d) / 2, (a + d) / 2, d))]


def repaired(trigger: float = 1.0, delta: float = 1.0) -> list[tuple[int, Rule]]:
    """Repair of outliers: first single samples, then pairs, that stand off from near ends of their window."""
    return [(3, single(trigger, delta)), (4, double(trigger, delta))]


def levelled(trigger: float = 3.0, delta: float = 1.0, rounds: int = 2) -> list[tuple[int, Rule]]:
    """Rounds of: dips take the next sample, spikes the one before, near-flat triples their mean; then pairs that stand off are bridged."""
    return [(3, triple(trigger, delta)), (4, bridged(trigger))] * rounds


REPAIRS: dict[str, Callable] = {"my": repaired, "my2": levelled}
REDUCERS: dict[str, Callable] = {"savgol": savgol, "gaussian": gaussian, "conv": moving, "moving average": moving, "centred": centred}


def streamed(samples: DataFrame, axis: Axis, signal: str, passes: list[tuple[int, Rule]]) -> DataFrame:
    """samples with `smoothed`: the passes one behind the other along each series. A task holds a batch and the few rows that a pass waits with."""
    schema = StructType([*samples.schema.fields, StructField("smoothed", DoubleType())])
    keys = list(axis.key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, now, waiting = Chain(passes), None, None  # waiting: rows whose values the chain still holds

        def given(rows: pa.Table, done: np.ndarray) -> Iterator[pa.RecordBatch]:
            rows = rows.slice(0, len(done))
            values = pa.array(done, pa.float64(), mask=rows.column(signal).is_null().to_numpy())  # a missing value stays missing
            yield from rows.append_column("smoothed", values).combine_chunks().to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            done = []
            series = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
            values = b.column(signal).cast(pa.float64()).to_numpy(zero_copy_only=False)
            edges = [k for k in range(len(series)) if not k or series[k] != series[k - 1]]
            for lo, hi in zip(edges, [*edges[1:], len(series)], strict=True):
                if series[lo] != now:
                    done.append(chain.flush())
                    now = series[lo]
                done.append(chain.push(values[lo:hi]))
            rows = pa.Table.from_batches([b]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([b])])
            ready = np.concatenate(done)
            yield from given(rows, ready)
            waiting = rows.slice(len(ready))
        if waiting is not None:
            yield from given(waiting, chain.flush())

    reachable(samples.sparkSession)
    rows = samples.repartition(*keys).sortWithinPartitions(*keys, axis.time, *axis.tie)
    return rows.mapInArrow(run, schema)


def smoothed(samples: DataFrame, axis: Axis, signal: str, method: str, threshold: float = 3.0, **how) -> DataFrame:
    """samples with `smoothed`, and `clipped` (the same, 0 at or under the threshold); each series of the key on its own."""
    if method in REPAIRS:
        flat = streamed(samples, axis, signal, REPAIRS[method](**how))
    else:
        flat = samples.withColumn("smoothed", REDUCERS[method](F.col(signal).cast("double"), axis.window(), **how))
    return flat.withColumn("clipped", clipped("smoothed", threshold))
