"""What needs the distances of all pairs: blocks of rows against blocks of rows, as matrices in tasks; no row for each pair.

A task holds one block and lets the others stream by, so that its memory is two blocks and what it keeps of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.functions.session import reachable, with_checkpoints

#: Rows of a block, about.
ROWS = 1000
#: Clusters (of all labellings) whose distances are summed in one product.
COLUMNS = 4096
#: Distances that are worked on at once (numbers that a core's cache holds).
CACHED = 16384


class Block(NamedTuple):
    """Rows of a block by ascending id: ids, coordinates (n, d), and further columns as Arrow arrays by name."""

    number: int
    ids: np.ndarray
    x: np.ndarray
    more: dict[str, pa.Array]


def as_block(number: int, values: pa.StructArray) -> Block:
    """A block of rows (id, x, and further fields)."""
    ids = values.field("id").to_numpy()
    x = np.array(values.field("x").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(ids), -1)
    return Block(number, ids, x, {f.name: values.field(f.name) for f in list(values.type)[2:]})


def one_list(fields: dict[str, Any]) -> pa.ListArray:
    """One list of structs with these fields; a field with two dimensions is one of lists."""
    lists = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
    rows = pa.StructArray.from_arrays([lists(v) if v.ndim == 2 else pa.array(v) for v in fields.values()], names=list(fields))
    return pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)


def blocked(rows: DataFrame, columns: list[str], more: dict[str, Column] | None = None, part: str | None = None) -> DataFrame:
    """(b, rows) of rows (id, columns): blocks of about ROWS rows each, dealt by a hash of the id. An id stands for one row. With `part` (a
    column of small whole numbers from 0 on) a block holds rows of one part: (b, part, rows)."""
    each = F.struct(F.col("id").cast("long").alias("id"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"), *(c.alias(k) for k, c in (more or {}).items()))
    most = rows.count() if part is None else rows.groupBy(part).count().agg(F.max("count")).first()[0] or 0
    n = max(1, math.ceil(most / ROWS))
    at = F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(n)).cast("int")
    by = [at.alias("b")] if part is None else [(F.col(part) * n + at).cast("int").alias("b"), F.col(part).alias("part")]
    return rows.groupBy(*by).agg(F.sort_array(F.collect_list(each)).alias("rows"))


def cut_tree(sample: np.ndarray, n: int) -> list[tuple[int, float, int, int]]:
    """(axis, edge, below, above) of a tree that cuts a sample into n parts at medians of its widest axis; a child under 0 is part -child - 1."""
    nodes: list = []
    parts = iter(range(n))

    def cut(x: np.ndarray, n: int) -> int:
        if n == 1:
            return -next(parts) - 1
        at, axis = len(nodes), int(np.ptp(x, axis=0).argmax()) if len(x) else 0
        nodes.append(None)
        edge = float(np.quantile(x[:, axis], (n // 2) / n)) if len(x) else 0.0
        below = x[:, axis] <= edge
        nodes[at] = (axis, edge, cut(x[below], n // 2), cut(x[~below], n - n // 2))
        return at

    cut(sample, n)
    return nodes


def near_blocked(rows: DataFrame, columns: list[str], more: dict[str, Column] | None = None) -> DataFrame:
    """(b, rows, lo, hi) of rows (id, columns): blocks of about ROWS rows that lie beside one another, and their boxes. A sample of 32 rows a
    block (200,000 at most) places the edges, on which no result depends."""
    reachable(rows.sparkSession)
    count = rows.count()
    n = max(1, math.ceil(count / ROWS))
    x = F.array(*(F.col(c).cast("double") for c in columns))
    most = min(32 * n, 200_000)
    sample = rows.select(x.alias("x"), F.xxhash64(F.col("id").cast("long")).alias("h")).orderBy("h").limit(most).toArrow()
    tree = cut_tree(np.array(sample.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, len(columns)), n)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").flatten().to_numpy(zero_copy_only=False)).reshape(-1, len(columns))
            at = np.full(len(x), 0 if tree else -1)
            while (inner := at >= 0).any():
                for k in np.unique(at[inner]).tolist():
                    axis, edge, below, above = tree[k]
                    mine = np.flatnonzero(at == k)
                    at[mine] = np.where(x[mine, axis] <= edge, below, above)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array((-at - 1).astype(np.int32))], names=["_id", "_block"])

    dealt = rows.select(F.col("id").cast("long").alias("id"), x.alias("x")).mapInArrow(deal, "_id long, _block int")
    each = F.struct(F.col("id").cast("long").alias("id"), x.alias("x"), *(c.alias(k) for k, c in (more or {}).items()))
    ends = {n: F.array(*(f(c).cast("double") for c in columns)) for n, f in (("lo", F.min), ("hi", F.max))}
    made = rows.join(dealt, F.col("id").cast("long") == F.col("_id")).groupBy(F.col("_block").alias("b")).agg(F.sort_array(F.collect_list(each)).alias("rows"), *(c.alias(k) for k, c in ends.items()))
    with_checkpoints(rows.sparkSession)
    return made.checkpoint()


def near_pairs(blocks: DataFrame, reach: Column | str, half: bool = False) -> DataFrame:
    """(to, b) of blocks (b, lo, hi, and what `reach` needs) whose boxes are at most `reach` of `to` apart; with `half`, either of two blocks
    gets the other, in turns, so that no block has most of the work."""
    own = blocks.drop("rows").select(F.col("b").alias("to"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), (F.expr(reach) if isinstance(reach, str) else reach).alias("_reach"))
    gap = F.expr("aggregate(zip_with(zip_with(_lo, hi, (a, b) -> a - b), zip_with(lo, _hi, (a, b) -> a - b), (a, b) -> greatest(a, b, 0D)), 0D, (s, d) -> s + d * d)")
    on = (F.sqrt(gap) <= F.col("_reach") * (1 + 1e-9)) & (((F.col("b") == F.col("to")) | ((F.col("b") > F.col("to")) == ((F.col("b") + F.col("to")) % 2 == 0))) if half else F.lit(True))
    return own.join(F.broadcast(blocks.select("b", "lo", "hi")), on).select("to", "b")  # a number and a box for each block


def against_all(blocks: DataFrame, start: Callable[[Block], Any], step: Callable[[Any, Block], pa.RecordBatch | None], finish: Callable[[Any], pa.RecordBatch | None], schema: str, half: bool = False, pairs: DataFrame | None = None) -> DataFrame:
    """Each block against every one (with `half`, those with its number or a higher one; with `pairs` (to, b), those that it is paired with): start(own) gives what step(kept, other) updates
    and finish(kept) turns into rows; step may give rows as well."""
    spark = blocks.sparkSession
    reachable(spark)
    with_checkpoints(spark)
    blocks = blocks.checkpoint() if pairs is None else blocks
    n = (blocks.agg(F.max("b")).first()[0] or 0) + 1
    last = F.col("b") if half else F.lit(n - 1)
    others = blocks.select("b", "rows", F.explode(F.sequence(F.lit(0), last)).alias("to")) if pairs is None else pairs.join(blocks, "b")
    others = others.select("to", F.lit(1).alias("turn"), "b", "rows")
    work = blocks.select(F.col("b").alias("to"), F.lit(0).alias("turn"), "b", "rows").unionByName(others)
    work = work.repartitionById(n, F.col("to")).sortWithinPartitions("to", "turn", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, of = None, -1
        for batch in batches:
            turns, numbers, to = (batch.column(c).to_pylist() for c in ("turn", "b", "to"))
            for k, (turn, number) in enumerate(zip(turns, numbers, strict=True)):
                if turn and to[k] != of:  # a number without a block
                    continue
                block = as_block(number, batch.column("rows").slice(k, 1).flatten())
                if turn == 0:
                    if kept is not None and (out := finish(kept)) is not None:
                        yield out
                    kept, of = start(block), number
                elif (out := step(kept, block)) is not None:
                    yield out
        if kept is not None and (out := finish(kept)) is not None:
            yield out

    return work.mapInArrow(run, schema)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of a to rows of b; a column at a time, so that equal rows are exactly 0 apart, and few rows at once."""
    total, b = np.zeros((len(a), len(b))), b.T.copy()
    at_once = max(1, CACHED // max(1, b.shape[1]))
    room = np.empty((at_once, b.shape[1]))
    for lo in range(0, len(a), at_once):
        some = total[lo : lo + at_once]
        d = room[: len(some)]
        for x, y in zip(a[lo : lo + at_once].T, b, strict=True):
            np.subtract(x[:, None], y, out=d)
            some += np.multiply(d, d, out=d)
        np.sqrt(some, out=some)
    return total


def batch(schema: dict[str, pa.DataType], *columns: Any) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.values(), strict=True)], names=list(schema))


SILHOUETTES = {"labelling": pa.int32(), "id": pa.int64(), "cluster": pa.int64(), "weight": pa.int64(), "silhouette": pa.float64()}


def all_silhouettes(points: DataFrame, columns: list[str], labels: DataFrame, part: str | None = None) -> DataFrame:
    """(labelling, id, cluster, weight, silhouette) of points (id, weight, columns) under many labellings (labelling, id, cluster).

    Points without a cluster in a labelling (noise) take no part in it. A point counts `weight` times; 0 in a cluster of one. The
    distances of two blocks are worked out once for all labellings. `part` names a column of small whole numbers from 0 on, where no
    labelling has points of several parts: blocks then hold one part and meet those of the same part only.
    """
    of = labels.groupBy("id").agg(F.collect_list(F.struct(F.col("labelling").cast("int").alias("l"), F.col("cluster").cast("long").alias("c"))).alias("labels"))
    blocks, pairs = blocked(points.join(of, "id"), columns, {"w": F.col("weight").cast("long"), "labels": F.col("labels")}, part), None
    if part is not None:
        with_checkpoints(points.sparkSession)
        blocks = blocks.checkpoint()
        pairs = blocks.select(F.col("b").alias("to"), "part").join(blocks.select("b", "part"), "part").select("to", "b")
        blocks = blocks.select("b", "rows")

    def table(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each label its row and the place of its (labelling, cluster) among the block's, and these by ascending order."""
        lists = block.more["labels"]
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten()
        labelling, cluster = flat.field("l").to_numpy(), flat.field("c").to_numpy()
        order = np.lexsort((cluster, labelling))
        labelling, cluster = labelling[order], cluster[order]
        new = np.concatenate([[True], (labelling[1:] != labelling[:-1]) | (cluster[1:] != cluster[:-1])])[: len(order)]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        return row, place, np.rec.fromarrays([labelling[new].astype(np.int64), cluster[new]], names="l,c")

    def start(own: Block):
        row, place, names = table(own)
        return [own, row, place, names, names, np.zeros((len(own.ids), len(names))), np.zeros(len(names))]

    def step(kept, other: Block):
        own, _, _, mine, names, sums, total = kept
        row, place, theirs = table(other)
        use = np.isin(theirs["l"], np.unique(mine["l"]))  # labellings of both
        weight = other.more["w"].to_numpy()
        same = len(names) == len(theirs) and bool((names == theirs).all())
        if not same:
            every = np.unique(np.concatenate([names, theirs[use]]))
            if len(every) > len(names):
                wider, totals = np.zeros((len(own.ids), len(every))), np.zeros(len(every))
                have = np.searchsorted(every, names)
                wider[:, have], totals[have] = sums, total
                kept[4:] = names, sums, total = every, wider, totals
        at = np.arange(len(names)) if same else np.searchsorted(names, theirs)
        apart = distances(own.x, other.x)
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        for lo in range(0, len(theirs), COLUMNS):
            hi = min(lo + COLUMNS, len(theirs))
            part = slice(*np.searchsorted(place, [lo, hi]))
            share = np.zeros((len(other.ids), hi - lo))
            share[row[part], place[part] - lo] = weight[row[part]]
            fine = use[lo:hi]
            if not fine.all():
                share = share[:, fine]
            to = at[lo:hi][fine]
            if not len(to):
                continue
            to = slice(to[0], to[-1] + 1) if to[-1] - to[0] == len(to) - 1 else to
            sums[:, to] += apart @ share
            total[to] += share.sum(0)

    def finish(kept):
        own, row, place, mine, names, sums, total = kept
        weight, out = own.more["w"].to_numpy(), []
        for k in np.unique(mine["l"]).tolist():
            lo, hi = np.searchsorted(names["l"], [k, k + 1])
            labels = mine["l"][place] == k
            rows, cluster = row[labels], mine["c"][place[labels]]
            d, n = sums[rows, lo:hi], total[lo:hi]
            at = np.searchsorted(names["c"][lo:hi], cluster)
            a = d[np.arange(len(rows)), at] / np.maximum(n[at] - 1, 1)
            mean = d / n
            mean[np.arange(len(rows)), at] = np.inf
            b = mean.min(1)
            most = np.maximum(a, b)
            with np.errstate(invalid="ignore", divide="ignore"):
                s = np.where((n[at] > 1) & np.isfinite(b) & (most > 0), (b - a) / most, 0.0)
            out.append(batch(SILHOUETTES, np.full(len(rows), k), own.ids[rows], cluster, weight[rows], s))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

    return against_all(blocks, start, step, finish, "labelling int, id long, cluster long, weight long, silhouette double", pairs=pairs)
