"""Clusters by density: DBSCAN for many radii and counts at once, and OPTICS, both from one spanning forest for each count.

Points that are equal are one point with a weight. For each min_samples, points have a core distance (the radius that
holds so many rows), and pairs a reach: the largest of their distance and both core distances. A minimum spanning tree
over reaches holds the components of every radius, and the order of OPTICS (whose
reach is thus the same from both sides: at least the core distance of either). Trees of two blocks are made in tasks from
coordinates (of many points only those of near blocks, see spanning_trees); an edge that is not in the tree of a part is not in that of the whole, so trees of parts merge. The tree
of one min_samples (24 bytes a point) and its nearest few points end up in one task.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.functions.session import reachable, with_checkpoints
from wattloom.operators.blockwise import COLUMNS, Block, against_all, batch, blocked, distances, near_blocked, near_pairs

EPS = tuple(k / 100 for k in range(1, 100))
MIN_SAMPLES = tuple(range(2, 11))
XI = tuple(round(0.01 + 0.05 * k, 2) for k in range(10))
#: Trees that a task merges.
TREES = 8
#: Points from which on blocks lie beside one another and meet only where they are near.
MANY = 8000
#: Clusters whose sums of distances a task holds for its rows.
CLUSTERS = 32768
#: A cluster with this share of all points, or more, is summed by products.
MEETING = 32


def weighted(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(id, weight, columns): equal rows as one, under their smallest id. Rows with a missing coordinate are left out."""
    return rows.dropna(subset=columns).groupBy(*columns).agg(F.min(F.col("id").cast("long")).alias("id"), F.count(F.lit(1)).alias("weight"))


def nearest(points: DataFrame, columns: list[str], most: int) -> DataFrame:
    """(id, weight, columns, near: array of (d, id, w)): the `most` nearest points of each, itself included, the smaller id on ties."""
    weight, many = {"w": F.col("weight").cast("long")}, points.count() > MANY
    blocks = near_blocked(points, columns, weight) if many else blocked(points, columns, weight)

    def start(own: Block):
        n = len(own.ids)
        return own, [np.full((n, most), np.inf), np.full((n, most), np.iinfo(np.int64).max), np.zeros((n, most), np.int64)]

    def step(kept, other: Block):
        own, near = kept
        off = np.maximum(np.maximum(other.x.min(0) - own.x, own.x - other.x.max(0)), 0)
        row = np.flatnonzero(np.sqrt((off * off).sum(1)) * (1 - 1e-9) <= near[0][:, -1])
        if not len(row):
            return
        apart, last = distances(own.x[row], other.x), near[0][row, -1]
        if len(other.ids) > most:
            last = np.minimum(last, np.partition(apart, most - 1, axis=1)[:, most - 1])
        r, c = np.nonzero(apart <= last[:, None])
        old = np.repeat(np.arange(len(row)), most)
        d = np.concatenate([near[0][row].ravel(), apart[r, c]])
        ids = np.concatenate([near[1][row].ravel(), other.ids[c]])
        w = np.concatenate([near[2][row].ravel(), other.more["w"].to_numpy()[c]])
        of = np.concatenate([old, r])
        order = np.lexsort((ids, d, of))
        first = np.searchsorted(of[order], np.arange(len(row)))
        take = order[first[:, None] + np.arange(most)]  # every row has at least `most` places
        near[0][row], near[1][row], near[2][row] = d[take], ids[take], w[take]

    def finish(kept):
        own, (d, ids, w) = kept
        has = w > 0
        each = pa.StructArray.from_arrays([pa.array(v[has]) for v in (d, ids, w)], names=["d", "id", "w"])
        near = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has.sum(1))]), pa.int32()), each)
        return pa.RecordBatch.from_arrays([pa.array(own.ids), near], names=["id", "near"])

    pairs = None
    if many:  # how far the nearest points of a block's own lie bounds where nearer ones can be
        def bound(kept):
            own, (d, _, _) = kept
            return batch({"b": pa.int32(), "far": pa.float64()}, [own.number], [d[:, -1].max()])

        alone = against_all(blocks, start, step, bound, "b int, far double", pairs=blocks.select(F.col("b").alias("to"), "b"))
        pairs = near_pairs(blocks.join(alone, "b"), "far")
    found = against_all(blocks, start, step, finish, "id long, near array<struct<d:double,id:long,w:long>>", pairs=pairs)
    return points.join(found, "id")


def core_distances(near: DataFrame, min_samples: Iterable[int]) -> DataFrame:
    """near with cores: by min_samples, the distance within which so many rows lie (itself counts); null if there are not so many."""
    upto = F.expr("transform(near, (e, i) -> struct(e.d as d, aggregate(slice(near, 1, i + 1), 0L, (a, x) -> a + x.w) as n))")
    reached = lambda m: F.get(F.filter("_upto", lambda e: e["n"] >= m), F.lit(0))["d"]
    cores = F.array(*map(reached, min_samples))
    return near.withColumn("_upto", upto).withColumn("cores", cores).drop("_upto")


def prim(apart: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, reach) of the edges of a minimum spanning tree over reaches, from the distances of all pairs."""
    n = len(core)
    best, of, row, closer = np.full(n, np.inf), np.zeros(n, np.int64), np.empty(n), np.empty(n, bool)
    left, out = core.copy(), []  # endless for what the tree has
    at, has = 0, np.zeros(n, bool)
    for _ in range(n - 1):
        has[at], left[at], best[at] = True, np.inf, np.inf
        np.maximum(apart[at], left, out=row)
        np.maximum(row, core[at], out=row)
        np.less(row, best, out=closer)
        np.copyto(best, row, where=closer)
        np.copyto(of, at, where=closer)
        at = int(best.argmin())
        if best[at] == np.inf:
            at = int(has.argmin())
        else:
            out.append((of[at], at, best[at]))
    a, b, w = zip(*out, strict=True) if out else ((), (), ())
    return np.array(a, np.int64), np.array(b, np.int64), np.array(w, float)


class Sets:
    """Disjoint sets of numbers 0 .. n - 1, with the members of each."""

    def __init__(self, n: int):
        self.of, self.members = list(range(n)), [[k] for k in range(n)]

    def join(self, a: int, b: int) -> tuple[int, list[int]] | None:
        """Joins the sets of a and b: (the set that stays, the members that came to it); None if they were one."""
        a, b = self.of[a], self.of[b]
        if a == b:
            return None
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        moved, self.members[b] = self.members[b], []
        for k in moved:
            self.of[k] = a
        self.members[a] += moved
        return a, moved


EDGES = "m int, part int, a long, b long, reach double"


def lightest(edges: pd.DataFrame) -> pd.DataFrame:
    """The edges of a minimum spanning forest."""
    edges = edges.sort_values(["reach", "a", "b"], kind="stable")
    names, codes = np.unique(edges[["a", "b"]].to_numpy(), return_inverse=True)
    sets = Sets(len(names))
    keep = [sets.join(a, b) is not None for a, b in codes.reshape(-1, 2).tolist()]
    return edges[keep]


KINDS = {"m": pa.int32(), "part": pa.int32(), "a": pa.int64(), "b": pa.int64(), "reach": pa.float64()}


def endless() -> Column:
    """Core distances, endless where there is none."""
    return F.transform("cores", lambda c: F.coalesce(c, F.lit(float("inf"))))


def spanning_trees(points: DataFrame, columns: list[str], min_samples: list[int]) -> DataFrame:
    """(m, part, a, b, reach): for each of min_samples, the edges of a minimum spanning tree of points with cores.

    Of many points, blocks that are near give all edges up to a reach that joins most points. What lies outside of the largest
    component then needs its lightest edge into it and a tree of its own.
    """
    if points.count() <= MANY:
        return merged(block_trees(points, columns, min_samples).checkpoint())
    reach = points.select(F.element_at("cores", -1).alias("c")).agg(F.percentile_approx("c", 0.9)).first()[0]
    if reach is None:
        return merged(block_trees(points, columns, min_samples).checkpoint())
    edges = merged(block_trees(points, columns, min_samples, 2 * reach).checkpoint()).checkpoint()
    inside = edges.groupBy("m").applyInPandas(largest, "m int, id long")
    flags = inside.groupBy("id").agg(F.collect_set("m").alias("_in"))
    marked = points.join(flags, "id", "left").withColumn("out", F.array(*(~F.coalesce(F.array_contains("_in", m), F.lit(False)) for m in min_samples))).drop("_in").checkpoint()
    blocks = near_blocked(marked, columns, {"cores": endless(), "out": F.col("out")})
    outside = blocks.where(F.exists("rows", lambda r: F.exists(r["out"], lambda o: o))).select(F.col("b").alias("to"))
    pairs = outside.crossJoin(F.broadcast(blocks.select("b")))  # a number for each block

    def table(block: Block) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array(block.more[k].flatten().to_numpy(zero_copy_only=False)).reshape(len(block.ids), -1) for k in ("cores", "out"))

    def start(own: Block):
        return own, *table(own), np.full((len(own.ids), len(min_samples)), np.inf), np.full((len(own.ids), len(min_samples)), -1)

    def step(kept, other: Block) -> None:
        own, cores, out, best, to = kept
        theirs, far = table(other)
        some = np.flatnonzero(out.any(1))
        apart = distances(own.x[some], other.x)
        for j in range(len(min_samples)):
            mine, into = out[some, j].astype(bool), np.flatnonzero(~far[:, j].astype(bool))
            if mine.any() and len(into):
                way = np.maximum(apart[mine][:, into], theirs[into, j])
                least = way.argmin(1)
                w = np.maximum(way[np.arange(len(way)), least], cores[some[mine], j])
                nearer = w < best[some[mine], j]
                at = some[mine][nearer]
                best[at, j], to[at, j] = w[nearer], other.ids[into[least[nearer]]]

    def finish(kept) -> pa.RecordBatch:
        own, _, _, best, to = kept
        r, j = np.nonzero(np.isfinite(best))
        ends = own.ids[r], to[r, j]
        return batch(KINDS, np.array(min_samples)[j], np.zeros(len(r), int), np.minimum(*ends), np.maximum(*ends), best[r, j])

    more = against_all(blocks, start, step, finish, EDGES, pairs=pairs)
    every = edges.unionByName(more)
    for j, m in enumerate(min_samples):
        left = marked.where(F.col("out")[j]).select("id", "cores", *columns).checkpoint()
        if not left.isEmpty():
            every = every.unionByName(merged(block_trees(left.withColumn("cores", F.array(F.col("cores")[j])), columns, [m]).checkpoint()))
    return every.withColumn("part", F.lit(0)).groupBy("m", "part").applyInPandas(lightest, EDGES)


def largest(edges: pd.DataFrame) -> pd.DataFrame:
    """(m, id) of the largest component of a forest."""
    names, codes = np.unique(edges[["a", "b"]].to_numpy(), return_inverse=True)
    sets = Sets(len(names))
    for a, b in codes.reshape(-1, 2).tolist():
        sets.join(a, b)
    return pd.DataFrame({"m": edges["m"].iloc[0], "id": names[max(sets.members, key=len)]})


def block_trees(points: DataFrame, columns: list[str], min_samples: list[int], most: float | None = None) -> DataFrame:
    """Edges of the trees of all pairs of blocks; with `most` those up to that reach, from blocks that are near."""
    reachable(points.sparkSession)
    blocks = blocked(points, columns, {"cores": endless()}) if most is None else near_blocked(points, columns, {"cores": endless()})

    def step(own: Block, other: Block) -> pa.RecordBatch | None:
        both = [own] if own.number == other.number else [own, other]
        ids, x = np.concatenate([b.ids for b in both]), np.concatenate([b.x for b in both])
        cores = np.concatenate([b.more["cores"].flatten().to_numpy().reshape(len(b.ids), -1) for b in both])
        if most is not None and len(both) == 2:  # an edge that joins the two has both ends near the other's box
            off = [np.maximum(np.maximum(o.x.min(0) - b.x, b.x - o.x.max(0)), 0) for b, o in (both, both[::-1])]
            near = np.concatenate([np.sqrt((v * v).sum(1)) * (1 - 1e-9) <= most for v in off])
            ids, x, cores = ids[near], x[near], cores[near]
        if len(ids) < 2:
            return None
        out, apart = [], distances(x, x)
        for j, m in enumerate(min_samples):
            a, b, w = prim(apart, cores[:, j])
            if most is not None:
                a, b, w = (v[w <= most] for v in (a, b, w))
            out.append(batch(KINDS, np.full(len(a), m), np.full(len(a), own.number), np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), w))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(o.num_rows for o in out) else None

    pairs = None if most is None else near_pairs(blocks, F.lit(most), half=True)
    return against_all(blocks, lambda own: own, step, lambda own: None, EDGES, half=True, pairs=pairs)


def merged(edges: DataFrame) -> DataFrame:
    """The trees of parts as one for each m."""
    parts = (edges.agg(F.max("part")).first()[0] or 0) + 1
    first = True
    while first or parts > 1:
        edges = edges.withColumn("part", F.col("part") if first else F.floor(F.col("part") / TREES).cast("int"))
        edges = edges.groupBy("m", "part").applyInPandas(lightest, EDGES)
        parts, first = parts if first else math.ceil(parts / TREES), False
    return edges


def padded(lists: pa.ChunkedArray, fill: float) -> np.ndarray:
    """Lists of numbers as a matrix, shorter ones filled up."""
    lists = lists.combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    out = np.full((len(n), n.max(initial=0)), fill)
    out[np.arange(out.shape[1]) < n[:, None]] = lists.flatten().to_numpy()
    return out


class Forest:
    """Points with their nearest ones and core distances, and their trees, for many fits."""

    def __init__(self, rows: DataFrame, columns: list[str], min_samples: Iterable[int] = MIN_SAMPLES):
        with_checkpoints(rows.sparkSession)
        reachable(rows.sparkSession)
        self.rows, self.columns, self.min_samples = rows, columns, sorted(set(min_samples))
        self.points = weighted(rows, columns).checkpoint()
        found = core_distances(nearest(self.points, columns, max(self.min_samples)), self.min_samples)
        self.near = found.checkpoint()
        self.trees = spanning_trees(self.near, columns, self.min_samples).checkpoint()
        each = F.explode(F.arrays_zip(F.array(*map(F.lit, self.min_samples)).alias("m"), F.col("cores").alias("core")))
        self.cores = self.near.select("id", "weight", F.expr("transform(near, e -> e.id)").alias("ids"), F.expr("transform(near, e -> e.d)").alias("ds"), each.alias("c")).select(F.col("c.m").cast("int").alias("m"), "id", "weight", "ids", "ds", F.col("c.core").alias("core"))

    def of_rows(self, labels: DataFrame) -> DataFrame:
        """rows with the cluster of their point (id, cluster); null for noise and rows with a missing coordinate."""
        named = self.points.join(labels.select("id", "cluster"), "id").select(*(F.col(c).alias(f"_p_{c}") for c in self.columns), "cluster")
        same = [F.col(c) == F.col(f"_p_{c}") for c in self.columns]
        on = same[0]
        for more in same[1:]:
            on = on & more
        return self.rows.join(named, on, "left").drop(*(f"_p_{c}" for c in self.columns))

    def labellings(self, eps: Iterable[float], most: int | None = None) -> DataFrame:
        """(m, eps, id, cluster) of the points that are no noise, for every pair of radius and count: cluster is the smallest core id that
        is reached through cores at most eps apart; a point that is no core takes the smallest of the cores within eps.

        With `most`, labellings of fewer than two clusters or of `most` labels or more (noise is one) are left out, and so
        is one that equals that of the radius before.
        """
        eps = sorted(eps)
        kinds = {"m": pa.int32(), "eps": pa.float64(), "id": pa.int64(), "cluster": pa.int64()}

        def run(cores: pa.Table, tree: pa.Table) -> pa.Table:
            cores = cores.sort_by("id")
            ids, core = cores.column("id").to_numpy(), cores.column("core").combine_chunks().fill_null(float("inf")).to_numpy(zero_copy_only=False)
            if not len(ids):
                return batch_table(kinds)
            m = cores.column("m")[0].as_py()
            near, ds = padded(cores.column("ids"), ids[0]), padded(cores.column("ds"), np.inf)
            near = np.searchsorted(ids, near)
            tree = tree.sort_by("reach")
            a, b = (np.searchsorted(ids, tree.column(c).to_numpy()) for c in "ab")
            reach, at = tree.column("reach").to_numpy(), 0
            sets, label, before, out = Sets(len(ids)), np.arange(len(ids)), None, []
            for e in eps:
                while at < len(reach) and reach[at] <= e:
                    x, y = int(a[at]), int(b[at])
                    least = min(int(label[x]), int(label[y]))
                    if joined := sets.join(x, y):
                        stays, moved = joined
                        if label[stays] != least:
                            label[sets.members[stays]] = least
                        else:
                            label[moved] = least
                    at += 1
                is_core = core <= e
                last = np.iinfo(np.int64).max
                offered = np.where((ds <= e) & is_core[near], label[near], last).min(1, initial=last)
                found = np.where(is_core, label, offered)
                noise = found == last
                if most is not None:
                    k = len(np.unique(found[~noise]))
                    if k < 2 or k + noise.any() >= most or (before is not None and np.array_equal(before, found)):
                        continue
                    before = found
                out.append(batch(kinds, np.full((~noise).sum(), m), np.full((~noise).sum(), e), ids[~noise], ids[found[~noise]]))
            return pa.Table.from_batches(out) if out else batch_table(kinds)

        def batch_table(kinds) -> pa.Table:
            return pa.Table.from_batches([batch(kinds, [], [], [], [])])

        return self.cores.groupBy("m").cogroup(self.trees.groupBy("m")).applyInArrow(run, "m int, eps double, id long, cluster long")

    def orders(self) -> DataFrame:
        """(m, place, id, weight, reach, core): the order of OPTICS from the smallest id on; the first has no reach (null)."""

        def run(cores: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
            if not len(cores):
                return pd.DataFrame({"m": [], "place": [], "id": [], "weight": [], "reach": [], "core": []})
            beside: dict[int, list[tuple[float, int]]] = {i: [] for i in cores["id"].tolist()}
            for a, b, w in zip(tree["a"].tolist(), tree["b"].tolist(), tree["reach"].tolist(), strict=True):
                beside[a].append((w, b))
                beside[b].append((w, a))
            seen, order = set(), []
            for first in sorted(beside):  # one tree, unless there are fewer rows than min_samples
                queue = [(math.inf, first)]
                while queue:
                    w, i = heapq.heappop(queue)
                    if i in seen:
                        continue
                    seen.add(i)
                    order.append((i, None if w == math.inf else w))
                    for edge in beside[i]:
                        if edge[1] not in seen:
                            heapq.heappush(queue, edge)
            by = cores.set_index("id")
            ids = [i for i, _ in order]
            return pd.DataFrame({"m": cores["m"].iloc[0], "place": range(len(order)), "id": ids, "weight": by.loc[ids, "weight"].to_numpy(), "reach": [w for _, w in order], "core": by.loc[ids, "core"].to_numpy()})

        cores = self.cores.select("m", "id", "weight", "core")
        return cores.groupBy("m").cogroup(self.trees.select("m", "a", "b", "reach").groupBy("m")).applyInPandas(run, "m int, place int, id long, weight long, reach double, core double")

    def extracted(self, xi: Iterable[float] = XI) -> DataFrame:
        """(m, xi, id, cluster) of OPTICS' clusters: of nested ones the innermost; points outside of all are noise and left out.

        Equal rows stand behind one another in the order, as far apart as their core distance.
        """
        xi = sorted(xi)

        def run(order: pd.DataFrame) -> pd.DataFrame:
            order = order.sort_values("place")
            m = int(order["m"].iloc[0])
            copies = np.repeat(np.arange(len(order)), order["weight"])
            again = np.concatenate([[False], copies[1:] == copies[:-1]])
            reach = np.where(again, order["core"].to_numpy(float)[copies], order["reach"].fillna(np.inf).to_numpy(float)[copies])
            ids, out = order["id"].to_numpy(), []
            for x in xi:
                label = innermost(steep_clusters(reach, x, m), len(copies))
                part = pd.DataFrame({"id": ids[copies], "cluster": label})[label >= 0].drop_duplicates("id")
                out.append(part.assign(m=m, xi=x))
            return pd.concat(out)[["m", "xi", "id", "cluster"]]

        return self.orders().groupBy("m").applyInPandas(run, "m int, xi double, id long, cluster long")


def steep(reach: np.ndarray, xi: float, least: int, down: bool) -> list[tuple[int, int]]:
    """Maximal steep areas of a reachability plot: they begin and end at xi-steep places, go one way only, and have fewer than `least`
    places in a row between that are not steep."""
    a, b = (reach[:-1], reach[1:]) if down else (reach[1:], reach[:-1])
    with np.errstate(invalid="ignore"):
        is_steep, one_way = a * (1 - xi) >= b, a >= b
    is_steep &= ~(np.isinf(a) & np.isinf(b))
    out, k, n = [], 0, len(a)
    while k < n:
        if not is_steep[k]:
            k += 1
            continue
        last, j, flat = k, k + 1, 0
        while j < n and one_way[j]:
            flat = 0 if is_steep[j] else flat + 1
            if flat >= least:
                break
            if is_steep[j]:
                last = j
            j += 1
        out.append((k, last))
        k = last + 1
    return out


def steep_clusters(reach: np.ndarray, xi: float, least: int) -> list[tuple[int, int]]:
    """(first, last) of the clusters of a reachability plot: from a steep way down to a steep way up, of `least` places at least, with all
    in between lower than both ends by xi."""
    plot = np.concatenate([reach, [np.inf]])
    downs, ups = steep(plot, xi, least, True), steep(plot, xi, least, False)
    out: list[tuple[int, int]] = []
    held: list[list] = []  # ways down with the largest reach since their end
    since, k = 0.0, 0
    events = sorted([(s, e, True) for s, e in downs] + [(s, e, False) for s, e in ups])
    for s, e, is_down in events:
        since = max(since, plot[k : s + 1].max(initial=0.0)) if s + 1 > k else since
        held = [[d, max(most, since)] for d, most in held if since <= plot[d[0]] * (1 - xi) or plot[d[0]] == np.inf and since < np.inf]
        if is_down:
            held.append([(s, e), 0.0])
        else:
            end = plot[e + 1]
            for (ds, de), most in held:
                if most > end * (1 - xi) and end < np.inf:
                    continue
                first, last = ds, e
                if plot[ds] * (1 - xi) >= end:  # the way down begins higher
                    while first < de and plot[first + 1] > end:
                        first += 1
                elif end * (1 - xi) >= plot[ds]:  # the way up ends higher
                    while last > s and plot[last] > plot[ds]:
                        last -= 1
                if last - first + 1 >= least and first <= de and last >= s:
                    out.append((first, last))
        k, since = e + 1, plot[e + 1] if not is_down and e + 1 < len(plot) - 1 else 0.0
    return out


def innermost(clusters: list[tuple[int, int]], n: int) -> np.ndarray:
    """Labels of n places: shorter clusters first; one that overlaps one that is there is dropped."""
    label, k = np.full(n, -1, np.int64), 0
    for first, last in sorted(set(clusters), key=lambda c: (c[1] - c[0], c)):
        if (label[first : last + 1] == -1).all():
            label[first : last + 1] = k
            k += 1
    return label


def dbscan(rows: DataFrame, columns: list[str], eps: float, min_samples: int) -> DataFrame:
    """rows with cluster: the smallest core id reachable through cores at most eps apart; noise is null."""
    forest = Forest(rows, columns, [min_samples])
    return forest.of_rows(forest.labellings([eps]))


def block_scores(points: DataFrame, columns: list[str], labels: DataFrame) -> DataFrame:
    """(labelling, n, s, q) of points (id, weight, columns), by block, under many labellings (labelling, id, cluster): weight, sum and squared
    deviations of silhouettes. Points without a cluster in a labelling take no part in it.

    Labellings are scored in passes of at most CLUSTERS clusters, of which a task holds the sums of its rows' distances. Those of a
    cluster with many rows in a block come from products of matrices, those of others by adding up the rows' distances, so that the work of a
    pair of blocks does not grow with the number of clusters.
    """
    named = labels.groupBy("labelling", "cluster").agg(F.count(F.lit(1)).alias("size")).withColumn("at", F.row_number().over(Window.partitionBy("labelling").orderBy("cluster")) - 1).checkpoint()
    sizes = sorted((r["labelling"], r["k"]) for r in named.groupBy("labelling").agg(F.count(F.lit(1)).alias("k")).collect())  # a row for each labelling
    least, passes = points.count() / MEETING, []
    for labelling, k in sizes:
        if not passes or sum(n for _, n in passes[-1]) + k > CLUSTERS:
            passes.append([])
        passes[-1].append((labelling, k))
    out = [pass_scores(points, columns, labels, named, some, least) for some in passes]
    return reduce(DataFrame.unionByName, out)


def pass_scores(points: DataFrame, columns: list[str], labels: DataFrame, named: DataFrame, some: list[tuple[int, int]], least: float) -> DataFrame:
    """Block_scores of labellings (number, clusters); clusters of `least` points or more are large."""
    edges = np.concatenate([[0], np.cumsum([k for _, k in some])]).tolist()
    width, numbers = edges[-1], [labelling for labelling, _ in some]
    first = points.sparkSession.createDataFrame(list(zip(numbers, edges, strict=False)), "labelling int, first int")
    placed = named.join(F.broadcast(first), "labelling").select("labelling", "cluster", "size", (F.col("first") + F.col("at")).cast("int").alias("place"))  # a row for each labelling
    large = np.array(sorted(r["place"] for r in placed.where(F.col("size") >= least).select("place").collect()), np.int64)  # MEETING of each labelling at most
    of = labels.join(placed, ["labelling", "cluster"]).groupBy("id").agg(F.collect_list("place").alias("places"))
    blocks = blocked(points.join(of, "id"), columns, {"w": F.col("weight").cast("long"), "places": F.col("places")})

    def table(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each label its row and its cluster's place, by ascending place, and the rows' weights."""
        lists = block.more["places"]
        row, place = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
        order = np.argsort(place, kind="stable")
        return row[order], place[order].astype(np.int64), block.more["w"].to_numpy().astype(float)

    def start(own: Block):
        return own, np.zeros((width, len(own.ids))), np.zeros(width)

    def step(kept, other: Block) -> None:
        own, sums, total = kept
        row, place, weight = table(other)
        total += np.bincount(place, weight[row], width)
        apart = distances(other.x, own.x)
        at = np.searchsorted(large, place)
        is_large = large[np.minimum(at, len(large) - 1)] == place if len(large) else np.zeros(len(place), bool)
        for lo in range(0, len(large), COLUMNS):
            here = is_large & (at >= lo) & (at < lo + COLUMNS)
            share = np.zeros((min(COLUMNS, len(large) - lo), len(other.ids)))
            share[at[here] - lo, row[here]] = weight[row[here]]
            sums[large[lo : lo + COLUMNS]] += share @ apart
        row, place = row[~is_large], place[~is_large]
        ends = np.append(np.flatnonzero(np.diff(place, prepend=-1)), len(place))
        k = 0
        while k < len(ends) - 1:
            last = max(k + 1, int(np.searchsorted(ends, ends[k] + COLUMNS, "right")) - 1)
            mine = row[ends[k] : ends[last]]
            far = apart[mine]
            if (weight[mine] != 1).any():
                far *= weight[mine, None]
            sums[place[ends[k:last]]] += np.add.reduceat(far, ends[k:last] - ends[k], axis=0)
            k = last

    def finish(kept) -> pa.RecordBatch:
        own, sums, total = kept
        row, place, weight = table(own)
        out = []
        for j, number in enumerate(numbers):
            lo, hi = edges[j], edges[j + 1]
            here = slice(*np.searchsorted(place, [lo, hi]))
            rows, at = row[here], place[here] - lo
            if not len(rows):
                continue
            n, k = total[lo:hi], np.arange(len(rows))
            d = sums[lo:hi] if len(rows) == sums.shape[1] and (rows == k).all() else sums[lo:hi, rows]
            a = d[at, k] / np.maximum(n[at] - 1, 1)
            mean = d / n[:, None]
            mean[at, k] = np.inf
            b = mean.min(0)
            most = np.maximum(a, b)
            with np.errstate(invalid="ignore", divide="ignore"):
                s = np.where((n[at] > 1) & np.isfinite(b) & (most > 0), (b - a) / most, 0.0)
            w = weight[rows]
            out.append((number, w.sum(), (w * s).sum(), (w * (s - (w * s).sum() / w.sum()) ** 2).sum()))
        return batch({"labelling": pa.int32(), "n": pa.float64(), "s": pa.float64(), "q": pa.float64()}, *(zip(*out, strict=True) if out else [[]] * 4))

    return against_all(blocks, start, step, finish, "labelling int, n double, s double, q double")


def scored(forest: Forest, labels: DataFrame, by: list[str], weights: tuple[float, float]) -> tuple[Row | None, DataFrame]:
    """The best labelling's row (by, score), the first of equal ones; and labels with `labelling`. Score: mean silhouette less its deviation."""
    labels = labels.checkpoint()
    names = [tuple(r) for r in labels.select(*by).distinct().orderBy(*by).collect()]  # a row for each pair of parameters
    if not names:
        return None, labels
    spark = labels.sparkSession
    kinds = [f"{c} {labels.schema[c].dataType.simpleString()}" for c in by]
    numbers = spark.createDataFrame([(k, *n) for k, n in enumerate(names)], ", ".join(["labelling int", *kinds]))
    labels = labels.join(F.broadcast(numbers), by)  # a row for each pair of parameters
    parts = block_scores(forest.points, forest.columns, labels.select("labelling", "id", "cluster"))
    by_labelling = Window.partitionBy("labelling")
    mean = F.sum("s").over(by_labelling) / F.sum("n").over(by_labelling)
    spread = parts.withColumn("_q", F.col("q") + F.col("n") * F.pow(F.col("s") / F.col("n") - mean, F.lit(2.0))).groupBy("labelling").agg((F.sum("s") / F.sum("n")).alias("mean"), F.sqrt(F.sum("_q") / F.sum("n")).alias("sd"))
    score = spread.select("labelling", (weights[0] * F.col("mean") - weights[1] * F.col("sd")).alias("score"))
    best = score.join(F.broadcast(numbers), "labelling").orderBy(F.desc(F.round("score", 12)), *by).first()  # a row for each pair of parameters
    return best, labels


def density_search(rows: DataFrame, columns: list[str], eps: Iterable[float] = EPS, min_samples: Iterable[int] = MIN_SAMPLES, weights: tuple[float, float] = (1.0, 0.0)) -> tuple[DataFrame | None, float, tuple[float, int] | None]:
    """(labelled rows, score, (eps, min_samples)): the best of all pairs by the silhouette of the rows that are no noise.

    Labellings with fewer than two clusters, or in which nearly every row is a cluster of its own, are skipped; the smallest
    radius, then count, of equally good ones is taken. One forest serves all pairs.
    """
    forest = Forest(rows, columns, min_samples)
    best, labels = scored(forest, forest.labellings(eps, rows.count() - 1), ["eps", "m"], weights)
    if best is None or best["score"] <= -1:
        return None, -1.0, None
    return forest.of_rows(labels.where(F.col("labelling") == best["labelling"])), best["score"], (best["eps"], best["m"])


def optics(rows: DataFrame, columns: list[str], xi: float = 0.05, min_samples: int = 5) -> DataFrame:
    """rows with cluster (numbered by length, then place in the order); noise is null."""
    forest = Forest(rows, columns, [min_samples])
    return forest.of_rows(forest.extracted([xi]))


def optics_search(rows: DataFrame, columns: list[str], xi: Iterable[float] = XI, min_samples: Iterable[int] = MIN_SAMPLES, weights: tuple[float, float] = (1.0, 0.0), noise: bool = False) -> tuple[DataFrame | None, float, tuple[float, int] | None]:
    """(labelled rows, score, (xi, min_samples)): the best of all pairs by silhouette. Labellings with fewer than two clusters are
    skipped, and those with any noise unless `noise`."""
    forest = Forest(rows, columns, min_samples)
    labels = forest.extracted(xi).checkpoint()
    shape = labels.groupBy("xi", "m").agg(F.count_distinct("cluster").alias("k"), F.count(F.lit(1)).alias("n"))
    fine = shape.where((F.col("k") > 1) & (F.lit(noise) | (F.col("n") == forest.points.count()))).select("xi", "m")
    best, labels = scored(forest, labels.join(fine, ["xi", "m"]), ["xi", "m"], weights)
    if best is None or best["score"] <= -1:
        return None, -1.0, None
    return forest.of_rows(labels.where(F.col("labelling") == best["labelling"])), best["score"], (best["xi"], best["m"])
