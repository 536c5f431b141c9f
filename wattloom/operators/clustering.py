"""Clustering of event features: model search, scores, and clusterers."""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import and_
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.functions.session import reachable, settled, with_checkpoints
from wattloom.operators.blockwise import Block, against_all, all_silhouettes, as_block, blocked, distances, near_blocked, one_list
from wattloom.operators.density import dbscan, density_search, optics, optics_search  # noqa: F401
from wattloom.operators.features import assembled, pca_scores

MAX_K = 20
#: Clusters that Ward's criterion merges in one task (a few numbers each).
WARD_BLOCK = 8192
#: Clusters of a block that are searched together.
WARD_LEAF = 64
#: Rows among which a start chooses each of its centres.
SEEN = 10
#: Rows of a task that fits many clusterings, at most so many where there are tasks enough for all cores.
PART_ROWS, PART_MOST = 1000, 16384
#: Tasks whose sums by centre the driver adds up.
FEW_TASKS = 64
#: Distances that are worked on at once (numbers that a core's cache holds).
CACHED = 131072
#: Clusters of labellings that are scored in one pass over the pairs, and those whose distances are summed in one product.
SCORED, COLUMNS = 16384, 2048
#: Rows whose distances are summed in single precision.
SINGLE = 1024
#: Jobs of parts that run at once.
AT_ONCE = 4


def squared(a: list[Column], b: list[Column]) -> Column:
    return sum(((x - y) * (x - y) for x, y in zip(a[1:], b[1:], strict=True)), (a[0] - b[0]) * (a[0] - b[0]))


def silhouettes(rows: DataFrame, columns: list[str], cluster: str = "cluster") -> DataFrame:
    """(id, cluster, silhouette): euclidean, from the distances of all pairs; 0 in a cluster of one. Rows without a cluster (noise) are left out.

    cluster is a whole number, an id one row. Quadratic in rows, as the score is: blocks of rows meet as matrices.
    """
    base = rows.where(F.col(cluster).isNotNull()).select("id", F.col(cluster).alias("_c"), *columns, F.lit(1).alias("weight"))
    labels = base.select(F.lit(0).alias("labelling"), F.col("id").cast("long").alias("id"), F.col("_c").alias("cluster"))
    found = all_silhouettes(base.select(F.col("id").cast("long").alias("id"), "weight", *columns), columns, labels)
    return found.select(F.col("id").cast(rows.schema["id"].dataType).alias("id"), F.col("cluster").cast(rows.schema[cluster].dataType).alias(cluster), "silhouette")


def silhouette_score(rows: DataFrame, columns: list[str], weights: tuple[float, float] = (1.0, 0.0), per_cluster: bool = True, cluster: str = "cluster") -> DataFrame:
    """One row: mean silhouette by weight, less the mean over clusters of their deviation (or the deviation over all)."""
    each = silhouettes(rows, columns, cluster)
    if per_cluster:
        parts = each.groupBy(cluster).agg(F.sum("silhouette").alias("s"), F.count(F.lit(1)).alias("n"), F.stddev_pop("silhouette").alias("sd"))
        mean, spread = F.sum("s") / F.sum("n"), F.avg("sd")
    else:
        parts, mean, spread = each, F.avg("silhouette"), F.stddev_pop("silhouette")
    return parts.agg(mean.alias("mean_silhouette"), spread.alias("spread"), (weights[0] * mean - weights[1] * spread).alias("score"))


def centroids(rows: DataFrame, columns: list[str], cluster: str = "cluster") -> DataFrame:
    return rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"), *(F.avg(c).alias(f"_m_{c}") for c in columns))


def davies_bouldin(rows: DataFrame, columns: list[str], cluster: str = "cluster") -> DataFrame:
    """One row (score): mean over clusters (whole numbers) of the largest ratio of spreads to distance of centres."""
    centre = centroids(rows, columns, cluster)
    means = [F.col(f"_m_{c}") for c in columns]
    spread = rows.join(centre, cluster).groupBy(cluster, *(f"_m_{c}" for c in columns)).agg(F.avg(F.sqrt(squared([F.col(c) for c in columns], means))).alias("s"))
    blocks = blocked(spread.withColumnRenamed(cluster, "id"), [f"_m_{c}" for c in columns], {"s": F.col("s")})

    def step(kept, other: Block) -> None:
        own, best = kept
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = (own.more["s"].to_numpy()[:, None] + other.more["s"].to_numpy()) / distances(own.x, other.x)
        ratio[~np.isfinite(ratio) | (own.ids[:, None] == other.ids)] = -np.inf
        np.maximum(best, ratio.max(1), out=best)

    def finish(kept) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.where(np.isfinite(kept[1]), kept[1], np.nan), pa.float64())], names=["r"])

    ratios = against_all(blocks, lambda own: (own, np.full(len(own.ids), -np.inf)), step, finish, "r double")
    return ratios.agg(F.avg(F.nanvl("r", F.lit(None).cast("double"))).alias("score"))


def calinski_harabasz(rows: DataFrame, columns: list[str], cluster: str = "cluster") -> DataFrame:
    """One row (score): between to within sums of squares, each by its degrees of freedom."""
    centre = centroids(rows, columns, cluster)
    whole = rows.agg(F.count(F.lit(1)).alias("_total"), *(F.avg(c).alias(f"_g_{c}") for c in columns))
    means = [F.col(f"_m_{c}") for c in columns]
    between = centre.crossJoin(F.broadcast(whole)).agg(F.sum(F.col("_n") * squared(means, [F.col(f"_g_{c}") for c in columns])).alias("b"), F.count(F.lit(1)).alias("k"), F.max("_total").alias("n"))
    inside = rows.join(centre, cluster).agg(F.sum(squared([F.col(c) for c in columns], means)).alias("w"))
    both = between.crossJoin(F.broadcast(inside))
    return both.select((F.try_divide("b", "w") * F.try_divide(F.col("n") - F.col("k"), F.col("k") - 1)).alias("score"))


def assign(rows: DataFrame, columns: list[str], centres: list[list[float]], only: bool = False) -> DataFrame | Column:
    """rows with cluster: the nearest of fixed centres, the first on ties; with `only` that column alone."""
    x = [F.col(c) for c in columns]
    far = [F.struct(squared(x, [F.lit(float(v)) for v in c]).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centres)]
    found = F.array_min(F.array(*far))["k"]
    return found if only else rows.withColumn("cluster", found)


def kmeans(rows: DataFrame, columns: list[str], k: int, seed: int = 0) -> DataFrame:
    v = assembled(rows, columns)
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(v).transform(v).drop("_v")


SCORES = {
    "si": lambda r, c, w: silhouette_score(r, c, w).first()["score"],
    "db": lambda r, c, w: -davies_bouldin(r, c).first()["score"],
    "ch": lambda r, c, w: calinski_harabasz(r, c).first()["score"],
}


def starts(rows: DataFrame, columns: list[str], k: int, n: int) -> np.ndarray:
    """(n, k, columns): of each of n starts, k rows apart from one another (k-means++) among SEEN * k rows that a hash of the id and the start picks."""
    at = F.array(*(F.col(c).cast("double") for c in columns)).alias("x")
    each = rows.select("id", at, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("s")).withColumn("h", F.xxhash64("s", F.col("id").cast("string")))
    first = Window.partitionBy("s").orderBy("h", "x")
    found = each.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= SEEN * k).select("s", "_n", "x").collect()  # n * SEEN * k rows
    out = np.zeros((n, k, len(columns)))
    for s in range(n):
        x = np.array([r["x"] for r in sorted((r for r in found if r["s"] == s), key=lambda r: r["_n"])])
        rng = np.random.default_rng(s)
        out[s, 0] = x[0]
        far = ((x - x[0]) ** 2).sum(1)
        for j in range(1, k):
            pick = int(np.searchsorted(np.cumsum(far), rng.random() * far.sum(), "right")) if far.sum() > 0 else j
            out[s, j] = x[min(pick, len(x) - 1)]
            far = np.minimum(far, ((x - out[s, j]) ** 2).sum(1))
    return out


class Fits(NamedTuple):
    """Fits of Lloyd's rounds: of each its centres, and by centre the rows, the sum of their squared distances and of their distances."""

    centres: list[np.ndarray]
    sizes: list[np.ndarray]
    within: list[np.ndarray]
    apart: list[np.ndarray]


def nearest_centres(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(fits, rows): of each fit (fits, k, columns) the nearest centre of each row, the first of those equally near but for rounding. Half
    the squared distances come from products of rows with centres, some rows at a time; their last bits are made the centre's number, so
    that the least of a row names its centre."""
    fits, k, d = centres.shape
    middle = x.mean(0) if len(x) else np.zeros(d)
    c, x = (centres - middle).transpose(1, 0, 2).reshape(-1, d), x - middle
    half, own = (c * c).sum(1) / 2, (x * x).sum(1) / 2
    rounding = 2e-14 * (half.max(initial=0.0) + own.max(initial=0.0)) + 1e-300
    c = np.concatenate([-c, (half + rounding * (1 + np.repeat(np.arange(k), fits)))[:, None], np.ones((len(c), 1))], 1)
    x = np.concatenate([x, np.ones((len(x), 1)), own[:, None]], 1).T.copy()
    at_once, names, numbers = max(16, CACHED // len(c)), (1 << (k - 1).bit_length()) - 1, np.arange(k)[:, None, None]
    out, room = np.zeros((fits, x.shape[1]), np.int64), np.empty(len(c) * at_once)
    for lo in range(0, x.shape[1], at_once):
        n = min(at_once, x.shape[1] - lo)
        far = np.dot(c, x[:, lo : lo + n], out=room[: len(c) * n].reshape(len(c), n)).view(np.int64).reshape(k, fits, n)  # none is negative
        np.bitwise_and(far, ~names, out=far)
        np.bitwise_or(far, numbers, out=far)
        np.bitwise_and(np.minimum.reduce(far, axis=0), names, out=out[:, lo : lo + n])
    return out


def by_size(work: list[tuple[int, np.ndarray, int]], most: int = 64) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
    """By part, (places, centres) of fits (place, centres, part) with equally many centres, at most `most` together: place is where a fit's
    first centre is counted."""
    same: dict[tuple[int, int], list] = {}
    for at, c, part in work:
        same.setdefault((part, len(c)), []).append((at, c))
    out: dict[int, list] = {}
    for (part, _), mine in sorted(same.items()):
        for i in range(0, len(mine), most):
            places, centres = zip(*mine[i : i + most], strict=True)
            out.setdefault(part, []).append((np.array(places), np.array(centres)))
    return out


def centre_sums(base: DataFrame, d: int, work: list[tuple[int, np.ndarray, int]], width: int, apart: bool = False, tasks: int | None = None) -> np.ndarray:
    """(width, columns): by centre the number of its rows and the sums of their coordinates; with `apart` instead of these the sums of squared
    distances and of distances. A fit sees the rows of its part. One pass over base (part, x: array) and one aggregate; the sums of few tasks
    (`tasks` of base, FEW_TASKS at most) are added up by the driver, which saves a shuffle in every round."""
    groups = by_size(work)
    names = ["n", "w", "a"] if apart else ["n", *(f"s{j}" for j in range(d))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), width))
        for b in batches:
            every, number = np.array(b.column("x").flatten().to_numpy(zero_copy_only=False)).reshape(-1, d), b.column("part").to_numpy()
            for p, i in ((p, i) for p in np.unique(number).tolist() for i in range(0, int((number == p).sum()), 1024)):
                part = every[number == p][i : i + 1024]
                for at, centres in groups.get(p, ()):
                    own = nearest_centres(part, centres)
                    k = centres.shape[1]
                    flat = (own + np.arange(len(at))[:, None] * k).ravel()
                    if apart:
                        near = sum((part[:, j] - centres[:, :, j].ravel()[flat].reshape(own.shape)) ** 2 for j in range(d)).ravel()
                        values = [None, near, np.sqrt(near)]
                    else:
                        values = [None, *(np.tile(part[:, j], len(at)) for j in range(d))]
                    where = (at[:, None] + np.arange(k)).ravel()
                    for t, v in zip(total, values, strict=True):
                        t[where] += np.bincount(flat, v, len(where))
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(t[some]) for t in total)], names=["c", *names])

    stats = base.mapInArrow(run, ", ".join(["c int", *(f"{c} double" for c in names)]))
    if tasks is None or tasks > FEW_TASKS:
        stats = stats.groupBy("c").agg(*(F.sum(c).alias(c) for c in names))
    found = stats.toArrow()  # a row for each centre (and task)
    at = found.column("c").to_numpy()
    return np.stack([np.bincount(at, found.column(c).to_numpy(), width) for c in names], 1)


def all_kmeans(rows: DataFrame, columns: list[str], first: list[np.ndarray], rounds: int = 100, parts: list[int] | None = None) -> Fits:
    """Lloyd's rounds of many fits together: a round is one pass over the rows and one aggregate, and a last pass gives what the final
    centres hold. Ties go to the first centre, a centre without rows stays. With `parts` a fit sees the rows of its part (column part).
    The driver holds the centres."""
    reachable(rows.sparkSession)
    centres, todo = [c.copy() for c in first], list(range(len(first)))
    edges = np.concatenate([[0], np.cumsum([len(c) for c in centres])])
    base = rows.select((F.col("part") if parts else F.lit(0)).cast("int").alias("part"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"))
    d, width, parts, tasks = len(columns), int(edges[-1]), parts or [0] * len(first), base.rdd.getNumPartitions()
    for _ in range(rounds + 1):
        if not todo:
            break
        found, left = centre_sums(base, d, [(int(edges[k]), centres[k], parts[k]) for k in todo], width, tasks=tasks), []
        for k in todo:
            mine = found[edges[k] : edges[k + 1]]
            new = np.where(mine[:, :1] > 0, mine[:, 1:] / np.maximum(mine[:, :1], 1), centres[k])
            if np.abs(new - centres[k]).max() > 1e-12 * (1 + np.abs(new).max()):
                centres[k] = new
                left.append(k)
        todo = left
    n, within, apart = centre_sums(base, d, [(int(edges[k]), c, parts[k]) for k, c in enumerate(centres)], width, True, tasks).T
    return Fits(centres, *(np.split(v, edges[1:-1]) for v in (n, within, apart)))


def fit_silhouettes(points: DataFrame, columns: list[str], centres: list[np.ndarray], kind: type) -> DataFrame:
    """(labelling, cluster, n, s, q) of points (id, columns), by block, of the labellings by the nearest centre of each fit: number, sum and
    squared deviations of the silhouettes of a cluster's points.

    A task holds the sums of distances of its block's rows to each cluster; labels are worked out where they are needed, and no row is
    made for a point and a labelling. With kind float32, sums over SINGLE rows are of single precision.
    """
    edges = np.concatenate([[0], np.cumsum([len(c) for c in centres])])
    width, groups = int(edges[-1]), by_size([(k, c, 0) for k, c in enumerate(centres)])[0]

    def places(block: Block) -> np.ndarray:
        """(labellings, rows): the place of a row's cluster among those of all labellings."""
        out = np.zeros((len(centres), len(block.ids)), np.int64)
        for which, c in groups:
            out[which] = nearest_centres(block.x, c) + edges[which, None]
        return out

    def start(own: Block):
        return own, places(own), np.zeros((len(own.ids), width)), np.zeros(width)

    def step(kept, other: Block) -> None:
        own, mine, sums, total = kept
        apart = distances(own.x, other.x)
        theirs = mine if own.number == other.number else places(other)
        total += np.bincount(theirs.ravel(), minlength=width)
        single = kind is np.float32 and apart.max(initial=0) < 1e30 and not ((apart > 0) & (apart < 1e-30)).any()
        apart = apart.astype(np.float32) if single else apart
        rows, at_once, first = np.arange(len(other.ids)), SINGLE if single else len(other.ids), 0
        widest = max(COLUMNS, int(np.diff(edges).max()))
        room = [np.empty(len(v) * widest, apart.dtype) for v in (own.ids, other.ids)]
        while first < len(centres):
            last = max(first + 1, int(np.searchsorted(edges, edges[first] + COLUMNS, "right")) - 1)
            lo, hi = int(edges[first]), int(edges[last])
            product, share = (r[: len(r) // widest * (hi - lo)].reshape(-1, hi - lo) for r in room)
            share[:] = 0
            share[rows, theirs[first:last] - lo] = 1
            for at in range(0, len(rows), at_once):
                sums[:, lo:hi] += np.dot(apart[:, at : at + at_once], share[at : at + at_once], out=product)
            first = last

    def finish(kept) -> pa.RecordBatch:
        own, mine, sums, total = kept
        row, out = np.arange(len(own.ids)), []
        for k, c in enumerate(centres):
            lo, hi = edges[k], edges[k + 1]
            d, n, at = sums[:, lo:hi], total[lo:hi], mine[k] - lo
            a = d[row, at] / np.maximum(n[at] - 1, 1)
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = np.where(n > 0, d / n, np.inf)
                mean[row, at] = np.inf
                b = mean.min(1)
                most = np.maximum(a, b)
                s = np.where((n[at] > 1) & np.isfinite(b) & (most > 0), (b - a) / most, 0.0)
            count, total_s = np.bincount(at, minlength=len(c)), np.bincount(at, s, len(c))
            q = np.bincount(at, (s - (total_s / np.maximum(count, 1))[at]) ** 2, len(c))
            some = np.flatnonzero(count)
            out.append((np.full(len(some), k), some, count[some], total_s[some], q[some]))
        columns = [np.concatenate(v) for v in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names=["labelling", "cluster", "n", "s", "q"])

    return against_all(blocked(points, columns), start, step, finish, "labelling int, cluster long, n long, s double, q double")


def silhouette_scores(points: DataFrame, columns: list[str], centres: list[np.ndarray], weights: tuple[float, float], kind: type = np.float64) -> np.ndarray:
    """The score of the labelling by each fit: mean silhouette less the mean over clusters of their deviation."""
    out, lo = np.zeros(len(centres)), 0
    while lo < len(centres):
        hi = lo + max(1, int(np.searchsorted(np.cumsum([len(c) for c in centres[lo:]]), SCORED, "right")))
        each = fit_silhouettes(points, columns, centres[lo:hi], kind)
        by = Window.partitionBy("labelling", "cluster")
        mean = F.sum("s").over(by) / F.sum("n").over(by)
        each = each.withColumn("_q", F.col("q") + F.col("n") * F.pow(F.col("s") / F.col("n") - mean, F.lit(2.0)))
        parts = each.groupBy("labelling", "cluster").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sqrt(F.sum("_q") / F.sum("n")).alias("sd"))
        value = weights[0] * F.sum("s") / F.sum("n") - weights[1] * F.avg("sd")
        for r in parts.groupBy("labelling").agg(value.alias("v")).collect():  # a row for each fit
            out[lo + r["labelling"]] = r["v"]
        lo = hi
    return out


def fit_scores(rows: DataFrame, columns: list[str], fits: Fits, score: str, weights: tuple[float, float], best: bool = False) -> list[float | None]:
    """The score of each fit; those of one group, or where it is not defined, have none. With `best`, silhouettes of many fits are summed in
    single precision first, and fits that cannot be the best by the bound of its error have none."""
    if score == "si":
        base = rows.select(F.col("id").cast("long").alias("id"), *columns)
        which = np.arange(len(fits.centres))
        if best and len(which) > 1:
            # A sum of SINGLE rounded terms is off by SINGLE roundings at most, a silhouette then by twice that; so is a deviation.
            error = 3 * (SINGLE + 2) * 2.0**-24 * (abs(weights[0]) + abs(weights[1]))
            found = silhouette_scores(base, columns, fits.centres, weights, np.float32)
            which = np.flatnonzero(found >= found.max() - 2 * error)
        out: list[float | None] = [None] * len(fits.centres)
        for k, v in zip(which.tolist(), silhouette_scores(base, columns, [fits.centres[k] for k in which], weights).tolist(), strict=True):
            out[k] = v
        return out
    out = []
    for c, n, w, a in zip(*fits, strict=True):
        k, total = len(c), n.sum()
        if score == "ch":
            middle = (n[:, None] * c).sum(0) / total
            between, inside = float((n * ((c - middle) ** 2).sum(1)).sum()), float(w.sum())
            out.append(between / inside * (total - k) / (k - 1) if inside > 0 and k > 1 else None)
        else:
            with np.errstate(divide="ignore", invalid="ignore"):
                spread = a / n
                ratio = (spread[:, None] + spread) / np.sqrt(((c[:, None] - c) ** 2).sum(2))
            ratio[np.arange(k), np.arange(k)] = -np.inf
            worst = ratio.max(1)
            out.append(-float(worst.mean()) if np.isfinite(worst).all() else None)
    return out


def search(rows: DataFrame, columns: list[str], score: str = "si", repeats: int = 50, min_samples: int = 2, weights: tuple[float, float] = (1.0, 0.0), max_k: int = MAX_K, clusterer=None) -> tuple[DataFrame | None, float, int]:
    """(labelled rows, score, k): the best of k = 2 .. min(ceil(sqrt n), max_k), each from `repeats` starts; labellings with a small
    cluster are skipped, of equal ones the first (k, start) is taken.

    The fits of all k and starts run together: one pass over the rows for each of Lloyd's rounds, and one for their scores.
    With a clusterer (rows, columns, k, seed) of one's own the fits are one by one, without repeats if they cannot differ.
    """
    rows = rows.dropna(subset=columns)
    n = rows.count()
    if n < 2:
        raise ValueError("at least two rows are needed")
    ks = range(2, min(math.ceil(math.sqrt(n)), max_k) + 1)
    best: tuple[DataFrame | None, float, int] = (None, -math.inf, 0)
    if clusterer is not None:
        for k in ks:
            for seed in range(1 if clusterer is ward else repeats):
                labelled = clusterer(rows, columns, k, seed=seed)
                sizes = [r["count"] for r in labelled.groupBy("cluster").count().collect()]  # at most k
                if len(sizes) < k or min(sizes) < min_samples:
                    continue
                found = SCORES[score](labelled, columns, weights)
                if found is not None and found > best[1]:
                    best = (labelled, found, k)
        return best
    return search_parts([rows], [n], columns, score, repeats, min_samples, weights, max_k)[0]


def search_parts(parts: list[DataFrame], counts: list[int], columns: list[str], score: str = "si", repeats: int = 50, min_samples: int = 2, weights: tuple[float, float] = (1.0, 0.0), max_k: int = MAX_K) -> list[tuple[DataFrame | None, float, int]]:
    """The k-means search of each of few parts (rows without missing columns, with their counts), all rounds of all parts together."""
    spark = parts[0].sparkSession
    with_checkpoints(spark)
    best: list[tuple[DataFrame | None, float, int]] = [(None, -math.inf, 0)] * len(parts)
    points = reduce(DataFrame.unionByName, (r.select(F.lit(p).alias("part"), "id", *columns) for p, r in enumerate(parts)))
    n, tasks = sum(counts), 2 * spark.sparkContext.defaultParallelism
    points = points.repartition(max(1, min(math.ceil(n / PART_ROWS), max(tasks, math.ceil(n / PART_MOST))))).checkpoint()
    begun: list[np.ndarray] = []
    of: list[int] = []
    for p, n in enumerate(counts):
        ks = range(2, min(math.ceil(math.sqrt(n)), max_k) + 1)
        if len(ks):
            first = starts(points.where(F.col("part") == p), columns, ks[-1], repeats)
            begun += [first[s, :k] for k in ks for s in range(repeats)]
            of += [p] * (len(ks) * repeats)
    if not begun:
        return best
    fits = all_kmeans(points, columns, begun, parts=of)
    # Starts that end in the same groups are scored once.
    seen: dict[tuple, int] = {}
    for k, size in enumerate(fits.sizes):
        if size.min() >= min_samples:
            seen.setdefault((of[k], *sorted(map(tuple, np.round(fits.centres[k], 9).tolist()))), k)
    for p in range(len(parts)):
        chosen = [k for k in seen.values() if of[k] == p]
        if not chosen:
            continue
        scores = fit_scores(points.where(F.col("part") == p), columns, Fits(*([v[k] for k in chosen] for v in fits)), score, weights, best=True)
        at, top = -1, -math.inf
        for k, found in zip(chosen, scores, strict=True):
            if found is not None and found > top + (1e-12 * abs(found) if at >= 0 else 0):
                at, top = k, found
        if at >= 0:
            best[p] = assign(parts[p], columns, fits.centres[at].tolist()), top, len(fits.centres[at])
    return best


def two_stage(rows: DataFrame, first: list[str], second: list[str], components: int = 3, **how) -> tuple[DataFrame, dict[int, list[int]]]:
    """Clusters by the first columns, then within each cluster by principal components of the second ones.

    (rows with stage1 and cluster, stage1 -> clusters). A part that is small or cannot be split stays one cluster. Labels go
    to rows by id.
    """
    top, _, _ = search(rows, first, **how)
    if top is None:
        top = rows.withColumn("cluster", F.lit(0))
    with_checkpoints(rows.sparkSession)
    top = top.withColumnRenamed("cluster", "stage1").checkpoint()
    counts = top.groupBy("stage1").count().orderBy("stage1").collect()  # at most MAX_K
    n = min(components, len(second))
    names = [f"PC{i}" for i in range(n)]

    def scores_of(r) -> DataFrame:
        return pca_scores(top.where(F.col("stage1") == r["stage1"]), ["id"], second, n).dropna(subset=names).checkpoint()

    split = [r for r in counts if r["count"] >= 4]
    with ThreadPoolExecutor(AT_ONCE) as pool:  # the parts are Spark jobs that do not need one another
        made = list(pool.map(inheritable_thread_target(scores_of), split))
        if how.get("clusterer") is None:
            results = search_parts(made, [m.count() for m in made], names, **{k: v for k, v in how.items() if k != "clusterer"}) if made else []
        else:
            results = list(pool.map(inheritable_thread_target(lambda m: search(m, names, **how)), made))
    by_part = {r["stage1"]: (labels, k) for r, (labels, _, k) in zip(split, results, strict=True)}
    found = [by_part.get(r["stage1"], (None, 1)) for r in counts]
    out, mapping, used = None, {}, 0
    for r, (labels, k) in zip(counts, found, strict=True):
        part = top.where(F.col("stage1") == r["stage1"])
        part = part.join(labels.select("id", "cluster"), "id") if labels is not None else part.withColumn("cluster", F.lit(0))
        k = k if labels is not None else 1
        part = part.withColumn("cluster", F.col("cluster") + used)
        mapping[r["stage1"]], used = list(range(used, used + k)), used + k
        out = part if out is None else out.unionByName(part)
    return out, mapping


def merge_order(x: np.ndarray, n: np.ndarray) -> list[tuple[int, int, float]]:
    """(kept, gone, height) of Ward's merges of clusters with centres x and sizes n, by chains of nearest neighbours."""
    x, n, names, left = x.T.astype(float).copy(), n.astype(float).copy(), np.arange(len(n)), len(n)  # a cluster that has gone has no size
    out, chain = [], []
    while left > 1:
        if not chain:
            if left < len(n) / 2:
                here = n > 0
                x, n, names = x[:, here].copy(), n[here], names[here]
            chain = [int(np.argmax(n > 0))]
        while True:
            k = chain[-1]
            d = (x[0] - x[0, k]) ** 2
            for v in x[1:]:
                d += (v - v[k]) ** 2
            d *= n * n[k] / (n + n[k])
            d[n == 0] = np.inf
            d[k] = np.inf
            j = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[j]:
                j = chain[-2]
                break
            chain.append(j)
        chain = chain[:-2]
        a, b = min(k, j), max(k, j)
        out.append((int(names[a]), int(names[b]), float(d[j])))
        x[:, a] = (n[a] * x[:, a] + n[b] * x[:, b]) / (n[a] + n[b])
        n[a] += n[b]
        n[b] = 0
        left -= 1
    return out


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order of pairs that is the same from both sides and spreads them."""
    h = np.minimum(a, b).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.maximum(a, b).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def leaf_order(x: np.ndarray) -> np.ndarray:
    """An order of the rows of x in which every WARD_LEAF of them lie together: cut at the widest axis, again and again."""
    out, left = [], [np.arange(len(x))]
    while left:
        rows = left.pop()
        if len(rows) <= WARD_LEAF:
            out.append(rows)
            continue
        half = (len(rows) // WARD_LEAF + 1) // 2 * WARD_LEAF
        rows = rows[np.argsort(x[rows, np.ptp(x[rows], axis=0).argmax()], kind="stable")]
        left += [rows[half:], rows[:half]]
    return np.concatenate(out)


def cheaper(own: Block, best: list[np.ndarray], rows: np.ndarray, other: Block, part: slice) -> None:
    """Lets `rows` of a block meet a part of another one; best (heights, orders, partners of the block's rows) is brought up to date."""
    height, order, which = best
    n, m, ids = own.more["n"][rows][:, None], other.more["n"][part], other.ids[part]
    cost = np.zeros((len(rows), len(ids)))
    for k in range(own.x.shape[1]):
        d = own.x[rows, k, None] - other.x[part, k]
        cost += d * d
    cost *= n * m / (n + m)
    if own.number == other.number:
        cost[own.ids[rows][:, None] == ids] = np.inf
    least = cost.min(1)
    some = np.flatnonzero(np.isfinite(least) & (least <= height[rows]))
    r, k = np.nonzero(cost[some] == least[some, None])
    at = rows[some[r]]
    h = pair_hash(own.ids[at], ids[k])
    first = np.lexsort((h, at))
    at, once = np.unique(at[first], return_index=True)
    new, partner, least = h[first][once], ids[k[first][once]], least[some[r[first][once]]]
    better = (least < height[at]) | (new < order[at])
    at = at[better]
    height[at], order[at], which[at] = least[better], new[better], partner[better]


def nearest_clusters(clusters: DataFrame, columns: list[str]) -> DataFrame:
    """(c, other, height) of clusters (c, n, columns): the cheapest partner by Ward's criterion; of equal ones that whose pair comes first
    in an order by hash, so that many pairs choose each other even where all are equally far apart.

    Blocks hold clusters that lie together. Each is first searched in itself; then a row meets those leaves of other blocks
    that may hold a partner as cheap, by its distance from a leaf's box and the leaf's smallest cluster.
    """
    spark = clusters.sparkSession
    with_checkpoints(spark)
    reachable(spark)
    dims = range(len(columns))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = as_block(batch.column("b")[i].as_py(), batch.column("rows").slice(i, 1).flatten())
                order = leaf_order(own.x)
                own = Block(own.number, own.ids[order], own.x[order], {"n": own.more["n"].to_numpy()[order]})
                best = [np.full(len(order), np.inf), np.full(len(order), np.iinfo(np.uint64).max, np.uint64), np.full(len(order), -1)]
                for at in range(0, len(order), WARD_LEAF):
                    cheaper(own, best, np.arange(len(order)), own, slice(at, at + WARD_LEAF))
                ends = np.arange(0, len(order), WARD_LEAF)
                lo, hi, n, top = np.minimum.reduceat(own.x, ends), np.maximum.reduceat(own.x, ends), np.minimum.reduceat(own.more["n"], ends), np.maximum.reduceat(best[0], ends)
                rows = {"id": own.ids, "x": own.x, "n": own.more["n"], "height": best[0], "first": best[1].view(np.int64), "which": best[2]}
                yield pa.RecordBatch.from_arrays([pa.array([own.number], pa.int32()), one_list(rows), one_list({"lo": lo, "hi": hi, "n": n, "top": top})], names=["b", "rows", "leaves"])

    near = near_blocked(clusters.withColumnRenamed("c", "id"), columns, {"n": F.col("n")})
    row, leaf = "struct<id:long,x:array<double>,n:double,height:double,first:long,which:long>", "struct<lo:array<double>,hi:array<double>,n:double,top:double>"
    blocks = near.select("b", "rows").mapInArrow(inside, f"b int, rows array<{row}>, leaves array<{leaf}>").join(near.select("b", "lo", "hi"), "b").checkpoint()
    own = blocks.select(F.col("b").alias("to"), F.inline("leaves")).toDF("to", "_lo", "_hi", "_n", "_top")
    others = blocks.select("b", "lo", "hi", F.array_min("leaves.n").alias("n"))
    sides = [F.greatest(F.col("_lo")[k] - F.col("hi")[k], F.col("lo")[k] - F.col("_hi")[k], F.lit(0.0)) for k in dims]
    least = F.col("_n") * F.col("n") / (F.col("_n") + F.col("n")) * squared(sides, [F.lit(0.0)] * len(sides))
    pairs = own.join(F.broadcast(others), (F.col("to") != F.col("b")) & (least * (1 - 1e-9) <= F.col("_top"))).select("to", "b").distinct()

    def start(own: Block):
        m = own.more
        own = own._replace(more={"n": m["n"].to_numpy()})
        return own, [m["height"].to_numpy().copy(), m["first"].to_numpy().view(np.uint64).copy(), m["which"].to_numpy().copy()]

    def step(kept, other: Block) -> None:
        own, best = kept
        other = other._replace(more={"n": other.more["n"].to_numpy()})
        ends = np.arange(0, len(other.ids), WARD_LEAF)
        lo, hi = np.minimum.reduceat(other.x, ends), np.maximum.reduceat(other.x, ends)
        n, m = own.more["n"][:, None], np.minimum.reduceat(other.more["n"], ends)
        least = np.zeros((len(own.ids), len(ends)))
        for k in dims:
            x = own.x[:, k, None]
            side = np.maximum(np.maximum(lo[:, k] - x, x - hi[:, k]), 0.0)
            least += side * side
        least *= n * m / (n + m) * (1 - 1e-9)
        for j in np.argsort(least.min(0)).tolist():
            rows = np.flatnonzero(least[:, j] <= best[0])
            if len(rows):
                cheaper(own, best, rows, other, slice(int(ends[j]), int(ends[j]) + WARD_LEAF))

    def finish(kept) -> pa.RecordBatch:
        own, (height, _, which) = kept
        has = which >= 0
        return pa.RecordBatch.from_arrays([pa.array(own.ids[has]), pa.array(which[has]), pa.array(height[has])], names=["c", "other", "height"])

    return against_all(blocks.select("b", "rows"), start, step, finish, "c long, other long, height double", pairs=pairs)


def ward(rows: DataFrame, columns: list[str], k: int, seed: int = 0) -> DataFrame:
    """rows with cluster: agglomerative clusters by Ward's criterion, numbered by their first row.

    Equal rows are one cluster from the beginning, so that there are no more clusters than different rows. While there are
    many clusters, all pairs that are each other's nearest are merged in a round of joins, which Ward's criterion allows
    in any order; the last WARD_BLOCK clusters are merged in one task. The k - 1 highest merges are undone.
    """
    with_checkpoints(rows.sparkSession)
    reachable(rows.sparkSession)
    base = rows.dropna(subset=columns)
    same = base.groupBy(*(F.col(c).cast("double").alias(c) for c in columns)).agg(F.min(F.col("id").cast("long")).alias("c"), F.count(F.lit(1)).cast("double").alias("n"))
    now = points = settled(same.select("c", "n", *columns))
    merges = None
    while now.count() > WARD_BLOCK:
        near = settled(nearest_clusters(now, columns))
        back = near.select(F.col("c").alias("other"), F.col("other").alias("c"))
        mutual = settled(near.join(back, ["c", "other"]).where("c < other"))
        merges = mutual if merges is None else merges.unionByName(mutual)
        into = mutual.select(F.col("other").alias("c"), F.col("c").alias("_to"))
        moved = now.join(into, "c", "left").withColumn("c", F.coalesce("_to", "c"))
        now = settled(moved.groupBy("c").agg(F.sum("n").alias("_n"), *((F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c) for c in columns)).withColumnRenamed("_n", "n"))

    def finish(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(parts)).sort_values("c")
        ids = data["c"].to_numpy()
        found = merge_order(data[columns].to_numpy(float), data["n"].to_numpy(float))
        yield pd.DataFrame([(ids[a], ids[b], h) for a, b, h in found], columns=["c", "other", "height"]).astype({"c": "int64", "other": "int64", "height": "float64"})

    last = now.select("c", "n", *columns).coalesce(1).mapInPandas(finish, "c long, other long, height double")  # WARD_BLOCK rows at most
    merges = settled(last if merges is None else merges.unionByName(last))
    undone = merges.orderBy(F.desc("height"), F.desc("other")).limit(max(k - 1, 0))
    kept = merges.join(F.broadcast(undone.select("other")), "other", "left_anti")  # k - 1 rows
    # A cluster goes into another once at most: roots by doubling.
    up = settled(points.select("c").join(kept.select(F.col("other").alias("c"), F.col("c").alias("to")), "c", "left").select("c", F.coalesce("to", "c").alias("to")))
    while True:
        further = settled(up.join(up.select(F.col("c").alias("to"), F.col("to").alias("_next")), "to").select("c", F.col("_next").alias("to")))
        if further.join(up, ["c", "to"], "left_anti").isEmpty():
            break
        up = further
    roots = sorted((r["first"], r["to"]) for r in up.groupBy("to").agg(F.min("c").alias("first")).collect())  # k rows
    names = rows.sparkSession.createDataFrame([(to, i) for i, (_, to) in enumerate(roots)], "to long, cluster int")
    labels = up.join(F.broadcast(names), "to").join(points, "c").select(*(F.col(c).alias(f"_p_{c}") for c in columns), "cluster")  # k rows
    on = [F.col(c).cast("double") == F.col(f"_p_{c}") for c in columns]
    return base.drop("cluster").join(labels, reduce(and_, on)).drop(*(f"_p_{c}" for c in columns))
