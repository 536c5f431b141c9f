"""Gaussian mixtures: all families, numbers of components and folds together, by sums over the rows.

A round of expectation and maximisation is one pass over the rows and one aggregate of each component's weight, sum and
products, for all fits that have not settled. Features are standardised, then scaled by median and quartiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import RobustScaler, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions.session import reachable, with_checkpoints
from wattloom.operators.blockwise import all_silhouettes
from wattloom.operators.clustering import all_kmeans, starts
from wattloom.operators.features import assembled

FAMILIES = ("full", "tied", "diag", "spherical")
KS, FOLDS = tuple(range(2, 11)), 5
#: Starts of k-means, of which the best begins a fit.
STARTS = 10
#: What is added to variances; the gain in mean log likelihood under which a fit has settled; rounds at most.
FLOOR, TOLERANCE, ROUNDS = 1e-6, 1e-3, 100


class Parts(NamedTuple):
    """Shares (k), means (k, d), covariances (k, d, d)."""

    shares: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def logs(self, x: np.ndarray) -> np.ndarray:
        """(rows, k): log of share times density."""
        out = np.empty((len(x), len(self.shares)))
        for j, (share, mean, cov) in enumerate(zip(*self, strict=True)):
            lower = np.linalg.cholesky(cov)
            y = np.linalg.solve(lower, (x - mean).T)
            out[:, j] = math.log(max(share, 1e-300)) - 0.5 * ((y * y).sum(0) + len(mean) * math.log(2 * math.pi)) - np.log(np.diag(lower)).sum()
        return out


def shaped(family: str, n: np.ndarray, s: np.ndarray, q: np.ndarray, before: Parts | None) -> Parts:
    """The parts of a family from each component's weight, sum and sum of products."""
    k, d = s.shape
    safe = np.maximum(n, 1e-12)
    means = s / safe[:, None]
    full = q / safe[:, None, None] - means[:, :, None] * means[:, None, :]
    if family == "tied":
        full = np.broadcast_to((full * safe[:, None, None]).sum(0) / safe.sum(), (k, d, d))
    elif family == "diag":
        full = full * np.eye(d)
    elif family == "spherical":
        full = np.maximum(np.trace(full, axis1=1, axis2=2) / d, 0)[:, None, None] * np.eye(d)
    full = full + FLOOR * np.eye(d)
    if before is not None:  # a component that has lost its rows stays where it was
        lost = n < 1e-9
        means[lost] = before.means[lost]
        full = np.where(lost[:, None, None], before.covariances, full)
    try:
        np.linalg.cholesky(full)
    except np.linalg.LinAlgError:
        full = full + 1e-3 * np.eye(d)
    return Parts(n / n.sum(), means, full)


def free(family: str, k: int, d: int) -> float:
    """Free parameters of a mixture."""
    return k * d + k - 1 + {"full": k * d * (d + 1) / 2, "tied": d * (d + 1) / 2, "diag": k * d, "spherical": k}[family]


class Fit(NamedTuple):
    """A family, a number of components, and the fold that is left out (-1: none)."""

    family: str
    k: int
    fold: int


def log_sum(logs: np.ndarray) -> np.ndarray:
    most = logs.max(1)
    return most + np.log(np.exp(logs - most[:, None]).sum(1))


def fit_all(points: DataFrame, d: int, fits: list[Fit], begun: dict[int, dict[int, np.ndarray]]) -> list[Parts]:
    """The parts of each fit on points (x: array, fold). begun: by fold and k, the centres from whose nearest rows a fit begins."""
    reachable(points.sparkSession)
    now: list[Parts | None] = [None] * len(fits)
    like, done = [-math.inf] * len(fits), [False] * len(fits)
    names = [f"s{j}" for j in range(d)] + [f"q{j}" for j in range(d * d)]
    for _ in range(ROUNDS + 1):
        todo = [k for k, over in enumerate(done) if not over]
        if not todo:
            break
        work = [(k, fits[k], now[k] if now[k] is not None else begun[fits[k].fold][fits[k].k]) for k in todo]

        def run(batches: Iterator[pa.RecordBatch], work=work) -> Iterator[pa.RecordBatch]:
            total = {k: np.zeros((f.k, 2 + d + d * d)) for k, f, _ in work}
            for b in batches:
                x = np.array(b.column("x").flatten().to_numpy(zero_copy_only=False)).reshape(-1, d)
                fold = b.column("fold").to_numpy()
                products = (x[:, :, None] * x[:, None, :]).reshape(len(x), d * d)
                all_ = np.concatenate([np.ones((len(x), 1)), x, products], 1)
                for k, f, parts in work:
                    use = fold != f.fold
                    if isinstance(parts, np.ndarray):
                        share = np.eye(f.k)[((x[use][:, None] - parts) ** 2).sum(2).argmin(1)]
                    else:
                        logs = parts.logs(x[use])
                        whole = log_sum(logs)
                        share = np.exp(logs - whole[:, None])
                        total[k][0, 0] += whole.sum()
                    total[k][:, 1:] += share.T @ all_[use]
            rows = np.concatenate([np.concatenate([np.full((f.k, 1), k), np.arange(f.k)[:, None], total[k]], 1) for k, f, _ in work])
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0].astype(np.int32)), pa.array(rows[:, 1].astype(np.int32)), *(pa.array(rows[:, 2 + j]) for j in range(2 + d + d * d))], names=["fit", "part", "like", "n", *names])

        sums = points.select("x", "fold").mapInArrow(run, "fit int, part int, like double, n double, " + ", ".join(f"{c} double" for c in names))
        rows = sums.groupBy("fit", "part").agg(*(F.sum(c).alias(c) for c in ("like", "n", *names))).orderBy("fit", "part").collect()  # a row for each component
        found = {k: np.array([list(r)[2:] for r in rows if r["fit"] == k]) for k in todo}
        for k in todo:
            v, first = found[k], now[k] is None
            mean = v[:, 0].sum() / max(v[:, 1].sum(), 1e-12)
            done[k] = not first and abs(mean - like[k]) < TOLERANCE
            like[k] = like[k] if first else mean
            if not done[k]:
                now[k] = shaped(fits[k].family, v[:, 1], v[:, 2 : 2 + d], v[:, 2 + d :].reshape(-1, d, d), now[k])
    return now


LABELLED = "labelling int, id long, cluster long, like double"


def labelled(points: DataFrame, d: int, fits: list[Fit], parts: list[Parts]) -> DataFrame:
    """(labelling, id, cluster, like) of the rows that a fit has left out (of all, if none), by the likeliest component."""
    work = list(zip(fits, parts, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("x").flatten().to_numpy(zero_copy_only=False)).reshape(-1, d)
            fold, ids = b.column("fold").to_numpy(), b.column("id").to_numpy()
            for k, (f, p) in enumerate(work):
                use = fold == f.fold if f.fold >= 0 else np.ones(len(x), bool)
                if use.any():
                    logs = p.logs(x[use])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(use.sum(), k), pa.int32()), pa.array(ids[use]), pa.array(logs.argmax(1), pa.int64()), pa.array(log_sum(logs))], names=["labelling", "id", "cluster", "like"])

    return points.select("id", "x", "fold").mapInArrow(run, LABELLED)


def fit_scores(points: DataFrame, d: int, fits: list[Fit], parts: list[Parts]) -> dict[Fit, float]:
    """Mean of silhouette, Calinski-Harabasz / 1000, -BIC / 10000 and -AIC / 10000 of each fit over the rows that it has left out;
    fits that give one group there have none. A labelling has rows of one fold, so only these meet."""
    labels = labelled(points, d, fits, parts).checkpoint()
    columns = [f"x{j}" for j in range(d)]
    wide = points.select("id", "fold", *(F.col("x")[j].alias(c) for j, c in enumerate(columns)))
    square = sum((F.col(c) * F.col(c) for c in columns[1:]), F.col(columns[0]) * F.col(columns[0]))
    stats = labels.join(wide, "id").groupBy("labelling", "cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("like").alias("like"), F.sum(square).alias("q"), *(F.sum(c).alias(c) for c in columns)).collect()  # a row for each component
    sil = {r["labelling"]: r["s"] for r in all_silhouettes(wide.withColumn("weight", F.lit(1)), columns, labels.select("labelling", "id", "cluster"), "fold" if all(f.fold >= 0 for f in fits) else None).groupBy("labelling").agg(F.avg("silhouette").alias("s")).collect()}  # a row for each fit
    out = {}
    for k, f in enumerate(fits):
        rows = [r for r in stats if r["labelling"] == k]
        n = np.array([r["n"] for r in rows], float)
        if len(rows) < 2 or k not in sil:
            continue
        s, q = np.array([[r[c] for c in columns] for r in rows]), np.array([r["q"] for r in rows])
        total, mean = n.sum(), s.sum(0) / n.sum()
        between = float((n * ((s / n[:, None] - mean) ** 2).sum(1)).sum())
        within = float((q - (s * s).sum(1) / n).sum())
        ch = between / within * (total - len(n)) / (len(n) - 1) if within > 0 else 0.0
        like, p = sum(r["like"] for r in rows), free(f.family, f.k, d)
        bic, aic = p * math.log(total) - 2 * like, 2 * p - 2 * like
        out[f] = (sil[k] + ch / 1000 - bic / 10000 - aic / 10000) / 4
    return out


class Mixture(NamedTuple):
    """A fitted mixture with its scaling: it labels rows that it has not seen as well."""

    scaling: PipelineModel
    columns: list[str]
    family: str
    parts: Parts
    score: float

    def scaled(self, rows: DataFrame) -> DataFrame:
        """(id, x, fold: none) of rows without a missing feature."""
        return self.scaling.transform(assembled(rows, self.columns)).select(F.col("id").cast("long").alias("id"), vector_to_array("_z").alias("x"), F.lit(-1).alias("fold"))

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows (id, columns) with cluster; null where a feature is missing."""
        reachable(rows.sparkSession)
        one = Fit(self.family, len(self.parts.shares), -1)
        found = labelled(self.scaled(rows), len(self.columns), [one], [self.parts]).select(F.col("id").alias("_id"), F.col("cluster").cast("int").alias("cluster"))
        return rows.drop("cluster").join(found, F.col("id").cast("long") == F.col("_id"), "left").drop("_id")


def fit_mixture(rows: DataFrame, columns: list[str], ks: tuple[int, ...] | range = KS, families: tuple[str, ...] = FAMILIES, folds: int = FOLDS) -> Mixture:
    """The mixture of the family and number of components whose fits score best over folds (dealt by a hash of the id), fitted to all rows.

    Of equal ones the first (number, family) is taken. An id stands for one row; rows with a missing feature are left out.
    """
    with_checkpoints(rows.sparkSession)
    v = assembled(rows, columns)
    standard = StandardScaler(inputCol="_v", outputCol="_s", withMean=True).fit(v)
    robust = RobustScaler(inputCol="_s", outputCol="_z", withCentering=True, relativeError=0.0).fit(standard.transform(v))
    scaling, d = PipelineModel([standard, robust]), len(columns)
    dealt = F.pmod(F.xxhash64(F.col("id").cast("long"), F.lit(42)), F.lit(folds)).cast("int")
    points = scaling.transform(v).select(F.col("id").cast("long").alias("id"), vector_to_array("_z").alias("x"), dealt.alias("fold")).checkpoint()
    axes = [f"x{j}" for j in range(d)]
    wide = points.select("id", "fold", *(F.col("x")[j].alias(c) for j, c in enumerate(axes)))
    n, ks = points.count(), [k for k in ks]
    ks = [k for k in ks if k <= n] or [1]
    first = starts(wide, axes, max(ks), STARTS)
    means = all_kmeans(wide, axes, [first[s, :k] for k in ks for s in range(STARTS)], 30)
    by_k = {}
    for j, k in enumerate(ks):  # the best start of each number begins its fits in all folds
        own = range(j * STARTS, (j + 1) * STARTS)
        by_k[k] = means.centres[min(own, key=lambda i: (means.within[i].sum(), i))]
    fits = [Fit(f, k, fold) for k in ks for f in families for fold in range(folds)]
    scores = fit_scores(points, d, fits, fit_all(points, d, fits, dict.fromkeys(range(folds), by_k)))
    mean = {(k, f): np.mean(v) for k in ks for f in families if (v := [s for x, s in scores.items() if (x.k, x.family) == (k, f)])}
    if not mean:
        raise ValueError("no mixture gives more than one group")
    best = max(mean.values())
    k, family = next(key for key, v in mean.items() if v == best)
    whole = Fit(family, k, -1)
    return Mixture(scaling, columns, family, fit_all(points, d, [whole], {-1: by_k})[0], float(best))


def gaussian_mixture(rows: DataFrame, columns: list[str], ks: tuple[int, ...] | range = KS, **how) -> tuple[DataFrame, float, int]:
    """(rows with cluster, score, number of components) of the best mixture."""
    model = fit_mixture(rows, columns, ks, **how)
    return model.predict(rows.dropna(subset=columns)), model.score, len(model.parts.shares)
