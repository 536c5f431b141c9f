"""Centroid clustering: Lloyd's rounds with Yinyang's bounds.

The centroids are put into groups once. A row carries the distance of its centroid at most and, for each group, the
distance of the group's other centroids at least. A row whose bounds rule out all groups strictly keeps its centroid;
else the groups that are not ruled out are measured in whole numbers, so that ties are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.common import forget, read, written
from wattloom.llm.lloyd import added, finite, floored, means, over, paired, squared, under

SCALE, WIDTH, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Centroids to a group, about.
TO_GROUP = 4
STATE = "vec_id long, x array<long>, cluster int, upper double, lower array<double>, distance long"


class Centres(NamedTuple):
    """Centroids, the group of each, and how far each has moved at most."""

    at: np.ndarray
    group: np.ndarray
    moved: np.ndarray


def grouped(at: np.ndarray, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: a few Lloyd's rounds over the centroids, which begin with every TO_GROUP-th."""
    points = at.astype(np.float64)
    heads = points[::TO_GROUP].copy()
    for _ in range(rounds):
        of = ((points[:, None] - heads) ** 2).sum(2).argmin(1)
        for g in np.unique(of):
            heads[g] = points[of == g].mean(0)
    return np.unique(of, return_inverse=True)[1]


def measured(x: np.ndarray, now: Centres) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower by group) of rows x against all centroids."""
    d2 = squared(x, now.at)
    cluster, rows = d2.argmin(1), np.arange(len(x))
    far = under(d2)
    upper = over(d2[rows, cluster])
    far[rows, cluster] = np.inf
    return cluster, upper, np.stack([far[:, now.group == g].min(1, initial=np.inf) for g in range(now.group.max() + 1)], 1)


def assigned(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, now: Centres) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after centroids have moved, and how many distances were measured for it."""
    groups = lower.shape[1]
    drift = np.array([now.moved[now.group == g].max(initial=0.0) for g in range(groups)])
    upper = np.nextafter(upper + now.moved[cluster], np.inf)
    lower = np.maximum(np.nextafter(lower - drift, -np.inf), 0)
    rows = np.flatnonzero(upper >= lower.min(1))  # the global filter
    if not len(rows):
        return cluster, upper, lower, 0
    mine = paired(x[rows], now.at[cluster[rows]])
    upper[rows] = over(mine)
    left = upper[rows] >= lower[rows].min(1)
    rows, mine, n = rows[left], mine[left], len(rows)
    if not len(rows):
        return cluster, upper, lower, n
    best, old = mine.copy(), cluster[rows]
    new = old.copy()
    seen = {}
    for g in range(groups):  # the group filter
        members = np.flatnonzero(now.group == g)
        at = np.flatnonzero(upper[rows] >= lower[rows, g])
        if not len(at) or not len(members):
            continue
        d2 = squared(x[rows[at]], now.at[members])
        n += d2.size
        seen[g] = (at, members, d2)
        k = d2.argmin(1)
        found, which = d2[np.arange(len(at)), k], members[k]
        better = (found < best[at]) | ((found == best[at]) & (which < new[at]))
        best[at[better]], new[at[better]] = found[better], which[better]
    for g, (at, members, d2) in seen.items():  # what the groups' centroids but the row's own one are apart now
        lower[rows[at], g] = np.where(members == new[at, None], np.inf, under(d2)).min(1, initial=np.inf)
    gone = np.flatnonzero(new != old)
    np.minimum.at(lower, (rows[gone], now.group[old[gone]]), under(mine[gone]))  # the old one is one of the others now
    cluster = cluster.copy()
    cluster[rows] = new
    upper[rows] = over(best)
    return cluster, upper, lower, n


def assign(rows: DataFrame, now: Centres) -> DataFrame:
    """rows (vec_id, x, and STATE's other columns from the second round on) with their clusters, bounds and distances."""
    width = now.at.shape[1]
    first = "cluster" not in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("x").flatten().to_numpy(zero_copy_only=False), np.int64).reshape(b.num_rows, width)
            if first:
                cluster, upper, lower = measured(x, now)
            else:
                bounds = np.array(b.column("lower").flatten().to_numpy(zero_copy_only=False)).reshape(b.num_rows, now.group.max() + 1)
                cluster, upper, lower, _ = assigned(x, b.column("cluster").to_numpy(), b.column("upper").to_numpy(), bounds, now)
            columns = [pa.array(cluster, pa.int32()), pa.array(upper, pa.float64()), pa.array(lower.tolist(), pa.list_(pa.float64())), pa.array(paired(x, now.at[cluster]), pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), *columns], names=["vec_id", "x", "cluster", "upper", "lower", "distance"])

    return rows.mapInArrow(run, STATE)


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), centroids) of vectors (vec_id, embedding) with exactly `width` components.

    Vectors that are null, of another length, or hold a null, NaN or infinite component are left out. The first centroids
    are the vectors with the smallest SHA-256 of "seed:vec_id"; every row counts, also where ids or vectors repeat (rows
    of one id by their components), and rows without an id come last. With fewer rows than k there are as many centroids as rows. An
    empty table gives no rows. Components of a size whose squared distances exceed 64 bits raise an OverflowError.
    """
    fine = vectors.where(finite("embedding") & (F.size("embedding") == width)).select(F.col("vec_id").cast("long").alias("vec_id"), floored("embedding", scale).alias("x"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = fine.orderBy(F.asc_nulls_last(key), "x").limit(k).collect()  # k rows
    if not first:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, width), np.int64)
    at = np.array([r["x"] for r in first], np.int64)
    now = Centres(at, grouped(at), np.zeros(len(at)))
    state = written(assign(fine, now), "clusters")
    for _ in range(rounds):
        sums = {r["cluster"]: (r["n"], r["s"]) for r in added(state, "x", ["cluster"], F.lit(0), width).collect()}  # k rows
        new = means(now.at, sums)
        apart = paired(new, now.at)
        now = Centres(new, now.group, over(apart) * (apart > 0))
        before, state = state, written(assign(state, now), "clusters")
        forget(before)
    return state.select("vec_id", "cluster", "distance"), now.at


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, at = clustered(read(spark, sf_dir, "embeddings"))
    sums = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # a row for each centroid
    rows = [(k, sums[k], sum(sums.values()), hashlib.sha256(",".join(map(str, at[k].tolist())).encode()).hexdigest()) for k in sums]
    each = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # CENTROIDS rows


def oracle() -> str:
    nearest = "SELECT vec_id, arg_min(k, struct_pack(d := d, k := k)) AS k, min(d) AS d FROM (SELECT e.vec_id, c.k, sum((e.x - c.x) * (e.x - c.x))::BIGINT AS d FROM e JOIN {c} c USING (j) GROUP BY ALL) GROUP BY 1"
    steps = [f"""kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {WIDTH} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
    e AS (SELECT vec_id, unnest(range({WIDTH})) AS j, unnest(v) AS x FROM kept),
    c0 AS (SELECT k, j, x FROM e JOIN (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k FROM kept QUALIFY k < {CENTROIDS}) USING (vec_id))"""]
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED ({nearest.format(c=f'c{r}')})")
        if r < ROUNDS:
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, c.j, coalesce(s.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT k, j, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM e JOIN a{r} USING (vec_id) GROUP BY ALL) s USING (k, j))")
    steps.append(f"h AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k)")
    return f"WITH {', '.join(steps)} SELECT vec_id, k::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, centroid_sha256 FROM a{ROUNDS} JOIN h USING (k)"


QUERIES = {"op13_centroids": query}
ORACLES = {"op13_centroids": oracle()}
