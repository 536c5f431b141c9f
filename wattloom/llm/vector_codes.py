"""Vector codes: each part of a vector is the number of the nearest entry of the part's codebook (Lloyd's rounds with Elkan's bounds).

A row carries, for each part, the distance of its entry at most and the distance of every entry at least. Entries that
the triangle inequality rules out strictly are not measured; the others are, in whole numbers, so that ties are exact.
Between rounds the bounds shift by what the entries have moved.
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

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Lower bounds are kept in whole units of 16 bits; a larger one counts as this.
MOST = 65535
STATE = "vec_id long, label {label}, x array<long>, code array<int>, upper array<double>, lower binary, error long"


class Books(NamedTuple):
    """Codebooks (part, entry, component); how far each entry has moved at most; half the distances between entries at least."""

    entries: np.ndarray
    moved: np.ndarray
    half: np.ndarray


def books(entries: np.ndarray, before: np.ndarray | None = None) -> Books:
    moved = np.zeros(entries.shape[:2]) if before is None else np.stack([over(paired(a, b)) * (paired(a, b) > 0) for a, b in zip(entries, before, strict=True)])
    return Books(entries, moved, np.stack([under(squared(e, e)) / 2 for e in entries]))


def measured(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, upper, lower) of parts x against all entries."""
    d2 = squared(x, entries)
    code = d2.argmin(1)
    return code, over(d2[np.arange(len(x)), code]), np.minimum(under(d2), MOST).astype(np.uint16)


def assigned(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, entries: np.ndarray, moved: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after entries have moved, and how many distances were measured for it."""
    upper = np.nextafter(upper + moved[code], np.inf)
    lower = np.maximum(lower - np.ceil(moved), 0).astype(np.uint16)
    own = np.arange(len(half))
    nearest = np.where(own[:, None] == own, np.inf, half).min(1)
    rows = np.flatnonzero(upper >= nearest[code])
    if not len(rows):
        return code, upper, lower, 0
    at = code[rows]
    mine = paired(x[rows], entries[at])
    upper[rows] = tight = over(mine)
    open_ = (tight[:, None] >= lower[rows]) & (tight[:, None] >= half[at])
    open_[np.arange(len(rows)), at] = False
    r, k = np.nonzero(open_)
    d2 = paired(x[rows[r]], entries[k])
    lower[rows[r], k] = np.minimum(under(d2), MOST)
    lower[rows, at] = np.minimum(under(mine), MOST)
    best = np.full(open_.shape, np.iinfo(np.int64).max)
    best[r, k] = d2
    best[np.arange(len(rows)), at] = mine
    new = best.argmin(1)  # the first of equal ones
    code = code.copy()
    code[rows] = new
    upper[rows] = over(best[np.arange(len(rows)), new])
    return code, upper, lower, len(rows) + len(r)


def assign(rows: DataFrame, now: Books, kind: str) -> DataFrame:
    """rows (vec_id, label, x, and STATE's other columns from the second round on) with their codes, bounds and errors."""
    n_parts, n_entries, width = now.entries.shape
    first = "code" not in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("x").flatten().to_numpy(zero_copy_only=False), np.int64).reshape(b.num_rows, n_parts, width)
            found = []
            if not first:
                codes = np.array(b.column("code").flatten().to_numpy(zero_copy_only=False)).reshape(-1, n_parts)
                uppers = np.array(b.column("upper").flatten().to_numpy(zero_copy_only=False)).reshape(-1, n_parts)
                lowers = np.frombuffer(b"".join(b.column("lower").to_pylist()), np.uint16).reshape(-1, n_parts, n_entries)
            for p in range(n_parts):
                found.append(measured(x[:, p], now.entries[p]) if first else assigned(x[:, p], codes[:, p], uppers[:, p], lowers[:, p], now.entries[p], now.moved[p], now.half[p])[:3])
            code, upper, lower = (np.stack(v, 1) for v in zip(*found, strict=True))
            error = sum(paired(x[:, p], now.entries[p][code[:, p]]) for p in range(n_parts))
            lists = [pa.array(v.tolist(), pa.list_(t)) for v, t in ((code, pa.int32()), (upper, pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("x"), *lists, pa.array([v.tobytes() for v in lower], pa.binary()), pa.array(error, pa.int64())], names=["vec_id", "label", "x", "code", "upper", "lower", "error"])

    return rows.mapInArrow(run, STATE.format(label=kind))


def kept(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(vec_id, label, x: whole numbers) of the vectors that are coded, and their length."""
    fine = vectors.where(finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), "label", floored("embedding", scale).alias("x"))
    size = F.size("x")
    common = fine.where((size > 0) & (size % parts == 0)).groupBy(size.alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = common[0]["d"] if common else 0
    return fine.where(size == d), d


def coded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code: array, error), codebooks (part, entry, component)) of vectors (vec_id, embedding, label).

    Vectors that are null or hold a null, NaN or infinite component are dropped; so are those whose length is not the
    most frequent one (the longest of equally frequent ones) among those that `parts` divides. Every row counts, also
    where ids or vectors repeat; rows without an id come last when the first entries are chosen. With fewer rows than
    `entries`, a codebook has as many entries as there are rows. An empty table gives no rows. Components of a size
    whose squared distances exceed 64 bits raise an OverflowError. The driver holds the codebooks and a sum for each entry.
    """
    rows, d = kept(vectors, parts, scale)
    kind = rows.schema["label"].dataType.simpleString()
    if not d:
        return vectors.sparkSession.createDataFrame([], f"vec_id long, label {kind}, code array<int>, error long"), np.zeros((parts, 0, 0), np.int64)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()  # `entries` rows
    width = d // parts
    now = books(np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy())
    state = written(assign(rows, now, kind), "codes")
    for _ in range(rounds):
        each = state.select("x", F.posexplode("code").alias("part", "entry"))
        sums: list[dict[int, tuple[int, list[int]]]] = [{} for _ in range(parts)]
        for r in added(each, "x", ["part", "entry"], F.col("part") * width, width).collect():  # a row for each entry
            sums[r["part"]][r["entry"]] = (r["n"], r["s"])
        now = books(np.stack([means(e, s) for e, s in zip(now.entries, sums, strict=True)]), now.entries)
        before, state = state, written(assign(state, now, kind), "codes")
        forget(before)
    return state.select("vec_id", "label", "code", "error"), now.entries


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, entries = coded(read(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, entries.reshape(-1).tolist())).encode()).hexdigest()
    text = F.lower(F.array_join(F.transform("code", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    total = found.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    both = found.join(total, F.col("label").eqNullSafe(F.col("_label")))
    return both.select("vec_id", text.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle() -> str:
    width = 64 // PARTS
    nearest = "SELECT vec_id, part, arg_min(k, struct_pack(d := d, k := k)) AS k, min(d) AS d FROM (SELECT e.vec_id, e.part, c.k, sum((e.x - c.x) * (e.x - c.x))::BIGINT AS d FROM e JOIN {c} c USING (part, j) GROUP BY ALL) GROUP BY 1, 2"
    steps = [f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
    e AS (SELECT vec_id, i // {width} AS part, i % {width} AS j, x FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(v) AS x FROM kept)),
    c0 AS (SELECT k, part, j, x FROM e JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept QUALIFY k < {ENTRIES}) USING (vec_id))"""]
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED ({nearest.format(c=f'c{r}')})")
        if r < ROUNDS:
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, c.part, c.j, coalesce(s.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT k, part, j, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM e JOIN a{r} USING (vec_id, part) GROUP BY ALL) s USING (k, part, j))")
    steps.append(f"f AS (SELECT vec_id, string_agg(lpad(lower(to_hex(k)), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)")
    steps.append(f"h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, k, j)) AS codebooks_sha256 FROM c{ROUNDS})")
    return f"WITH {', '.join(steps)} SELECT f.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM f JOIN kept USING (vec_id), h"


QUERIES = {"op12_vector_codes": query}
ORACLES = {"op12_vector_codes": oracle()}
