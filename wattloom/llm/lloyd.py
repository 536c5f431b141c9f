"""What the clusterers of whole-number vectors share: exact distances, floored means, and roundings that keep bounds bounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(column: str) -> Column:
    """True where the vector is there and none of its components is null, NaN or infinite."""
    return F.expr(f"{column} is not null and forall({column}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def floored(column: str, factor: int) -> Column:
    """floor(factor * x) of each component, x as double."""
    return F.transform(F.col(column).cast("array<double>"), lambda x: F.floor(x * float(factor)).cast("long"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows x (n, d) to rows c (k, d) of int64, exactly. Beyond 64 bits an OverflowError."""
    if not x.size or not c.size:
        return np.zeros((len(x), len(c)), np.int64)
    most = 4 * x.shape[1] * max(int(np.abs(x).max()), int(np.abs(c).max()), -int(x.min()), -int(c.min())) ** 2
    if most < 1 << 53:  # all sums are whole numbers that a double holds
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    if most >= 1 << 63:
        raise OverflowError("components are too large for distances of 64 bits")
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def paired(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x to the same row of c; their magnitudes are those that squared() has seen."""
    d = x - c
    return (d * d).sum(1)


def over(d2: np.ndarray) -> np.ndarray:
    """Roots rounded up: no root is larger than what is given."""
    return np.nextafter(np.sqrt(d2.astype(np.float64)) * (1 + 1e-12), np.inf)


def under(d2: np.ndarray) -> np.ndarray:
    """Roots rounded down, at least 0."""
    return np.maximum(np.nextafter(np.sqrt(d2.astype(np.float64)) * (1 - 1e-12), -np.inf), 0)


def means(old: np.ndarray, sums: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    """The floored means of the members, by number; those without members stay. sums: number -> (count, sum of each component)."""
    new = old.copy()
    for k, (n, total) in sums.items():
        new[k] = [s // n for s in total]
    return new


def added(rows: DataFrame, x: str, by: list[str], start: Column, width: int) -> DataFrame:
    """(by, n, s: array) of the sums of `width` components of x from `start` on."""
    sums = [F.sum(F.get(F.col(x), start + j)).alias(f"_s{j}") for j in range(width)]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums).select(*by, "n", F.array(*(f"_s{j}" for j in range(width))).alias("s"))
