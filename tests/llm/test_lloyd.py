import hashlib
import math

import numpy as np
import pytest

from wattloom.llm import centroids, lloyd, vector_codes

TABLE = "vec_id long, embedding array<float>, label int, x int, code string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "a") for i, v, lab in rows], TABLE)


def nearest(x, c):
    d = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(2)
    k = [min(range(len(c)), key=lambda j: (row[j], j)) for row in d]
    return np.array(k), [int(row[j]) for row, j in zip(d, k, strict=True)]


def moved(x, k, c):
    return np.array([[sum(int(v) for v in x[k == j][:, w]) // int((k == j).sum()) for w in range(x.shape[1])] if (k == j).any() else c[j] for j in range(len(c))])


def plain_codes(rows, parts, entries, rounds):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    x = np.array([[math.floor(1024 * v) for v in np.array(r[1], np.float32).astype(float)] for r in rows]).reshape(len(rows), parts, -1)
    codes, books, errors = [], [], np.zeros(len(rows), object)
    for p in range(parts):
        c = x[:entries, p]
        for _ in range(rounds):
            c = moved(x[:, p], nearest(x[:, p], c)[0], c)
        k, d = nearest(x[:, p], c)
        codes.append(k)
        books.append(c)
        errors = errors + np.array(d, object)
    return {r[0]: (list(k), int(e)) for r, k, e in zip(rows, np.stack(codes, 1).tolist(), errors, strict=True)}, np.stack(books)


def some_vectors(seed, n, d, kinds=9):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(kinds, d))[rng.integers(0, kinds, n)] + rng.normal(size=(n, d)) * 0.3) * 0.1
    x[n // 2 :: 7] = x[0]  # a hot vector
    x[5::11] = np.round(x[5::11] * 8) / 8  # ties
    return [(int(k), v.astype(np.float32).tolist(), int(k) % 3 or None) for k, v in enumerate(x)]


@pytest.mark.parametrize("n, entries", [(700, 32), (20, 32)])
def test_codes_equal_plain_rounds(spark, n, entries):
    rows = some_vectors(n, n, 16)
    found, books = vector_codes.coded(frame(spark, rows[::-1]), 4, entries, 4)
    want, entries_ = plain_codes(rows, 4, entries, 4)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in found.collect()} == want
    assert (books == entries_).all()


def test_codes_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = some_vectors(3, 60, 8)
    odd = [(1000, None, 1), (1001, [nan] * 8, 1), (1002, [inf] + [0.0] * 7, 1), (1003, [None] + [0.0] * 7, 1), (1004, [], 1), (1005, [1.0] * 4, 1), (1006, [1.0] * 7, 1)]
    rows = [*good, (None, [0.5] * 8, None), *odd]
    found, books = vector_codes.coded(frame(spark, rows), 4, 8, 2)
    want, entries = plain_codes([*good, (None, [0.5] * 8, None)], 4, 8, 2)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in found.collect()} == want and (books == entries).all()
    twice, _ = vector_codes.coded(frame(spark, good + good), 4, 8, 2)
    assert twice.count() == 120 and twice.distinct().count() == 60
    for none in (frame(spark, []), frame(spark, odd[:5])):
        assert vector_codes.coded(none)[0].count() == 0


def test_codes_query(spark, folder, monkeypatch):
    rows = some_vectors(8, 300, 64)
    got = vector_codes.query(spark, folder(embeddings=frame(spark, rows))).collect()
    want, books = plain_codes(rows, 4, 256, 4)
    labels = {r[0]: r[2] for r in rows}
    total = {lab: sum(e for k, (_, e) in want.items() if labels[k] == lab) for lab in set(labels.values())}
    digest = hashlib.sha256(",".join(str(v) for v in books.reshape(-1).tolist()).encode()).hexdigest()
    assert {r["vec_id"]: tuple(r)[1:] for r in got} == {k: ("".join(f"{c:02x}" for c in code), e, total[labels[k]], digest) for k, (code, e) in want.items()}


def test_bounds_save_distances():
    rng = np.random.default_rng(4)
    x = np.floor((rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) * 0.05) * 1024).astype(np.int64)
    first = x[:64]
    code, upper, lower = vector_codes.measured(x, first)
    second = moved(x, code, first)
    now = vector_codes.books(second[None], first[None])
    code, upper, lower, n = vector_codes.assigned(x, code, upper, lower, second, now.moved[0], now.half[0])
    assert (code == nearest(x, second)[0]).all() and n < 0.5 * 3000 * 64
    d = np.sqrt(((x[:, None] - second) ** 2).sum(2))
    assert (upper >= d[np.arange(3000), code]).all() and (lower <= d).all()
    centres = centroids.Centres(first[:16], centroids.grouped(first[:16]), np.zeros(16))
    cluster, upper, lower = centroids.measured(x, centres)
    new = moved(x, cluster, first[:16])
    centres = centroids.Centres(new, centres.group, lloyd.over(((new - first[:16]) ** 2).sum(1)))
    cluster, upper, lower, n = centroids.assigned(x, cluster, upper, lower, centres)
    assert (cluster == nearest(x, new)[0]).all() and n < 3000 * 16


def plain_clusters(rows, k, rounds):
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()))
    ints = lambda r: [math.floor(64 * v) for v in np.array(r[1], np.float32).astype(float)]
    c, x = np.array([ints(r) for r in order[:k]]), np.array([ints(r) for r in rows])
    for _ in range(rounds):
        c = moved(x, nearest(x, c)[0], c)
    at, d = nearest(x, c)
    return at, d, c


def test_centroids_query(spark, folder):
    nan = float("nan")
    rows = some_vectors(6, 400, 64)
    odd = [(900, None, 1), (901, [nan] * 64, 1), (902, [1.0] * 63, 1), (903, [], 1)]
    got = {r["vec_id"]: tuple(r)[1:] for r in centroids.query(spark, folder(embeddings=frame(spark, rows + odd))).collect()}
    at, d, c = plain_clusters(rows, 16, 3)
    inertia = {k: sum(e for e, j in zip(d, at, strict=True) if j == k) for k in range(16)}
    digest = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c.tolist()]
    assert got == {r[0]: (int(k), e, inertia[k], sum(d), digest[k]) for r, k, e in zip(rows, at, d, strict=True)}


def test_few_and_no_vectors(spark, folder):
    few = some_vectors(2, 5, 64)
    found, at = centroids.clustered(frame(spark, [*few, few[0]]))
    assert len(at) == 6 and found.count() == 6 and {r["distance"] for r in found.collect()} == {0}
    none = folder(embeddings=frame(spark, []))
    assert centroids.query(spark, none).count() == 0 and vector_codes.query(spark, none).count() == 0


def test_large_components_are_exact_or_raise():
    x = np.array([[1 << 29, 3], [-(1 << 29), 5]])
    assert lloyd.squared(x, x).tolist() == [[0, (1 << 60) + 4], [(1 << 60) + 4, 0]]
    with pytest.raises(OverflowError):
        lloyd.squared(x << 4, x)
