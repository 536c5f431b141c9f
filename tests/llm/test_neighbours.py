import numpy as np
from pyspark.sql import functions as F

from wattloom.llm import neighbours


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rank int, score double")


def brute_force(vectors, query, top=20):
    q = np.array(vectors[query], np.float64)
    return sorted((-float(np.array(v, np.float64) @ q), k) for k, v in vectors.items() if k != query)[:top]


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_NODES", 700)
    monkeypatch.setattr(neighbours, "TOGETHER", 40)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 32))
    x = (centres[rng.integers(0, 12, 2000)] + rng.normal(size=(2000, 32)) * 0.6).astype(np.float32) * rng.uniform(0.3, 2, (2000, 1)).astype(np.float32)
    x[500:1200] = x[500]  # a hot vector
    vectors = dict(enumerate(x.tolist()))
    df = table(spark, [(k, v, 1, 1, 1.0) for k, v in vectors.items()])
    rows = neighbours.nearest(df, df.where("vec_id % 20 = 0")).collect()
    hits = total = 0
    for q in range(0, 2000, 20):
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == q)
        want = brute_force(vectors, q)
        assert [r[0] for r in got] == list(range(1, 21)) and [(-r[2], r[1]) for r in got] == sorted((-r[2], r[1]) for r in got)
        assert all(abs(r[2] - float(np.array(vectors[r[1]]) @ np.array(vectors[q]))) < 1e-9 for r in got)
        hits += sum(r[2] >= -want[-1][0] - 1e-9 for r in got)
        total += 20
    assert hits / total >= 0.95


def test_shards_grow_in_number_only():
    assert [neighbours.shard_count(n, 64, 20) for n in (0, 1, 8192, 8193, 10**9)] == [0, 1, 1, 2, 122071]
    fit = neighbours.SHARD_BYTES // (12 * 10_000 + 320)
    assert neighbours.shard_count(100 * fit, 10_000, 20) == 100 and neighbours.shard_count(100 * fit + 1, 10_000, 20) == 101
    assert neighbours.shard_count(3, 10**8, 20) == 3


def test_more_shards_than_partitions(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_BYTES", 20 * (12 * 4 + 320))
    x = np.random.default_rng(3).normal(size=(500, 4)).astype(np.float32)
    df = table(spark, [(k, v, 1, 1, 1.0) for k, v in enumerate(x.tolist())])
    rows = neighbours.nearest(df, df.where("vec_id % 20 = 0")).collect()
    assert len(rows) == 25 * 20 and neighbours.index(neighbours.usable(df), 20)[1] == {4: 25}
    for q in range(0, 500, 20):  # shards smaller than a search's beam are searched whole
        want = brute_force(dict(enumerate(x.tolist())), q)
        assert [r["vec_id"] for r in sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])] == [k for _, k in want]


def test_recall_of_a_graph_larger_than_a_shard():
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(40, 24))[rng.integers(0, 40, 20_000)] + rng.normal(size=(20_000, 24)) * 0.7).astype(np.float32)
    graph, q = neighbours.build(x), x[::400]
    found = np.concatenate([neighbours.search(graph, part, 20)[0] for part in np.split(q, 2)])
    best = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found.tolist(), best.tolist(), strict=True)]) >= 0.95


def test_rows_of_one_id_are_candidates_each(spark):
    df = table(spark, [(0, [1.0, 0.0], 1, 1, 1.0), (0, [2.0, 0.0], 1, 1, 1.0), (1, [5.0, 0.0], 1, 1, 1.0), (1, [4.0, 0.0], 1, 1, 1.0)])
    got = sorted(tuple(r) for r in neighbours.nearest(df, df.where("vec_id = 0")).collect())
    assert got == [(0, 1, 1, 5.0), (0, 1, 1, 10.0), (0, 2, 1, 4.0), (0, 2, 1, 8.0), (0, 3, 0, 2.0), (0, 3, 0, 2.0)]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1, 1, 1.0), (20, [0.0, 2.0], None, None, None), (1, [3.0, 1.0], 1, 1, 1.0), (2, [0.0, 0.0], 1, 1, 1.0), (3, None, 1, 1, 1.0), (4, [nan, 1.0], 1, 1, 1.0), (5, [inf, 1.0], 1, 1, 1.0), (6, [None, 1.0], 1, 1, 1.0), (7, [], 1, 1, 1.0), (None, [1.0, 1.0], 1, 1, 1.0), (1, [3.0, 1.0], 1, 1, 1.0), (40, [1.0, 2.0, 3.0], 1, 1, 1.0), (60, None, 1, 1, 1.0), (9, [3.0, 1.0], 1, 1, 1.0)]
    df = table(spark, rows)
    got = sorted(tuple(r) for r in neighbours.nearest(df, df.where("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 1, 3.0), (0, 2, 1, 3.0), (0, 3, 9, 3.0), (0, 4, 20, 0.0), (20, 1, 1, 2.0), (20, 2, 1, 2.0), (20, 3, 9, 2.0), (20, 4, 0, 0.0)]
    assert neighbours.nearest(df.where(F.lit(False)), df.where(F.lit(False))).count() == 0
