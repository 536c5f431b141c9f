"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, as flat neighbour arrays.

Equal vectors are one node that carries its smallest ids, so a hot vector costs one node. Shards hold some thousand nodes
each, whatever the table's size, so that a build, a graph's cell and a task's memory are bounded and recall does not fall as
the table grows; their number grows. A task loads a shard once and answers the queries that stream by; the shards' results
are merged. Nearness is the inner product: vectors get one more component so that all of a shard have the
same length, which makes the largest inner product the nearest neighbour.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.llm.common import read, written

TOP = 20
#: Nodes of a shard and bytes of its graph at most, about (by hash); queries that are answered at a time; rows of a product.
SHARD_NODES, SHARD_BYTES, TOGETHER, PART = 8192, 1 << 26, 256, 1024
#: Links of a node (twice as many on the ground), candidates for them, nodes kept in a search, and nodes expanded in a step.
LINKS, CANDIDATES, BEAM, STEP = 16, 48, 144, 4
SEED = 7
RESULT = "query_id long, rank int, vec_id long, score double"


def diverse(x: np.ndarray, nodes: np.ndarray, near: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
    """Of each node's candidates (nearest first, -1 for none), those that are nearer to it than to any taken before; -1 fills up."""
    pts = x[near]
    among = np.matmul(pts, pts.transpose(0, 2, 1))
    taken = np.zeros(near.shape, bool)
    for k in range(near.shape[1]):
        free = ~(taken & (among[:, k] > sim[:, k, None])).any(1)
        taken[:, k] = free & (near[:, k] >= 0) & (near[:, k] != nodes) & (taken.sum(1) < most)
    order = np.argsort(~taken, axis=1, kind="stable")[:, :most]
    out = np.full((len(near), most), -1, np.int64)
    out[:, : order.shape[1]] = np.where(np.take_along_axis(taken, order, 1), np.take_along_axis(near, order, 1), -1)
    return out


def nearest_of(sim: np.ndarray, near: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` candidates with the largest similarities in each row, best first."""
    keep = np.argpartition(-sim, min(most, sim.shape[1]) - 1, axis=1)[:, :most]
    s = np.take_along_axis(sim, keep, 1)
    by = np.argsort(-s, axis=1, kind="stable")
    return np.take_along_axis(np.take_along_axis(near, keep, 1), by, 1), np.take_along_axis(s, by, 1)


def layer(x: np.ndarray, members: np.ndarray, most: int) -> np.ndarray:
    """Links (members, most) among members, in the order in which they enter: each takes diverse ones of the nearest that have
    entered before it or with its batch, found by products of PART rows at a time; free places go to the nearest that have taken
    it. Each batch doubles the layer."""
    n, pts = len(members), x[members]
    own = np.full((n, most), -1, np.int32)
    done, size = 0, 64
    while done < n:
        end = min(n, size)
        for lo in range(done, end, PART):
            part = np.arange(lo, min(end, lo + PART))
            near = np.broadcast_to(np.arange(end), (len(part), end))
            sim = pts[part] @ pts[:end].T
            sim[np.arange(len(part)), part] = -np.inf
            found, value = nearest_of(sim, near, min(CANDIDATES, end))
            own[part, : most // 2] = diverse(pts, part, found, value, most // 2)
        done, size = end, 2 * end
    return returned(pts, own, most)


def returned(pts: np.ndarray, own: np.ndarray, most: int) -> np.ndarray:
    """Each node's own links, then as many of the nearest nodes that have taken it as there is place for."""
    a, k = np.nonzero(own >= 0)
    b = own[a, k]
    pairs = np.unique(np.stack([np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([np.zeros_like(a), np.ones_like(a)])], 1), axis=0)
    first = np.concatenate([[True], (np.diff(pairs[:, :2], axis=0) != 0).any(1)]) if len(pairs) else np.zeros(0, bool)
    pairs = pairs[first]  # a link of one's own stands before the same one as a return
    sim = np.einsum("ij,ij->i", pts[pairs[:, 0]], pts[pairs[:, 1]])
    pairs = pairs[np.lexsort((-sim, pairs[:, 2], pairs[:, 0]))]
    place = np.arange(len(pairs)) - np.searchsorted(pairs[:, 0], pairs[:, 0])
    fits = place < most
    links = np.full((len(own), most), -1, np.int32)
    links[pairs[fits, 0], place[fits]] = pairs[fits, 1]
    return links


def build(vectors: np.ndarray) -> dict[str, np.ndarray]:
    """The graph of float32 vectors (n, d). members{l}: nodes of layer l in the order in which they enter; links{l}: their
    neighbours by position in that order. Layer 0 holds all nodes; each further one a random 1 in LINKS."""
    rng = np.random.default_rng(SEED)
    norms = np.einsum("ij,ij->i", vectors, vectors)
    x = np.concatenate([vectors, np.sqrt(np.maximum(norms.max(initial=0) - norms, 0))[:, None]], 1).astype(np.float32)
    height = np.floor(-np.log(1 - rng.random(len(x))) / np.log(LINKS)).astype(int)
    order = rng.permutation(len(x)).astype(np.int32)
    out = {"x": x}
    for level in range(int(height.max(initial=0)) + 1):
        members = order[height[order] >= level]
        out[f"members{level}"], out[f"links{level}"] = members, layer(x, members, 2 * LINKS if level == 0 else LINKS)
    return out


def search(graph: dict[str, np.ndarray], queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of the k best found for each query, best first; -1 and -inf fill up."""
    x = graph["x"]
    q = np.concatenate([queries, np.zeros((len(queries), 1))], 1).astype(np.float32)
    top = max(int(name[7:]) for name in graph if name.startswith("members"))
    entry = np.full((len(q), 1), graph[f"members{top}"][0], np.int64)
    for level in range(top, -1, -1):
        found, sim = descend(x, graph[f"members{level}"], graph[f"links{level}"], q, entry, max(BEAM, k) if level == 0 else 4)
        entry = found[:, : 4 if level else None]
    order = np.argsort(-sim, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(found, order, 1), np.take_along_axis(sim, order, 1)


def descend(x: np.ndarray, members: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """A beam search on one layer for all queries at once: (nodes, similarities) of the beam."""
    place = np.full(len(x), -1, np.int64)
    place[members] = np.arange(len(members))
    rows = np.arange(len(q))[:, None]
    seen = np.zeros((len(q), len(members) + 1), bool)  # the last column stands for no node
    seen[:, -1] = True
    at = np.full((len(q), beam), -1, np.int64)
    at[:, : entry.shape[1]] = np.where(entry >= 0, place[entry], -1)[:, :beam]
    sim = np.where(at >= 0, np.matmul(x[members[at]], q[:, :, None])[..., 0], -np.inf)
    seen[rows, at] = True
    spent = at < 0
    while True:
        open_sim = np.where(spent, -np.inf, sim)
        step = min(STEP, beam)
        pick = np.argpartition(-open_sim, step - 1, axis=1)[:, :step]
        live = np.take_along_axis(open_sim, pick, 1) > -np.inf
        if not live.any():
            return np.where(at >= 0, members[at], -1), sim
        spent[rows, pick] = True
        nodes = np.take_along_axis(at, pick, 1)
        new = np.where(live[..., None], links[nodes], -1).reshape(len(q), -1).astype(np.int64)
        new = np.where(seen[rows, new], -1, new)
        new = np.sort(new, axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        seen[rows, new] = True
        new_sim = np.where(new >= 0, np.matmul(x[members[new]], q[:, :, None])[..., 0], -np.inf)
        all_at, all_sim = np.concatenate([at, new], 1), np.concatenate([sim, new_sim], 1)
        all_spent = np.concatenate([spent, new < 0], 1)
        keep = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
        at, sim, spent = (np.take_along_axis(v, keep, 1) for v in (all_at, all_sim, all_spent))


def packed(graph: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **graph)
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return dict(found)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part: null ids and vectors that are null, empty, zero or hold null or non-finite components do not."""
    fine = "vec_id is not null and size(embedding) > 0 and exists(embedding, x -> x != 0) and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(fine)


def index(vectors: DataFrame, top: int) -> tuple[DataFrame, dict[int, int]]:
    """(dim, shard, graph, ids): the graphs of all usable vectors, in a table; and the number of shards by dim. ids: of each node, the
    smallest top + 1 of its rows."""
    first = Window.partitionBy("embedding").orderBy("vec_id")
    nodes = vectors.withColumn("n", F.row_number().over(first)).where(F.col("n") <= top + 1)
    nodes = written(nodes.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("embedding")), "nodes")  # at most top + 1 ids
    shards = {r["dim"]: shard_count(r["count"], r["dim"], top) for r in nodes.groupBy("dim").count().collect()}  # a row for each length of vectors
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("embedding"), of_dim(shards)).cast("int"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(part["embedding"].to_numpy()).astype(np.float64)
        graph = build(x.astype(np.float32)) | {"vectors": x}
        return pd.DataFrame({"dim": part["dim"][:1], "shard": part["shard"][:1], "graph": [packed(graph)], "ids": [part["ids"].tolist()]})

    dealt = dealt.repartition(max(1, sum(shards.values())), "dim", "shard")  # a number of its own, so that builds are not merged into one task
    return written(dealt.groupBy("dim", "shard").applyInPandas(run, "dim int, shard int, graph binary, ids array<array<long>>"), "graphs"), shards


def shard_count(nodes: int, dim: int, top: int) -> int:
    """Shards for so many nodes: of SHARD_NODES, or of as many as SHARD_BYTES hold (a node has its vector in double and in single
    precision, some 36 links, and up to top + 1 ids)."""
    return -(-nodes // max(1, min(SHARD_NODES, SHARD_BYTES // (12 * dim + 160 + 8 * top))))


def of_dim(shards: dict[int, int]) -> Column:
    """The number of shards of a row's dim."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in shards.items() for x in pair))[F.col("dim")], F.lit(1)) if shards else F.lit(1)


def nearest(vectors: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query (vec_id, embedding) the `top` nearest found among all rows but its own.

    Ties go to the smaller id. Rows that share an id are candidates each; equal query rows are one, others with one id
    are answered each. Queries that take no part give no rows; with fewer candidates than `top`, all found. Vectors of
    different lengths do not meet. An empty table gives no rows.
    """
    graphs, shards = index(usable(vectors), top)
    asked = usable(queries).distinct().withColumn("dim", F.size("embedding"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), (of_dim(shards) - 1).cast("int"))))  # every query to every shard
    asked = asked.select("dim", "shard", F.lit(1).alias("turn"), F.lit(None).cast("binary").alias("graph"), F.lit(None).cast("array<array<long>>").alias("ids"), "vec_id", "embedding")
    loaded = graphs.select("dim", "shard", F.lit(0).alias("turn"), "graph", "ids", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("embedding"))
    work = loaded.unionByName(asked.withColumn("vec_id", F.col("vec_id").cast("long")))
    work = work.repartition(max(1, sum(shards.values())), "dim", "shard").sortWithinPartitions("dim", "shard", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, ids = None, []
        for b in batches:
            turns = b.column("turn").to_numpy()
            edges = np.unique(np.concatenate([[0], np.flatnonzero(turns == 0), np.flatnonzero(turns == 0) + 1, [b.num_rows]]))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if turns[lo] == 0:
                    graph, ids = unpacked(b.column("graph")[lo].as_py()), b.column("ids")[lo].as_py()
                    continue
                for k in range(lo, hi, TOGETHER):
                    part = b.slice(k, min(TOGETHER, hi - k))
                    q = np.array(part.column("embedding").to_pylist(), np.float64)
                    yield found(graph, ids, part.column("vec_id").to_numpy(), q)

    def found(graph: dict[str, np.ndarray], ids: list[list[int]], of: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        nodes, _ = search(graph, q, top + 1)
        exact = np.einsum("qkd,qd->qk", graph["vectors"][nodes], q)
        out: list[tuple[int, bytes, int, float]] = []
        for k, query in enumerate(of.tolist()):
            best = []
            for s, node in zip(exact[k].tolist(), nodes[k].tolist(), strict=True):
                if node >= 0:
                    own = list(ids[node])
                    if query in own and np.array_equal(graph["vectors"][node], q[k]):
                        own.remove(query)  # its own row
                    best += [(-s, v) for v in own]
            out += [(query, q[k].tobytes(), v, -s) for s, v in sorted(best)[:top]]
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=["query_id", "asked", "vec_id", "score"])

    merged = work.mapInArrow(run, "query_id long, asked binary, vec_id long, score double").withColumn("asked", F.xxhash64("asked"))
    order = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


QUERIES = {"op6_neighbours": query}
