"""Mixing sources to target weights by a splitting tree.

Documents of a source are dealt by hash into blocks. A source's quota is a number of block draws: whole passes over its
blocks and then, in an order permuted anew for that pass, the first blocks up to its target. A tree splits the quotas of
all sources exactly among the output shards: every node draws its left side's part from the multivariate hypergeometric
distribution. A shard then draws its number of blocks of every source, disjoint from the other shards' draws, and orders
their documents by hash. What a document gives is the sum over the shards that draw its block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.llm.common import read, written

#: Weights of the sources in their order, repeating; and how often a source may be taken at most.
WEIGHTS, MAX_PASSES = (5, 2, 1), 3
#: Blocks of a source, and parts of the block that its target cuts. Windows hold so many rows, and the last one a part's documents.
BLOCKS = 1024
#: Groups of sources whose quotas are split together; the driver holds a row of shard quotas for each.
CHUNKS = 1024
SHARDS, SEED = 16, 20240229
#: The generator draws from fewer than so many block draws in all; more are drawn in strata of fewer, all sources in each.
MOST_DRAWN = 10**9
WORDS = r"[^\x20\x09-\x0D]+"


def shares(whole: np.ndarray, parts: int) -> list[np.ndarray]:
    """whole in `parts` parts that add up to it and differ by one at most."""
    have = np.asarray(whole, object)
    ends = [have * k // parts for k in range(parts + 1)]
    return [(b - a).astype(np.int64) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def drawn_part(rng: np.random.Generator, have: np.ndarray, wanted: int) -> np.ndarray:
    """Of `have` draws of each source, those among `wanted` ones: multivariate hypergeometric, in strata where there are very many."""
    total = int(have.sum())
    if not total:
        return have
    strata = shares(have, total // max(MOST_DRAWN - 1, 1) + 1 if total >= MOST_DRAWN else 1)
    ends, seen = [0], 0
    for part in strata:
        seen += int(part.sum())
        ends.append(wanted * seen // total)
    return sum((rng.multivariate_hypergeometric(part, b - a, method="marginals") for part, a, b in zip(strata, ends[:-1], ends[1:], strict=True)), np.zeros(len(have), np.int64))


def split_quotas(quotas: np.ndarray, sizes: np.ndarray, seed: list[int]) -> np.ndarray:
    """(shards, sources): quotas of sources split exactly over a binary tree of shards, which take `sizes` draws in all."""
    out = np.zeros((len(sizes), len(quotas)), np.int64)

    def split(have: np.ndarray, first: int, count: int, node: int) -> None:
        if count == 1:
            out[first] = have
            return
        left = count // 2
        wanted = int(sizes[first : first + left].sum())
        part = drawn_part(np.random.default_rng([*seed, node]), have, wanted)
        split(part, first, left, 2 * node)
        split(have - part, first + left, count - left, 2 * node + 1)

    split(np.asarray(quotas, np.int64), 0, len(sizes), 1)
    return out


def slim(docs: DataFrame, seed: int) -> DataFrame:
    """docs with _source (never null, in order but that "-" is last), _place (a hash of id and text) and _block."""
    return docs.withColumns({
        "_source": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")),
        "_place": F.xxhash64(F.lit(seed), "doc_id", "text"),
    }).withColumn("_block", F.pmod("_place", F.lit(BLOCKS)).cast("int"))


def weighed(sources: DataFrame) -> DataFrame:
    """sources (_source, _source_size) with _weight by their place in code point order, null last. Ranks come from ranges and their counts."""
    spark = sources.sparkSession
    order = [F.col("_source") == "-", F.col("_source")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(sources.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "mix-sources")
    counts = sorted((r["_part"], r["count"]) for r in dealt.groupBy("_part").count().collect())  # a row for each partition
    before = np.cumsum([0, *(c for _, c in counts)]).tolist()
    offsets = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], "_part int, before long")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    weights = F.array(*(F.lit(w) for w in WEIGHTS))
    ranked = dealt.join(F.broadcast(offsets), "_part")  # a row for each partition
    return ranked.select("_source", "_source_size", F.get(weights, F.pmod(rank, F.lit(len(WEIGHTS))).cast("int")).alias("_weight"))


def targeted(sources: DataFrame) -> DataFrame:
    """sources (_source, _source_size, _weight) with _target: shares of the whole by weight, stopped at MAX_PASSES times the size; what is
    over is shared anew until none is above. Each round is one aggregate; the driver holds three numbers."""
    whole = sources.agg(F.sum("_source_size").alias("left"), F.sum("_weight").alias("weight")).first()
    total, left, weight, stopped = whole["left"] or 0, whole["left"] or 0, whole["weight"] or 1, 0
    while True:
        share = F.lit(float(left)) * F.col("_weight") / F.lit(float(weight))
        most = (MAX_PASSES * F.col("_source_size")).cast("double")
        r = sources.agg(F.count_if(share > most).alias("n"), F.sum(F.when(share > most, MAX_PASSES * F.col("_source_size"))).alias("full"), F.sum(F.when(share <= most, F.col("_weight"))).alias("weight")).first()
        if r["n"] == stopped:
            return sources.withColumn("_target", F.least(share, most))
        stopped, left, weight = r["n"], total - r["full"], r["weight"]


def sharded(draws: DataFrame, shards: int, seed: int) -> DataFrame:
    """(_source, ends) of draws (_source, n): by the splitting tree, the number of a source's draws in each shard, summed up to it.

    The tree is drawn for groups of sources first (CHUNKS at most, on the driver), then for the sources of each group.
    """
    spark = draws.sparkSession
    draws = draws.withColumn("chunk", F.pmod(F.xxhash64("_source"), F.lit(CHUNKS)).cast("int"))
    totals = sorted((r["chunk"], r["n"]) for r in draws.groupBy("chunk").agg(F.sum("n").alias("n")).collect())  # at most CHUNKS
    quotas = np.array([n for _, n in totals], np.int64)
    edges = np.arange(shards + 1, dtype=object) * int(quotas.sum()) // shards
    parts = split_quotas(quotas, np.diff(edges).astype(np.int64), [seed])
    by_chunk = spark.createDataFrame([(c, parts[:, k].tolist()) for k, (c, _) in enumerate(totals)], "chunk int, sizes array<long>")

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_source")
        found = split_quotas(rows["n"].to_numpy(), np.asarray(rows["sizes"].iloc[0], np.int64), [seed, int(rows["chunk"].iloc[0]) + 1])
        return pd.DataFrame({"_source": rows["_source"], "ends": list(found.cumsum(0).T)})

    return draws.join(F.broadcast(by_chunk), "chunk").groupBy("chunk").applyInPandas(split, "_source string, ends array<long>")


def drawn(rows: DataFrame, shards: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (_source, _place, _block, _size): the facts of every block (_source, _block, _source_size, _target, _passes, _cut, _draws)
    and the documents of blocks that a target cuts (_source, _place, _part: words of the cut pass that a row gives).

    _draws: (pass, shard) of every draw of the block.
    """
    sources = targeted(written(weighed(rows.groupBy("_source").agg(F.sum("_size").alias("_source_size"))), "mix-weights"))
    quota = F.least(F.floor(F.col("_target") * (1 + 1e-12)), MAX_PASSES * F.col("_source_size"))
    sources = sources.withColumn("_quota", quota.cast("long")).withColumns({
        "_passes": F.coalesce(F.floor(F.try_divide("_quota", "_source_size")), F.lit(0)).cast("int"),
        "_rest": F.coalesce(F.try_mod("_quota", "_source_size"), F.lit(0)),
    })
    blocks = rows.groupBy("_source", "_block").agg(F.sum("_size").alias("words")).join(sources.drop("_weight", "_quota"), "_source")
    last = Window.partitionBy("_source").orderBy(F.xxhash64(F.lit(seed), "_passes", "_block"), "_block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("before", F.sum("words").over(last) - F.col("words"))
    blocks = written(blocks.withColumn("_cut", (F.col("before") < F.col("_rest")) & (F.col("before") + F.col("words") > F.col("_rest"))), "mix-blocks")

    draws = blocks.select("*", F.explode(F.expr("sequence(0, _passes)")).alias("pass")).where("words > 0 and (pass < _passes or before < _rest)")
    order = Window.partitionBy("_source").orderBy("pass", F.xxhash64(F.lit(seed), "pass", "_block"), "_block")
    draws = draws.withColumn("at", F.row_number().over(order) - 1)
    ends = sharded(draws.groupBy("_source").agg(F.count(F.lit(1)).alias("n")), shards, seed)
    placed = draws.join(ends, "_source").withColumn("shard", F.expr("size(filter(ends, e -> e <= at))"))
    lists = placed.groupBy("_source", "_block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("_draws"))  # MAX_PASSES + 1 at most
    facts = blocks.join(lists, ["_source", "_block"], "left").select("_source", "_block", "_source_size", "_target", "_passes", "_cut", "_draws")

    cut = blocks.where("_cut").select("_source", "_block", (F.col("_rest") - F.col("before")).alias("room"))
    near = rows.join(cut, ["_source", "_block"]).groupBy("_source", "_place").agg(F.sum("_size").alias("words"), F.count(F.lit(1)).alias("m"), F.first("room").alias("room"))
    near = near.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "_place"), F.lit(BLOCKS)))
    parts = near.groupBy("_source", "part").agg(F.sum("words").alias("words"))
    parts = parts.select("_source", "part", (F.sum("words").over(Window.partitionBy("_source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).alias("start"))
    inside = Window.partitionBy("_source", "part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    near = near.join(parts, ["_source", "part"]).withColumn("start", F.col("start") + F.sum("words").over(inside) - F.col("words"))
    given = F.greatest(F.lit(0), F.least("words", F.col("room") - F.col("start")))
    return facts, near.select("_source", "_place", F.floor(given / F.col("m")).alias("_part"), F.floor(F.col("words") / F.col("m")).alias("_part_of"))


def mixed(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards) of docs (doc_id, text, source): words that the mix takes of a document, repeats
    counted, and the shards that draw it.

    Null texts and texts without words have size 0 and are never drawn. A null source is a source of its own, the last. A
    source's words taken add up to its target, rounded down (less a word for each of several equal rows that a target
    cuts): the document at the edge is taken in part. Rows that repeat count as documents of their own. No documents give
    no rows.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)).cast("long"), F.lit(0))
    rows = written(slim(docs.select("doc_id", "text", "source"), seed).select("doc_id", "_source", "_place", "_block", size.alias("_size")), "mix-rows")
    facts, cut = drawn(rows, shards, seed)
    out = rows.join(facts, ["_source", "_block"]).join(cut, ["_source", "_place"], "left")
    each = F.expr("transform(coalesce(_draws, array()), d -> struct(d.shard as shard, if(d.pass < _passes or not _cut, _size, coalesce(_part, 0)) as words))")
    out = out.withColumn("_each", F.filter(each, lambda d: d["words"] > 0))
    taken = F.aggregate("_each", F.lit(0).cast("long"), lambda s, d: s + d["words"])
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken"), F.col("_each.shard").alias("shards"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself: every document as often as its block is drawn, brought together by shard (each in several parts) in hash order.

    The document that a target cuts counts as drawn if at least half of it is; documents without words are kept once.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)).cast("long"), F.lit(0))
    rows = written(slim(docs.select("doc_id", "text", "source"), seed).select("_source", "_place", "_block", size.alias("_size")), "mix-rows")
    facts, cut = drawn(rows, shards, seed)
    facts = written(facts.select("_source", "_block", "_passes", "_cut", "_draws"), "mix-facts")
    cut = written(cut.where("2 * _part >= _part_of").select("_source", "_place", F.lit(True).alias("_in")), "mix-cut")
    out = slim(docs, seed).join(facts, ["_source", "_block"]).join(cut, ["_source", "_place"], "left")
    drawn_ = F.expr("transform(filter(coalesce(_draws, array()), d -> d.pass < _passes or not _cut or coalesce(_in, false)), d -> d.shard)")
    alone = F.array(F.pmod("_place", F.lit(shards)).cast("int"))
    has_words = F.coalesce(F.col("text").rlike(WORDS), F.lit(False))
    out = out.select(*(F.col(c) for c in docs.columns), "_place", F.posexplode(F.when(has_words, drawn_).otherwise(alone)).alias("_copy", "_shard"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, n // shards)
    out = out.repartition(n, "_shard", F.pmod(F.xxhash64("_place", "_copy"), F.lit(parts)))
    return out.sortWithinPartitions("_shard", F.xxhash64("_place", "_copy")).select(docs.columns)


QUERIES = {"op2_mixing": query}
