"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are perfect binary trees, flattened into arrays (feature, threshold by inner node; value by leaf),
so numpy walks all documents of a batch through all trees level by level.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.common import extended, id_remainder, read

#: Labelled rows that the trees are fitted on, at most (chosen by a hash of the id); bounds what the driver gathers.
MAX_TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2, MIN_WEIGHT = 80, 4, 64, 0.15, 1.0, 2.0
THRESHOLD = 0.3

FEATURES = (
    "log_chars", "log_words", "word_len", "word_len_sd", "lower", "upper", "digit", "space", "newline", "stop_mark",
    "symbol", "other", "entropy", "distinct_words", "top_word", "log_lines", "words_per_line", "repeated_lines",
    "ends_in_symbol", "capitalised", "short_words", "packed", "repeated_chars", "distinct_bytes",
)

LOWER, UPPER, DIGIT, SPACE, NEWLINE, MARK, SYMBOL, OTHER = range(8)


def _classes() -> np.ndarray:
    table = np.full(256, SYMBOL, np.uint8)
    for code in range(256):
        c = chr(code)
        if code >= 128:
            table[code] = OTHER
        elif c.isalpha():
            table[code] = LOWER if c.islower() else UPPER
        elif c.isdigit():
            table[code] = DIGIT
        elif c == "\n":
            table[code] = NEWLINE
        elif c.isspace():
            table[code] = SPACE
        elif c in ".,;:?'\"-()":
            table[code] = MARK
    return table


CLASSES = _classes()


def statistics(text: str | None, packer: zstandard.ZstdCompressor) -> list[float]:
    """The FEATURES of a whole text; a null text counts as empty, whose statistics are all 0."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    kind = CLASSES[data]
    n = len(data)
    share = np.bincount(kind, minlength=8) / n
    counts = np.bincount(data, minlength=256)
    p = counts[counts > 0] / n
    blank = (kind == SPACE) | (kind == NEWLINE)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    lengths = ends - starts if len(starts) else np.zeros(1)
    m = max(len(starts), 1)
    tally = Counter(words)
    return [
        math.log1p(n), math.log1p(len(words)), float(lengths.mean()), float(lengths.std()),
        *(float(share[k]) for k in (LOWER, UPPER, DIGIT, SPACE, NEWLINE, MARK, SYMBOL, OTHER)),
        float(-(p * np.log2(p)).sum()), len(tally) / max(len(words), 1), max(tally.values(), default=0) / max(len(words), 1),
        math.log1p(len(lines)), len(words) / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1),
        float((kind[ends - 1] == SYMBOL).sum()) / m if len(ends) else 0.0, float((kind[starts] == UPPER).sum()) / m if len(starts) else 0.0,
        float((lengths <= 3).mean()), len(packer.compress(raw)) / n, float((data[1:] == data[:-1]).mean()) if n > 1 else 0.0, len(p) / 256,
    ]


def featurised(docs: DataFrame) -> DataFrame:
    """(doc_id, features) of docs (doc_id, text), in one narrow pass."""
    kind = pa.from_numpy_dtype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for b in batches:
            rows = [statistics(t, packer) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.list_(kind))], names=["doc_id", "features"])

    return docs.select("doc_id", "text").mapInArrow(run, extended(docs.select("doc_id").schema, "features array<double>"))


@dataclass
class Trees:
    """base: log-odds; feature, threshold: (trees, 2**DEPTH - 1); value: (trees, 2**DEPTH)."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        total = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            rows, at = np.arange(len(part))[:, None], np.zeros((len(part), len(self.feature)), np.int64)
            trees = np.arange(len(self.feature))[None, :]
            for _ in range(DEPTH):
                at = 2 * at + 1 + (part[rows, self.feature[trees, at]] > self.threshold[trees, at])
            total[lo : lo + 4096] += self.value[trees, at - inner].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosts on the logistic loss over binned features. Labels y lie in 0 to 1. Without rows every score is 0.5; with one label, its share."""
    inner = 2**DEPTH - 1
    shape = (TREES, inner)
    share = float(np.clip((y.sum() + 0.5) / (len(y) + 1), 1e-6, 1 - 1e-6))
    model = Trees(math.log(share / (1 - share)), np.zeros(shape, np.int32), np.full(shape, np.inf), np.zeros((TREES, inner + 1)))
    if not len(y):
        return model
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)  # v > cut k-1
    margin = np.full(len(y), model.base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            slot = at - first
            best = np.zeros(nodes)
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                key, n = slot * BINS + binned[:, f], nodes * BINS
                gl, hl = (np.bincount(key, w, n).reshape(nodes, BINS).cumsum(1) for w in (g, h))
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[(hl < MIN_WEIGHT) | (ht - hl < MIN_WEIGHT)] = 0
                k = gain[:, : len(cut)].argmax(1)
                top = gain[np.arange(nodes), k]
                for node in np.flatnonzero(top > best + 1e-9):
                    best[node] = top[node]
                    model.feature[t, first + node], model.threshold[t, first + node] = f, cut[k[node]]
            at = 2 * at + 1 + (x[np.arange(len(y)), model.feature[t, at]] > model.threshold[t, at])
        leaf = at - inner
        gs, hs = (np.bincount(leaf, w, inner + 1) for w in (g, h))
        model.value[t] = -RATE * gs / (hs + L2)
        margin += model.value[t][leaf]
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Trees:
    """Fits on at most MAX_TRAIN_ROWS labelled documents. Repeated labels of a document are averaged; null labels and ids teach nothing."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN_ROWS)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")  # at most MAX_TRAIN_ROWS ids
    one = featurised(chosen).groupBy("doc_id").agg(F.min("features").alias("features"))
    rows = sorted(one.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "features").collect())
    x = np.array([r["features"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit_trees(x, np.array([r["label"] for r in rows], float))


def scored(docs: DataFrame, model: Trees) -> DataFrame:
    """(doc_id, score, predicted) of every row of docs (doc_id, text), in one narrow pass."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for b in batches:
            x = np.array([statistics(t, packer) for t in b.column("text").to_pylist()], float).reshape(b.num_rows, len(FEATURES))
            score = sent.value.score(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, extended(docs.select("doc_id").schema, "score double, predicted int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty and null texts are scored from statistics of 0; a null id is not held out and teaches nothing."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit(docs, labels.where(id_remainder("doc_id", 5) != 0))
    held = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    return scored(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES = {"op3_quality": query}
