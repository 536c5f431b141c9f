"""Suffix-array dedup by refinement of buckets: bytes covered by a long string that starts anywhere else too.

A window (a string of `length` bytes) has one anchor: its q-gram of the smallest hash, the first of equal ones. Equal
windows have equal anchors at equal offsets, so that windows meet only within the initial bucket of their anchor's
q-gram. The windows of a document that share an anchor are a piece. Within a bucket, pieces with the same bytes are one
kind; a kind that occurs twice is settled as a whole. In buckets of several kinds one piece of each kind is refined:
buckets of the suffixes by 8 bytes are refined by the buckets at later offsets, each round using those that the round
before has refined, until a bucket stands for `length` bytes; windows whose bucket holds another one are repeats.
Buckets of very many kinds are refined by Spark instead, window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.common import forget, read, written
from wattloom.llm.shingles import mixed

LENGTH, Q = 400, 100
#: Windows of a document that are looked at together; a piece ends there.
CHUNK = 1 << 20
#: Kinds of a bucket that are refined in one task at most.
KINDS = 2000
#: Bytes that are refined together, about (whole buckets).
TOGETHER = 1 << 20
_letters = mixed(np.arange(256, dtype=np.uint64), 3)
PIECES = "i long, u1 long, u2 long, n int, c1 long, c2 long, p int, m int, o int"


def doubled(h: np.ndarray, by: int) -> np.ndarray:
    """Hashes of grams from those of the grams at their start and `by` further on."""
    return mixed(h[: len(h) - by] * np.uint64(0xD6E8FEB86659FD93) + h[by:], 1)


def anchors(data: np.ndarray, length: int, q: int) -> np.ndarray:
    """The anchor of each window of data, in order."""
    h, have = _letters[data], 1
    while have < q:
        by = min(have, q - have)
        h, have = doubled(h, by), have + by
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    have, wide = 1, length - q + 1
    while have < wide:
        by = min(have, wide - have)
        least, have = np.minimum(least[: len(least) - by], least[by:]), have + by
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def pieces(raw: bytes, length: int, q: int) -> Iterator[tuple[int, int, int]]:
    """(first window, windows, anchor) of the runs of windows with the same anchor."""
    data = np.frombuffer(raw, np.uint8)
    for at in range(0, len(raw) - length + 1, CHUNK):
        of = anchors(data[at : at + CHUNK + length - 1], length, q)
        edges = np.flatnonzero(np.diff(of, prepend=-1))
        yield from zip((edges + at).tolist(), np.diff(edges, append=len(of)).tolist(), (of[edges] + at).tolist(), strict=True)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def scanned(texts: DataFrame, length: int, q: int) -> DataFrame:
    """PIECES of texts (c1, c2, text): bucket, kind, how often (2: twice or more), class of the text, first window, windows, anchor's offset.

    What a batch has seen before is settled at once: a row with no bucket, for neighbours together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        names = [x.split()[0] for x in PIECES.split(", ")]
        for b in batches:
            known: dict[bytes, int] = {}
            rows: list[list] = []
            again: list[list] = []
            for c1, c2, text in zip(b.column("c1").to_pylist(), b.column("c2").to_pylist(), b.column("text").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                view = memoryview(raw)
                for p, m, a in pieces(raw, length, q):
                    kind = xxhash.xxh3_128_digest(view[p : p + m - 1 + length], a - p)
                    if (seen := known.setdefault(kind, len(rows))) == len(rows):
                        rows.append([signed(xxhash.xxh3_64_intdigest(view[a : a + q])), int.from_bytes(kind[:8], "big", signed=True), int.from_bytes(kind[8:], "big", signed=True), 1, c1, c2, p, m, a - p])
                        continue
                    rows[seen][3] = 2
                    last = again[-1] if again else None
                    if last and last[4:6] == [c1, c2] and last[6] + last[7] == p:
                        last[7] += m
                    else:
                        again.append([None, None, None, 2, c1, c2, p, m, None])
            for k in range(0, len(rows) + len(again), 100_000):
                part = (rows + again)[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in part], kind) for j, kind in enumerate(kinds)], names=names)

    return texts.mapInArrow(run, PIECES)


def refined(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """True for each window (the first windows[k] positions of string k) whose bytes another window has as well.

    Strings lie behind one another in data. Bucket numbers of 8 bytes are refined by pairs of buckets until they stand
    for `length` bytes.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    n = len(data)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : n + k]
    bucket = np.unique(key, return_inverse=True)[1].astype(np.int64)
    # Places of windows and of what they need later on; a window never reaches beyond its string.
    inside = np.arange(n) - np.repeat(starts, sizes)
    left = np.repeat(sizes, sizes) - inside
    have = 8
    while have < length:
        by = min(have, length - have)
        at = np.flatnonzero(left >= have + by)  # shorter suffixes take no part any more
        pair = bucket[at] * np.int64(n + 1) + bucket[at + by]
        bucket = np.full(n, -1, np.int64)
        bucket[at] = np.unique(pair, return_inverse=True)[1]
        have += by
    starts_window = np.flatnonzero(inside < np.repeat(windows, sizes))
    of = bucket[starts_window]
    return np.bincount(of, minlength=1)[of] > 1 if len(of) else np.zeros(0, bool)


def runs(of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the runs of neighbouring places `at` of the same `of`."""
    new = np.ones(len(at), bool)
    new[1:] = (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return first, np.diff(first, append=len(at))


RANGES = "c1 long, c2 long, p int, m int"


def ranges(c1: np.ndarray, c2: np.ndarray, p: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(p, pa.int32()), pa.array(m, pa.int32())], names=["c1", "c2", "p", "m"])


def refined_buckets(members: DataFrame, length: int) -> DataFrame:
    """RANGES of repeated windows of members (i, c1, c2, p, m, bytes), bucket i by bucket, of which a task takes many together."""

    def settle(rows: pa.Table) -> pa.RecordBatch:
        strings = rows.column("bytes").to_pylist()
        sizes = np.array([len(s) for s in strings])
        starts = np.cumsum(sizes) - sizes
        m = rows.column("m").to_numpy().astype(np.int64)
        hit = refined(np.frombuffer(b"".join(strings), np.uint8), starts, sizes, m, length)
        string = np.repeat(np.arange(len(m)), m)
        place = np.arange(len(string)) - np.repeat(np.cumsum(m) - m, m) + rows.column("p").to_numpy()[string]
        string, place = string[hit], place[hit]
        first, count = runs(string, place)
        return ranges(rows.column("c1").to_numpy()[string[first]], rows.column("c2").to_numpy()[string[first]], place[first], count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.column("bytes").nbytes
            if size < TOGETHER:
                continue
            rows = pa.Table.from_batches(held)
            i = rows.column("i").to_numpy()
            whole = int(np.searchsorted(i, i[-1]))  # the last bucket may go on
            if whole:
                yield settle(rows.slice(0, whole))
            held = rows.slice(whole).combine_chunks().to_batches()
            size = sum(x.column("bytes").nbytes for x in held)
        if held and sum(x.num_rows for x in held):
            yield settle(pa.Table.from_batches(held))

    return members.repartition("i").sortWithinPartitions("i").mapInArrow(run, RANGES)


def refined_windows(members: DataFrame, length: int) -> DataFrame:
    """The same, window by window: a window's bucket by all its bytes, counted by Spark, so that no task holds a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                m = part.column("m").to_numpy().astype(np.int64)
                digests = b"".join(xxhash.xxh3_128_digest(s[j : j + length]) for s, n in zip(part.column("bytes").to_pylist(), m.tolist(), strict=True) for j in range(n))
                u = np.frombuffer(digests, np.int64).reshape(-1, 2)
                of = np.repeat(np.arange(len(m)), m)
                p = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m) + part.column("p").to_numpy()[of]
                found = ranges(part.column("c1").to_numpy()[of], part.column("c2").to_numpy()[of], p, np.ones(len(of)))
                yield pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1]), *found.columns], names=["u1", "u2", *found.schema.names])

    windows = members.mapInArrow(run, f"u1 long, u2 long, {RANGES}")
    twice = windows.groupBy("u1", "u2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u1", "u2")
    return windows.join(twice, ["u1", "u2"]).select("c1", "c2", "p", "m")


def with_class(docs: DataFrame) -> DataFrame:
    """(doc_id, text, c1, c2): null texts as empty, and 128 bits of hash that name the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumns({"c1": F.xxhash64("text"), "c2": F.xxhash64(F.lit(11), "text")})


def removable(docs: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """(c1, c2, text, spans: array of p, m): each different text that has repeated windows, with the runs of windows that are repeated.

    docs: as with_class() gives them. Every row counts as a place, also rows that are equal throughout.
    """
    long = docs.where(F.octet_length("text") >= length)
    all_pieces = written(scanned(long.select("c1", "c2", "text"), length, q), "pieces")
    bucketed = all_pieces.where("i is not null")
    shared = bucketed.groupBy("i").agg(F.sum("n").alias("n")).where("n > 1").select("i")
    open_ = written(bucketed.join(shared, "i"), "open-pieces")
    kinds = open_.groupBy("i", "u1", "u2").agg(F.sum("n").alias("n"), F.min(F.struct("c1", "c2", "p", "m", "o")).alias("one"))
    kinds = written(kinds, "kinds")
    settled = open_.join(kinds.where("n > 1").select("u1", "u2"), ["u1", "u2"], "left_semi").select("c1", "c2", "p", "m")
    settled = settled.unionByName(all_pieces.where("i is null").select("c1", "c2", "p", "m")).distinct()  # equal texts, one row
    several = kinds.groupBy("i").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    chosen = kinds.join(several, "i").select("i", "kinds", "one.*")

    spans = settled.groupBy("c1", "c2").agg(F.collect_list(F.struct("p", "m")).alias("spans"))  # of one text
    asked = chosen.groupBy("c1", "c2").agg(F.collect_list(F.struct("i", "kinds", "p", "m")).alias("asked"))
    marks = spans.join(asked, ["c1", "c2"], "full_outer")
    texts = long.select("c1", "c2", "text").dropDuplicates(["c1", "c2"])
    marked = written(texts.join(marks, ["c1", "c2"]), "marked-texts")
    forget(all_pieces, open_)

    asked = marked.where("asked is not null").select("c1", "c2", F.col("text").cast("binary").alias("raw"), F.inline("asked"))
    strings = F.expr(f"substring(raw, p + 1, m + {length - 1})")
    members = written(asked.select("i", "kinds", "c1", "c2", "p", "m", strings.alias("bytes")), "members")
    found = refined_buckets(members.where(F.col("kinds") <= KINDS).drop("kinds"), length)
    found = found.unionByName(refined_windows(members.where(F.col("kinds") > KINDS), length))
    more = written(found.groupBy("c1", "c2").agg(F.collect_list(F.struct("p", "m")).alias("more")), "repeats")  # of one text
    forget(members, kinds)
    both = marked.select("c1", "c2", "text", "spans").join(more, ["c1", "c2"], "left")
    empty = F.array().cast("array<struct<p:int,m:int>>")
    return both.select("c1", "c2", "text", F.concat(F.coalesce("spans", empty), F.coalesce("more", empty)).alias("spans")).where(F.size("spans") > 0)


def cut(raw: bytes, spans: list[tuple[int, int]], length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """(what is left of raw, the removed runs) where `spans` are runs of repeated windows (first, how many)."""
    out: list[list[int]] = []
    for p, m in sorted(spans):
        if out and p <= out[-1][1]:
            out[-1][1] = max(out[-1][1], p + m - 1 + length)
        else:
            out.append([p, p + m - 1 + length])
    edges = [0, *(x for run in out for x in run), len(raw)]
    return b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)), [(a, z) for a, z in out]


def kept(docs: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept: bytes) of docs (doc_id, text), without each byte that a string of `length` bytes
    covers which also starts anywhere else, same document included.

    Null texts count as empty; texts of fewer than `length` bytes stay whole. Every row is a document of its own: rows
    that are equal throughout repeat each other. Columns but doc_id and text are not looked at. An empty table gives no
    rows. The kept bytes may cut a character of several bytes.
    """
    return results(docs, length, q, whole=True)


def results(docs: DataFrame, length: int, q: int, whole: bool) -> DataFrame:
    """What kept() gives, or with kept_sha256 in place of the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                left, gone = cut(raw, [(s["p"], s["m"]) for s in spans], length)
                rows.append((len(raw) - len(left), len(gone), left if whole else hashlib.sha256(left).hexdigest()))
            new = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary() if whole else pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("c1"), b.column("c2"), *new], names=["c1", "c2", "n_removed", "n_spans", "left"])

    named = with_class(docs)
    done = removable(named, length, q).mapInArrow(run, f"c1 long, c2 long, n_removed long, n_spans long, left {'binary' if whole else 'string'}")
    own = F.col("text").cast("binary") if whole else F.sha2(F.col("text").cast("binary"), 256)
    each = named.select("doc_id", "c1", "c2", F.octet_length("text").cast("long").alias("n_bytes"), own.alias("_own")).join(done, ["c1", "c2"], "left")
    zero = F.lit(0).cast("long")
    return each.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("left", "_own").alias("kept" if whole else "kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(read(spark, sf_dir, "documents"), LENGTH, Q, whole=False)


ORACLE = f"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
    w AS (SELECT doc_id, p, md5(array_slice(b, p + 1, p + {LENGTH})) AS h FROM (SELECT doc_id, b, unnest(range(octet_length(b) - {LENGTH - 1})) AS p FROM d WHERE octet_length(b) >= {LENGTH})),
    r AS (SELECT doc_id, p FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
    g AS (SELECT *, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {LENGTH}, true)::INT AS cut FROM r),
    s AS (SELECT doc_id, min(p) AS a, max(p) + {LENGTH} AS z FROM (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g) GROUP BY doc_id, run),
    k AS (SELECT doc_id, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS z FROM s UNION ALL SELECT doc_id, max(z), NULL FROM s GROUP BY doc_id UNION ALL SELECT doc_id, 0, NULL FROM d WHERE doc_id NOT IN (SELECT doc_id FROM s)),
    t AS (SELECT k.doc_id, sha256(unhex(string_agg(hex(array_slice(b, k.a + 1, coalesce(k.z, octet_length(b)))), '' ORDER BY k.a, k.z NULLS LAST))) AS kept_sha256 FROM k JOIN d USING (doc_id) GROUP BY k.doc_id),
    c AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256 FROM d JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)"""

QUERIES = {"op11_repeats": query}
ORACLES = {"op11_repeats": ORACLE}
