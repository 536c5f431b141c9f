"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

File format (little-endian): magic, first 16 bytes of the dictionary's sha256, u8 bytes per id, u32 documents; then for
each document i64 doc_id, u8 whether the id is null, u32 tokens; then u64 offsets (one more than documents); then the
frames. The offset index lets one short document be read without the rest. A file is a row of a Parquet table in the
shared folder, so any store that Spark reaches can hold it; `part` and `seq` give the files' order.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.common import Remembered, read, worker_of, written

MAGIC = b"WLTOKEN1"
HEAD = struct.Struct("<8s16sBI")
#: A file is closed when its frames reach this size.
FILE_BYTES = 4 << 20
#: Documents, and bytes of each, that the dictionary is trained on, at most.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 1000, 8192, 65536
LEVEL = 3
END_ID = 0
#: Encoded units, and words, that a worker remembers, at most twice so many of each (about 75 MB each when full).
REMEMBERED = 250_000
# The code points of Unicode's White_Space property, where the tokenizer's pattern always cuts.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ID = attrgetter("id")
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
#: Parts that the pattern cuts around, whatever stands beside them; blanks run up to the one that the next word takes.
UNITS = re.compile(
    f" ?[{LETTERS}]++(?![^\\x00-\\x7f])| ?[0-9]++(?![^\\x00-\\x7f])| ?[{MARKS}]++(?=[A-Za-z0-9{BLANK}]|$)"
    f"| ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
)
#: Blanks besides single spaces between words and line feeds.
UNUSUAL = re.compile("[\t\v\f\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


#: One part of the pattern, whole: what the library's model takes without its pattern.
ALONE = re.compile(f" ?(?:[{LETTERS}]+|[0-9]+|[{MARKS}]+)")
#: A word that is one part, and marks that often end one; the pattern cuts between them.
ONE_PART, ENDS = re.compile(f"[{LETTERS}]+"), ".,;:!?"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class Words:
    """Serialized ids by word and by unit of text. The tokenizers library encodes what is new; no token crosses a unit's edge."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.space = self.letters[ord(" ")]
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.kind == "H" else "<u4")
        self.end = np.array([END_ID], self.dtype).tobytes()
        self.units = Remembered(self.unit, REMEMBERED)
        self.words = Remembered(self.word, REMEMBERED)  # each behind a space

    def packed(self, ids: Iterable[int]) -> bytes:
        out = array(self.kind, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def alone(self, unit: str) -> bytes:
        letters = unit.replace(" ", self.space) if unit.isascii() and unit.isprintable() else unit.encode().decode("latin-1").translate(self.letters)
        return self.packed(map(ID, self.model.tokenize(letters)))

    def unit(self, unit: str) -> bytes:
        return self.alone(unit) if ALONE.fullmatch(unit) else self.packed(self.tokenizer.encode(unit, add_special_tokens=False).ids)

    def word(self, word: str) -> bytes:
        if ONE_PART.fullmatch(word):
            return self.alone(f" {word}")
        core = word.rstrip(ENDS)
        if len(core) < len(word) and ONE_PART.fullmatch(core):
            return self.words[core] + self.units[word[len(core) :]]
        line, feed, then = word.partition("\n")
        if line and feed and "\n" not in then:
            return self.words[line] + self.units[feed] + b"".join(map(self.units.__getitem__, UNITS.findall(then)))
        return b"".join(map(self.units.__getitem__, UNITS.findall(f" {word}")))

    def encode(self, text: str | None) -> bytes:
        """All ids of a text and the end id, serialized."""
        t = text or ""
        if not t or t[0] == " " or t[-1] == " " or "  " in t or " \n" in t or "\n " in t or UNUSUAL.search(t):
            return b"".join(map(self.units.__getitem__, UNITS.findall(t))) + self.end
        head, _, tail = t.partition(" ")
        return b"".join(map(self.units.__getitem__, UNITS.findall(head))) + (b"".join(map(self.words.__getitem__, tail.split(" "))) if tail else b"") + self.end


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    return Words(path)


def trained(samples: list[bytes]) -> bytes:
    """A dictionary from serialized id arrays; too few to train on: their plain content."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES]


def packed(docs: list[tuple[int | None, int, bytes]], dictionary: bytes, width: int) -> bytes:
    """A file of (doc_id, tokens, frame)."""
    index = np.zeros(len(docs), [("id", "<i8"), ("null", "u1"), ("n", "<u4")])
    index["id"], index["null"], index["n"] = [d[0] or 0 for d in docs], [d[0] is None for d in docs], [d[1] for d in docs]
    offsets = np.concatenate([[0], np.cumsum([len(d[2]) for d in docs])]).astype("<u8")
    head = HEAD.pack(MAGIC, hashlib.sha256(dictionary).digest()[:16], width, len(docs))
    return b"".join([head, index.tobytes(), offsets.tobytes(), *(d[2] for d in docs)])


class TokenFile:
    """Reads a file; `document(k)` decompresses the k-th document only."""

    def __init__(self, blob: bytes, dictionary: bytes):
        magic, digest, self.width, n = HEAD.unpack_from(blob)
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest()[:16]:
            raise ValueError("not a token file, or of another dictionary")
        kind = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4")])
        self.index = np.frombuffer(blob, kind, n, HEAD.size)
        self.offsets = np.frombuffer(blob, "<u8", n + 1, at := HEAD.size + n * kind.itemsize)
        self.blob, self.first = blob, at + 8 * (n + 1)
        self.reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def document(self, k: int) -> np.ndarray:
        a, b = (self.first + int(x) for x in self.offsets[k : k + 2])
        return np.frombuffer(self.reader.decompress(self.blob[a:b]), f"<u{self.width}").astype("<u4")


def write_files(docs: DataFrame, path: str) -> tuple[DataFrame, bytes]:
    """Writes the ids of docs (doc_id, text) and gives (part, seq, n_tokens, file) and the dictionary.

    Null texts are empty documents of one end id. Documents lie in ascending doc_id order (null first; rows of one id in
    the order of a hash of their text), dealt by range, so no task holds more than its range.
    """
    docs = docs.select("doc_id", "text")
    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    some = docs.join(F.broadcast(chosen), "doc_id", "left_semi").limit(SAMPLE_DOCS)  # at most SAMPLE_DOCS ids

    def serialize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([words(path).encode(t)[:SAMPLE_BYTES] for t in b.column("text").to_pylist()], pa.binary())], names=["ids"])

    dictionary = trained(sorted(bytes(r["ids"]) for r in some.mapInArrow(serialize, "ids binary").collect()))
    sent = docs.sparkSession.sparkContext.broadcast(dictionary)  # at most DICT_BYTES

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("token_files", words.cache_clear)
        w = words(path)
        kind = {"dict_data": zstandard.ZstdCompressionDict(sent.value)} if sent.value else {}
        z = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, **kind)
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def closed() -> pa.RecordBatch:
            row = {"part": [part], "seq": [seq], "n_tokens": [sum(d[1] for d in held)], "file": [packed(held, sent.value, w.dtype.itemsize)]}
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("file", pa.binary())]))

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = w.encode(text)
                held.append((doc, len(ids) // w.dtype.itemsize, frame := z.compress(ids)))
                size += len(frame)
                if size >= FILE_BYTES:
                    yield closed()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield closed()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    files = dealt.mapInArrow(write, "part int, seq int, n_tokens long, file binary")
    return written(files, "token-files"), dictionary


def read_files(files: DataFrame, dictionary: bytes) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    spark = files.sparkSession
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row for each partition written
    before, rows = 0, []
    for r in totals:
        rows.append((r["part"], before))
        before += r["n"]
    parts = spark.createDataFrame(rows, "part int, before long")
    seqs = files.select("part", "seq", "n_tokens").alias("a")
    earlier = seqs.join(seqs.alias("b"), F.expr("a.part = b.part and b.seq < a.seq"), "left").groupBy("a.part", "a.seq").agg(F.coalesce(F.sum("b.n_tokens"), F.lit(0)).alias("inside"))
    placed = files.join(earlier, ["part", "seq"]).join(parts, "part").select((F.col("before") + F.col("inside")).alias("start"), "file")
    sent = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, blob in zip(b.column("start").to_pylist(), b.column("file"), strict=True):
                f = TokenFile(blob.as_py(), sent.value)
                n = f.index["n"].astype(np.int64)
                crc = [zlib.crc32(f.document(k).tobytes()) for k in range(len(n))]
                ids = pa.array(f.index["id"], pa.int64(), mask=f.index["null"].astype(bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_files(*write_files(read(spark, sf_dir, "documents"), tokenizer_path()))


QUERIES = {"op5_token_files": query}
