"""SentencePiece encoding and decoding by a prefix table.

The last token of every prefix of a text is unique. An automaton gives the tokens that end at each position; the one
that is compatible with the last token of the prefix before it (both together encode to just these two) is kept.
Walking the table backwards gives the ids, in time linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from wattloom.llm.common import Remembered, extended, reachable, read, worker_of

MARK = "▁"
#: Encoded words, parts of words and tested pairs that a worker remembers, at most twice so many of each (about 40 MB each when full).
REMEMBERED = 150_000
INFINITE = float("inf")
PROBE = f" a  béａÅﬁ\t\r\n{MARK}<s>中\U0001f600 "


class Coder:
    """Encodes and decodes as the library does with the model at `path` (BPE, byte fallback, identity normaliser, dummy prefix)."""

    def __init__(self, path: str):
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        plain = [i for i in range(size) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        self.rank = {p: -lib.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(lib.id_to_piece(i)[3:5], 16): i for i in range(size) if lib.is_byte(i)}
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        if len(self.bytes) != 256 or lib.normalize(PROBE) != MARK + PROBE.replace(" ", MARK):
            raise ValueError("the model needs byte fallback, an identity normaliser and a dummy prefix")
        inner = any(MARK in p.lstrip(MARK) for p in self.ids)  # else no token crosses the end of a word
        self.words = re.compile(r"(?s).+" if inner else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.spaced = not inner
        self.letters = {p for p in self.ids if len(p) == 1}
        self.inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}  # neighbours that some token holds
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.raw = [b""] * size
        for p, i in self.ids.items():
            self.raw[i] = p.replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        self.packed = Remembered(lambda t: np.array([self.ids[t]] if t in self.ids else [self.bytes[b] for b in t.encode()], "<u4").tobytes(), REMEMBERED)
        self.traces: dict[str, tuple | None] = {}  # a vocabulary's at most
        self.pairs = Remembered(lambda pair: self.compatible(*pair), REMEMBERED)
        self.stretches = Remembered(self.stretch_ids, REMEMBERED)
        self.known = Remembered(self.word_ids, REMEMBERED)
        self.after_space = Remembered(lambda word: self.word_ids(MARK + word), REMEMBERED)

    def merged(self, text: str) -> list[str]:
        """The definition: merge the neighbours whose union ranks first, leftmost first, until none is a token."""
        out = list(text)
        while True:
            best = min(((self.rank[p], k) for k in range(len(out) - 1) if (p := out[k] + out[k + 1]) in self.rank), default=None)
            if best is None:
                return out
            out[best[1] : best[1] + 2] = [out[best[1]] + out[best[1] + 1]]

    def trace(self, token: str) -> tuple[list[float], list[str], list[str]] | None:
        """The ranks of a token's own merges in order, and its outermost parts before each and at the end; None if it encodes to more."""
        if token not in self.traces:
            parts, ranks, lefts, rights = list(token), [], [token[0]], [token[-1]]
            while best := min(((self.rank[p], k) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in self.rank), default=None):
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
                ranks.append(best[0])
                lefts.append(parts[0])
                rights.append(parts[-1])
            self.traces[token] = ([*ranks, INFINITE], lefts, rights) if len(parts) == 1 else None
        return self.traces[token]

    def compatible(self, left: str, right: str) -> bool:
        """Whether both side by side encode to just these two (an empty left: whether right encodes to itself).

        Each side merges as it does alone unless a merge across the edge between them ranks before the next of both.
        """
        if (b := self.trace(right)) is None or not left:
            return b is not None
        if (a := self.trace(left)) is None:
            return False
        i = j = 0
        while True:
            own, other = a[0][i], b[0][j]
            across = self.rank.get(a[2][i] + b[1][j], INFINITE)
            if across < own and across <= other:
                return False
            if own == other == INFINITE:
                return True
            if own <= other:
                i += 1
            else:
                j += 1

    def tokens(self, word: str) -> list[str]:
        """The prefix table of a word, walked backwards. A character outside the vocabulary is a token of its own."""
        last: list[str | None] = ["", *[None] * len(word)]
        pairs = self.pairs
        found = self.automaton.iter(word)
        if not self.letters.issuperset(word):
            alone = ((k, c) for k, c in enumerate(word) if c not in self.ids)
            found = sorted([*found, *alone], key=lambda x: (x[0], -len(x[1])))
        for at, piece in found:  # by end, the longest first
            if last[at + 1] is None and (before := last[at + 1 - len(piece)]) is not None and pairs[before, piece]:
                last[at + 1] = piece
        out, end = [], len(word)
        while end:
            if last[end] is None:
                return self.merged(word)  # tokens of equal rank can leave a prefix without a last token
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def stretch_ids(self, text: str) -> bytes:
        """Little-endian ids of a text."""
        return b"".join([self.packed[t] for t in self.tokens(text)])

    def word_ids(self, word: str) -> bytes:
        """Little-endian ids of a word, cut where two neighbours lie together in no token."""
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.inside]
        if not cuts:
            return self.stretch_ids(word)
        return b"".join([self.stretches[word[a:b]] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)])

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text between the begin and end ids."""
        if not text:
            body = b""
        elif self.spaced and "  " not in text and text[0] != " " and text[-1] != " " and MARK not in text:
            body = b"".join(map(self.after_space.__getitem__, text.split(" ")))
        else:
            body = b"".join(map(self.known.__getitem__, self.words.findall(MARK + text.replace(" ", MARK))))
        return np.concatenate([[self.begin], np.frombuffer(body, "<u4"), [self.end]]).astype("<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; control ids give nothing, the dummy prefix goes."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return (raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


DIGESTS = (("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"))


def encoded(docs: DataFrame, path: str, keep: list[str], with_ids: bool = False) -> DataFrame:
    """Columns `keep` of docs with n_tokens, ids_sha256 and decoded_sha256, and token_ids if asked for; one narrow pass over whole texts.

    A null text is empty: just the begin and end ids. Kept columns that clash with the new ones are dropped.
    """
    added = [*DIGESTS, *([("token_ids", "array<int>")] if with_ids else [])]
    keep = [c for c in keep if c not in dict(added)]
    base = docs.select([*(docs[c] for c in keep), docs["text"].alias("_text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("pieces", coder.cache_clear)
        c = coder(path)
        for b in batches:
            all_ids, texts = [], b.column(len(keep)).to_pylist()
            n, sha, back = [], [], []
            for t in texts:
                ids = c.encode(t or "")
                n.append(len(ids))
                sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                back.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
            new = [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                new.append(pa.array(all_ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *new], names=[*keep, *dict(added)])

    return base.mapInArrow(run, extended(base.select(keep).schema, ", ".join(map(" ".join, added))))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read(spark, sf_dir, "documents"), model_path(), ["doc_id"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs (without the text) with their token ids and digests."""
    reachable(spark)
    return encoded(docs, model_path(), [c for c in docs.columns if c != "text"], with_ids=True)


QUERIES = {"op8_sentencepiece": query}
