"""Sets of word shingles as sorted hashes, for many texts at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words of a shingle.
WORDS = 5
#: Bytes of text that are worked on at a time (a longer text alone).
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
FACTORS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 65536), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= CHUNK + 65536:
            _powers[base] = have
    return have[:n]


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first text, texts, their bytes with a blank behind each, where each starts)."""
    first, parts, size = 0, [], 0
    for k, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        if parts and size + len(raw) > CHUNK:
            yield first, len(parts), b" ".join([*parts, b""]), np.cumsum([0, *(len(p) + 1 for p in parts)])
            first, parts, size = k, [], 0
        parts.append(raw)
        size += len(raw) + 1
    if parts:
        yield first, len(parts), b" ".join([*parts, b""]), np.cumsum([0, *(len(p) + 1 for p in parts)])


def sets(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, hashes, offsets): the distinct shingles of each text in a run of texts, ascending within each.

    A-Z count as a-z, words lie between blanks (space and 9 to 13). A text with fewer than WORDS words is one shingle; one
    without words, or null, has none.
    """
    for first, n, raw, starts in chunks(texts):
        data = LOWER[np.frombuffer(raw, np.uint8)]
        blank = BLANK[data]
        edges = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8)))
        begin, end = edges[::2], edges[1::2]
        text = np.searchsorted(starts, begin, "right") - 1
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), dtype=np.uint64)])
        word = mixed((sums[end] - sums[begin]) * powers(INVERSE, len(data))[begin])
        count = np.bincount(text, minlength=n)
        whole = np.zeros(0, np.uint64)
        of = np.zeros(0, np.int64)
        if len(word) >= WORDS:
            m = len(word) - WORDS + 1
            value = sum((word[k : k + m] * FACTORS[k] for k in range(WORDS)), np.zeros(m, np.uint64))
            inside = text[:m] == text[WORDS - 1 :]
            whole, of = mixed(value[inside]), text[:m][inside]
        short = np.flatnonzero((count > 0) & (count < WORDS))
        if len(short):
            at = np.concatenate([[0], np.cumsum(count)])
            extra = []
            for t in short:
                w = word[at[t] : at[t + 1]]
                extra.append((w * FACTORS[: len(w)]).sum(dtype=np.uint64) + np.uint64(WORDS - len(w)))
            whole, of = np.concatenate([whole, mixed(np.array(extra, np.uint64), 1)]), np.concatenate([of, short])
        order = np.lexsort((whole, of))
        whole, of = whole[order], of[order]
        new = np.ones(len(of), bool)
        new[1:] = (whole[1:] != whole[:-1]) | (of[1:] != of[:-1])
        whole, of = whole[new], of[new]
        yield first, whole, np.searchsorted(of, np.arange(n + 1))
