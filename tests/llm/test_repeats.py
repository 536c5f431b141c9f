import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.llm import repeats


def plain(texts, length):
    """(n_bytes, n_removed, n_spans, kept) of each text by brute force."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[p : p + length] for r in raw for p in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 2, bool)
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p + 1 : p + 1 + length] = True
        left = bytes(b for b, g in zip(r, gone[1:], strict=False) if not g)
        out.append((len(r), int(gone.sum()), int((~gone[:-1] & gone[1:]).sum()), left))
    return out


def some_texts(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé中") for _ in range(rng.randrange(1, 8)))
    passages = [" ".join(word() for _ in range(rng.randrange(60, 160))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 150))) for _ in range(2)]
        t = rng.choice(passages)
        if rng.random() < 0.5:
            k = rng.randrange(len(t))
            t = t[:k] + word() + t[k + rng.randrange(3) :]
        texts.append(parts[0] + (t if rng.random() < 0.7 else "") + parts[1])
    return [*texts, texts[3], texts[3], texts[5][50:], "ab" * 900, "x" * 2000, "x" * 399, "x" * 400, "", None, passages[0][:380]]


@pytest.mark.parametrize("most", [2000, 1])  # with 1, Spark refines all buckets window by window
def test_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "KINDS", most)
    texts = some_texts(most)
    docs = spark.createDataFrame([(k, t, 7, 8, 9) for k, t in enumerate(texts)], "doc_id long, text string, p int, m int, c1 int")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.kept(docs.repartition(5)).collect()}
    want = plain(texts, 400)
    assert got == dict(enumerate(want)) and sum(w[1] > 0 for w in want) > 60
    hashed = {r["doc_id"]: r["kept_sha256"] for r in repeats.results(docs, 400, 100, whole=False).collect()}
    assert hashed == {k: hashlib.sha256(w[3]).hexdigest() for k, w in enumerate(want)}


def test_other_lengths(spark):
    texts = ["abcabcabcabc", "zzabcabcq", "abc", "qqqqqqqqqq", None, "zzabcabcq and more", "é中é中é中"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for length, q in ((8, 3), (9, 9), (12, 8)):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.kept(docs, length, q).collect()}
        assert got == dict(enumerate(plain(texts, length)))


def test_pieces_cover_every_window_once(monkeypatch):
    raw = " ".join(t or "" for t in some_texts(5, 20)).encode()
    for chunk in (1 << 20, 1000):
        monkeypatch.setattr(repeats, "CHUNK", chunk)
        found = list(repeats.pieces(raw, 400, 100))
        assert [x for p, m, _ in found for x in range(p, p + m)] == list(range(len(raw) - 399))
        assert all(p + m - 1 <= a <= p + 300 for p, m, a in found)
    of = {raw[x : x + 400]: a - x for p, m, a in found for x in range(p, p + m)}
    assert all(of[raw[x : x + 400]] == a - x for p, m, a in found for x in range(p, p + m))  # equal windows, equal anchors


def test_odd_documents(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.kept(odd_docs).collect())
    assert got == Counter((r["doc_id"], *w) for r, w in zip(rows, plain([r["text"] for r in rows], 400), strict=True))
    assert repeats.kept(no_docs).count() == 0
    nulls = no_docs.sparkSession.range(3).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    assert [tuple(r)[1:4] for r in repeats.kept(nulls).collect()] == [(0, 0, 0)] * 3


def test_query_on_an_empty_table(spark, no_docs, folder):
    found = repeats.query(spark, folder(documents=no_docs))
    assert found.count() == 0 and found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
