import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.llm import language_id, mixing, quality

EN, FR = "the and of to in that house water tree people with from", "le la les des une que dans pour avec maison arbre eau"


def speech(rng, vocabulary, n):
    return " ".join(rng.choice(vocabulary.split()) for _ in range(n))


def test_language(spark, odd_docs, no_docs, folder):
    rng = random.Random(1)
    rows = [(k, speech(rng, EN if k % 2 else FR, rng.randrange(15, 60)), "en" if k % 2 else "fr") for k in range(300)]
    rows += [(900, None, "en"), (901, "", "en"), (902, "123 !?", "fr"), (903, "the water", None), (None, "le la", "fr")]
    path = folder(documents=spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in language_id.query(spark, path).collect()}
    held = [k for k in range(300) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k]["held_out"] == (k in held) for k in range(300))
    assert np.mean([got[k]["lang_pred"] == rows[k][2] for k in held]) > 0.97
    assert [got[k]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3 and len(got) == len(rows)
    assert language_id.stage(spark, odd_docs, "").columns == odd_docs.columns and language_id.stage(spark, no_docs, "").count() == 0


def test_short_clean_texts_pass_the_language_stage(spark):
    rng = random.Random(5)
    rows = [(k, speech(rng, EN if k % 2 else FR, rng.randrange(15, 60)), "en" if k % 2 else "fr") for k in range(300)]
    short = {1000 + k: f"{w.title()}." for k, w in enumerate(f"{EN} {FR}".split())}
    docs = spark.createDataFrame(rows + [(k, w, None) for k, w in short.items()] + [(2000, "12 !?", None)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in language_id.stage(spark, docs, "").collect()}
    assert kept == {*range(300), *short}


def test_a_tie_of_languages_is_a_rejection_only_where_a_lead_would_show():
    rng = random.Random(6)
    raw = "\n".join(speech(rng, EN, 40) for _ in range(100)).encode()
    models = language_id.compressors({"a": raw, "b": raw})
    assert language_id.classify("The.", models) == ("a", 0.0, False)
    assert language_id.classify(" ".join(f"{rng.getrandbits(64):x}" for _ in range(100)), models)[1:] == (0.0, True)


def test_every_language_is_learned_within_the_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"word{k} of language {k % 300}", f"l{k % 300}") for k in range(900)], "doc_id long, text string, lang string")
    assert len(language_id.fit(docs)) == 300
    monkeypatch.setattr(language_id, "MODEL_CHARS", 300 * 8)
    assert len(small := language_id.fit(docs)) == 300 and sum(map(len, small.values())) <= 300 * 8
    assert language_id.classify("word", language_id.compressors(dict(list(small.items())[:3])))[0] in small


def test_dictionaries_hold_more_than_a_shared_opening(spark):
    rng, opening = random.Random(7), "x9 " * 400
    rows = [(k, opening + speech(rng, EN if k % 2 else FR, 500), "en" if k % 2 else "fr") for k in range(60)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model["en"].count(b"water") > 20 and model["fr"].count(b"maison") > 20


def test_quality(spark, odd_docs, no_docs, folder):
    rng = random.Random(2)
    rows = [(k, speech(rng, EN, 60) if k % 3 else " | ".join(speech(rng, EN, 40).split()).upper() + "!!", int(k % 3 > 0)) for k in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").unionByName(odd_docs.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (1, None), (2, 1), (2, 1)], "doc_id long, quality int")
    path = folder(documents=docs, labels=labels)
    got = {r["doc_id"]: r for r in quality.query(spark, path).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([got[k]["predicted"] == rows[k][2] for k in held]) > 0.95 and all(got[k]["held_out"] for k in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values()) and quality.query(spark, path).count() == docs.count()


def test_quality_without_labels(spark, odd_docs, folder):
    path = folder(documents=odd_docs, labels=spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.query(spark, path).collect()} == {0.5}


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    model = quality.fit_trees(x, (x[:, 0] + x[:, 1] > 0).astype(float))
    total = []
    for row in x[:40]:
        s = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            at = 0
            for _ in range(quality.DEPTH):
                at = 2 * at + 1 + int(row[f[at]] > t[at])
            s += v[at - len(f)]
        total.append(1 / (1 + np.exp(-s)))
    assert np.allclose(model.score(x[:40]), total) and ((model.score(x) > 0.5) == (x[:, 0] + x[:, 1] > 0)).mean() > 0.95


def plain_targets(sizes, weights):
    """The level at which min(3 * size, level * weight) add up to all sizes, by bisection."""
    lo, hi = 0.0, 3.0 * max(sizes) / min(weights) + 1
    for _ in range(200):
        level = (lo + hi) / 2
        lo, hi = (level, hi) if sum(min(3 * s, level * w) for s, w in zip(sizes, weights, strict=True)) < sum(sizes) else (lo, level)
    return [min(3 * s, hi * w) for s, w in zip(sizes, weights, strict=True)]


@pytest.mark.parametrize("sizes", [[100, 10, 1], [1, 1, 1000, 5], [0, 7, 0, 3], [50], [10, 10, 10], [0, 0], [1] * 40 + [900], list(range(1, 60))])
def test_targets(spark, sizes):
    names = [chr(0x41 + 37 * k) for k in range(len(sizes) - 1)] + [None]
    random.Random(1).shuffle(order := list(range(len(sizes))))
    rows = spark.createDataFrame([("-" if names[k] is None else "=" + names[k], sizes[k]) for k in order], "_source string, _source_size long")
    got = {r["_source"]: r["_target"] for r in mixing.targeted(mixing.weighed(rows)).collect()}
    want = plain_targets(sizes, [(5, 2, 1)[k % 3] for k in range(len(sizes))])
    assert all(abs(got["-" if n is None else "=" + n] - w) < 1e-6 * max(1, w) for n, w in zip(names, want, strict=True))


def test_split_keeps_quotas(monkeypatch):
    q, sizes = np.array([13, 0, 5, 1000]), np.diff(np.arange(8) * 1018 // 7)
    for most in (10**9, 1):
        monkeypatch.setattr(mixing, "MOST_DRAWN", most)
        parts = mixing.split_quotas(q, sizes, [1])
        assert (parts.sum(0) == q).all() and (parts.sum(1) == sizes).all() and (parts >= 0).all()
        assert (parts == mixing.split_quotas(q, sizes, [1])).all()


def test_shards_draw_disjoint_runs_of_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNKS", 3)
    n = {f"={k}": 1 + 7 * k for k in range(20)}
    got = {r["_source"]: r["ends"] for r in mixing.sharded(spark.createDataFrame(list(n.items()), "_source string, n long"), 5, 9).collect()}
    assert set(got) == set(n) and all(e == sorted(e) and e[-1] == n[s] for s, e in got.items())
    totals = np.diff(np.array([[0, *e] for e in got.values()]).sum(0))
    assert totals.max() - totals.min() <= 1


@pytest.mark.parametrize("blocks", [4, 1024])
def test_mix(spark, odd_docs, no_docs, folder, monkeypatch, blocks):
    monkeypatch.setattr(mixing, "BLOCKS", blocks)
    rng = random.Random(4)
    rows = [(k, speech(rng, EN, rng.randrange(0, 30)), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(200)]
    rows += [(500, "one row that stands here twice", "c")] * 2
    path = folder(documents=spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = mixing.query(spark, path).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.query(spark, path).collect())) and len(got) == 202
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s))
    size = {s: sum(len(r[1].split()) for r in rows if r[2] == s) for s in sources}
    want = dict(zip(sources, plain_targets([size[s] for s in sources], [5, 2, 1, 5][: len(sources)]), strict=True))
    of, text = {r[0]: r[2] for r in rows}, {r[0]: r[1] for r in rows}
    for s in sources:
        mine = [r for r in got if of[r["doc_id"]] == s]
        assert -2 <= sum(r["taken"] for r in mine) - want[s] <= 1 and all(abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == size[s] for r in mine)
        cut = [r for r in mine if r["size"] and r["taken"] % r["size"]]
        assert len(cut) <= 2  # the document that the target cuts, or two equal rows
    assert all(0 <= r["taken"] <= 3 * r["size"] and r["size"] == len(text[r["doc_id"]].split()) for r in got)
    assert all(len(r["shards"]) == -(-r["taken"] // r["size"]) for r in got if r["size"])
    kept = mixing.stage(spark, spark.read.parquet(f"{path}/documents.parquet"), "").groupBy("doc_id").count().collect()
    kept = {r["doc_id"]: r["count"] for r in kept}
    assert all(kept.get(r["doc_id"], 0) == (round(r["taken"] / r["size"] + 1e-9) if r["size"] else 1) for r in got if r["doc_id"] != 500)


def test_mix_of_odd_rows(spark, odd_docs, no_docs, folder):
    got = mixing.query(spark, folder(documents=odd_docs)).collect()
    assert len(got) == odd_docs.count() and all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mixed(no_docs).count() == 0
    out = mixing.stage(spark, odd_docs, "")
    assert out.columns == odd_docs.columns and mixing.stage(spark, no_docs, "").count() == 0
    assert out.where("text is null or trim(text) = ''").count() >= 2


def test_quotas_beyond_the_generator_are_drawn_too(monkeypatch):
    quotas, sizes = np.array([5 * 10**9, 0, 3, 2 * 10**9 + 1, 999]), np.array([1750001001, 1750000000, 1750000002, 1750000000])
    parts = mixing.split_quotas(quotas, sizes, [7])
    assert (parts.sum(0) == quotas).all() and (parts.sum(1) == sizes).all() and (parts >= 0).all()
    exact = quotas[3] * sizes / sizes.sum()
    off = parts[:, 3] - exact
    assert (off != np.floor(off)).any() and 100 < np.abs(off).max() < 10**6  # drawn, not dealt in proportion
    few = mixing.split_quotas(np.array([40, 7, 0, 25]), np.array([30, 42]), [1])
    monkeypatch.setattr(mixing, "MOST_DRAWN", 20)
    many = mixing.split_quotas(np.array([40, 7, 0, 25]), np.array([30, 42]), [1])
    assert (few.sum(0) == many.sum(0)).all() and (many.sum(1) == [30, 42]).all() and (many >= 0).all()


def test_language_equals_a_plain_loop_over_dictionaries(spark, folder):
    import zstandard

    rng = random.Random(9)
    rows = [(k, speech(rng, EN if k % 2 else FR, rng.randrange(60, 4000)), "en" if k % 2 else "fr") for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(language_id.trained_on(docs))
    got = {r["doc_id"]: r for r in language_id.query(spark, folder(documents=docs)).collect()}
    for k, text, _ in rows:
        sizes = {}
        for name, raw in model.items():
            how = zstandard.ZstdCompressionParameters.from_level(language_id.LEVEL, min_match=language_id.MIN_MATCH, write_checksum=0, write_content_size=0, write_dict_id=0)
            zip_ = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)
            data = text.lower().encode()
            sizes[name] = sum(len(zip_.compress(data[i : i + 8192])) for i in range(0, len(data), 8192))
        (a, first), (b, _) = sorted((n, name) for name, n in sizes.items())
        assert got[k]["lang_pred"] == first and got[k]["score"] == pytest.approx(1 - a / b) and got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1)


def test_queries_on_empty_tables(spark, no_docs, folder):
    at = folder(documents=no_docs, labels=spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.query(spark, at).count() == 0 and language_id.query(spark, at).count() == 0 and mixing.query(spark, at).count() == 0
