import random
import re

import numpy as np
import pytest

from wattloom.llm import common, ngram_join, shingles


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_force(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    lowest = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            lowest[find(k)] = min(lowest.get(find(k), d), d)
    return sorted(((d, len(sets[k]), lowest.get(find(k))) for k, (d, _) in enumerate(rows)), key=str)


def found(df):
    return sorted((tuple(r) for r in ngram_join.linked(df).collect()), key=str)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert found(odd_docs) == brute_force(rows)
    assert found(no_docs) == []


@pytest.mark.parametrize("frequent", [0, 200_000])
def test_near_copies_at_the_threshold(spark, monkeypatch, frequent):
    monkeypatch.setattr(ngram_join, "MAX_FREQUENT", max(frequent, 1))
    monkeypatch.setattr(ngram_join, "BITS_BLOCK", 600)
    monkeypatch.setattr(ngram_join, "SETS_BLOCK", 400)
    monkeypatch.setattr(ngram_join, "HOT", 4)
    monkeypatch.setattr(ngram_join, "MIN_HASHES", 1)  # leaves links to the trees
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(25)]
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 5, 12, 40, 90]))]
        if rng.random() < 0.5:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(3000)}"
            texts.append(" ".join(copy[rng.randrange(0, 3) :]))
    rng.shuffle(texts)
    rows = [(k * 3 + 1, t) for k, t in enumerate(texts)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute_force(rows)


def test_shingles_count_distinct_runs():
    texts = ["a b c d e f", "", None, "A  b\tC d", "x " * 50, "\x0ba\x1cb c"]
    sizes = [n for _, _, at in shingles.sets(texts) for n in np.diff(at)]
    assert sizes == [len(shingle_set(t)) for t in texts]


@pytest.mark.parametrize("bottom", [1, 5, 32])
def test_the_tree_loses_no_pair(monkeypatch, bottom):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: rng.integers(40, 400)], rng.integers(0, 1 << 63, rng.integers(0, 60)).astype(np.uint64)])) for _ in range(60)]
    monkeypatch.setattr(ngram_join, "BOTTOM", bottom)
    monkeypatch.setattr(ngram_join, "PAIR_BYTES", 1000)
    top = ngram_join.tree([(k, len(s), ngram_join.bitmap(s), k) for k, s in enumerate(sets)])
    got = {tuple(sorted(p)) for p in ngram_join.candidates(top, top)}
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    assert want and want <= got and len(got) < 60 * 59 // 2


def test_stage_keeps_one_of_each_group(spark, odd_docs):
    kept = ngram_join.stage(spark, odd_docs, "").collect()
    ids = [r["doc_id"] for r in kept]
    assert set(odd_docs.columns) == set(kept[0].asDict()) and ids.count(None) == 1
    assert 6 in ids and 7 not in ids and 8 not in ids and len(ids) == len(set(ids))


def test_only_few_texts_are_shuffled(spark):
    rows = [(k, f"w{k} " * 3 + "text") for k in range(400)]
    docs = ngram_join.placed(spark.createDataFrame(rows, "doc_id long, text string"))
    maybe, sure = ngram_join.parted(docs, docs.where("doc_id < 10").select(ngram_join.PLACE))
    assert sorted(r["doc_id"] for r in maybe.unionByName(sure).collect()) == list(range(400))
    assert set(range(10)) <= {r["doc_id"] for r in maybe.collect()} and maybe.count() < 20
    everything, nothing = ngram_join.parted(docs, docs.select(ngram_join.PLACE))
    assert (everything.count(), nothing.count()) == (400, 0)
    none, all_ = ngram_join.parted(docs, docs.where("doc_id < 0").select(ngram_join.PLACE))
    assert (none.count(), all_.count()) == (0, 400)


def test_a_small_group_meets_at_once(spark):
    members = spark.createDataFrame([(1, c, c // 2, 10) for c in range(6)] + [(2, c, c // 300, 10) for c in range(600)], 'group long, class long, component long, n long')
    met = ngram_join.dealt(members, 1000)
    assert met.where("group = 1").count() == 6
    pairs = met.where("group = 2").alias("x").join(met.where("group = 2").alias("y"), ngram_join.KEYS).where("x.component < y.component")
    assert pairs.select("x.class", "y.class").distinct().count() == 300 * 300


def test_a_worker_keeps_what_one_operator_remembers():
    gone = []
    common.worker_of("a", lambda: gone.append("a"))
    common.worker_of("a", lambda: gone.append("a"))
    assert gone == []
    common.worker_of("b")
    common.worker_of("b")
    assert gone == ["a"]
