import random

import numpy as np

import corpus_pipeline
from wattloom.llm import mixing, pieces
from test_learned import EN, FR, plain_targets, speech
from test_ngram_join import brute_force


def test_all_stages_on_a_small_corpus(spark, folder):
    rng = random.Random(11)
    base = [speech(rng, EN if k % 2 else FR, rng.randrange(20, 60)) for k in range(60)]
    rows = [(k, f"{t} write to u{k}@mail.org soon" if k % 5 == 0 else t, "en" if k % 2 else "fr", "abc"[k % 3]) for k, t in enumerate(base)]
    rows += [(100 + k, base[k] + " again", "en" if k % 2 else "fr", "a") for k in range(1, 30, 4)]  # near copies
    rows += [(200, "12 34 !?", "en", "a"), (201, None, "fr", "b"), (202, "", None, None)]  # no letter
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.run(spark, folder(documents=docs)).collect()
    letters = [(d, t) for d, t, *_ in rows if t and any(c.isalpha() for c in t)]
    kept = {d for d, _, root in brute_force(letters) if d == root}
    assert {r["doc_id"] for r in out} <= kept
    coder, text, source = pieces.coder(pieces.model_path()), {r[0]: r[1] for r in rows}, {r[0]: r[3] for r in rows}
    for r in out:
        found = coder.decode(np.array(r["token_ids"]))
        assert found == text[r["doc_id"]].replace(f"u{r['doc_id']}@mail.org", "[EMAIL]")
    words = {d: len(text[d].split()) for d in kept}
    sources = sorted({source[d] for d in kept})
    goal = plain_targets([sum(words[d] for d in kept if source[d] == s) for s in sources], [5, 2, 1])
    for s, want in zip(sources, goal, strict=True):
        assert abs(sum(words[r["doc_id"]] for r in out if source[r["doc_id"]] == s) - want) <= max(words.values())
    assert max(sum(r["doc_id"] == d for r in out) for d in kept) <= mixing.MAX_PASSES


def test_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert "token_ids" in out.columns and (out.count() == 0) == (name == "none")
