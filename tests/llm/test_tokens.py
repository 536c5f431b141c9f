import hashlib
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wattloom.llm import pieces, token_files

TEXT = st.text(st.one_of(st.sampled_from(" \n\tabtheing1'▁é中—😀#$\x1c\x85　²ª"), st.characters(exclude_categories=["Cs"])), max_size=60)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_pieces_equal_the_library(text):
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    c = pieces.coder(pieces.model_path())
    ids = c.encode(text)
    assert ids.tolist() == lib.encode(text, add_bos=True, add_eos=True)
    assert c.decode(ids) == lib.decode(ids.tolist())


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_units_equal_the_library(texts):
    w = token_files.words(token_files.tokenizer_path())
    got = [np.frombuffer(w.encode(x), w.dtype).tolist() for x in texts]
    assert got == [e.ids + [0] for e in w.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_piece_query(spark, odd_docs, no_docs, library, folder):
    rows = pieces.query(spark, folder(documents=odd_docs)).collect()
    texts = [r["text"] for r in odd_docs.collect()]
    want = []
    for t in texts:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(tuple(r[1:]) for r in rows) == sorted(want)
    out = pieces.stage(spark, odd_docs, "")
    assert "token_ids" in out.columns and out.count() == odd_docs.count() and pieces.stage(spark, no_docs, "").count() == 0


def test_token_files(spark, odd_docs, no_docs, folder, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 2000)
    tokenizer = Tokenizer.from_file(token_files.tokenizer_path())
    files, dictionary = token_files.write_files(odd_docs, token_files.tokenizer_path())
    rows = sorted((tuple(r) for r in token_files.read_files(files, dictionary).collect()), key=lambda r: r[1])
    ids = [r[0] for r in rows]
    assert ids == sorted(ids, key=lambda d: (d is not None, d)) and files.count() > 2
    assert [r[1] for r in rows] == [sum(x[2] for x in rows[:k]) for k in range(len(rows))]
    want = sorted((str(r["doc_id"]), len(e := [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]), zlib.crc32(np.array(e, "<u4").tobytes())) for r in odd_docs.collect())
    assert sorted((str(r[0]), r[2], r[3]) for r in rows) == want
    blob = files.first()["file"]
    one = token_files.TokenFile(bytes(blob), dictionary)
    assert len(one.document(0)) == one.index["n"][0]
    with pytest.raises(ValueError):
        token_files.TokenFile(bytes(blob), dictionary + b"x")
    assert token_files.query(spark, folder(documents=no_docs)).count() == 0


def test_a_word_is_encoded_once_with_and_without_marks(monkeypatch):
    coder = token_files.Words(token_files.tokenizer_path())
    seen, alone = [], coder.alone
    monkeypatch.setattr(coder, "alone", lambda unit: seen.append(unit) or alone(unit))
    text = "a zebra zebra, zebra.\nZebra zebra?! überté überté, x\n\ny zebra\n"
    ids = np.frombuffer(coder.encode(text), coder.dtype).tolist()
    assert ids == [*coder.tokenizer.encode(text, add_special_tokens=False).ids, 0]
    assert seen.count(" zebra") == 1 and seen.count(" überté") == 1
