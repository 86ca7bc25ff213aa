from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as s

from evalframe.llm import bpe, common, queries

RANKS = bpe.load_ranks(queries.RANKS)
CODEC = bpe.Codec(RANKS, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(s.text(max_size=200))
def test_ids_as_the_library_gives_them(text):
    ids = next(CODEC.encode([text]), None)
    got = [] if ids is None else ids.tolist()
    assert got == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(bpe.np.array(got, dtype="<u4")) == text.encode()


@pytest.mark.parametrize("text", ["a" * 255, "a" * 256, "a" * 257, "ab" * 3000, "é" * 1000, "☃" * 500 + "x" * 700, "<|endoftext|>", "\n" * 400, "日本語" * 300])
def test_long_pieces(text):
    assert next(CODEC.encode([text])).tolist() == LIBRARY.encode_ordinary(text)


def test_remembered_pieces_may_be_forgotten(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    texts = [f"some words of text number {i} and more" for i in range(50)]
    monkeypatch.setattr(bpe, "_groups", lambda texts: iter([[t] for t in texts]))
    assert [x.tolist() for x in codec.encode(texts)] == [LIBRARY.encode_ordinary(t) for t in texts]


def test_every_pair_is_found():
    table = CODEC.table
    keys = bpe.np.array(list(table.pairs), dtype=bpe.np.int64)
    assert (table.merges(keys >> 32, keys & 0xFFFFFFFF) == bpe.np.array(list(table.pairs.values()))).all()
    assert table.merges(bpe.np.array([-1, 5]), bpe.np.array([5, -1])).tolist() == [bpe.NONE, bpe.NONE]


def test_whole_table(spark, middle):
    docs = common.read(spark, middle, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    got = queries.op5_bpe(spark, middle).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(bpe.np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
