"""Encoding, decoding and counts against the libraries."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from reviewshift.llm import bpe, queries, token_counts
from tests.conftest import SF_SMALL

BPE, PIECE = (str(public_tokenizers.path(f)) for f in (queries.BPE_FILE, queries.PIECE_FILE))
LETTERS = [chr(c) for c in [*range(0x300), *range(0x370, 0x500), 0x2028, 0x202F, 0x3000, 0x4E00, 0x1F600, 0x660, 0x2160, 0x2581]]


def odd_texts():
    rng = random.Random(5)
    return ["", " ", "  a", "it's we'LL I'm", "<|endoftext|>x<|endoftext|>", "aaaaaaa", "\n\n a\n", "é" * 30,
            "".join(rng.choices("abcdefgh", k=20_000)), *("".join(rng.choices(LETTERS, k=50)) for _ in range(500))]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(BPE)


def test_ids_and_round_trip_equal_the_library(library):
    own, texts = bpe.ByteBpe(BPE), odd_texts()
    flat, sizes = own.encode(texts)
    parts = np.split(flat, np.cumsum(sizes)[:-1])
    for text, ids in zip(texts, parts):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_cache_is_emptied(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    own = bpe.ByteBpe(BPE)
    for _ in range(3):
        flat, _ = own.encode(["one two three four five six seven"])
        assert flat.tolist() == library.encode("one two three four five six seven").ids


def test_query_equals_the_library(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = queries.op3_bpe(spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        back = library.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_awkward_rows(spark, awkward, empty, library):
    rows = bpe.add_tokens(awkward, BPE, decoded="back").collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert r["ids"] == library.encode(r["text"] or "").ids and r["back"] == (r["text"] or "")
    assert bpe.add_tokens(empty, BPE, digests=True).count() == 0


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


def test_piece_counts_equal_the_library(pieces):
    own = token_counts.PieceCounter(PIECE)
    for text in [*odd_texts(), "▁▁ x▁y", "<s> a </s> <unk>", "\0a\0"]:
        words = own.pre_tokens(text)
        assert int(own.count(words).sum() if words else 0) == len(pieces.encode(text))


def test_count_query_equals_the_library(spark, pieces):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = queries.op4_token_counts(spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(pieces.encode(docs[r["doc_id"]]))
        assert tuple(r) == (r["doc_id"], len(docs[r["doc_id"]].encode()), n, n > 4096)


def test_counts_of_awkward_rows(spark, awkward, empty, pieces, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_DOCS", 4)  # several blocks a task
    got = sorted(map(tuple, token_counts.count_tokens(awkward, PIECE).collect()), key=str)
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), len(pieces.encode(r["text"] or "")))
                   for r in awkward.collect()), key=str)
    assert got == want
    assert token_counts.count_tokens(empty, PIECE).count() == 0


def test_counts_by_ids_of_any_type(spark, pieces):
    texts = ["one two two", "", "three"]
    df = spark.createDataFrame([(f"id{i}", t) for i, t in enumerate(texts)], "name string, body string")
    got = {tuple(r) for r in token_counts.count_tokens(df, PIECE, "name", "body").collect()}
    assert got == {(f"id{i}", len(t), len(pieces.encode(t))) for i, t in enumerate(texts)}


def test_order_by_word_and_times_beyond_63_bits():
    rng = np.random.default_rng(1)
    for scale in (1, 1 << 40):
        word, place, times = rng.integers(0, 9, 200) * scale, rng.integers(0, 50, 200), rng.integers(1, 4, 200) * min(scale, 1 << 20)
        order = np.lexsort((place, times, word))
        got = token_counts._by_word_and_times(word, place, times, 50)
        assert all((a == b[order]).all() for a, b in zip(got, (word, place, times)))


def test_frequent_pre_tokens_have_a_salt_for_each_task(spark):
    df = spark.createDataFrame([(i, "the same words") for i in range(80)], "doc_id long, text string").repartition(8)
    rows = token_counts.frequencies(df, PIECE).filter("n_bytes is null").select("piece", "salt", "block").distinct().collect()
    blocks = {r["block"] for r in rows}
    assert len(blocks) == 8 and all(len({r["salt"] for r in rows if r["piece"] == p}) == 8 for p in {r["piece"] for r in rows})
