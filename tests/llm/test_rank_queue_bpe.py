"""Rank-queue BPE against the library, also with rank files that no training gives."""

from __future__ import annotations

import base64
import hashlib
import random
import time

import public_tokenizers
import pytest
import tiktoken

from reviewshift.llm import queries, rank_queue_bpe as rq
from tests.conftest import SF_SMALL
from tests.llm.test_bpe import odd_texts

FILE = str(public_tokenizers.path(queries.RANK_FILE))


def library_of(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    with open(FILE, "rb") as f:
        return library_of({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def test_ids_and_round_trip_equal_the_library(library):
    own = rq.vocabulary(FILE)
    texts = [*odd_texts(), "日本語のテキスト" * 40, "x\x1cy\x85z", "नमस्ते दुनिया", "a" * 3000, "ab" * 1500]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()
        assert own.written(ids) == ",".join(map(str, ids))


def test_any_order_of_ranks():
    """New pairs may rank below those that wait, and a whole pre-token may be out of its merges' reach."""
    rng = random.Random(3)
    for _ in range(150):
        pieces = {bytes(rng.choices(b"abc", k=rng.randint(2, 6))) for _ in range(rng.randint(1, 40))}
        order = [bytes([b]) for b in range(256)] + sorted(pieces)
        rng.shuffle(order)
        ranks = {p: r for r, p in enumerate(order)}
        own, library = rq.RankedBpe(ranks), library_of(ranks)
        words = ["".join(rng.choices("abc", k=rng.choice([1, 2, 5, 12, 40, 700]))) for _ in range(20)]
        assert list(own.encode(words)) == [library.encode_ordinary(w) for w in words]


def test_queue_gives_the_lowest_rank():
    rng = random.Random(4)
    queue, held = rq.RankQueue(300_000), {}
    for _ in range(3000):
        if held and rng.random() < 0.45:
            low = min(held)
            assert queue.pop() == (low, sorted(held.pop(low)))
        else:
            r, p = rng.randrange(300_000) if rng.random() < 0.7 else rng.randrange(70), rng.randrange(1000)
            if r in held:
                queue.bucket[r].append(p)
            else:
                queue.open(r, [p])
            held.setdefault(r, []).append(p)
    assert rq.RankQueue(1).pop() is None and rq.RankQueue(0).pop() is None


def test_very_long_pre_tokens_take_time_in_proportion():
    own, rng = rq.vocabulary(FILE), random.Random(5)
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=400_000))
    def took(w):
        t = time.perf_counter()
        own.merged([w.encode()])
        return time.perf_counter() - t
    took(word[:50_000])
    assert took(word) < 8 * max(took(word[:100_000]), 0.05)  # four times the letters


def test_cache_is_emptied_and_keeps_no_long_words(library, monkeypatch):
    monkeypatch.setattr(rq, "CACHE_WORDS", 3)
    own = rq.RankedBpe(rq.vocabulary(FILE).ranks)
    for _ in range(3):
        text = "one two three four five " + "q" * 500
        assert list(own.encode([text])) == [library.encode_ordinary(text)]
        assert max(map(len, own.known)) <= rq.CACHED_CHARS


def test_query_equals_the_library(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = queries.op13_rank_queue_bpe(spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode_bytes(ids)).hexdigest()


def test_awkward_rows(spark, awkward, empty, library):
    rows = rq.add_tokens(awkward, FILE, decoded="back", digests=True).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert r["ids"] == library.encode_ordinary(r["text"] or "") and bytes(r["back"]) == (r["text"] or "").encode()
        assert r["n_tokens"] == len(r["ids"]) and r["score"] == "s"
    assert rq.add_tokens(empty, FILE, digests=True).count() == 0
