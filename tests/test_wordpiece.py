"""The sub-word matcher against a greedy walk."""

from __future__ import annotations

import random
import time

import pytest

from reviewshift.operators import shift, wordpiece as wp
from tests.test_verdict_r1 import _greedy


def frames(spark, words, vocab):
    return (spark.createDataFrame([(w,) for w in words], "word string"),
            spark.createDataFrame([(v,) for v in vocab], "piece string"))


def random_case(rng):
    letters = "ab#é"[:rng.randint(2, 4)]
    draw = lambda k: "".join(rng.choices(letters, k=rng.randint(1, k)))
    vocab = {draw(5) for _ in range(rng.randint(0, 8))} | {"##" + draw(5) for _ in range(rng.randint(0, 10))}
    return sorted({draw(14) for _ in range(30)}), vocab


def test_trie_equals_a_greedy_walk():
    rng = random.Random(1)
    for _ in range(400):
        words, vocab = random_case(rng)
        got = wp.PieceTrie.of(iter(vocab)).counts(words)
        assert [max(n, 1) for n in got.tolist()] == [_greedy(w, vocab, 10 ** 6) for w in words]


@pytest.mark.parametrize("max_pieces", [wp.MAX_PIECES, 3])  # 3: by joins
@pytest.mark.parametrize("max_chars", [None, 6])
def test_both_ways_agree(spark, max_pieces, max_chars):
    words, vocab = random_case(random.Random(7))
    words += ["", "a" * 300]
    got = wp.wordpiece_counts(*frames(spark, words, vocab | {"a", "##a", "##aa"}), max_chars, max_pieces).collect()
    assert {r.word: r.n_pieces for r in got} == {w: _greedy(w, vocab | {"a", "##a", "##aa"}, max_chars or 10 ** 6) for w in words}


def test_null_words_and_empty_vocabulary(spark):
    got = wp.wordpiece_counts(*frames(spark, [None, "", "ab"], [])).collect()
    assert sorted([(r.word, r.n_pieces) for r in got], key=str) == [("", 1), ("ab", 1), (None, 1)]


def test_time_is_linear_in_the_word():
    trie = wp.PieceTrie.of(iter(["a", "##a", "##" + "a" * 50 + "b"]))  # every letter ends in a long near miss
    def took(n):
        t = time.perf_counter()
        assert trie.counts(["a" * n])[0] == n
        return time.perf_counter() - t
    took(1000)
    assert took(40_000) < 8 * max(took(10_000), 0.05)


def test_published_vocabulary_file(spark, tmp_path):
    path = tmp_path / "vocab.txt"
    path.write_text("[UNK]\nbarang\n##nya\nba\n\n##rang\n", encoding="utf-8")
    vocab = wp.read_piece_vocab(spark, str(path))
    assert sorted(map(tuple, vocab.collect())) == [("##nya", 2), ("##rang", 5), ("[UNK]", 0), ("ba", 3), ("barang", 1)]
    df = spark.createDataFrame([(1, "Barangnya barang!"), (2, None), (3, "")], "id int, review_text string")
    got = {r["id"]: (r["n_words"], r["n_pieces"]) for r in shift.fragmentation_ratio(df, vocab, ["id"]).collect()}
    assert got[1] == (2, 4) and got[3] == (0, 0)
