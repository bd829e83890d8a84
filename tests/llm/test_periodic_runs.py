"""Periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from reviewshift.llm import periodic_runs as pr
from reviewshift.llm import queries
from tests.conftest import SF_CHECK


def brute_runs(words, exponent=4, least=6):
    """Every maximal stretch of each period, word by word, without those of a smaller period."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            size = i + q - s
            if size >= max(least, exponent * q) and not any(
                    all(words[x] == words[x + d] for x in range(s, s + size - d)) for d in range(1, q)):
                out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def expected(words, exponent=4, least=6):
    runs = brute_runs(words, exponent, least)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept(words, runs)))


def odd_words(rng):
    out = []
    while len(out) < rng.randint(0, 70):
        unit = rng.choices("abcd"[:rng.randint(1, 4)], k=rng.randint(1, 11))
        out += unit * rng.choice([1, 1, 2, 4, 5, 9])
        out = out[:len(out) - rng.randint(0, min(3, len(out)))]
    return out


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        texts = [odd_words(rng) for _ in range(rng.randint(1, 6))]
        got = pr.runs_of_texts(texts)
        assert [list(map(tuple, r.tolist())) for r in got] == [brute_runs(t) for t in texts]
        assert [pr.collapsed(t, r) for t, r in zip(texts, got)] == [kept(t, map(tuple, r.tolist())) for t, r in zip(texts, got)]


def test_other_exponents():
    rng = random.Random(2)
    for _ in range(100):
        words = odd_words(rng)
        got = pr.runs_of_texts([words], min_exponent=5, min_length=12)[0]
        assert list(map(tuple, got.tolist())) == brute_runs(words, 5, 12)


def test_wavelet_tree_equals_sorting():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 64, 65, 1000):
        values = rng.permutation(n).astype(np.int32)
        tree = pr.WaveletTree(values)
        lo = rng.integers(0, n, 200)
        hi = lo + 1 + rng.integers(0, n - lo)
        x = values[lo + rng.integers(0, hi - lo)]
        after, before = tree.beside(lo, hi, x)
        for a, b, own, up, down in zip(lo, hi, x, after, before):
            part = np.sort(values[a:b])
            k = int(np.searchsorted(part, own))
            assert up == (part[k + 1] if k + 1 < len(part) else own) and down == (part[k - 1] if k else own)


def test_long_runs_and_equal_texts():
    rng = random.Random(4)
    unit = rng.choices([str(i) for i in range(300)], k=777)
    words = ["x"] + unit * 40 + unit[:5] + ["y"]
    texts = [words, words, ["a"] * 50_000, [str(i) for i in range(5000)] * 3]
    assert [list(map(tuple, r.tolist())) for r in pr.runs_of_texts(texts)] == [
        [(1, 777 * 40 + 5, 777)], [(1, 777 * 40 + 5, 777)], [(0, 50_000, 1)], []]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, SF_CHECK).collect()}
    assert len(got) == len(docs)
    looped = 0
    for r in docs:
        words = pr.words_of(r["text"] or "")
        n, h = len(words), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            looped += 1
        if n <= 1500:
            assert got[r["doc_id"]] == expected(words)
    assert looped > 50


def test_awkward_rows(spark, awkward, empty):
    rows = pr.add_runs(awkward, digests=True).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        words = pr.words_of(r["text"] or "")
        assert r["score"] == "s" and [tuple(x) for x in r["runs"]] == (
            [(0, 30_000, 1)] if len(words) == 30_000 else brute_runs(words))
        assert r["collapsed"] == kept(words, r["runs"])
    assert pr.add_runs(empty).count() == 0
    with pytest.raises(ValueError):
        pr.add_runs(empty, min_exponent=3)


def test_looped_texts_of_few_words(spark):
    rows = spark.createDataFrame([("a",), (" a\tb ",), ("a b c d e f g",)], "text string")
    from pyspark.sql import functions as F
    got = rows.select(pr.looped(F.col("text"), lambda n: n - n, lambda n: F.lit(2))).collect()
    assert [r[0] for r in got] == ["a", "a b", "a b a b a b a"]


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "a a a a a a a", "x", "y")], "doc_id long, text string, Start string, `a.b` string")
    row = pr.add_runs(df).first()
    assert row["start"] == 0 and row["a.b"] == "y" and row["collapsed"] == "a"
