"""Vocabulary sketches against exact counts, the keyword automaton against plain search."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewshift.operators import keywords, shift, sketches

SCHEMA = "source_platform string, review_text string"


def _texts(rng, words, n, size):
    return [" ".join(rng.choices(words, k=size)) for _ in range(n)]


@pytest.mark.parametrize("lg_k, exact", [(16, True), (9, False)])
def test_sketched_rates_lie_within_their_bounds(spark, lg_k, exact):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(6000)]
    rows = [("tokopedia", t) for t in _texts(rng, words[:4000], 300, 40)]
    rows += [("shopee", t) for t in _texts(rng, words[2500:], 200, 40)] + [("empty", "  "), ("shopee", None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = {(r["source"], r["target"]): r for r in shift.vocab_oov_rate(df).collect()}
    parts = [sketches.vocab_sketches(df.filter(F.pmod(F.xxhash64("review_text"), F.lit(3)) == k), lg_k=lg_k) for k in range(3)]
    whole = sketches.vocab_sketches(df, lg_k=lg_k)
    for made in (whole, sketches.merge_sketches(parts, lg_k=lg_k)):
        got = {(r["source"], r["target"]): r for r in sketches.overlap(made, lg_k=lg_k).collect()}
        assert want.keys() <= got.keys()
        for k, r in want.items():
            assert abs(got[k]["oov_type_rate"] - r["oov_type_rate"]) <= got[k]["rate_error"] + 1e-6
            assert (got[k]["rate_error"] == 0) == exact
            if exact:
                assert (got[k]["n_types"], got[k]["n_oov_types"]) == (r["n_types"], r["n_oov_types"])


def plain_hits(texts, words):
    out = Counter()
    for i, t in texts:
        low = (t or "").lower()
        for w in words:
            at = low.find(w)
            while at >= 0:
                out[i, w] += 1
                at = low.find(w, at + 1)
    return out


@pytest.mark.parametrize("max_keywords", [keywords.MAX_KEYWORDS, 40])  # 40: several parts
def test_keywords_that_overlap(spark, max_keywords):
    rng = random.Random(2)
    draw = lambda k: "".join(rng.choices("abé ", k=rng.randint(1, k)))
    words = sorted({draw(4) for _ in range(120)})
    texts = [(i, "".join(rng.choices("ABaabé \U0001f600", k=60))) for i in range(50)] + [(50, None), (51, "")]
    df = spark.createDataFrame(texts, "id int, review_text string")
    kw = spark.createDataFrame([(w,) for w in [*words, words[0], None, ""]], "keyword string")
    got = {(r["id"], r["keyword"]): r["n"] for r in keywords.keyword_hits(df, kw, ["id"], max_keywords=max_keywords).collect()}
    assert got == plain_hits(texts, words)
    assert keywords.keyword_hits(df, kw.limit(0), ["id"]).count() == 0


def test_ten_thousand_keywords(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abcdefgh", k=rng.randint(3, 6))) for _ in range(16_000)})[:10_000]
    texts = [(i, "".join(rng.choices("abcdefgh", k=2000)), i % 5 + 1) for i in range(40)] + [(40, "zzz", 3), (41, None, 4), (42, "zz", 1)]
    df = spark.createDataFrame(texts, "id int, review_text string, rating int")
    kw = spark.createDataFrame([(w,) for w in words], "keyword string")
    want = plain_hits([t[:2] for t in texts], words)
    got = {(r["id"], r["keyword"]): r["n"] for r in keywords.keyword_hits(df, kw, ["id"]).collect()}
    assert got == want and len(words) == 10_000
    labels = {r["id"]: (r["label"], r["n_keywords"]) for r in keywords.label_by_table(df, kw, ["id"]).collect()}
    assert labels[40] == ("Netral", 0) and labels[41] == ("Positif", 0) and labels[42] == ("Negatif", 0)
    assert all(labels[i] == ("Negatif", len({w for j, w in want if j == i})) for i in range(40))
