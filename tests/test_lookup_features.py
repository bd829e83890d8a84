"""Unit tests: token lookups as joins, TF-IDF, early stopping, inline Indonesian rows."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from reviewshift.functions import text as tx
from reviewshift.operators import features, lookup, metrics


@pytest.fixture(scope="module")
def toks(spark):
    df = spark.createDataFrame([(1, "brg bgt ok cod"), (2, "kurir lemot gk"), (3, "")], "review_id long, t string")
    return lookup.token_positions(df, ["review_id"], "t")


def test_token_positions(toks):
    rows = sorted((r.review_id, r.pos, r.token) for r in toks.collect())
    assert rows[:4] == [(1, 1, "brg"), (1, 2, "bgt"), (1, 3, "ok"), (1, 4, "cod")]
    assert len(rows) == 7


def test_lexicon_join_whitelist_and_deletion(spark, toks):
    lex = lookup.lexicon_table(spark, {"bgt": "banget", "gk": "tidak", "cod": "bayar", "wkwk": ""}, ("cod",))
    got = {(r.review_id, r.pos): (r.normalized, r.in_lexicon) for r in lookup.lexicon_join(toks, lex).collect()}
    assert got[(1, 2)] == ("banget", True)
    assert got[(1, 4)] == ("cod", False)        # whitelisted: removed from the lookup table
    assert got[(2, 3)] == ("tidak", True)
    assert got[(1, 1)] == ("brg", False)


def test_semi_and_anti_joins(spark, toks):
    wl = lookup.word_table(spark, ["cod", "kurir", "lemot"])
    semi = sorted(r.token for r in lookup.whitelist_semi(toks, wl).collect())
    anti = sorted(r.token for r in lookup.stopword_anti(toks, wl).collect())
    assert semi == ["cod", "kurir", "lemot"]
    assert anti == ["bgt", "brg", "gk", "ok"]


def test_attention_mask(spark):
    df = spark.createDataFrame([("a b c",), ("",)], "review_text_clean string")
    rows = lookup.attention_mask(df, [], max_len=5).collect()
    assert [list(r.attention_mask) for r in rows] == [[1, 1, 1, 0, 0], [0, 0, 0, 0, 0]]
    assert [r.n_tokens for r in rows] == [3, 0]


def test_terms_unigrams_then_bigrams(spark):
    df = spark.createDataFrame([("a b c",), ("x",), ("",)], "t string")
    got = [list(r.terms) for r in features.with_terms(df, "t", []).collect()]
    assert got == [["a", "b", "c", "a b", "b c"], ["x"], []]


def test_tfidf_matches_hand_computation(spark):
    train = spark.createDataFrame([(1, "a b"), (2, "a c")], "row_seq long, review_text_clean string") \
        .withColumn("k", F.lit("m"))
    vocab = features.tfidf_fit(train, ["k"], ["row_seq"], max_features=3)
    v = {r["term"]: (r["index"], r["idf"]) for r in vocab.collect()}
    assert set(v) == {"a", "a b", "a c"}           # top 3 by count, ties by term
    assert v["a"][0] == 0 and abs(v["a"][1] - 1.0) < 1e-12
    out = {(r.row_seq, r.term): r.tfidf for r in features.tfidf_transform(train, vocab, ["k"], ["row_seq"]).collect()}
    idf2 = math.log(3 / 2) + 1
    assert abs(out[(1, "a")] - 1 / math.sqrt(1 + idf2 ** 2)) < 1e-12
    assert abs(out[(1, "a b")] - idf2 / math.sqrt(1 + idf2 ** 2)) < 1e-12


def test_best_round_early_stopping(spark):
    f1 = [0.5, 0.6, 0.6, 0.55, 0.59, 0.7, 0.8]       # stops after round 5 (3 rounds without gain)
    df = spark.createDataFrame([("m", i + 1, float(i), v) for i, v in enumerate(f1)],
                               "k string, round int, alpha double, f1_macro double")
    r = metrics.best_round(df, ["k"]).first()
    assert (r.best_round, r.best_alpha, r.best_f1_macro, r.rounds_run, r.early_stopped) == (2, 1.0, 0.6, 5, True)
    r2 = metrics.best_round(df.filter("round <= 3"), ["k"]).first()
    assert (r2.best_round, r2.rounds_run, r2.early_stopped) == (2, 3, False)


FIXTURE_ROWS = [   # inline unit rows (stop words = identity)
    ("barang rusak pas nyampe, penjual ga respon sama sekali", True,
     "barang rusak pas nyampe, penjual tidak respon dengan sekali"),
    ("mantaaap bgt!!! wkwk", True, "mantap bgt!"),
    ("mantaaap bgt !!! wkwk", True, "mantap banget !"),
    ("mantaaap bgt !!! wkwk", False, "mantap bgt ! wkwk"),
    ("jnt cod kirim 10000", True, "j t cod kirim 10"),
]


@pytest.mark.parametrize("raw,norm,want", FIXTURE_ROWS)
def test_inline_fixture_rows(spark, raw, norm, want):
    df = spark.createDataFrame([(raw,)], "s string")
    assert df.select(tx.clean_text("s", use_normalization=norm)).first()[0] == want


def test_rejected_inputs(spark):
    df = spark.createDataFrame([("12345",), ("ok",), (None,), ("mantap sekali",)], "s string")
    assert [r[0] for r in df.select(tx.clean_pipeline("s")).collect()] == [None] * 4
