"""Tests of FINDINGS_r03: tokens and terms counted where the texts lie, scoring once, tests without splitting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from conftest import SF_SMALL
from reviewshift.functions import label as lb
from reviewshift.functions import lexicon as lx
from reviewshift.functions import text as tx
from reviewshift.operators import model, vocab
from reviewshift.plans import catalog

TEXTS = ["a b a", " b\u3000b\x1cc\x85 ", "", None, "\u2003", "c\u200bd é a", "a" * 50 + " a\n\na"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_token_counts_are_added_up_in_place(spark):
    rows = [(g, i % 4 - 1 if i % 5 else None, t) for i, t in enumerate(TEXTS * 5) for g in ("x", None)]
    df = spark.createDataFrame(rows, "g string, c int, review_text_clean string")
    got = vocab.token_counts(df, ["g"], out=["n0", "n1"], by="c")
    old = df.select("g", "c", F.explode(tx.tokens("review_text_clean")).alias("token")).groupBy("g", "token").agg(
        *[F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(2)])
    assert got.exceptAll(old).count() == old.exceptAll(got).count() == 0 < got.count()
    assert "explode" not in _plan(got).lower()
    labelled = df.select("g", F.lit("Positif").alias("sentiment_label"), "review_text_clean")
    assert "explode" not in _plan(model.nb_token_counts(labelled, ("g",))).lower()
    assert _plan(vocab.build_vocab(df, ["g"])).lower().count("explode") == 1  # the two special tokens


def test_text_tokens_of_each_row_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(vocab, "PIECE_BYTES", 50)  # several slices a batch
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, review_text_clean string").coalesce(1)
    got = vocab.text_tokens(df, ["id"])
    old = df.select("id", F.explode(tx.tokens("review_text_clean")).alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("cnt"))
    assert got.exceptAll(old).count() == old.exceptAll(got).count() == 0 < got.count()
    assert "Exchange" not in _plan(got)


def test_has_tokens_and_is_meaningful_equal_the_long_way(spark):
    emoji = ["😀ab😀", "a😀😀😀", " ❤a b ", "12 34", "١٢٣٤٥", "1234567\n", "a    b", "😀😀😀😀😀😀", "ab\u3000❤", "a\n😀\nb\n"]
    df = spark.createDataFrame([(t,) for t in [*TEXTS, *emoji]], "t string")
    for n in range(7):
        s = tx.strip("t")
        plain = F.coalesce((F.length(s) >= n) & ~tx.is_digits(s) & (F.length(tx.strip(tx.strip_emoji(s, ""))) >= n), F.lit(False))
        got = df.select("t", tx.has_tokens("t", n).eqNullSafe(tx.token_count("t") >= n).alias("h"),
                        tx.is_meaningful("t", n).eqNullSafe(plain).alias("m")).collect()
        assert all(r["h"] and r["m"] for r in got), (n, got)
    assert "split" not in _plan(df.select(tx.clean_pipeline("t", False)))


def test_keywords_are_plain_searches_over_one_copy(spark):
    df = spark.createDataFrame([(t,) for t in ["Rusak!", "ok kw", "", None, "lamabanget", "LAMA BANGET"]], "t string")
    out = df.select(lb.has_keyword("t").alias("k"))
    low = F.lower(F.coalesce(F.col("t"), F.lit("")))
    want = df.select(reduce(lambda a, b: a | b, [low.contains(k) for k in lx.NEGATIVE_KEYWORDS]).alias("k"))
    assert [r.k for r in out.collect()] == [r.k for r in want.collect()]
    assert "RLIKE" not in _plan(out).upper() and _plan(out).count("lower(") == 1


def test_pairs_and_drops_score_once(spark):
    for name in ("loso_delta", "domain_degradation"):
        plan = _plan(catalog.queries()[name](spark, SF_SMALL))
        assert "MapInArrow" not in plan and "nb-near" not in plan
