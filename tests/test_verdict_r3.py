"""Tests of the round's findings: work that is done once, and rows that stay where they are."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from conftest import SF_SMALL
from reviewshift.functions import lexicon as lx
from reviewshift.functions import text as tx
from reviewshift.operators import curate, features, model, ranking, splits
from reviewshift.plans import catalog
from reviewshift.plans import experiment as ex


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_fallback_cleans_a_text_once(spark):
    df = spark.createDataFrame([("Brg @a kotak   merah!!", lx.SLANG_DICT["brg"] + " kotak merah!"), ("OK ", "ok"), (None, None)],
                               "t string, want string")
    out = df.select("want", tx.clean_with_fallback("t").alias("got"))
    assert all(r["want"] == r["got"] for r in out.collect())
    # the combined pass over runs and punctuation stands once in the plan
    assert _plan(out).count(tx.REPEAT_RE) == 1


def test_one_pass_steps_equal_the_single_steps(spark):
    texts = ["@a#b#@c 😀😀@d", "a!!b..c???d----", "aaa!!!\n\n\nbb", "x&y  　z\x1f&", "@www.a.b c", "𝐀@x𝐀#", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    steps = tx.strip_emoji(tx.strip_hashtags(tx.strip_mentions(tx.strip_urls(tx.lower("t")))))
    one = tx.squeeze_punct(tx.collapse_runs(steps))
    wide = F.trim(F.regexp_replace(tx.strip_symbols("t"), tx.SPACE_RE, " "))
    got = df.select(one.eqNullSafe(tx.clean_prefix("t")).alias("p"), wide.eqNullSafe(tx.clean_suffix("t")).alias("s"))
    assert all(r["p"] and r["s"] for r in got.collect())


def test_hash_cut_is_the_hash_rank(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.lit(0).alias("source_seq"), (F.col("id") % 2900).alias("row_seq"))
    df = df.withColumn("g", F.when(F.col("g") > 0, F.col("g"))).withColumn("_h", ranking.md5_key("source_seq", "row_seq"))
    cuts = spark.createDataFrame([(None, 300, 333), (1, 0, 1000), (2, 999, 5000)], "g long, a long, b long")
    got = ranking.hash_cut(df, ["g"], "_h", ["row_seq"], cuts, ["a", "b"]).groupBy("g", "part").count().collect()
    assert {(r["g"], r["part"]): r["count"] for r in got} == {
        (None, 0): 300, (None, 1): 33, (None, 2): 667, (1, 1): 1000, (2, 0): 999, (2, 1): 1}
    ranked = ranking.hash_rank(df, ["g"], "_h", ["row_seq"]).filter("g = 2 and rank <= 999").select("row_seq")
    assert ranked.exceptAll(ranking.hash_cut(df, ["g"], "_h", ["row_seq"], cuts, ["a", "b"])
                            .filter("g = 2 and part = 0").select("row_seq")).count() == 0


def test_split_and_downsampling_do_not_sort_all_texts(spark):
    df = spark.range(2000).select(
        F.lit("p").alias("source_platform"), F.lit("c").alias("condition"), F.lit("Positif").alias("sentiment_label"),
        F.lit("Positif").alias("label"), F.lit(0).alias("source_seq"), F.col("id").alias("row_seq"))
    for out in (splits.stratified_split(df), curate.downsample_to_median(df)):
        sort = [line for line in _plan(out).splitlines() if "row_seq" in line and "Exchange hashpartitioning" in line]
        assert sort == [] or "_inside" in _plan(out)
        assert out.count() == 2000


def test_scores_with_few_hot_tokens_equal_those_with_all(spark):
    m = spark.createDataFrame(
        [(p, c, t, [math.log(0.1 + 0.1 * i + 0.01 * j) for j in range(3)])
         for p in ("x", "y") for c in ("b", "q") for i, t in enumerate(("aa", "bb", "cc") if p == "x" else ("bb", "dd"))],
        "source_platform string, condition string, token string, ll array<double>")
    p = spark.createDataFrame([("x", "b", [-1.0, -2.0, -3.0]), ("y", "b", [-2.0, -1.0, -3.0]), ("x", "q", [-1.0, -1.0, -1.0])],
                              "source_platform string, condition string, prior array<double>")
    docs = spark.createDataFrame([(1, "b", "aa bb aa zz", 7), (2, "b", "", 8), (3, "q", "dd cc", 9), (3, "q", "dd", 9),
                                  (4, None, "aa", 1), (5, "b", None, 2), (6, "none", "aa", 3)],
                                 "id long, condition string, review_text_clean string, truth long")
    rows = lambda n, carry=(): sorted(
        (r["id"], r["condition"], r["train_src"], tuple(r["scores"]), r["pred"])
        for r in model.nb_score(docs, m, p, ["id"], carry=carry, hot_tokens=n).collect())
    assert rows(0) == rows(2) == rows(100)
    got = {(r[0], r[2]): r[3][0] for r in rows(1)}
    assert set(got) == {(1, "x"), (1, "y"), (2, "x"), (2, "y"), (3, "x"), (3, "y"), (5, "x"), (5, "y")}
    assert got[1, "x"] == round(-1 + 2 * math.log(0.1) + math.log(0.2), 6)
    assert got[3, "x"] == round(-2 + math.log(0.3), 6) and got[3, "y"] == round(2 * math.log(0.2), 6)
    assert len(rows(1, ("truth",))) == 10  # the repeated row 3 carries its sums twice


def test_term_counts_with_repeated_documents_and_few_features(spark):
    df = spark.createDataFrame([("a", 1, "x y x"), ("a", 1, "x"), ("a", 2, "y z"), ("b", 1, None), ("b", 2, "x y"), (None, 1, "q q")],
                               "k string, d long, review_text_clean string")
    stats = {(r.k, r.term): (r.ttf, r.df) for r in features.term_stats(df, ["k"], ["d"]).collect()}
    assert stats == {("a", "x"): (3, 1), ("a", "y"): (2, 2), ("a", "z"): (1, 1), ("a", "x y"): (1, 1), ("a", "y x"): (1, 1),
                     ("a", "y z"): (1, 1), ("b", "x"): (1, 1), ("b", "y"): (1, 1), ("b", "x y"): (1, 1),
                     (None, "q"): (2, 1), (None, "q q"): (1, 1)}
    vocab = features.tfidf_fit(df, ["k"], ["d"], max_features=3)
    got = {(r["k"], r["term"]): r["index"] for r in vocab.collect()}
    assert got == {("a", "x"): 0, ("a", "y"): 1, ("a", "x y"): 2, ("b", "x"): 0, ("b", "x y"): 1, ("b", "y"): 2}
    rows = features.tfidf_transform(df, vocab, ["k"], ["d"])
    assert {(r.k, r.d) for r in rows.collect()} == {("a", 1), ("a", 2), ("b", 2)}
    for r in rows.groupBy("k", "d").agg(F.sum(F.col("tfidf") ** 2).alias("n")).collect():
        assert abs(r.n - 1) < 1e-9
    # counted in place: no shuffle is dealt by (document, term)
    assert "hashpartitioning(k" not in _plan(rows).replace(" ", "")


def test_train_grid_makes_the_splits_once(spark, monkeypatch):
    made = []
    splits_of = ex.experiment_splits
    monkeypatch.setattr(ex, "experiment_splits", lambda *a, **k: made.append(1) or splits_of(*a, **k))
    assert catalog.queries()["train_grid"](spark, SF_SMALL).count() == 4
    assert len(made) == 1
