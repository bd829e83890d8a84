"""Tests of FINDINGS_r03, second session: linear models without CountVectorizer.fit, stream scoring without moving cleaned texts."""

from __future__ import annotations

import re

import numpy as np
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F

from reviewshift.operators import features, model
from reviewshift.plans import q_stream

WORDS = ["bagus", "rusak", "lama", "cepat", "biasa", "mantap", "kecewa"]


def test_linear_grid_counts_terms_once_and_fits_the_same_models(spark, monkeypatch):
    rows = [(p, i % 3, " ".join(WORDS[(i * k + i % 3 + len(p)) % 7] for k in range(1, 3 + i % 5))) for p in ("x", "yy") for i in range(60)]
    df = spark.createDataFrame(rows, "source_platform string, label_id int, review_text_clean string")
    want = {}
    for p in ("x", "yy"):
        part = features.class_weight_col(features.with_terms(df.filter(F.col("source_platform") == p), "review_text_clean", ["label_id"]))
        want[p] = features.linear_pipeline("svm", 500, 8).fit(part.withColumn("label", F.col("label_id").cast("double")))

    def no_fit(*a, **k):
        raise AssertionError("terms are shuffled as objects, a key at a time")

    monkeypatch.setattr(CountVectorizer, "_fit", no_fit)
    got = features.fit_linear_grid(df, ["source_platform"], "svm", max_features=500, max_iter=8)
    assert set(got) == {("x",), ("yy",)}
    for (p,), model in got.items():
        a, b = want[p].stages, model.stages
        assert sorted(a[0].vocabulary) == sorted(b[0].vocabulary)
        at = [b[0].vocabulary.index(t) for t in a[0].vocabulary]
        assert np.allclose(a[1].idf.toArray(), b[1].idf.toArray()[at])
        for c, d in zip(a[3].models, b[3].models):
            assert np.allclose(c.coefficients.toArray(), d.coefficients.toArray()[at], atol=1e-3)
        test = features.with_terms(df.filter(F.col("source_platform") == p), "review_text_clean", ["label_id"])
        assert [r[0] for r in want[p].transform(test).select("prediction").collect()] \
            == [r[0] for r in model.transform(test).select("prediction").collect()]


def test_top_terms_breaks_ties_by_term(spark):
    df = spark.createDataFrame([("x", t, n, 1) for t, n in [("b", 2), ("a", 2), ("c", 3), ("d", 1)]], "k string, term string, ttf long, df long")
    assert [(r["term"], r["_r"]) for r in features.top_terms(df, ["k"], 2).orderBy("_r").collect()] == [("c", 1), ("a", 2)]


def test_texts_dealt_by_review_stay_where_they_are(spark):
    train = spark.createDataFrame([(p, c, x, " ".join(WORDS[i + j] for j in range(3)))
                                   for i, p in enumerate(("tokopedia", "shopee")) for c in ("baseline", "proposed")
                                   for i, x in enumerate(("Negatif", "Netral", "Positif"))],
                                  "source_platform string, condition string, sentiment_label string, review_text_clean string")
    m, p = model.materialize_model(*model.nb_train(train))
    texts = [(i % 25, " ".join(WORDS[(i * k) % 7] for k in range(1, 4)) + f" lain{i}") for i in range(30)]  # ids come twice
    raw = spark.createDataFrame(texts, "review_id long, review_text string")
    want = model.score_cleaned(model.fallback_clean_paths(raw, ["review_id"]), m, p, ["review_id"])
    cleaned = model.fallback_clean_paths(raw.repartition(8, "review_id"), ["review_id"]).persist()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    scorer = model.Scorer(m, p, hot_tokens=3).keep(8)
    try:
        for _ in range(2):  # two batches, one model
            got = model.sentiments(scorer.score(cleaned, ["review_id"], carry=("review_text_clean",), dealt=8), ["review_id"])
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in re.search(r"Join.*?InMemoryTableScan [^\n]*review_text_clean", plan, re.S)[0], plan
            assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < got.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        scorer.release()
        cleaned.unpersist()


def test_landing_moves_no_texts(spark, monkeypatch):
    rows = spark.range(0, 40, 1, 8).selectExpr("id AS review_id", "concat('ulasan ', id) AS review_text")
    monkeypatch.setattr(q_stream.fx, "reviews", lambda *_: rows)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("landing", "landing")
    try:
        path = q_stream._land_reviews(spark, "", files=5)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    (job,) = tracker.getJobIdsForGroup("landing")
    assert len(tracker.getJobInfo(job).stageIds) == 1  # no shuffle
    back = spark.read.json(path)
    assert sorted(back.select("review_id", "review_text").collect()) == sorted(rows.collect())
    assert len(back.inputFiles()) == 5
