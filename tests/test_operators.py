"""Property tests of the relational operators."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from reviewshift.operators import curate, metrics, shift, splits
from reviewshift.operators.ranking import hash_rank, md5_key
from reviewshift.plans import experiment as ex
from reviewshift.sources import fixtures as fx


@pytest.fixture(scope="module")
def split_df(spark):
    return ex.experiment_splits(spark, SF_SMALL).cache()


def test_splits_disjoint_complete_exact(spark, split_df):
    keys = ["source_seq", "row_seq", "condition"]
    total = split_df.count()
    assert total > 0
    assert split_df.select(*keys).distinct().count() == total          # each row in one part
    assert set(r[0] for r in split_df.select("split").distinct().collect()) <= {"train", "val", "test"}
    strata = ["source_platform", "condition"]
    alloc = splits.split_allocation(split_df, strata)
    got = split_df.groupBy(*strata, "sentiment_label").pivot("split", ["train", "val", "test"]).count() \
        .na.fill(0)
    j = alloc.join(got, strata + ["sentiment_label"])
    assert j.count() == alloc.count()
    for r in j.collect():
        assert (r["train"], r["val"], r["test"]) == (r["n_train"], r["n_val"], r["n_test"])
        assert r["n_train"] + r["n_val"] + r["n_test"] == r["n_c"]


def test_split_allocation_is_stratified_70_15_15(spark):
    df = spark.range(1000).select(
        F.lit("p").alias("source_platform"), F.lit("c").alias("condition"),
        F.when(F.col("id") < 600, "Positif").when(F.col("id") < 900, "Netral").otherwise("Negatif")
        .alias("sentiment_label"))
    a = {r["sentiment_label"]: r for r in splits.split_allocation(df, ["source_platform", "condition"]).collect()}
    assert sum(r["n_train"] for r in a.values()) == 700
    assert sum(r["n_val"] for r in a.values()) == 150
    assert (a["Positif"]["n_train"], a["Netral"]["n_train"], a["Negatif"]["n_train"]) == (420, 210, 70)


def test_hash_rank_is_a_permutation(spark):
    df = spark.range(5000).select(F.col("id").alias("source_seq"), F.lit(0).alias("row_seq"),
                                  (F.col("id") % 3).alias("g"))
    r = hash_rank(df.withColumn("_h", md5_key("source_seq", "row_seq")), ["g"], "_h",
                  ["source_seq", "row_seq"], out="rk")
    per = r.groupBy("g").agg(F.min("rk").alias("lo"), F.max("rk").alias("hi"),
                             F.count(F.lit(1)).alias("n"), F.countDistinct("rk").alias("d"))
    for row in per.collect():
        assert row["lo"] == 1 and row["hi"] == row["n"] == row["d"]


def test_jsd_properties(spark):
    docs = fx.reviews(spark, SF_SMALL)
    dist = shift.word_distribution(docs)
    same = shift.jensen_shannon(shift.align_distributions(dist, "shopee", "shopee")).first()
    assert same["jsd"] == 0.0 and not same["domain_shift"]
    ab = shift.jensen_shannon(shift.align_distributions(dist, "shopee", "tokopedia")).first()
    ba = shift.jensen_shannon(shift.align_distributions(dist, "tokopedia", "shopee")).first()
    assert ab["jsd"] == ba["jsd"]
    assert 0.0 < ab["jsd"] <= math.log(2)


def test_confusion_cells_sum_to_n(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 1), (2, 2), (2, 2), (2, 1)], "label_id int, pred int") \
        .withColumn("g", F.lit("x"))
    cells = metrics.confusion_cells(df, ["g"])
    assert cells.count() == 9
    assert cells.agg(F.sum("n")).first()[0] == 6
    s = metrics.scores_from_cells(metrics.confusion_wide(df, ["g"]), ["g"]).first()
    assert s["n"] == 6 and abs(s["accuracy"] - 4 / 6) < 1e-6


def test_baseline_equals_proposed_with_empty_lexicon(spark):
    r = fx.reviews(spark, SF_SMALL)
    both = splits.dual_path_clean(r, lexicon={}, whitelist=())
    p = both.groupBy("review_id").agg(F.count_distinct("review_text_clean").alias("k"),
                                      F.count(F.lit(1)).alias("n"))
    assert p.filter((F.col("k") != 1) | (F.col("n") != 2)).count() == 0


def test_dedup_keeps_first_in_concat_order(spark):
    df = spark.createDataFrame(
        [(1, 5, "sama", 4), (0, 9, "sama", 1), (0, 3, "beda", 2), (0, 7, "sama", 5)],
        "source_seq int, row_seq int, review_text string, rating int")
    got = {r["review_text"]: r for r in curate.dedup_first(df).collect()}
    assert (got["sama"]["source_seq"], got["sama"]["row_seq"], got["sama"]["rating"]) == (0, 7, 5)
    assert got["beda"]["rating"] == 2


def test_downsample_to_median(spark):
    df = spark.range(60).select(F.col("id").alias("source_seq"), F.lit(0).alias("row_seq"),
                                F.when(F.col("id") < 40, "Positif").when(F.col("id") < 50, "Netral")
                                .otherwise("Negatif").alias("label"))
    got = {r["label"]: r["count"] for r in curate.downsample_to_median(df).groupBy("label").count().collect()}
    assert got == {"Positif": 10, "Netral": 10, "Negatif": 10}


def test_master_pipeline_counts(spark):
    m = ex.master(spark, SF_SMALL)
    n = m.count()
    assert n > 0
    assert m.select("review_text").distinct().count() == n                 # deduplicated
    per = [r["count"] for r in m.groupBy("label").count().collect()]
    per.sort()
    assert len(per) == 3 and per[1] == per[2]                               # big classes cut to the median


def test_rating_quota_fill_and_running_total(spark):
    from reviewshift.operators import quota
    rows = [("s1", 5, i, i) for i in range(5)] + [("s1", 4, i, 10 + i) for i in range(2)] + [("s2", 5, 0, 20)]
    df = spark.createDataFrame(rows, "shop string, rating int, ts int, event_id int")
    q = {5: 3, 4: 1, 3: 1, 2: 1, 1: 1}
    kept = quota.rating_quota(df, "shop", "rating", "ts", "event_id", q)
    got = sorted((r.shop, r.rating, r.ts) for r in kept.collect())
    assert got == [("s1", 4, 1), ("s1", 5, 2), ("s1", 5, 3), ("s1", 5, 4), ("s2", 5, 0)]   # newest first
    fill = {(r.shop, r.rating): (r.collected, r.fill) for r in quota.quota_fill(kept, "shop", "rating", q).collect()}
    assert fill[("s1", 5)] == (3, 1.0) and fill[("s2", 4)] == (0, 0.0) and len(fill) == 10
    run = quota.running_total(quota.quota_fill(kept, "shop", "rating", q), "shop", "rating", q)
    last = {r.shop: r.running_total for r in run.collect() if r.rating == 1}
    assert last == {"s1": 4, "s2": 5}


def test_hash_rank_hot_group_and_dedup_hot_text(spark):
    # one group / one text holds most rows: ranks stay a permutation and dedup keeps one row
    df = spark.range(20000).select(F.col("id").alias("source_seq"), F.lit(0).alias("row_seq"),
                                   F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("g"),
                                   F.when(F.col("id") % 3 == 0, F.lit("sama")).otherwise(
                                       F.col("id").cast("string")).alias("review_text"))
    r = hash_rank(df.withColumn("_h", md5_key("source_seq", "row_seq")), ["g"], "_h",
                  ["source_seq", "row_seq"], out="rk")
    for row in r.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rk").alias("d"),
                                  F.max("rk").alias("hi")).collect():
        assert row["n"] == row["d"] == row["hi"]
    d = curate.dedup_first(df.select("source_seq", "row_seq", "review_text"))
    assert d.count() == 13333 + 1                  # 6,667 copies of "sama" become one row
    assert d.filter(F.col("review_text") == "sama").first()["source_seq"] == 0
