"""Faults that small fixtures do not reach: nulls, late rows, small shares, mixed files, hot groups."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from reviewshift.functions import text as tx
from reviewshift.operators import curate, model, quota, ranking, shift, splits, vocab
from reviewshift.sources import adapters
from reviewshift.sources import csv_io as io
from reviewshift.streaming import stream as st

CSV_HEAD = "review_text,rating,product_name,review_date,reviewer_name\n"


def test_hash_rank_keeps_null_groups_and_is_a_bigint(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "g string, id long")
    r = ranking.hash_rank(df.withColumn("_h", ranking.md5_key("id")), ["g"], "_h", ["id"])
    assert sorted((str(x.g), x.rank) for x in r.collect()) == [("None", 1), ("None", 2), ("a", 1)]
    assert dict(r.dtypes)["rank"] == "bigint"


def test_range_rank_equals_row_number_and_uses_many_buckets(spark):
    df = spark.range(5000).select((F.col("id") * 7 + 3).alias("o"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"))
    got = ranking.range_rank(df, ["g"], "o")
    want = {}
    for r in sorted(df.collect(), key=lambda r: r.o):
        want[r.o] = want.get(("n", r.g), 0) + 1
        want[("n", r.g)] = want[r.o]
    assert all(r["rank"] == want[r.o] for r in got.collect())


@pytest.mark.parametrize("k", [1, 7, 2000])
def test_top_k_equals_one_window(spark, k):
    df = spark.range(3000).select(F.concat(F.lit("w"), "id").alias("w"), (F.col("id") % 50).alias("n"), F.lit("g").alias("g"))
    got = ranking.top_k(df, ["g"], [F.col("n").desc(), F.col("w")], k, ["w"])
    want = sorted(((-r.n, r.w) for r in df.collect()))[:k]
    assert [(-r.n, r.w) for r in sorted(got.collect(), key=lambda r: r["rank"])] == want


def test_no_window_sorts_a_whole_group_first(spark):
    """Above a whole word table there is a window by (group, bucket)."""
    docs = spark.createDataFrame([("a", "x y z")], "g string, review_text_clean string")
    shops = spark.createDataFrame([(1, 5, 2, 3)], "shop int, rating int, ts int, id int")
    plans = [vocab.build_vocab(docs, ["g"], max_vocab=5000), quota.rating_quota(shops, "shop", "rating", "ts", "id"),
             shift.top_k_words(shift.word_counts(docs.withColumnRenamed("g", "source_platform"), "review_text_clean"), 5000)]
    for df in plans:
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("Window [") == 2 and "_salt" in [ln for ln in text.split("\n") if "Window [" in ln][-1]


def test_small_hold_out_is_exact(spark):
    df = spark.range(10_000).select(F.lit("p").alias("s"), F.lit("Positif").alias("sentiment_label"))
    a = splits.split_allocation(df, ["s"], holdout=0.0004, second_test_size=0.5).first()
    assert (a.n_train, a.n_val, a.n_test) == (9996, 2, 2)


def test_null_strata_are_split_too(spark):
    df = spark.range(100).select(F.lit(None).cast("string").alias("s"), F.lit("Positif").alias("sentiment_label"),
                                 F.lit(0).alias("source_seq"), F.col("id").alias("row_seq"))
    got = {r["split"]: r["count"] for r in splits.stratified_split(df, ["s"]).groupBy("split").count().collect()}
    assert got == {"train": 70, "val": 15, "test": 15}


def test_stream_dedup_keeps_late_rows(spark):
    rows = spark.range(400).select(
        F.col("id").alias("review_id"), F.concat(F.lit("text "), F.col("id") % 300).alias("review_text"),
        F.timestamp_seconds(F.lit(1_700_000_000) - F.col("id") * 10_000).alias("event_time"))
    landing = io.scratch_path(spark, "late")
    rows.repartition(5).write.json(landing)
    out = st.stream_dedup(spark, landing, io.scratch_path(spark, "late-out"), io.scratch_path(spark, "late-ckpt"))
    assert out.count() == out.select("text_hash").distinct().count() == 300


def test_csv_ratings_and_missing_values(spark, tmp_path):
    rows = ['"good, ""very"" good\nindeed",4.0,p,d,n', "bad rating,abc,p,d,n", "no rating,,p,,", "NA,5,p,d,n", "nine,9,p,d,n", "five,5,NA,d,n"]
    (tmp_path / "r.csv").write_bytes(b"\xef\xbb\xbf" + (CSV_HEAD + "\n".join(rows) + "\n").encode())
    got = {r.review_text: r for r in io.read_reviews_csv(spark, str(tmp_path), "shopee").collect()}
    assert got['good, "very" good\nindeed'].rating == 4
    assert got["bad rating"].rating == got["no rating"].rating == 3 and got["five"].rating == 5
    assert all(r.source_platform == "shopee" and r.product_name is not None for r in got.values())
    assert io.read_reviews_csv(spark, str(tmp_path / "none"), "shopee").count() == 0


def test_latin1_is_decided_by_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes((CSV_HEAD + "café utf,5,p,d,n\n").encode())
    (tmp_path / "b.csv").write_bytes((CSV_HEAD + "café latin,5,p,d,n\n").encode("latin-1"))
    assert sorted(r[0] for r in io.read_csv(spark, str(tmp_path)).select("review_text").collect()) == ["café latin", "café utf"]


def test_appends_add_up(spark):
    path = io.scratch_path(spark, "append")
    assert io.count_rows(spark, path).first()[0] == 0
    for n in (3, 4):
        io.append_rows(spark.range(n), path)
    assert io.count_rows(spark, path).first()[0] == 7
    assert len([f for f in os.listdir(path) if os.path.isdir(os.path.join(path, f))]) == 0


def test_a_class_without_documents_has_probability_0(spark):
    rows = [("a", "c", "good fine", "Positif"), ("a", "c", "bad poor", "Negatif")]
    train = spark.createDataFrame(rows, "source_platform string, condition string, review_text_clean string, sentiment_label string")
    m, p = model.nb_train(train)
    test = spark.createDataFrame([(1, "c", "good"), (2, "c", "unknown words")], "id long, condition string, review_text_clean string")
    got = {r.id: r for r in model.nb_score(test, m, p, ["id"], carry=("review_text_clean",)).withColumn(
        "p", model.softmax(F.col("scores"))).collect()}
    assert got[1].pred == 2 and all(abs(sum(r.p) - 1) < 1e-3 and r.p[1] == 0 for r in got.values())


def test_kde_leaves_constant_groups_out(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 2.0), ("c", 5.0)], "source_platform string, v double")
    assert {r[0] for r in shift.kde_density(df, "v", grid=5).select("source_platform").collect()} == {"b"}


def test_defaults_keep_column_types(spark):
    df = spark.createDataFrame([(None, None)], "review_text string, rating int")
    assert dict(curate.fill_defaults(df).dtypes)["rating"] == "int"


def test_lenient_dates(spark):
    want = {"2024-01-05 10:00:00": "2024-01-05", "5 Jan 2024": "2024-01-05", "01/05/2024": "2024-01-05",
            "January 5, 2024": "2024-01-05", "2024/1/5 7:08:09": "2024-01-05", "13/13/2024": None, "soon": None, "": None}
    df = spark.createDataFrame([(d,) for d in want], "d string").select("d", tx.normalize_date("d").alias("got"))
    assert {r.d: r.got for r in df.collect()} == want


def test_a_failing_source_is_left_out(spark, caplog):
    good = spark.createDataFrame([("fine", 5, "5 Jan 2024", "u", 1)], "content string, score int, at string, userName string, row_seq long")
    got = adapters.load_sources({
        "no file": lambda: adapters.adapt_appstore(spark.read.parquet("/no/such/table")),
        "no column": lambda: adapters.adapt_appstore(good.drop("score")),
        "good": lambda: adapters.adapt_appstore(good)})
    assert len(got) == 1 and got[0].first().review_date == "2024-01-05"
    assert [r.args[0] for r in caplog.records if r.name == adapters.__name__] == ["no file", "no column"]


def _greedy(word, vocab, max_chars):
    at, n = 0, 0
    while at < len(word) <= max_chars:
        ends = [e for e in range(at + 1, len(word) + 1) if ("##" if at else "") + word[at:e] in vocab]
        if not ends:
            return 1
        at, n = ends[-1], n + 1
    return max(n, 1)


@pytest.mark.parametrize("max_chars", [100, 5])
def test_sub_words_equal_a_greedy_walk(spark, max_chars):
    vocab = {"a", "ab", "abc", "##b", "##bc", "##c", "##ca", "é", "##\U0001f600", "##d"}
    words = ["abc", "abca", "abd", "cab", "x", "abcbcbcca", "é\U0001f600c", "ddd", "a" * 120]
    got = shift.wordpiece_counts(spark.createDataFrame([(w,) for w in words], "word string"),
                                 spark.createDataFrame([(v,) for v in vocab], "piece string"), max_chars)
    assert {r.word: r.n_pieces for r in got.collect()} == {w: _greedy(w, vocab, max_chars) for w in words}


def test_running_total_over_many_ranges(spark):
    rows = [(f"s{i:03d}", r, (i * r) % 7) for i in range(200) for r in (5, 1, 3)]
    fill = spark.createDataFrame(rows, "shop string, rating int, collected long")
    got = quota.running_total(fill, "shop", "rating", {1: 9, 3: 9, 5: 9}).collect()
    total = 0
    for r in sorted(got, key=lambda r: (r.shop, r.rating)):
        total += r.collected
        assert r.running_total == total
    assert len(got) == len(rows)
