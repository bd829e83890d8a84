"""Null groups, quarantine of landed pages, order keys, and an entry without the training-data part."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from collections import Counter

from pyspark.sql import functions as F

from conftest import ROOT, SF_SMALL
from reviewshift.operators import curate, ranking, splits
from reviewshift.sources import csv_io as io
from reviewshift.sources import fixtures as fx
from reviewshift.sources import pages as pg
from reviewshift.streaming import stream as st


def test_null_groups_are_groups(spark):
    rows = [("a" if i % 3 else None, i, 0) for i in range(24)]
    df = spark.createDataFrame(rows, "g string, row_seq int, source_seq int")
    sizes = lambda d, c="g": Counter(r[c] for r in d.select(c).collect())
    assert sizes(splits.sample_per_group(df, "g", 5)) == {"a": 5, None: 5}
    assert sizes(splits.sample_per_group(df, "g", 100)) == {"a": 12, None: 8}
    assert sizes(curate.downsample_to_median(df.withColumnRenamed("g", "label")), "label") == {"a": 12, None: 8}
    three = df.withColumn("label", F.when(F.col("row_seq") < 12, F.col("g")).otherwise("b"))
    assert sizes(curate.downsample_to_median(three), "label") == {"a": 8, None: 4, "b": 8}
    keyed = df.withColumn("_h", ranking.md5_key("row_seq"))
    assert sorted(r["k"] for r in ranking.hash_rank(keyed, ["g"], "_h", ["row_seq"], "k").filter("g is null").collect()) == list(range(1, 9))
    assert sorted(r["k"] for r in ranking.range_rank(df, ["g"], "row_seq", "k").filter("g is null").collect()) == list(range(1, 9))
    assert ranking.top_k(df, ["g"], [F.col("row_seq")], 3, ["row_seq"]).filter("g is null").count() == 3
    folds = splits.kfold_assign(df.withColumn("label", F.lit("x")), ["g"], "label", 4)
    assert sizes(folds.filter("g is null"), "fold") == {0: 2, 1: 2, 2: 2, 3: 2}


ODD_PAGES = [
    "not json {", json.dumps({"shop": "s", "page": 1}), json.dumps({"shop": "s", "page": 2, "response": None}), "[1, 2]",
    json.dumps({"shop": "s", "page": 3, "response": {"data": {"productrevGetShopReviewReadingList": {"list": {"a": 1}}}}}),
    json.dumps({"shop": "s", "page": 4, "response": {"data": {"productrevGetShopReviewReadingList": {"list": []}}}}),
    json.dumps({"shop": "s", "page": 5, "requested_rating": 2, "response": {"data": {"productrevGetShopReviewReadingList": {
        "list": [7, None, {"reviewText": " bagus sekali ", "rating": "five", "product": 3, "extra": [1]},
                 {"reviewText": "barang oke", "rating": 4, "product": {"productName": " tas "}}]}}}}), "", "  ",
]


def test_pages_that_do_not_fit_are_quarantined(spark):
    parsed = pg.parse_pages(spark.createDataFrame([(x,) for x in ODD_PAGES], "value string")).cache()
    bad = sorted((r["page"], r["pos"], r["reason"]) for r in pg.quarantined(parsed).collect() if r["page"])
    assert bad == [(1, None, "no envelope"), (2, None, "no envelope"), (3, None, "no list"),
                   (5, 0, "not an object"), (5, 1, "not an object")]
    assert {r["raw"] for r in pg.quarantined(parsed).collect()} >= {ODD_PAGES[0], ODD_PAGES[1], "7"}
    assert Counter(r["reason"] for r in pg.quarantined(parsed).collect() if not r["page"]) == {"not JSON": 1, "no envelope": 1}
    good = [(r["review_text"], r["rating"], r["product_name"], r["pos"]) for r in pg.reviews_of(parsed).collect()]
    assert sorted(good) == [("bagus sekali", 2, "", 2), ("barang oke", 4, "tas", 3)]


def test_rows_and_quarantine_are_all_that_landed(spark):
    pages = fx.landed_pages(spark, SF_SMALL)
    landing, out = io.scratch_path(spark, "t-landing-q"), io.scratch_path(spark, "t-out-q")
    lines = pages.select(F.to_json(F.struct("*")).alias("value"))
    lines.unionByName(spark.createDataFrame([(x,) for x in ODD_PAGES], "value string")).repartition(3).write.text(landing)
    rows = st.stream_ingest(spark, landing, out, io.scratch_path(spark, "t-ckpt-q"))
    bad = st.ingest_quarantine(spark, out)
    batch = pg.parse_pages(spark.read.text(landing))
    key = ["shop", "page", "pos", "review_text"]
    assert Counter(map(tuple, rows.select(key).collect())) == Counter(map(tuple, pg.reviews_of(batch).select(key).collect()))
    assert Counter(map(tuple, bad.collect())) == Counter(map(tuple, pg.quarantined(batch).collect()))
    # every landed page is in the parsed rows or in the quarantine
    landed = {(r["shop"], r["requested_rating"], r["page"]) for r in pages.select("shop", "requested_rating", "page").collect()}
    seen = {(r["shop"], r["requested_rating"], r["page"]) for r in batch.select("shop", "requested_rating", "page").collect()}
    assert landed <= seen and bad.filter("reason = 'no envelope'").count() > 0
    # and the rows are those of the typed reader
    typed = pg.flatten_review_pages(spark.read.schema(pg.LANDED).json(lines.rdd.map(lambda r: r[0])))
    own = pg.reviews_of(pg.parse_pages(lines))
    cols = sorted(typed.columns)
    assert Counter(map(tuple, own.select(cols).collect())) == Counter(map(tuple, typed.select(cols).collect()))


def test_order_keys_of_sources_are_unique(spark):
    rows = fx.product_review_rows(spark, SF_SMALL)
    assert rows.select("row_seq").distinct().count() == rows.count()


def test_entry_works_without_the_training_data_part():
    code = ("import sys\nclass No:\n    def find_spec(self, name, path=None, target=None):\n"
            "        if name.split('.')[0] == {0!r}: raise ModuleNotFoundError(name, name=name)\n"
            "sys.meta_path.insert(0, No())\nimport __spark_entry__ as E\n"
            "assert len(E.queries()) > 120 and not [k for k in E.queries() if k.startswith('op') and k[2].isdigit()]")
    for hidden in ("public_tokenizers", "xxhash", "regex", "corpus_pipeline"):
        subprocess.run([sys.executable, "-c", code.format(hidden)], cwd=ROOT, check=True, env=dict(os.environ), timeout=120)
