"""Stream = batch: the availableNow streaming jobs give the batch answers."""

from __future__ import annotations

import time
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from conftest import SF_SMALL
from reviewshift.operators import model
from reviewshift.session import cut_lineage
from reviewshift.sources import csv_io as io
from reviewshift.sources import fixtures as fx
from reviewshift.sources import pages as pg
from reviewshift.streaming import stream as st
from reviewshift.plans import experiment as ex


def _rows(df, cols):
    return Counter(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_stream_ingest_equals_batch_flatten(spark):
    pages = fx.landed_pages(spark, SF_SMALL)
    landing = io.scratch_path(spark, "t-landing-pages")
    pages.repartition(4, "shop").write.json(landing)
    streamed = st.stream_ingest(spark, landing, io.scratch_path(spark, "t-ingested"),
                                io.scratch_path(spark, "t-ckpt"))
    batch = pg.flatten_review_pages(spark.read.schema(pg.LANDED).json(landing))
    cols = sorted(batch.columns)
    assert _rows(streamed, cols) == _rows(batch, cols)
    assert streamed.count() > 0


def test_stream_ingest_rerun_picks_up_nothing_new(spark):
    pages = fx.landed_pages(spark, SF_SMALL)
    landing = io.scratch_path(spark, "t-landing-pages2")
    pages.repartition(3, "shop").write.json(landing)
    out, ck = io.scratch_path(spark, "t-ingested2"), io.scratch_path(spark, "t-ckpt2")
    first = st.stream_ingest(spark, landing, out, ck).count()
    again = st.stream_ingest(spark, landing, out, ck).count()       # same checkpoint: no new files
    assert first == again > 0


def test_stream_score_equals_batch_score(spark):
    s = ex.experiment_splits(spark, SF_SMALL)
    m, p = model.nb_train(s.filter(F.col("split") == "train"))
    m, p = cut_lineage(m), cut_lineage(p)
    reviews = fx.reviews(spark, SF_SMALL).select(
        "review_id", "review_text",
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(secs=F.col("review_id")))
        .alias("event_time"))
    landing = io.scratch_path(spark, "t-landing-reviews")
    reviews.repartition(4, "review_id").write.json(landing)
    streamed = st.stream_score(spark, landing, io.scratch_path(spark, "t-scored"),
                               io.scratch_path(spark, "t-ckpt3"), m, p)
    batch = model.score_reviews(reviews, m, p, ["review_id"])
    cols = ["review_id", "train_src", "condition", "sentiment", "confidence"]
    assert _rows(streamed, cols) == _rows(batch, cols)


def test_stream_dedup_keeps_one_per_text(spark):
    reviews = fx.reviews(spark, SF_SMALL).select(
        "review_id", "review_text",
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(secs=F.col("review_id")))
        .alias("event_time"))
    landing = io.scratch_path(spark, "t-landing-dedup")
    reviews.repartition(4, "review_id").write.json(landing)
    out = st.stream_dedup(spark, landing, io.scratch_path(spark, "t-dedup"), io.scratch_path(spark, "t-ckpt4"))
    assert out.count() == reviews.select("review_text").distinct().count()
    assert out.select("text_hash").distinct().count() == out.count()


def _land(spark, landing, rows):
    spark.createDataFrame(rows, st.REVIEW_EVENT).coalesce(1).write.mode("append").json(landing)


def test_dedup_state_expires_and_reports(spark):
    """Three restarts of one stream: repeats are counted, a text that was away comes back as returned, and in the end
    every landed row is kept or counted."""
    landing, out, ck = (io.scratch_path(spark, n) for n in ("t-landing-ttl", "t-ttl", "t-ckpt-ttl"))
    t = datetime(2024, 1, 1)
    ttl = dict(ttl=timedelta(seconds=20), mark=timedelta(hours=1))

    def run():
        kept = st.stream_dedup(spark, landing, out, ck, **ttl).collect()
        side = st.dedup_side(spark, out).collect()
        return ({(r["review_id"], r["review_text"], r["status"]) for r in kept},
                {(r["review_id"], r["status"]): r["repeats"] for r in side if r["status"] == "expired"})

    _land(spark, landing, [(3, "a", t), (2, "a", t), (4, None, t), (5, None, None), (6, "b", t)])
    first, expired = run()
    assert first == {(2, "a", "first"), (4, None, "first"), (6, "b", "first")} and not expired
    _land(spark, landing, [(7, "a", t - timedelta(days=9)), (8, "c", t)])  # late, and within the time: a repeat
    second, expired = run()
    assert second == first | {(8, "c", "first")} and not expired
    time.sleep(25)
    _land(spark, landing, [(9, "a", t), (10, "a", t)])
    third, expired = run()
    assert third == second | {(9, "a", "returned")}
    assert expired[2, "expired"] == 2 and expired[4, "expired"] == 1  # 3 and 7 of a; 5 of the null text
    time.sleep(25)
    _land(spark, landing, [(11, "d", t)])
    fourth, expired = run()
    assert fourth == third | {(11, "d", "first")} and expired[9, "expired"] == 1
    assert len(fourth) + sum(expired.values()) == 10


def test_dedup_combines_a_hot_text_before_its_state():
    import pandas as pd
    b = pd.DataFrame({"review_id": range(100), "review_text": ["x"] * 99 + ["y"], "text_hash": ["x"] * 99 + ["y"],
                      "event_time": [datetime(2024, 1, 2)] * 98 + [datetime(2024, 1, 1)] * 2})
    got, = st._combined(iter([b]))
    assert got[["review_id", "rows"]].values.tolist() == [[98, 99], [99, 1]]
