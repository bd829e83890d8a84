"""Registered queries: the streaming jobs, driven to completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import model
from ..sources import csv_io as io
from ..sources import fixtures as fx
from ..streaming import stream as st
from . import experiment as ex
from . import q_sources
from .registry import register


def _land_reviews(spark, sf, files: int = 5) -> str:
    """Reviews landed as JSON files (event time derived from the id)."""
    r = fx.reviews(spark, sf).select(
        "review_id", "review_text",
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(secs=F.col("review_id")))
        .alias("event_time"))
    path = io.scratch_path(spark, "landing-reviews")
    r.coalesce(files).write.json(path)
    return path


def _ingest(spark, sf):
    landing = io.scratch_path(spark, "landing-pages")
    fx.landed_pages(spark, sf).repartition(5, "shop").write.json(landing)
    return st.stream_ingest(spark, landing, io.scratch_path(spark, "ingested"), io.scratch_path(spark, "ckpt"))


register("stream_ingest", q_sources.PAGES_ORACLE)(_ingest)


def _score(spark, sf):
    s = ex.experiment_splits(spark, sf, raw_text=False)
    m, p = model.nb_train(s.filter(F.col("split") == "train"))
    m, p = model.materialize_model(m, p)
    out = st.stream_score(spark, _land_reviews(spark, sf), io.scratch_path(spark, "scored"),
                          io.scratch_path(spark, "ckpt"), m, p)
    return out.select("review_id", "train_src", "condition", "sentiment", "confidence")


def _score_sql() -> str:
    from . import q_eval
    return q_eval.W(q_eval.SC, """
SELECT review_id, train_src, condition,
       CASE pred WHEN 0 THEN 'Negatif' WHEN 1 THEN 'Netral' ELSE 'Positif' END AS sentiment,
       round(exp(greatest(sc0, sc1, sc2) - _mx) / _z, 4) AS confidence
FROM rscore""")


register("stream_score", _score_sql())(_score)

register("stream_dedup", """
SELECT DISTINCT sha256(CASE WHEN doc_id % 41 = 0 THEN '12345' WHEN doc_id % 43 = 0 THEN 'oke' ELSE concat(
  CASE WHEN doc_id % 7 = 0 THEN 'brg dtg cpt bgt wkwk ' ELSE '' END, text,
  CASE WHEN doc_id % 11 = 0 THEN ' cek https://toko.example/p?id=1 ya' ELSE '' END,
  CASE WHEN doc_id % 13 = 0 THEN ' @admin #promo_2024 mantaaap!!' ELSE '' END,
  CASE WHEN doc_id % 17 = 0 THEN ' kecewa, barang rusak' ELSE '' END,
  CASE WHEN doc_id % 19 = 0 THEN ' ❤ j&t ok' ELSE '' END) END) AS text_hash
FROM documents""")(
    lambda spark, sf: st.stream_dedup(spark, _land_reviews(spark, sf), io.scratch_path(spark, "dedup"),
                                      io.scratch_path(spark, "ckpt")).select("text_hash"))
