"""The registered queries of this package, one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, decontaminate, hard_negatives, licenses, periodic_runs, quality, rank_queue_bpe, secrets, sharding,
               simhash, token_counts, topk, warc)
from .common import table

BPE_FILE, PIECE_FILE, RANK_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
SHARDS, TOKEN_LIMIT, KEEP_SCORE = 40, 4096, 0.3
Query = Callable[[SparkSession, str], DataFrame]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fitted_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.LineCrf:
    """A model of the labels outside the held-out fifth."""
    return quality.fit(docs, table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.add_scores(docs, fitted_quality(spark, docs, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARDS).withColumn("law", F.lit("key"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.add_tokens(docs, str(public_tokenizers.path(BPE_FILE)), ids=None, digests=True)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path(PIECE_FILE)))
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens",
                          (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and item that it leaks."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.add_licenses(docs).drop("text", "license_spans")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return secrets.scan(docs).select(
        "doc_id", *[count(k).alias(f"n_{secrets.KINDS[k]}") for k in range(len(secrets.RULES))],
        F.sha2(secrets.written(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_distance=2)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(table(spark, sf_dir, "pages"))
    return rows.filter("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three negatives for each of the five positives of every fiftieth vector; a seventh of the labels is moved on."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.mine(rows, F.col("id") % 50 == 0, positives=5, negatives=3, low=50, high=95)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the documents, of which a tenth are looped from some word on."""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(hashed / 10)
    loop = periodic_runs.looped(F.col("text"), lambda n: g % n, lambda n: 1 + F.floor((n - g % n) / (3 + g % 8)))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.when((hashed % 10 == 0) & F.col("text").rlike(periodic_runs.WORD), loop)
        .otherwise(F.col("text")).alias("text"))
    found = periodic_runs.add_runs(docs, runs=None, text_out=None, digests=True)
    return found.drop("text")


def op13_rank_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = rank_queue_bpe.add_tokens(docs, str(public_tokenizers.path(RANK_FILE)), ids=None, digests=True)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_quality, op2_sharding, op3_bpe, op4_token_counts, op5_decontaminate, op6_licenses, op7_secrets,
    op8_simhash, op9_topk, op10_warc, op11_hard_negatives,
    op12_periodic_runs, op13_rank_queue_bpe)}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {}
