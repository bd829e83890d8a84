"""The corpus pipeline: quality, near duplicates, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read back as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewshift.llm import bpe, decontaminate, quality, secrets, simhash
from reviewshift.llm.common import columns_of, free_name, stage_table, table
from reviewshift.llm.queries import BPE_FILE, KEEP_SCORE, fitted_quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    score = free_name(docs, "score")
    scored = quality.add_scores(docs, fitted_quality(spark, docs, sf_dir), out=score)
    return scored.filter(F.col(score) >= KEEP_SCORE).select(*columns_of(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id."""
    return simhash.keep_one(docs, shingle=3, max_distance=2)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in their texts; n_chars is that of the new text."""
    base, spans = free_name(docs, "base_spans"), free_name(docs, "spans")
    found = secrets.scan(docs, base=base, every=spans)
    clean = found.withColumn("text", secrets.masked(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long"))
                                 .otherwise(F.col("n_chars")))
    return clean.select(*columns_of(docs))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, their number and digests of the round trip."""
    coded = bpe.add_tokens(docs.select("doc_id", "text"), str(public_tokenizers.path(BPE_FILE)), digests=True)
    return coded.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage), ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage), ("secrets", secret_stage), ("tokens", token_stage),
]
#: A trained model, hashes with a seed, BM25 and BPE merges: no SQL. tests/llm holds the stages
#: against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
