"""CSV / text / parquet readers and writers of the review tables."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..operators import curate
from ..session import checkpoint_dir

RAW_SCHEMA = T.StructType([
    T.StructField("review_text", T.StringType()), T.StructField("rating", T.IntegerType()),
    T.StructField("product_name", T.StringType()), T.StructField("review_date", T.StringType()),
    T.StructField("reviewer_name", T.StringType()), T.StructField("source_platform", T.StringType()),
    T.StructField("source_seq", T.IntegerType()), T.StructField("row_seq", T.LongType()),
])

CSV_READ = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"',
            "inferSchema": "false", "mode": "PERMISSIVE"}
CSV_WRITE = {"header": "true", "escape": '"', "quote": '"', "quoteAll": "true",
             "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _not_utf8(df: DataFrame) -> list[str]:
    """Files of ``df`` that hold U+FFFD, which Spark puts for invalid UTF-8."""
    hit = F.lit(False)
    for c in df.columns:
        hit = hit | F.coalesce(F.col(f"`{c}`").contains("\ufffd"), F.lit(False))
    return [r[0] for r in df.filter(hit).select("_metadata.file_path").distinct().collect()]


def _missing(e: AnalysisException) -> bool:
    return e.getCondition() == "PATH_NOT_FOUND"


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8",
             fallback: str | None = "ISO-8859-1") -> DataFrame | None:
    """Header CSV with quoted newlines, all columns as strings.

    A missing path gives None. Spark does not fail on invalid UTF-8, it
    yields U+FFFD, so the latin-1 fallback re-reads the files that hold
    that character, and those only.
    """
    try:
        df = spark.read.options(**CSV_READ).option("encoding", encoding).csv(path)
        df.schema  # noqa: B018  (resolves the path)
    except AnalysisException as e:
        if _missing(e):
            return None
        raise
    if fallback and encoding.upper().replace("-", "") == "UTF8" and (bad := _not_utf8(df)):
        again = spark.read.schema(df.schema).options(**CSV_READ).option("encoding", fallback).csv(bad)
        df = df.filter(~F.col("_metadata.file_path").isin(bad)).unionByName(again)
    return df


def read_reviews_csv(spark: SparkSession, path: str, platform: str, source_seq: int = 0,
                     encoding: str = "UTF-8") -> DataFrame:
    """One platform's review CSV conformed to RAW (+ order keys).

    ``row_seq`` is taken at read time: a multiLine CSV file is one
    unsplit partition, so the id follows file order.
    """
    df = read_csv(spark, path, encoding)
    if df is None:
        return spark.createDataFrame([], RAW_SCHEMA)
    df = curate.null_na_tokens(df)
    df = df.withColumn("source_seq", F.lit(source_seq)).withColumn("row_seq", F.monotonically_increasing_id())
    return curate.conform_platform(df, platform)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", encoding: str = "UTF-8") -> str:
    """Header CSV (RFC 4180 quoting). Spark writes no BOM."""
    df.write.mode(mode).options(**CSV_WRITE).option("encoding", encoding).csv(path)
    return path


def write_splits(df: DataFrame, path: str) -> str:
    """One directory per platform x condition x split (partition pruning
    on read)."""
    df.write.mode("overwrite").partitionBy("source_platform", "condition", "split").parquet(path)
    return path


def read_split(spark: SparkSession, path: str, platform: str, condition: str, split: str) -> DataFrame:
    """One split -> (text, label id); the filters prune to one directory."""
    from ..operators.model import _label_id
    df = spark.read.parquet(path).where(
        (F.col("source_platform") == platform) & (F.col("condition") == condition) & (F.col("split") == split))
    return df.select(*[c for c in ("source_seq", "row_seq") if c in df.columns],
                     "review_text_clean", _label_id("sentiment_label").alias("label_id"))


def read_line_list(spark: SparkSession, path: str) -> DataFrame:
    """Text list, trimmed, without blank and '#' lines."""
    t = spark.read.text(path).select(tx.strip("value").alias("line"))
    return t.filter((F.col("line") != "") & ~F.col("line").startswith("#"))


def append_rows(df: DataFrame, path: str) -> str:
    """Append a batch of rows to the stored table. The committer shows
    a batch's files only when the whole batch is written."""
    df.write.mode("append").parquet(path)
    return path


def count_rows(spark: SparkSession, path: str) -> DataFrame:
    """Stored records (not physical lines), 0 when nothing is stored."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if not _missing(e):
            raise
        return spark.range(1).select(F.lit(0).cast("long").alias("n_rows"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"))
