"""Foreign review schemas -> the RAW review table, and their union."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import label as lb
from ..functions import text as tx
from ..operators import curate


log = logging.getLogger(__name__)


def _raw(text, rating, product, date, reviewer, platform="shopee") -> list:
    return [text.alias("review_text"), rating.alias("rating"), F.lit(product).alias("product_name"),
            date.alias("review_date"), reviewer.alias("reviewer_name"), F.lit(platform).alias("source_platform")]


def adapt_appstore(df: DataFrame, product: str = "shopee_app") -> DataFrame:
    """S3: content/score/at/userName; ``at`` parsed leniently -> yyyy-MM-dd or null."""
    keep = [c for c in ("source_seq", "row_seq") if c in df.columns]
    return df.select(*_raw(F.col("content"), F.col("score"), product, tx.normalize_date("at"),
                           F.col("userName")), *keep)


def adapt_binary_label(df: DataFrame, product: str = "marketplace_generic") -> DataFrame:
    """reviews/label with label 0 -> 1 star, 1 -> 5 stars, else 3."""
    keep = [c for c in ("source_seq", "row_seq") if c in df.columns]
    return df.select(*_raw(F.col("reviews"), lb.binary_to_rating("label"), product, F.lit("unknown"),
                           F.lit("anonymous")), *keep)


def adapt_product_review(df: DataFrame, product: str = "shopee_product") -> DataFrame:
    """comment/rating/username with a missing username -> anonymous."""
    keep = [c for c in ("source_seq", "row_seq") if c in df.columns]
    return df.select(*_raw(F.col("comment"), F.col("rating"), product, F.lit("unknown"),
                           F.coalesce(F.col("username"), F.lit("anonymous"))), *keep)


def load_sources(loaders: dict[str, Callable[[], DataFrame]]) -> list[DataFrame]:
    """The sources that can be read, in order. One whose path or columns are missing is
    reported and left out; faults in its rows are not met here, as nothing is run."""
    frames = []
    for name, load in loaders.items():
        try:
            df = load()
            df.schema  # noqa: B018  (resolves paths and columns)
        except AnalysisException as e:
            log.warning("source %s left out: %s", name, e)
            continue
        frames.append(df)
    return frames


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Concat the adapted sources in list order (source_seq = position),
    drop null/blank texts, keep the first copy of each text, rating as int.
    A source that failed to load is not in ``frames`` (``load_sources``)."""
    if not frames:
        raise ValueError("no source could be loaded")
    tagged = [f.withColumn("source_seq", F.lit(i)) for i, f in enumerate(frames)]
    u = reduce(lambda a, b: a.unionByName(b), tagged)
    u = u.filter(F.col("review_text").isNotNull() & ~tx.is_blank("review_text"))
    u = curate.dedup_first(u)
    return u.withColumn("rating", F.col("rating").cast("int"))
