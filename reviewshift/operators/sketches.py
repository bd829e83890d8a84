"""A8 / O6 at stream scale: vocabulary overlap from theta sketches.

A sketch of a platform's words is one binary row that merges with others of the
platform (another day, another task), so overlap rates of a growing corpus need
no second look at old texts. ``2 ** lg_k`` hashes are kept of each vocabulary:
up to that many distinct words the counts are exact, beyond it the share of
words that are missing has a standard error of about sqrt(r (1 - r) / k) with k
the hashes that are left for it; ``overlap`` states three of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shift

LG_K = 14


def vocab_sketches(df: DataFrame, text: str = "review_text", group: str = shift.PLATFORM, lg_k: int = LG_K) -> DataFrame:
    """(group, sketch, n_tokens): words are hashed into a sketch in every task, so no word is shuffled."""
    return shift.words(df, text, group).groupBy(group).agg(
        F.theta_sketch_agg("word", lg_k).alias("sketch"), F.count(F.lit(1)).alias("n_tokens"))


def merge_sketches(tables: list[DataFrame], group: str = shift.PLATFORM, lg_k: int = LG_K) -> DataFrame:
    """Sketch tables of parts of a corpus as those of the whole."""
    every = reduce(DataFrame.unionByName, tables)
    return every.groupBy(group).agg(F.theta_union_agg("sketch", lg_k).alias("sketch"), F.sum("n_tokens").alias("n_tokens"))


def overlap(sketches: DataFrame, group: str = shift.PLATFORM, lg_k: int = LG_K, digits: int = 6) -> DataFrame:
    """(source, target, n_types, n_oov_types, oov_type_rate, rate_error) for each ordered pair of groups; a row a group,
    so the pairs are those of the platforms. ``rate_error`` bounds the rate with three standard errors, 0 if exact."""
    s = sketches.select(F.col(group).alias("source"), F.col("sketch").alias("_s"))
    t = sketches.select(F.col(group).alias("target"), F.col("sketch").alias("_t"))
    pairs = F.broadcast(s).join(t, F.col("source") != F.col("target"))
    est = F.theta_sketch_estimate
    out = pairs.select("source", "target", est("_t").alias("n_types"), est(F.theta_difference("_t", "_s")).alias("n_oov_types"),
                       est(F.theta_union("_t", "_s", lg_k)).alias("_union"))
    rate = F.when(F.col("n_types") > 0, F.col("n_oov_types") / F.col("n_types")).otherwise(0.0)
    # hashes below the union's threshold that belong to the target
    kept = F.greatest(F.lit(1.0), F.lit(float(1 << lg_k)) * F.col("n_types") / F.greatest(F.col("_union"), F.lit(1)))
    error = F.when(F.col("_union") <= (1 << lg_k), 0.0).otherwise(
        3 * F.sqrt(F.greatest(rate * (1 - rate), 1 / kept) / kept))
    return out.select("source", "target", "n_types", "n_oov_types", F.round(rate, digits).alias("oov_type_rate"),
                      F.round(error, digits).alias("rate_error"))
