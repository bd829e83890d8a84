"""Registered queries: key -> (Spark callable, DuckDB oracle SQL or None).

Keys follow the operator inventory. Each Spark callable takes
(spark, sf_dir) and reads the driver tables (or data Spark derives from
them); each SQL runs in DuckDB over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import label as lb
from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import curate, metrics
from ..sources import fixtures as fx
from . import experiment as ex
from . import sqlgen as sg

from .registry import REGISTRY, Q, register


W = sg.with_

# --- MVP / master ------------------------------------------------------------------

register("master_counts", W(sg.master_ctes() + sg.clean_ctes(), """
SELECT source_platform, condition, label, count(*) AS n FROM cleaned GROUP BY ALL"""))(
    lambda spark, sf: ex.splits.dual_path_clean(ex.master(spark, sf))
    .groupBy("source_platform", "condition", "label").agg(F.count(F.lit(1)).alias("n")))

register("dedup_first", W(sg.master_ctes(), """
SELECT row_seq AS review_id, source_platform, rating FROM deduped"""))(
    lambda spark, sf: curate.dedup_first(curate.filter_noise(curate.conform_platform(
        fx.raw_reviews(spark, sf)))).select(F.col("row_seq").alias("review_id"), "source_platform",
                                            "rating"))

register("auto_label", W(sg.reviews_ctes(), f"""
SELECT review_id, {sg.label_case()} AS label FROM reviews"""))(
    lambda spark, sf: fx.reviews(spark, sf).select(
        "review_id", lb.auto_label("rating", "review_text").alias("label")))

register("downsample_to_median", W(sg.master_ctes(), """
SELECT row_seq AS review_id, label FROM master"""))(
    lambda spark, sf: ex.master(spark, sf).select(F.col("row_seq").alias("review_id"), "label"))

register("dual_path_clean", W(sg.reviews_ctes() + sg.clean_ctes("reviews"), """
SELECT review_id, condition, review_text_clean FROM cleaned"""))(
    lambda spark, sf: ex.splits.dual_path_clean(fx.reviews(spark, sf))
    .select("review_id", "condition", "review_text_clean"))

register("stratified_split", W(sg.experiment_ctes(), """
SELECT source_platform, condition, split, sentiment_label, count(*) AS n FROM splits GROUP BY ALL"""))(
    lambda spark, sf: ex.experiment_splits(spark, sf)
    .groupBy("source_platform", "condition", "split", "sentiment_label").agg(F.count(F.lit(1)).alias("n")))

register("split_membership", W(sg.experiment_ctes(), """
SELECT row_seq AS review_id, condition, split FROM splits"""))(
    lambda spark, sf: ex.experiment_splits(spark, sf)
    .select(F.col("row_seq").alias("review_id"), "condition", "split"))

register("loso_matrix", W(sg.experiment_ctes() + sg.nb_ctes() + [sg.cells_cte()], f"""
SELECT {sg.initcap('train_src')} AS train_src, {sg.initcap('test_src')} AS test_src,
       {sg.initcap('condition')} AS condition,
       n, accuracy, f1_macro, f1_negatif, f1_netral, f1_positif,
       CASE WHEN train_src = test_src THEN 'In-Domain' ELSE 'Cross-Platform' END AS eval_type
FROM (""" + sg.scores_select("train_src, test_src, condition") + ")"))(
    lambda spark, sf: ex.loso_matrix(spark, sf))


from . import q_text, q_shift, q_eval, q_sources, q_stream, q_lookup, q_features  # noqa: E402,F401  (register more keys)


def queries() -> dict[str, Q]:
    return {k: fn for k, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in REGISTRY.items() if sql is not None}


__all__ = ["REGISTRY", "queries", "oracle_sql", "register", "lx", "tx", "metrics"]
