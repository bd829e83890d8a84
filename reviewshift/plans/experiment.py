"""The study's end-to-end plans: master table, splits, models, LOSO grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..operators import curate, metrics, model, splits
from ..session import cut_lineage
from ..sources import fixtures as fx

DOC_KEYS = ["source_seq", "row_seq"]
GRID = ["train_src", "test_src", "condition"]


def master(spark: SparkSession, sf_dir: str, mode: str = "multi",
           materialize: bool = True) -> DataFrame:
    """3.1: conform -> denoise -> dedup -> label -> downsample.

    The labelled, deduplicated table is read twice by the downsampling
    (class sizes, ranks), so it is checkpointed first; the study writes
    its master table to storage at this point as well.
    """
    raw = fx.raw_reviews(spark, sf_dir)
    df = curate.union_platforms([curate.conform_platform(raw)])
    df = curate.with_label(curate.dedup_first(curate.filter_noise(df, mode)))
    if materialize:
        df = cut_lineage(df)
    return curate.downsample_to_median(df) if mode == "multi" else df


def cleaned(spark: SparkSession, sf_dir: str, stoplist=None, materialize: bool = True, raw_text: bool = True) -> DataFrame:
    """Both cleaning paths of the master table, in the split schema (+ keys); ``raw_text=False`` leaves the
    uncleaned text out, which would be written once for each path."""
    m = master(spark, sf_dir, materialize=materialize)
    c = splits.split_projection(splits.dual_path_clean(m, stoplist=stoplist, raw_text=raw_text))
    return cut_lineage(c) if materialize else c


def experiment_splits(spark: SparkSession, sf_dir: str, materialize: bool = True, raw_text: bool = True) -> DataFrame:
    """3.2: the 12 split tables as one frame keyed by platform/condition/split,
    checkpointed: training and every test set read it again. Models need no ``raw_text``."""
    s = splits.stratified_split(cleaned(spark, sf_dir, materialize=materialize, raw_text=raw_text))
    return cut_lineage(s) if materialize else s


def loso_predictions(spark: SparkSession, sf_dir: str, split_df: DataFrame | None = None) -> DataFrame:
    """Every test review scored by every model of its condition."""
    s = split_df if split_df is not None else experiment_splits(spark, sf_dir, raw_text=False)
    train = s.filter(F.col("split") == "train")
    tok_model, priors = model.materialize_model(*model.nb_train(train))
    # the truth (test platform, label id) rides through the scoring: no join back
    test = s.filter(F.col("split") == "test").select(
        *DOC_KEYS, "condition", "review_text_clean", F.col("source_platform").alias("test_src"),
        model._label_id().alias("label_id"))
    return model.nb_score(test, tok_model, priors, DOC_KEYS, carry=("test_src", "label_id"))


def title_case(df: DataFrame, cols=("train_src", "test_src", "condition")) -> DataFrame:
    """Platform / condition names in Title Case for the result tables."""
    return df.select(*[F.initcap(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def loso_matrix(spark: SparkSession, sf_dir: str, split_df: DataFrame | None = None) -> DataFrame:
    """F10 (flagship): condition x train x test with accuracy and F1s."""
    preds = loso_predictions(spark, sf_dir, split_df)
    wide = metrics.confusion_wide(preds, GRID)
    out = metrics.scores_from_cells(wide, GRID)
    out = out.withColumn("eval_type", F.when(F.col("train_src") == F.col("test_src"), "In-Domain")
                         .otherwise("Cross-Platform"))
    return title_case(out)


def loso_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    preds = loso_predictions(spark, sf_dir)
    return title_case(metrics.confusion_cells(preds, GRID))


__all__ = ["master", "cleaned", "experiment_splits", "loso_predictions", "loso_matrix",
           "loso_cells", "title_case", "lx"]
