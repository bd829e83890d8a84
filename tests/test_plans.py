"""Plan-shape guards for headline queries (cheap: sf0.001, planning only
after the lineage cuts the queries make themselves)."""

from __future__ import annotations

import re

import pytest

from conftest import SF_SMALL
import __spark_entry__ as E

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["loso_matrix", "dual_path_clean", "score_reviews", "jensen_shannon",
                                 "stratified_split", "build_vocab", "tfidf_features"])
def test_no_pairwise_joins_or_python_in_hot_paths(spark, key):
    p = _plan(E.queries()[key](spark, SF_SMALL))
    assert not [w for w in FORBIDDEN if w in p]


def test_document_scan_is_pruned(spark):
    p = _plan(E.queries()["dual_path_clean"](spark, SF_SMALL))
    schemas = re.findall(r"documents\.parquet.*?ReadSchema: (struct<[^>]*>)", p)
    assert schemas and all("lang" not in s and "n_chars" not in s for s in schemas)


def test_both_cleaning_paths_from_one_scan(spark):
    p = _plan(E.queries()["dual_path_clean"](spark, SF_SMALL))
    assert p.count("FileScan parquet") == 1 and "Generate explode" in p


def test_evaluation_scores_once(spark):
    p = _plan(E.queries()["evaluate_model"](spark, SF_SMALL))
    assert len(re.findall(r"Scan parquet[^\n]*nb-model", p)) == 1


def test_smoothing_rounds_are_columns_behind_the_join(spark):
    """The rounds fan out once, after the validation tokens have met the model."""
    p = _plan(E.queries()["best_model_select"](spark, SF_SMALL))
    assert not [w for w in FORBIDDEN if w in p]
