"""The pipeline's stages against brute-force versions, each on its own input."""

from __future__ import annotations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from reviewshift.llm import queries
from tests.conftest import SF_CHECK
from tests.llm.test_secrets import plain_spans
from tests.llm.test_simhash import plain_components, plain_fingerprint


@pytest.fixture(scope="module")
def stages(spark, scratch):
    """Rows of documents and of each stage, by doc_id."""
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(cp.STAGES):
        done = stage(spark, docs, SF_CHECK)
        if k + 1 < len(cp.STAGES):
            assert done.schema == docs.schema
        done.write.parquet(path := f"{scratch}/pipeline-{k}")
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return [{r["doc_id"]: r for r in rows} for rows in out]


def test_quality_goes_by_the_classifier(spark, stages):
    predicted = {r["doc_id"]: r["predicted"] for r in queries.op1_quality(spark, SF_CHECK).collect()}
    assert stages[1] == {i: r for i, r in stages[0].items() if predicted[i]}
    assert 0 < len(stages[1]) < len(stages[0])


def test_one_document_of_each_group(stages):
    rows = [(i, plain_fingerprint(r["text"])) for i, r in stages[1].items()]
    kept = {c for _, _, c in plain_components(rows)}
    assert stages[2] == {i: r for i, r in stages[1].items() if i in kept} and len(kept) < len(rows)


def test_leaks_go(spark, stages):
    items = [r["text"] for r in spark.read.parquet(f"{SF_CHECK}/benchmark.parquet").collect()]
    clean = {i: r for i, r in stages[2].items() if not any(t in r["text"] for t in items)}
    assert stages[3] == clean and len(clean) < len(stages[2])


def test_secrets_are_masked(stages):
    assert stages[4].keys() == stages[3].keys()
    for i, r in stages[4].items():
        old = stages[3][i]
        assert not plain_spans(r["text"])
        if not plain_spans(old["text"]) and r["text"] == old["text"]:
            assert r == old
        else:
            assert r["n_chars"] == len(r["text"]) and "[secret]" in r["text"]


def test_tokens(stages):
    library = Tokenizer.from_file(str(public_tokenizers.path(cp.BPE_FILE)))
    assert stages[5].keys() == stages[4].keys()
    for i, r in stages[5].items():
        assert r["ids"] == library.encode(stages[4][i]["text"], add_special_tokens=False).ids
        assert r["n_tokens"] == len(r["ids"])


def test_run_equals_its_stages(spark, stages):
    assert {r["doc_id"]: r for r in cp.run(spark, SF_CHECK).collect()} == stages[5]


def test_awkward_rows(spark, empty):
    rows = [(1, "Some words in a line.\nMore of them here.", "en", "s", 40), (1, "Some words in a line.\nMore of them here.", "en", "s", 40),
            (None, None, None, None, None), (2, None, "en", None, 0), (3, "", None, "s", 0), (None, "no id", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES[:-1]:
        done = stage(spark, docs, SF_CHECK)
        assert done.columns == docs.columns and done.count() <= len(rows)
    assert cp.STAGES[-1][1](spark, docs, SF_CHECK).count() == len(rows)
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF_CHECK).count() == 0, name


def test_columns_with_names_of_the_operators_stay(spark):
    """Names that the stages use themselves, and a dotted one."""
    rows = [(1, "one two three four five six", "a", "b", "c", "d", "e"), (2, "", "f", "g", "h", "i", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text_hash string, _row_id string, _leaks string, "
                                       "_leaks_0 string, `a.b` string")
    for stage in (cp.near_duplicate_stage, cp.decontamination_stage, cp.secret_stage):
        done = stage(spark, docs, SF_CHECK)
        assert done.schema == docs.schema and sorted(map(tuple, done.collect())) == rows
