"""The CRF against enumeration, held-out accuracy, defined results."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewshift.llm import queries, quality
from tests.conftest import SF_CHECK


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    each, step = np.array([3, 1, 5, 2]), rng.normal(size=(2, 2))
    good = rng.normal(size=each.sum())
    prob, pairs, log_z = quality.marginals(good, step, each)
    want, want_pairs, want_z, at = [], np.zeros((2, 2)), [], 0
    for n in each:
        own = good[at:at + n]
        weight = {y: np.exp(sum(own[i] * y[i] for i in range(n)) + sum(step[a, b] for a, b in zip(y, y[1:])))
                  for y in product((0, 1), repeat=int(n))}
        z = sum(weight.values())
        want_z.append(np.log(z))
        want += [sum(w for y, w in weight.items() if y[i]) / z for i in range(n)]
        for y, w in weight.items():
            for a, b in zip(y, y[1:]):
                want_pairs[a, b] += w / z
        at += n
    assert np.allclose(prob, want) and np.allclose(pairs, want_pairs) and np.allclose(log_z, want_z)


def test_held_out_accuracy(spark):
    scored = queries.op1_quality(spark, SF_CHECK)
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    rows = scored.join(labels, "doc_id").filter("held_out").select("predicted", "quality").collect()
    assert np.mean([r[0] == r[1] for r in rows]) >= 0.95
    assert scored.count() == spark.read.parquet(f"{SF_CHECK}/documents.parquet").count()


def test_awkward_rows(spark, awkward, empty):
    model = quality.train(["good line of words here\nand another", "BAD!! BAD!! BAD!!"] * 3, [1, 0] * 3, rounds=50)
    rows = quality.add_scores(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    same = {r["score"] for r in rows if not r["text"]}
    assert len(same) == 1  # null and empty alike
    assert quality.add_scores(empty, model).count() == 0


@pytest.mark.parametrize("ys", [[], [1, 1]])
def test_one_label_or_none(ys):
    model = quality.train(["a", "b"][:len(ys)], ys)
    assert np.allclose(model.score(["x", ""]), 0.5 if not ys else 1, atol=1e-3)


def test_labels_are_optional(spark, awkward):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert quality.fit(awkward, labels).score([""])[0] == pytest.approx(0.5)


def test_training_draws_from_whole_texts(spark):
    """A stretch is contiguous, whole texts stay whole, and every place of a long text is drawn for some id."""
    long = "\n".join(f"line {i}" for i in range(200))
    wide = "".join(chr(0x4E00 + i) for i in range(500))
    df = spark.range(600).select("id", F.when(F.col("id") % 3 == 0, long).when(F.col("id") % 3 == 1, wide).otherwise("a\nb\n").alias("t"))
    rows = df.select("id", "t", quality.stretch(F.col("t"), F.col("id"), 20, 100).alias("s")).collect()
    firsts = set()
    for r in rows:
        assert r["s"] in r["t"] and len(r["s"]) <= 100 and r["s"].count("\n") < 20
        if r["id"] % 3 == 2:
            assert r["s"] == r["t"]
        else:
            assert len(r["s"]) == 100
            firsts.add((r["id"] % 3, r["t"].index(r["s"]) * 8 // len(r["t"])))
    assert len(firsts) > 12


def test_a_bad_end_is_learned(spark):
    """Texts that are bad only behind their first sixty lines still teach what is bad."""
    good = "a quiet line of ordinary words, which ends well.\n"
    bad = "BUY!!! CLICK $$$ NOW!!! 999 >>> !!!\n"
    docs = spark.createDataFrame([(i, good * 30 if i % 2 else good * 60 + bad * 300) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert model.score([good * 5])[0] > 0.5 > model.score([bad * 5])[0]
