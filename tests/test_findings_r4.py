"""Findings of round 4: what is broadcast, and how many rows a Python task holds at once."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from reviewshift.llm import simhash
from reviewshift.operators import features, vocab


def _broadcasts(df) -> list[str]:
    """What each broadcast of the plan reads, as the planner chose it before a row was read."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return [line for line in plan.splitlines() if re.search(r"BroadcastHashJoin|BroadcastNestedLoopJoin", line)]


def test_exploded_fingerprints_are_not_broadcast(spark, scratch):
    """the planner takes 33 probes a segment for the size of one row."""
    path = f"{scratch}/few-prints"
    spark.range(20_000).selectExpr("id", "xxhash64(id) AS fp").write.parquet(path)
    prints = spark.read.parquet(path)
    joins = _broadcasts(simhash.link(prints.select("fp").distinct()))
    # only the segment values that over ``bucket`` fingerprints share may go to every task
    assert all("LeftSemi" in j for j in joins), joins


def _lists(rows):
    return pa.array(rows, pa.list_(pa.string()))


def test_terms_are_counted_in_pieces_of_bounded_bytes(monkeypatch):
    """terms take far more than their texts, so few texts are taken apart at once, whatever the batch."""
    rows = [["a b a"], [], ["x" * 500 + " y"], [None, "b"], *[["c d", "d c"]] * 40]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), _lists(rows)], names=["id", "_texts"])
    monkeypatch.setattr(features, "TERM_BYTES", 64)
    cut = list(features._pieces(b, 1))
    assert [i for x in cut for i in x.column(0).to_pylist()] == list(range(len(rows)))
    held = [[len(t or "") for r in x.column(1).to_pylist() for t in r] for x in cut]
    assert len(cut) > 3 and all(sum(h) <= 64 + max(h) for h in held)


def test_term_counts_of_texts():
    """bigrams are counted by token numbers and reach over no text's end, no empty text, no null."""
    rows = [["a b a b", "b"], [], [None, ""], ["b a  c"], ["c"]]
    names, row, code, count = features._term_counts(_lists(rows))
    names = names.to_pylist()
    got = [(r, names[c], n) for r, c, n in zip(row.tolist(), code.tolist(), count.tolist())]
    assert len(names) == len(set(names)) and row.tolist() == sorted(row.tolist())
    assert sorted(got) == [(0, "a", 2), (0, "a b", 2), (0, "b", 3), (0, "b a", 1),
                           (3, "a", 1), (3, "a c", 1), (3, "b", 1), (3, "b a", 1), (3, "c", 1), (4, "c", 1)]
    empty = features._term_counts(_lists([[], []]))
    assert [len(x) for x in empty] == [0, 0, 0, 0]


def test_texts_not_terms_go_to_python(spark):
    """the JVM made every term of a batch of documents, and sent it, before one was counted."""
    df = spark.createDataFrame([("k", 1, "a b"), ("k", 2, "b c")], "k string, d long, review_text_clean string")
    plan = features.term_stats(df, ["k"], ["d"])._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "split(" not in plan


def test_gradients_in_slices_of_few_values():
    """a slice is bounded by its values too, not by its rows alone."""
    sizes = np.array([5, 1, 300, 2, 2, 90, 10])
    cut = list(vocab.runs(sizes, 100))
    assert [i for at, n in cut for i in range(at, at + n)] == list(range(len(sizes)))
    assert all(sizes[at:at + n].sum() < 100 + sizes[at:at + n].max() for at, n in cut)
    assert list(vocab.runs(np.array([], np.int64), 100)) == []
