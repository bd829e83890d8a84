"""Exact top-k against brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from reviewshift.llm import queries, topk
from tests.conftest import SF_CHECK


def brute(rows, k=10):
    """rows: (id, vector); result rows for ids divisible by 100, equal query rows once."""
    good = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(1024 * x) for x in v]))
    out = []
    for q, qv in sorted({(i, tuple(v)) for i, v in good if i is not None and i % 100 == 0}):
        found = [(-max(min(sum(a * b for a, b in zip(v, qv)), topk.LONG), -topk.LONG), i is None, i) for i, v in good if i != q]
        found = sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k]
        out += [(q, n + 1, i, -s) for n, (s, _, i) in enumerate(found)]
    return sorted(out, key=str)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string, id int, dist double")


def searched(df, **how):
    return sorted(map(tuple, topk.search(df, F.col("id") % 100 == 0, **how).collect()), key=str)


@pytest.mark.parametrize("query_block", [2000, 3])
def test_equals_brute_force(spark, query_block):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [(300, rows[300][1]), (5000, None), (5100, []), (5200, [1.0, None]), (5300, [float("nan")] * 8),
             (5400, [float("inf")] + [0.0] * 7), (None, rows[5][1]), (5500, [0.5, 0.25])]
    rng.shuffle(rows)
    df = vectors(spark, [(*r, "x", 1, 0.0) for r in rows]).repartition(5)
    assert searched(df, query_block=query_block) == brute(rows)


def test_no_more_than_a_block_of_queries_is_held(spark, monkeypatch):
    sizes, plain = [], topk._block
    monkeypatch.setattr(topk, "_block", lambda rows, own, *a: sizes.append(len(own)) or plain(rows, own, *a))
    monkeypatch.setattr(topk, "BLOCK_BYTES", 8 * 10 * (8 + 4 + 1))  # ten queries
    rng, stats = random.Random(8), {}
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(0, 8000, 25)]
    df = vectors(spark, [(*r, "x", 1, 0.0) for r in rows])
    assert searched(df, n_pivots=4, stats=stats) == brute(rows)
    assert sum(sizes) == 80 and len(sizes) > 4 and max(sizes) < 30
    assert stats["pairs"] == 80 * 320 and 0 < stats["scored"] <= stats["pairs"]


def test_huge_components(spark):
    rows = [(i, [v, 1.0]) for i, v in enumerate([1e30, -1e30, 1e15, 2.5, 1e300, 0.1])] + [(100, [3.0, 2.0]), (200, [1e200, 0.0])]
    assert searched(vectors(spark, [(*r, "x", 1, 0.0) for r in rows])) == brute(rows)


def test_few_or_no_rows(spark):
    assert searched(vectors(spark, [])) == []
    assert searched(vectors(spark, [(100, [1.0], "x", 1, 0.0)])) == []
    got = searched(vectors(spark, [(100, [1.0], "x", 1, 0.0), (1, [2.0], "x", 1, 0.0), (2, [2.0], "x", 1, 0.0)]))
    assert [r[2] for r in got] == [1, 2]


def test_query_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_CHECK}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op9_topk(spark, SF_CHECK).collect()), key=str) == brute(rows)


def test_bounds_spare_evaluations():
    import numpy as np
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(20, 6)) * 4000
    x = np.floor(centre[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 6)) * 100)
    pivots = topk.choose_pivots(x, 16)
    seen, plain = [], topk.scores
    try:
        topk.scores = lambda a, q: seen.append(len(a)) or plain(a, q)
        best = topk.Best(np.array([0]), x[:1], topk.distances(x[:1], pivots), 10)
        best.add(np.arange(4000), np.zeros(4000, bool), x, topk.distances(x, pivots))
    finally:
        topk.scores = plain
    assert sum(seen) < 2000
    want = sorted((-int(s), i) for i, s in enumerate(x @ x[0]) if i)[:10]
    assert [(s, i) for s, _, i in best.found[0]] == want
