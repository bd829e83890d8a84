"""Hard-negative mining against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewshift.llm import hard_negatives as hn
from reviewshift.llm import queries
from reviewshift.llm.topk import LONG
from tests.conftest import SF_CHECK


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95):
    """rows: (id, vector, label)."""
    good = [(i, tuple(math.floor(256 * x) for x in v), l) for i, v, l in rows if l is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    first = lambda fs, k: sorted(fs, key=lambda f: (-f[1], f[0] is None, f[0] or 0))[:k]
    for a, q, label in sorted({r for r in good if r[0] is not None and r[0] % every == 0}, key=str):
        scored = [(i, max(min(sum(x * y for x, y in zip(v, q)), LONG), -LONG), l) for i, v, l in good if i != a]
        for p, ps, _ in first([s for s in scored if s[2] == label], positives):
            own = first([s for s in scored if s[2] != label and low * ps <= 100 * s[1] <= high * ps], negatives)
            out += [(a, p, k + 1, i, ps, s) for k, (i, s, _) in enumerate(own)]
    return sorted(out, key=str)


def mined(spark, rows, parts=4, **how):
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows],
                               "vec_id long, embedding array<double>, label int, id string, score double").repartition(parts)
    return sorted(map(tuple, hn.mine(df, F.col("id") % 50 == 0, **how).collect()), key=str)


def clustered(rng, n, width=8):
    centre = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    return [(i, [c + rng.gauss(0, 0.6) for c in centre[k]], rng.choice([k % 4, k % 4, 9]))
            for i in range(n) for k in [rng.randrange(6)]]


@pytest.mark.parametrize("anchor_block", [2000, 5])
def test_equals_brute_force(spark, anchor_block):
    rng = random.Random(1)
    rows = clustered(rng, 900)
    rows += [(2000 + i, rows[7][1], 3) for i in range(40)] + [(2100 + i, rows[8][1], rows[8][2]) for i in range(10)]  # ties
    rows += [(100, rows[100][1], rows[100][2]), (150, rows[3][1], 2), (None, rows[5][1], 1), (None, rows[5][1], 0),
             (5000, None, 1), (5050, [], 1), (5100, [1.0, None], 1), (5150, [float("nan")] * 8, 1),
             (5200, [float("inf")] + [0.0] * 7, 1), (5250, [1.0] * 8, None), (5300, [0.5, 0.25], 2), (7, rows[7][1], rows[7][2])]
    rng.shuffle(rows)
    want = brute(rows)
    assert len(want) > 100 and mined(spark, rows, anchor_block=anchor_block) == want


def test_other_counts_and_windows(spark):
    rows = clustered(random.Random(2), 400, width=5)
    assert mined(spark, rows, positives=2, negatives=7, low=10, high=130, codewords=3) == brute(rows, 50, 2, 7, 10, 130)


def test_huge_components(spark):
    rows = [(i, [v, 1.0], i % 2) for i, v in enumerate([1e30, -1e30, 1e15, 2.5, 1e300, 0.1, 3.0, 2.0])]
    rows += [(100, [3.0, 2.0], 0), (150, [1e200, 0.0], 1), (200, [1e8, 1e8], 0), (250, [0.4, 0.1], 1)]
    assert mined(spark, rows) == brute(rows)


def test_few_or_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(50, [1.0], 1)]) == []
    assert mined(spark, [(50, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (3, [1.0], 2)]) == [(50, 1, 1, 2, 65536, 58880)]
    assert mined(spark, [(50, [1.0], 1), (1, [-1.0], 1), (2, [-0.9], 2)]) == []  # no window below zero


def test_multi_sequence_gives_sums_in_order():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (1, 9), (9, 1), (7, 12), (0, 3)):
        a, b = -np.sort(-rng.normal(size=n)), -np.sort(-rng.normal(size=m))
        got = list(hn.multi_sequence(a, b))
        assert sorted((i, j) for _, i, j in got) == [(i, j) for i in range(n) for j in range(m)]
        sums = [s for s, _, _ in got]
        assert sums == sorted(sums, reverse=True)


def test_certified_searches_spare_rows():
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(40, 8)) * 1000
    x = np.floor(centre[rng.integers(0, 40, 20_000)] + rng.normal(size=(20_000, 8)) * 30)
    books = hn.codebook(x[:2000, :4], 16), hn.codebook(x[:2000, 4:], 16)
    codes = np.stack((hn.nearest(x[:, :4], books[0]), hn.nearest(x[:, 4:], books[1])), axis=1)
    labels = np.array(["a", "b"] * 10_000, object)
    cells = hn.Cells(np.arange(20_000), np.zeros(20_000, bool), labels, x, codes, books)
    want = hn.Positives("a", 5)
    cells.search(0, x[0], want)
    brute = sorted((-int(s), False, i) for i, s in enumerate(x @ x[0]) if i % 2 == 0 and i)[:5]
    assert want.found == brute and cells.scored < 5000


def test_query_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"])
            for r in spark.read.parquet(f"{SF_CHECK}/embeddings.parquet").collect()]
    want = brute(rows)
    assert want and sorted(map(tuple, queries.op11_hard_negatives(spark, SF_CHECK).collect()), key=str) == want
