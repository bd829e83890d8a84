"""Moves, shares and slots of the hash tree."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewshift.llm import queries, sharding
from tests.conftest import SF_CHECK


def ids(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))


def test_growth_moves_rows_only_into_the_new_shard(spark):
    for n in (40, 41, 45):
        rows = sharding.assign(ids(spark, 20_000), n).collect()
        moved = [r for r in rows if r["shard"] != r["grown_shard"]]
        assert {r["grown_shard"] for r in moved} == {n}
        assert abs(len(moved) / len(rows) - 1 / (n + 1)) < 0.006
        again = {r["doc_id"]: r["shard"] for r in sharding.assign(ids(spark, 20_000), n + 1).collect()}
        assert all(again[r["doc_id"]] == r["grown_shard"] for r in rows)


def test_shares_follow_weights(spark):
    shape = sharding.Tree((((1.0, 3.0), (2.0,)), ((4.0, 1.0, 1.0),)))
    rows = sharding.with_shard(ids(spark, 60_000), F.col("doc_id").cast("string"), shape, "s").groupBy("s").count().collect()
    got = {r["s"]: r["count"] / 60_000 for r in rows}
    assert all(abs(got[i] - w) < 0.01 for i, w in enumerate(sharding.expected_share(shape)))


def test_changed_weight_moves_rows_on_its_path_only(spark):
    old = sharding.Tree((((1.0, 1.0), (1.0, 1.0)), ((1.0, 1.0), (1.0, 1.0))))
    new = sharding.Tree((((1.0, 2.0), (1.0, 1.0)), ((1.0, 1.0), (1.0, 1.0))))
    key = F.col("doc_id").cast("string")
    moved = (sharding.with_shard(sharding.with_shard(ids(spark, 20_000), key, old, "a"), key, new, "b")
             .filter("a <> b").select("a", "b").distinct().collect())
    # the weight of shard 1 grows: no moves within region 1, within rack 1, or out of region 0
    for a, b in moved:
        assert b < 4
        assert not (a in (2, 3) and b in (2, 3))


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()}
    rows = queries.op2_sharding(spark, SF_CHECK).collect()
    assert len(rows) == len(docs)
    slots = {}
    for r in rows:
        text = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text) + 16, zlib.crc32(text), "key")
        assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_no_python_in_the_plan(spark):
    plan = queries.op2_sharding(spark, SF_CHECK)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_awkward_rows(spark, awkward, empty):
    rows = sharding.assign(awkward, 40).collect()
    assert len(rows) == awkward.count()
    assert len({r["shard"] for r in rows if r["doc_id"] == 5}) == 1
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    for shard, n in Counter(r["shard"] for r in rows).items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    sizes = {r["size"] for r in rows if r["doc_id"] in (2, 3)}
    assert sizes == {16}
    assert sharding.assign(empty, 40).count() == 0


def test_one_growth_rule_for_all_counts(spark):
    """Fewer than 40 shards: the caller's tree grows shard by shard, also past 40, and only the new shard takes rows."""
    start = sharding.Tree((((1.0, 1.0), (1.0,)), ((2.0,),)))
    with pytest.raises(ValueError):
        sharding.assign(ids(spark, 10), 39)
    for n in (4, 39, 40):
        rows = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in sharding.assign(ids(spark, 4000), n, shape=start).collect()}
        again = {r["doc_id"]: r["shard"] for r in sharding.assign(ids(spark, 4000), n + 1, shape=start).collect()}
        assert all(again[i] == g and g in (s, n) for i, (s, g) in rows.items())
