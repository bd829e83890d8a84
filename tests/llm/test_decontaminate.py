"""Retrieval against exhaustive BM25, leaks against planted passages."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from reviewshift.llm import decontaminate as dc
from reviewshift.llm import queries
from tests.conftest import SF_CHECK


def items_df(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def plain_scores(items, query):
    """BM25 of every item, as a share of the item's score for its own text."""
    words = {i: dc.words_of(t.lower()) for i, t in items}
    mean = sum(map(len, words.values())) / len(words)
    out = {}
    for i, own in words.items():
        def weight(term):
            df = sum(term in w for w in words.values())
            tf = own.count(term)
            idf = math.log(1 + (len(words) - df + 0.5) / (df + 0.5))
            return idf * tf * (dc.K1 + 1) / (tf + dc.K1 * (1 - dc.B + dc.B * len(own) / mean))
        out[i] = sum(weight(t) for t in set(own) & set(query)) / sum(weight(t) for t in set(own))
    return out


def random_items(n):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    return [(i, " ".join(rng.choices(words, k=rng.randint(5, 30))) + ".") for i in range(n)], words, rng


def test_retrieval_equals_exhaustive_scoring(spark):
    items, words, rng = random_items(50)
    for shard_weight in (10**6, 120):
        shards = list(dc.build(items_df(spark, items), shard_weight=shard_weight))
        assert (len(shards) > 1) == (shard_weight == 120)
        for threshold in (0.3, 0.6):
            query = set(rng.choices(words, k=25))
            got = {}
            for s in shards:
                known = np.array([s.term[w] for w in query if w in s.term], np.int64)
                got |= {s.items[i][0]: v for i, v in s.retrieve(known, threshold)}
            want = {i: v for i, v in plain_scores(items, query).items() if v >= threshold}
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_planted_passages(spark):
    items, words, rng = random_items(30)
    noise = lambda n: " ".join(rng.choices(words, k=n))
    docs = [(k, f"{noise(rng.randint(0, 300))} {t.upper()} {noise(200)}") for k, (_, t) in enumerate(items)]
    docs += [(100 + k, noise(400)) for k in range(20)] + [(200, items[3][1]), (200, items[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for shard_weight in (10**6, 400):
        got = {tuple(r) for r in dc.leaks(df, items_df(spark, items), shard_weight=shard_weight)
               .select("doc_id", "item_id").collect()}
        want = set()
        for d, t in docs:
            padded = f" {' '.join(dc.words_of(t.lower()))} "
            want |= {(d, i) for i, own in items if f" {' '.join(dc.words_of(own.lower()))} " in padded}
        assert want <= got and not any(d in got for d in range(100, 120))
    assert dc.remove_leaks(df, items_df(spark, items)).count() == 20


def test_half_an_item_is_no_leak(spark):
    q, a = "one two three four five six seven eight.", "Nine ten eleven twelve thirteen fourteen."
    docs = spark.createDataFrame([(1, q), (2, a), (3, f"x {q} {a} y"), (4, f"{a} {q}")], "doc_id long, text string")
    got = [r["doc_id"] for r in dc.leaks(docs, items_df(spark, [(1, f"{q} {a}")])).collect()]
    assert sorted(got) == [3, 4]


def test_query_finds_every_verbatim_item(spark):
    read = lambda n: spark.read.parquet(f"{SF_CHECK}/{n}.parquet").collect()
    items, docs = read("benchmark"), read("documents")
    want = {(d["doc_id"], i["item_id"]) for d in docs for i in items if i["text"] in d["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op5_decontaminate(spark, SF_CHECK).collect()}
    assert want and got == want


def plain_leaks(docs, items):
    """Every window of every item in every document, scored and verified."""
    def weights():
        words = {i: dc.words_of(t.lower()) for i, t in items}
        mean, n = sum(map(len, words.values())) / len(words), len(words)
        df = {}
        for own in words.values():
            for w in set(own):
                df[w] = df.get(w, 0) + 1
        for i, own in words.items():
            w = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * own.count(t) * (dc.K1 + 1)
                 / (own.count(t) + dc.K1 * (1 - dc.B + dc.B * len(own) / mean)) for t in set(own)}
            yield i, len(own), {t: x / sum(w.values()) for t, x in w.items()}
    impact = list(weights())
    text = dict(items)
    out = {}
    for d, t in docs:
        words = dc.words_of((t or "").lower())
        for i, size, own in impact:
            if sum(own[w] for w in own.keys() & set(words)) < dc.THRESHOLD - 1e-9:
                continue
            q, a = dc.split_item(text[i])
            step, best = max(size // 2, 1), None
            for at in range(0, max(len(words) - 2 * size + step, 1), step):
                passage = words[at:at + 2 * size]
                score = round(sum(own[w] for w in own.keys() & set(passage)), 9)
                if score >= dc.THRESHOLD - 1e-9 and (best is None or score > best[1]):
                    if size < dc.SHINGLE:
                        good = f" {' '.join(q + a)} " in f" {' '.join(passage)} "
                    else:
                        good = dc.share([], q, a, passage, 0.8) >= 0.8 and dc.share(q, a, [], passage, 0.8) >= 0.8
                    best = (at, score) if good else best
            if best:
                out[d, i] = best
    return out


def test_query_equals_a_scan_of_every_window(spark):
    read = lambda n: [tuple(r)[:2] for r in spark.read.parquet(f"{SF_CHECK}/{n}.parquet").collect()]
    want = plain_leaks(read("documents"), read("benchmark"))
    got = {(r["doc_id"], r["item_id"]): (r["first_word"], round(r["score"], 9))
           for r in queries.op5_decontaminate(spark, SF_CHECK).collect()}
    assert want and got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)


def test_three_shards_short_items_and_windows_of_their_own(spark):
    """What is found, and where, does not depend on the shards; items under five words stand whole and in order."""
    rng = random.Random(9)
    words = [f"u{i}" for i in range(400)]
    items = [(f"id{i}", " ".join(rng.sample(words, rng.choice([1, 2, 3, 4, 5, 9, 30, 200])))) for i in range(60)]
    docs = []
    for d in range(120):
        _, own = items[d % 60]
        own = own.split()
        if d >= 60 and len(own) > 1:
            own[rng.randrange(len(own))] = "other"
        docs.append((d, " ".join([*rng.choices(words, k=rng.randint(0, 90)), *own, *rng.choices(words, k=rng.randint(0, 90))])))
    want = plain_leaks(docs, items)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = spark.createDataFrame(items, "item_id string, text string")
    assert len(list(dc.build(rows, shard_weight=1200))) >= 3
    for shard_weight in (10**6, 1200):
        got = {(r["doc_id"], r["item_id"]): r["first_word"] for r in dc.leaks(df, rows, shard_weight=shard_weight).collect()}
        assert got == {k: at for k, (at, _) in want.items()}
    assert {(d, f"id{d}") for d in range(60)} <= want.keys()


def test_long_items_and_many_medium_ones(spark):
    """An item of 20,000 words, and 10,000 of 400: postings carry no texts."""
    rng = random.Random(10)
    long = " ".join(f"x{i}" for i in rng.sample(range(50_000), 20_000))
    items = spark.createDataFrame([(0, long)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c " + long + " d e"), (2, long[:30_000]), (3, "x1 x2")], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in dc.leaks(docs, items).collect()] == [(1, 0)]
    many = spark.range(10_000).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.concat(
        F.lit("y"), (F.xxhash64("id", i) % 200_000).cast("string")))).alias("text")).coalesce(1)
    table = dc.numbered(many, "id", "text")
    assert dc.postings(table).agg(F.sum("tf")).first()[0] >= 4_000_000
    size = dc.postings(table).filter("item = 0").count()
    assert size <= 800 and dc.postings(table).columns == ["item", "term", "tf", "len"]


def test_awkward_rows(spark, awkward, empty):
    items = items_df(spark, [(1, None), (2, ""), (3, "too short"), (None, "the same text twice and then more of it"),
                             (4, "And then a second one, with more words."), (4, "And then a second one, with more words.")])
    got = dc.leaks(awkward, items).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 4)]
    kept = dc.remove_leaks(awkward, items)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 1
    assert dc.leaks(empty, items).count() == 0
    assert dc.remove_leaks(awkward, items.limit(0)).count() == awkward.count()


def test_one_replaced_word_is_still_a_leak(spark):
    rng = random.Random(5)
    words = [f"v{i}" for i in range(3000)]
    items, docs = [], []
    for i, (n_q, n_a) in enumerate([(36, 8), (12, 2), (12, 3), (3, 9), (20, 5), (40, 30), (6, 14)]):
        own = rng.sample(words, n_q + n_a)
        items.append((i, f"{' '.join(own[:n_q])}. {' '.join(own[n_q:])}."))
        docs += [(i, " ".join([*rng.choices(words, k=30), *own[:k], "other", *own[k + 1:], *rng.choices(words, k=30)]))
                 for k in range(n_q + n_a)]
        # half an item stays no leak, whatever stands in place of the rest
        docs += [(100 + i, " ".join([*own[:n_q], *rng.choices(words, k=n_a)])), (100 + i, " ".join(own[n_q:]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = [(r["doc_id"], r["item_id"]) for r in dc.leaks(df, items_df(spark, items)).collect()]
    assert sorted(got) == sorted((d, d) for d, _ in docs if d < 100)


def test_edits_equal_brute_force():
    rng = random.Random(6)
    for _ in range(500):
        part, passage = rng.choices("abcd", k=rng.randint(1, 9)), rng.choices("abcde", k=rng.randint(0, 20))
        row = [0] * (len(passage) + 1)
        for i, w in enumerate(part):
            new = [i + 1]
            for j, x in enumerate(passage):
                new.append(min(row[j] + (w != x), row[j + 1] + 1, new[j] + 1))
            row = new
        assert dc.edits(part, passage) == min(row)
