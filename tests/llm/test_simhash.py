"""Fingerprints against a plain version, links against all pairs, components against a search."""

from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from reviewshift.llm import queries, simhash
from tests.conftest import SF_SMALL


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    own = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows: (id, fingerprint); component of each row as the smallest id."""
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[i + 1:]:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [(i, f, least.get(find(f))) for i, f in rows]


def near_prints(seed):
    """Clusters of fingerprints a few bits apart, and chains of them."""
    rng, out = random.Random(seed), []
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            out.append(f)
            g = f
            for _ in range(rng.randint(0, 4)):
                g ^= 1 << rng.randrange(64)
            f = rng.choice([f, g])
            out.append(g)
    return out + [0, (1 << 64) - 1, (1 << 64) - 3]


def test_fingerprints():
    for text in ["", " \n", "One", "one TWO", "a b c d a b c", "É é\x1fx y\tz w v", "w " * 300]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_long_texts_are_counted_in_chunks(monkeypatch):
    text = " ".join(str(i % 97) for i in range(5000))
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(text) == want == plain_fingerprint(text)


@pytest.mark.parametrize("bucket", [64, 2, 0])  # 0: all over the way for hot buckets
def test_components_equal_all_pairs(spark, bucket):
    prints = near_prints(bucket)
    rows = list(enumerate(prints))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in set(prints)], "fp long")
    links = simhash.link(df, 2, bucket)
    assert links.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2).count() == 0
    root = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    want = plain_components(rows)
    groups = {}
    for i, f, c in want:
        groups.setdefault(c, set()).add(root.get(signed(f), signed(f)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_query_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    want = plain_components([(r["doc_id"], plain_fingerprint(r["text"])) for r in docs])
    got = sorted(map(tuple, queries.op8_simhash(spark, SF_SMALL).collect()))
    assert got == sorted((i, f"{f:016x}", c) for i, f, c in want)


def test_awkward_rows(spark, awkward, empty):
    rows = [(r["doc_id"], plain_fingerprint(r["text"] or "")) for r in awkward.collect()]
    got = simhash.near_duplicates(awkward).select("id", "fp", "component_id").collect()
    assert sorted(((r[0], r[1] % (1 << 64), r[2]) for r in got), key=str) == sorted(plain_components(rows), key=str)
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids.count("5") == 1 and "6" not in ids and "2" in ids and "3" not in ids
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
