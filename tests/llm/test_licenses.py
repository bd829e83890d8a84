"""The automaton against plain search."""

from __future__ import annotations

import random
import re

from reviewshift.llm import licenses as li
from reviewshift.llm import queries
from tests.conftest import SF_CHECK


def plain_base(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = [(i, label) for phrase, label in li.PHRASES for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})))


def longest_suffixes(strings, words):
    """Matching statistics by plain search: the longest suffix at each word that stands in a string."""
    subs = {tuple(s[i:j]) for s in strings for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    return [max((n for n in range(1, i + 2) if tuple(words[i + 1 - n:i + 1]) in subs), default=0)
            for i in range(len(words))]


def test_matches_equal_plain_search():
    rng = random.Random(4)
    letters = "a b c d".split()
    for _ in range(30):
        texts = tuple(("x", " ".join(rng.choices(letters, k=rng.randint(4, 14)))) for _ in range(4))
        own = li.Automaton(texts, ((" ".join(rng.choices(letters, k=3)), "p"),))
        words = [w.encode() for w in rng.choices([*letters, "z"], k=80)]
        strings = [li.words_of(t) for _, t in texts] + [own.phrases[0][0]]
        stat = longest_suffixes(strings, words)
        want = {(i - n + 1, n) for i, n in enumerate(stat)
                if n >= li.MIN_MATCH and (i + 1 == len(stat) or stat[i + 1] <= n)}
        phrases, matches = own.stream(words)
        assert {(a, n) for a, n, _ in matches} == want
        assert sorted(a for a, _ in phrases) == [i for i in range(len(words)) if words[i:i + 3] == own.phrases[0][0]]
        for a, n, s in matches:  # the places in templates are right and whole
            own_words = words[a:a + n]
            places = {(k, i) for k, t in enumerate(strings[:-1]) for i in range(n - 1, len(t)) if t[i - n + 1:i + 1] == own_words}
            assert places == set(own.states[s].ends)


def test_templates_are_found_and_noise_is_not():
    own = li.automaton()
    for label, text in li.TEMPLATES:
        got = li.scan_text(f"Some words before it. {text} and some behind", own)
        assert label in got["labels"].split(",") and got["score"] >= li.COVERED
        holes = re.sub(r"(?i)\bsoftware\b", "programme", text)
        assert label in li.scan_text(holes, own)["labels"].split(",")
    assert li.scan_text("this is free of charge, and the use of it in any form is not", own)["labels"] == ""


def test_repeated_notices_are_separate_spans():
    text = "x y z. ".join(["Licensed under the Apache License, Version 2.0. "] * 3)
    got = li.scan_text(text, li.automaton())
    assert got["n_base"] == 3 and sum(s["covered"] == 1 for s in got["license_spans"]) == 3


def test_query_equals_plain_search(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()}
    rows = queries.op6_licenses(spark, SF_CHECK).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(docs[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_awkward_rows(spark, awkward, empty):
    rows = li.add_licenses(awkward).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(r["text"] or "")
    assert li.add_licenses(empty).count() == 0
