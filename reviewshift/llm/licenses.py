"""License scan with a generalised suffix automaton over the words of license templates.

A file's words stream through the automaton, which keeps the longest suffix read so far that
stands in some template (matching statistics). Matches that can't grow and have ``MIN_MATCH``
words or more are laid onto their places in the templates, and matches in line (short gaps, same
order) chain into spans. A template is found where a chain covers ``COVERED`` of its words.
Phrases are strings of the same automaton: a phrase stands wherever the suffix read has it as a
suffix of its own.

Defined results: null and empty texts have no words, phrases or spans, and score 0. Work is by
row: repeated rows and clashing names have no effect on others. Texts are streamed whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, texts_of

# Phrases of the base rule and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# Notices in public use, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
            "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
            "furnished to do so, subject to the following conditions: The above copyright notice and this "
            "permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                 "except in compliance with the License. You may obtain a copy of the License at "
                 "http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the "
              "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
              "License, or (at your option) any later version."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met: Redistributions of source code must retain the above "
            "copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
            "is hereby granted, provided that the above copyright notice and this permission notice appear in all "
            "copies."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
              "the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
MIN_MATCH, MAX_GAP, COVERED = 4, 8, 0.75

#: Letters of words as they are, A-Z in lower case, all else a space.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32
               for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass
class State:
    length: int
    link: int = -1
    next: dict[int, int] = field(default_factory=dict)
    ends: list[tuple[int, int]] = field(default_factory=list)     # (template, last word) of its strings
    phrases: list[tuple[int, int]] = field(default_factory=list)  # (length, phrase), the longest last


class Automaton:
    """Generalised suffix automaton of templates and phrases."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.templates = [(label, words_of(text)) for label, text in templates]
        self.phrases = [(words_of(text), label) for text, label in phrases]
        strings = [w for _, w in self.templates] + [w for w, _ in self.phrases]
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for s in strings for w in s))}
        self.states = [State(0)]
        for k, own in enumerate(strings):
            at = 0
            for i, w in enumerate(own):
                at = self._extend(at, self.number[w])
                if k < len(self.templates):
                    self.states[at].ends.append((k, i))
        order = sorted(range(1, len(self.states)), key=lambda s: -self.states[s].length)
        for s in order:  # what ends a string ends its suffixes
            link = self.states[s].link
            if self.states[link].length >= MIN_MATCH:
                self.states[link].ends.extend(self.states[s].ends)
        for k, (own, _) in enumerate(self.phrases):
            at = 0
            for w in own:
                at = self.states[at].next[self.number[w]]
            self.states[at].phrases.append((len(own), k))
        for s in reversed(order):
            self.states[s].phrases = sorted(self.states[self.states[s].link].phrases + self.states[s].phrases)
        self.shortest = min([MIN_MATCH, *(len(p) for p, _ in self.phrases)])

    def _extend(self, last: int, w: int) -> int:
        """The state of the string of ``last`` with ``w`` behind it."""
        st = self.states
        if w in st[last].next:
            q = st[last].next[w]
            return q if st[q].length == st[last].length + 1 else self._clone(last, q, w)
        cur = len(st)
        st.append(State(st[last].length + 1))
        p = last
        while p >= 0 and w not in st[p].next:
            st[p].next[w] = cur
            p = st[p].link
        if p < 0:
            st[cur].link = 0
        else:
            q = st[p].next[w]
            st[cur].link = q if st[q].length == st[p].length + 1 else self._clone(p, q, w)
        return cur

    def _clone(self, p: int, q: int, w: int) -> int:
        st = self.states
        new = len(st)
        st.append(State(st[p].length + 1, st[q].link, dict(st[q].next)))
        while p >= 0 and st[p].next.get(w) == q:
            st[p].next[w] = new
            p = st[p].link
        st[q].link = new
        return new

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Phrases as (first word, phrase) and matches that can't grow as (first word, length, state)."""
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), np.int32, len(words))
        known = np.concatenate(([False], ids >= 0, [False]))
        edge = np.flatnonzero(known[1:] != known[:-1])
        first, end = edge[::2], edge[1::2]
        long = end - first >= self.shortest  # shorter runs of known words hold neither
        phrases, matches, st = [], [], self.states
        for a, z in zip(first[long].tolist(), end[long].tolist()):
            at = n = 0
            for i, w in enumerate(ids[a:z].tolist(), a):
                if w not in st[at].next:
                    if n >= MIN_MATCH:
                        matches.append((i - n, n, at))
                    while at and w not in st[at].next:
                        at = st[at].link
                        n = st[at].length
                if w in st[at].next:
                    at, n = st[at].next[w], n + 1
                for size, k in st[at].phrases:
                    if size <= n:
                        phrases.append((i - size + 1, k))
            if n >= MIN_MATCH:
                matches.append((z - n, n, at))
        return phrases, matches

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """(template, first word, last word, covered share) of chains that cover enough."""
        laid = sorted({(k, start, end - n + 1, n) for start, n, s in matches for k, end in self.states[s].ends})
        out, chain = [], None  # of one template: first word, next word, next template word, covered

        def close():
            if chain:
                share = chain[4] / len(self.templates[chain[0]][1])
                if share >= COVERED:
                    out.append((chain[0], chain[1], chain[2] - 1, min(share, 1.0)))

        for k, start, at, n in laid:
            if chain and chain[0] == k and 0 <= start - chain[2] <= MAX_GAP and 0 <= at - chain[3] <= MAX_GAP:
                chain = (k, chain[1], start + n, at + n, chain[4] + n)
            elif not (chain and chain[0] == k and start < chain[2] and n <= chain[2] - chain[1]):
                close()
                chain = (k, start, start + n, at + n, n)
        close()
        return out


@lru_cache(maxsize=4)
def automaton(templates=TEMPLATES, phrases=PHRASES) -> Automaton:
    """One for each worker and set of templates."""
    return Automaton(templates, phrases)


SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()),
                     T.StructField("last_word", T.LongType()), T.StructField("covered", T.DoubleType())])
NEW = {"n_words": T.LongType(), "n_base": T.LongType(), "first_word": T.LongType(), "last_word": T.LongType(),
       "base_labels": T.StringType(), "labels": T.StringType(), "score": T.DoubleType(),
       "license_spans": T.ArrayType(SPAN)}
ARROW = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
         "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(),
         "license_spans": pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()),
                                              ("last_word", pa.int64()), ("covered", pa.float64())]))}


def scan_text(text: str, own: Automaton) -> dict:
    """The values of NEW for one text. The score is the largest share of a template that a span
    covers, and 1 where a phrase stands."""
    words = words_of(text)
    phrases, matches = own.stream(words)
    spans = own.spans(matches) if matches else []
    starts = [p[0] for p in phrases]
    base = {own.phrases[k][1] for _, k in phrases}
    found = base | {own.templates[s[0]][0] for s in spans}
    return {"n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None),
            "last_word": max(starts, default=None), "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(found)), "score": 1.0 if base else max((s[3] for s in spans), default=0.0),
            "license_spans": [{"label": own.templates[k][0], "first_word": a, "last_word": z, "covered": c}
                              for k, a, z, c in spans]}


def add_licenses(docs: DataFrame, text_col: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """``docs`` plus the columns of NEW; no shuffle."""

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        own = automaton(templates, phrases)
        rows = [scan_text(t, own) for t in texts_of(b.column(0))]
        return {n: pa.array([r[n] for r in rows], ARROW[n]) for n in NEW}

    return append_columns(docs, run, NEW, {"text": text_col})
