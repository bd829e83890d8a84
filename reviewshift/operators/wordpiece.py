"""Greedy longest-match sub-word pieces in time linear in the word.

The vocabulary becomes a trie whose nodes carry a failure link and the pieces
that are complete when the link is taken, so a walk over a word never goes
back: at a letter without an edge it emits those pieces and goes on from the
link. The trie is held as flat arrays (sorted edge keys, children, links), and
all distinct words of a batch walk it side by side, letter by letter.

A vocabulary has a size bound (``max_pieces``): up to it, the arrays go to the
executors once; a larger table is matched by joins instead, which need no
piece outside its partition. Both give the same pieces.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "##"          # marks a piece that continues a word
MAX_PIECES = 1_000_000
LETTERS = 0x110000     # code points
DEAD = -1


@dataclass(frozen=True)
class PieceTrie:
    """Node 0 is the start of a word, node 1 the start of a continuation."""

    keys: np.ndarray    # sorted: node * LETTERS + letter
    child: np.ndarray   # by key
    link: np.ndarray    # by node: where to go on, DEAD if no pieces cover the letters
    popped: np.ndarray  # by node: pieces that taking the link completes

    @classmethod
    def of(cls, pieces: Iterator[str]) -> "PieceTrie":
        edges: list[dict[int, int]] = [{}, {}]
        whole = [False, False]

        def insert(node: int, letters: str) -> None:
            for c in map(ord, letters):
                if c not in edges[node]:
                    edges[node][c] = len(edges)
                    edges.append({})
                    whole.append(False)
                node = edges[node][c]
            whole[node] = True

        for p in pieces:
            if p:
                insert(0, p)
            if p.startswith(PREFIX) and len(p) > len(PREFIX):
                insert(1, p[len(PREFIX):])
        link, popped = [DEAD] * len(edges), [0] * len(edges)
        todo = deque([0, 1])
        while todo:  # parents before children, shorter strings before longer ones
            u = todo.popleft()
            for c, v in edges[u].items():
                if whole[v]:
                    link[v], popped[v] = 1, 1
                else:
                    z, n = link[u], popped[u]
                    while z != DEAD and c not in edges[z]:
                        n += popped[z]
                        z = link[z]
                    if z != DEAD:
                        link[v], popped[v] = edges[z][c], n
                todo.append(v)
        flat = sorted((u * LETTERS + c, v) for u, own in enumerate(edges) for c, v in own.items())
        return cls(np.array([k for k, _ in flat], np.int64), np.array([v for _, v in flat], np.int64),
                   np.array(link, np.int64), np.array(popped, np.int64))

    def counts(self, words: list[str]) -> np.ndarray:
        """Number of pieces of each word; 0 for one that no pieces cover, and for the empty one."""
        size = np.array([len(w) for w in words], np.int64)
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        first = np.cumsum(size) - size
        node, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        alive = np.flatnonzero(size)
        at = 0
        while len(alive):
            ask = alive
            while len(ask):  # those without an edge take their link and ask again
                key = node[ask] * LETTERS + letters[first[ask] + at]
                spot = np.searchsorted(self.keys, key)
                spot[spot == len(self.keys)] = 0
                hit = self.keys[spot] == key if len(self.keys) else np.zeros(len(ask), bool)
                node[ask[hit]] = self.child[spot[hit]]
                ask = ask[~hit]
                self._follow(ask, node, n)
                ask = ask[node[ask] != DEAD]
            at += 1
            alive = alive[node[alive] != DEAD]
            alive = alive[size[alive] > at]
        ask = np.flatnonzero((size > 0) & (node != DEAD) & (node != 1))
        while len(ask):
            self._follow(ask, node, n)
            ask = ask[(node[ask] != DEAD) & (node[ask] != 1)]
        return np.where(node == DEAD, 0, n)

    def _follow(self, ask: np.ndarray, node: np.ndarray, n: np.ndarray) -> None:
        n[ask] += self.popped[node[ask]]
        node[ask] = self.link[node[ask]]


def read_piece_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(piece, id) of a published vocabulary: a piece a line, its number the id."""
    lines = spark.read.text(path, wholetext=True)
    return (lines.select(F.posexplode(F.split("value", "\r?\n")).alias("id", "piece"))
            .filter(F.col("piece") != "").select("piece", "id"))


def wordpiece_counts(words: DataFrame, vocab: DataFrame, max_chars: int | None = 100,
                     max_pieces: int = MAX_PIECES) -> DataFrame:
    """(word, n_pieces) of each row of ``words(word)`` against ``vocab(piece)``. A word that pieces
    do not cover, an empty one, or one of more than ``max_chars`` letters (the usual bound of such
    tokenizers; None: no bound) is one unknown piece."""
    pieces = [r[0] for r in vocab.select("piece").filter("piece is not null").limit(max_pieces + 1).collect()]
    if len(pieces) > max_pieces:
        return _counts_by_join(words, vocab, max_chars)
    shared = words.sparkSession.sparkContext.broadcast(PieceTrie.of(iter(pieces)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [w if w is not None and (max_chars is None or len(w) <= max_chars) else "" for w in b["word"]]
            yield pd.DataFrame({"word": b["word"], "n_pieces": np.maximum(shared.value.counts(own), 1)})

    return words.select("word").mapInPandas(run, "word string, n_pieces long")


def _counts_by_join(words: DataFrame, vocab: DataFrame, max_chars: int | None) -> DataFrame:
    """The same by joins: all cuts of a word no longer than the longest piece meet the vocabulary;
    of those found the longest at each place is kept and walked from the front."""
    longest = vocab.agg(F.max(F.length("piece"))).first()[0] or 0
    at, size = F.col("at"), F.col("size")
    fits = F.length("word") >= 1 if max_chars is None else F.length("word").between(1, max_chars)
    cuts = (words.select("word").distinct().filter(fits)
            .select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
            .select("word", "at", F.explode(F.sequence(F.lit(1), F.least(F.length("word") - at + 1, F.lit(longest)))).alias("size"))
            .select("word", "at", "size", F.concat(F.when(at > 1, PREFIX).otherwise(""),
                                                   F.substring(F.col("word"), at, size)).alias("piece")))
    found = (cuts.join(vocab.select("piece").distinct(), "piece").groupBy("word", "at").agg(F.max("size").alias("size"))
             .groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("at", "size"))).alias("longest")))

    def step(acc, i):
        long = F.try_element_at(F.col("longest"), i)
        here = (acc["at"] == i) & long.isNotNull()
        return F.struct(F.when(here, i + long).otherwise(acc["at"]).alias("at"),
                        F.when(here, acc["n"] + 1).otherwise(acc["n"]).alias("n"))

    walked = F.aggregate(F.sequence(F.lit(1), F.length("word")),
                         F.struct(F.lit(1).alias("at"), F.lit(0).alias("n")), step,
                         lambda acc: F.when(acc["at"] > F.length("word"), acc["n"]).otherwise(1))
    return words.join(found.select("word", walked.alias("n")), "word", "left") \
        .select("word", F.coalesce("n", F.lit(1)).cast("long").alias("n_pieces"))
