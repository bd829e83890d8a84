"""Benchmark decontamination: a BM25 index of test items, searched with block-max WAND.

Each training passage (a window of words, long enough that every occurrence of an item lies whole
in one) is a query. Impacts are BM25 term weights divided by the item's score for its own text, so
1.0 says that the passage has every term of the item. The lists of a passage's terms are ordered by
their largest impact. The pivot list is the one with which the maxima, from the smallest on, reach the
threshold: an item that only lists before it hold can't be retrieved. So the lists from the pivot on
name the candidates, and those before it are never read through, only looked up at a candidate. First
that is done for blocks of item numbers with the blocks' largest impacts, then for the items of the
blocks that stay open. (Moving a cursor for each list and choosing a pivot item at each step gives the
same items; in Python that took 6 ms a passage, this takes 0.3.) A document that retrieves nothing
as a whole has no passage that does. All items at or above the threshold are retrieved, no top k.

A retrieved item is held against the windows of twice its own length that begin at every half of
it, so what is found does not depend on the other items. It is a leak if a window retrieves it and
holds at least ``need`` of its question and of its answer: the last sentence is the answer, of an
item of one sentence the last third of its words. The share of a part is that of its word shingles
(five words) or, if that is too small, that of its words in the stretch of the window with the
fewest edits (words replaced, put in or left out): one edit takes five shingles but one word. A part
of two to four words is compared by edits together with its neighbours in the item, five words in
all; a part of one word has to be there. An item of fewer than five words has to stand in the window
whole and in order.

The index is built by DataFrame aggregation over all items, which are numbered first: postings are
(item, term, frequency) rows. It is used in shards of about ``shard_weight`` (postings, and 16 bytes
of text each as much as one), one pass over the documents each: the driver and the tasks hold one
shard, and the hits of a pass are written before the next shard is built.

Defined results: null and empty texts and items without words match nothing; equal items are items
of their own, an item row that is repeated is one item; repeated documents each get their rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import append_columns, columns_of, free_name, stage_table, texts_of

K1, B = 1.2, 0.75
BLOCK = 4          # item numbers of a block
SHINGLE, OVERLAP, THRESHOLD = 5, 0.8, 0.6
SLACK = 1e-9
SHARD_WEIGHT = 4_000_000
SLICE_POSTINGS = 200_000  # rows that a task hands on at once
words_of: Callable[[str], list[str]] = re.compile(r"\w+").findall


def hit_type(item_id: T.DataType) -> T.StructType:
    """The best window of a leaked item."""
    return T.StructType([T.StructField("item_id", item_id), T.StructField("first_word", T.LongType()),
                         T.StructField("n_words", T.LongType()), T.StructField("score", T.DoubleType()),
                         T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType())])


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer."""
    parts = [w for s in re.split(r"(?<=[.!?])\s+", text.strip()) if (w := words_of(s.lower()))]
    if len(parts) > 1:
        return sum(parts[:-1], []), parts[-1]
    own = parts[0] if parts else []
    cut = len(own) - len(own) // 3
    return own[:cut], own[cut:]


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    k = min(SHINGLE, len(words))
    return set(zip(*(words[i:] for i in range(k)))) if k else set()


def overlap(part: list[str], passage: list[str]) -> float:
    """Share of the shingles of ``part`` that ``passage`` holds; 1 for an empty part."""
    own = shingles(part)
    if not own:
        return 1.0
    k = len(next(iter(own)))
    return len(own & set(zip(*(passage[i:] for i in range(k))))) / len(own)


def edits(part: list[str], passage: list[str]) -> int:
    """Fewest words to replace, put in or leave out between ``part`` and a stretch of ``passage``
    (Myers' bit vectors, a bit for each word of ``part``)."""
    full, last, spots = (1 << len(part)) - 1, 1 << len(part) >> 1, {}
    for k, w in enumerate(part):
        spots[w] = spots.get(w, 0) | 1 << k
    up, down, now = full, 0, len(part)
    best = now
    for w in passage:
        eq = spots.get(w, 0)
        x = (((eq & up) + up) ^ up) | eq
        right, left = down | (full & ~(x | up)), up & x
        now += bool(right & last) - bool(left & last)
        best = min(best, now)
        right, left, eq = right << 1 & full, left << 1 & full, eq | down
        up, down = left | (full & ~(eq | right)), right & eq
    return best


def share(before: list[str], part: list[str], after: list[str], passage: list[str], need: float) -> float:
    """Share of ``part`` in ``passage`` by shingles or, where they fall short of ``need``, by edits."""
    own = overlap(part, passage)
    if own >= need or len(part) < 2:
        return own
    lacking = max(SHINGLE - len(part), 0)
    wide = before[max(len(before) - lacking, 0):] + part + after[:lacking]
    # words that are not there at all bound the edits from below
    there = sum((Counter(wide) & Counter(passage)).values())
    return max(own, (len(wide) - edits(wide, passage)) / len(wide)) if there >= need * len(wide) else own


def stands_in(part: list[str], passage: list[str]) -> bool:
    """Whether ``part`` stands in ``passage`` as one run."""
    n = len(part)
    return any(passage[i] == part[0] and passage[i:i + n] == part for i in range(len(passage) - n + 1))


@dataclass
class Index:
    """One shard: posting lists by term number, sorted by item number."""

    items: list[tuple[object, list[str], list[str]]]  # id, question, answer
    term: dict[str, int]
    starts: np.ndarray
    item: np.ndarray
    impact: np.ndarray

    def __post_init__(self):
        n = len(self.term)
        self.longest = max((len(q) + len(a) for _, q, a in self.items), default=1)
        self.top = np.maximum.reduceat(self.impact, self.starts[:-1]) if n else np.zeros(0)
        block = self.item // BLOCK
        owner = np.repeat(np.arange(n), np.diff(self.starts))
        edge = np.flatnonzero(np.concatenate(([True], (np.diff(owner) != 0) | (np.diff(block) != 0)))) if n else owner
        self.block, self.block_top = block[edge], np.maximum.reduceat(self.impact, edge) if n else np.zeros(0)
        self.block_starts = np.searchsorted(owner[edge], np.arange(n + 1))
        self.n_blocks = len(self.items) // BLOCK + 1
        self.block_key = owner[edge] * self.n_blocks + self.block
        self.key = owner * len(self.items) + self.item
        # the same postings by item
        order = np.argsort(self.item, kind="stable")
        self.own_term, self.own_impact = owner[order], self.impact[order]
        self.own_starts = np.searchsorted(self.item[order], np.arange(len(self.items) + 1))

    def _read(self, terms: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Places of the lists of ``terms``, one after another."""
        size = starts[terms + 1] - starts[terms]
        return np.arange(size.sum()) + np.repeat(starts[terms] - (np.cumsum(size) - size), size)

    def _pivot(self, terms: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, float]:
        """``terms`` from the pivot list on, those before it, and the sum of the maxima of these."""
        order = np.argsort(self.top[terms], kind="stable")
        sums = np.cumsum(self.top[terms[order]])
        pivot = int(np.searchsorted(sums, least))
        return terms[order[pivot:]], terms[order[:pivot]], float(sums[pivot - 1]) if pivot else 0.0

    def _look_up(self, rest: np.ndarray, left: np.ndarray, bound: np.ndarray, starts: np.ndarray, where: np.ndarray,
                 value: np.ndarray, key: np.ndarray) -> None:
        """Adds the values of the lists ``rest`` at the numbers ``left`` to ``bound``: by binary search for each
        (list, number), or through the lists where they hold less than that many searches would read."""
        if 4 * len(rest) * len(left) < (starts[rest + 1] - starts[rest]).sum():
            wanted = rest[:, None] * len(bound) + left[None, :]
            spot = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            bound[left] += np.where(key[spot] == wanted, value[spot], 0.0).sum(axis=0)
        else:
            at = self._read(rest, starts)
            bound += np.bincount(where[at], value[at], len(bound))

    def retrieve(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Item numbers and scores of at least ``threshold`` for the distinct ``terms``, by block-max WAND."""
        least = threshold - SLACK
        if self.top[terms].sum() < least:
            return []
        naming, rest, rest_top = self._pivot(terms, least)
        if not len(naming):
            return []
        at = self._read(naming, self.block_starts)
        bound = np.bincount(self.block[at], self.block_top[at], self.n_blocks)
        left = np.flatnonzero(bound + rest_top >= least)
        if not len(left):
            return []
        self._look_up(rest, left, bound, self.block_starts, self.block, self.block_top, self.block_key)
        opened = bound >= least
        if not opened.any():
            return []
        at = self._read(naming, self.starts)
        at = at[opened[self.item[at] // BLOCK]]
        score = np.bincount(self.item[at], self.impact[at], len(self.items))
        left = np.flatnonzero((score > 0) & (score + rest_top >= least))
        if not len(left):
            return []
        self._look_up(rest, left, score, self.starts, self.item, self.impact, self.key)
        return [(int(i), float(score[i])) for i in left if score[i] >= least]

    def best_window(self, i: int, words: list[str], numbers: np.ndarray, threshold: float, need: float) -> tuple | None:
        """The window of item ``i``'s own size with the highest score that holds its question and answer, the
        first of equal ones."""
        item_id, question, answer = self.items[i]
        size = len(question) + len(answer)
        step = max(size // 2, 1)
        own = slice(self.own_starts[i], self.own_starts[i + 1])
        terms, impact = self.own_term[own], self.own_impact[own]  # terms ascend
        at = np.minimum(np.searchsorted(terms, numbers), len(terms) - 1)
        place = np.flatnonzero(terms[at] == numbers)
        last = max(len(words) - 2 * size + step - 1, 0) // step  # the window that reaches the end
        # each place lies in up to 2 * size / step + 1 windows
        window = place[:, None] // step - np.arange(2 * size // step + 1)[None, :]
        window = np.where((window >= 0) & (place[:, None] < window * step + 2 * size), np.minimum(window, last), -1)
        inside = (window >= 0) & (place[:, None] < window * step + 2 * size) & (place[:, None] >= window * step)
        pair = np.unique(window[inside] * len(terms) + np.repeat(at[place], inside.sum(axis=1)))
        score = np.bincount(pair // len(terms), impact[pair % len(terms)], last + 1)
        for w in np.argsort(-np.round(score, 9), kind="stable").tolist():
            if score[w] < threshold - SLACK:
                return None
            passage = words[w * step:w * step + 2 * size]
            if size < SHINGLE:
                q = a = float(stands_in(question + answer, passage))
            else:
                q, a = share([], question, answer, passage, need), share(question, answer, [], passage, need)
            if q >= need and a >= need:
                return item_id, w * step, len(passage), float(score[w]), q, a
        return None

    def hits(self, text: str, threshold: float, need: float) -> list[tuple]:
        """Verified items of one document, the best window of each."""
        words = words_of(text.lower())
        known = [self.term[w] for w in self.term.keys() & set(words)]
        # the whole document bounds each of its passages
        if not known or not self.retrieve(np.array(known), threshold):
            return []
        numbers = np.fromiter(map(self.term.get, words, repeat(-1)), np.int64, len(words))
        found: set[int] = set()
        for at in range(0, max(len(words) - self.longest, 1), self.longest):
            own = np.unique(numbers[at:at + 2 * self.longest])
            found |= {i for i, _ in self.retrieve(own[own >= 0], threshold)}
        best = (self.best_window(i, words, numbers, threshold, need) for i in sorted(found))
        return [b for b in best if b]


def numbered(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stage table of item (a number), item_id, text: the distinct rows with a text."""
    rows = (items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
            .filter(F.col("text").isNotNull()).distinct())
    return stage_table(rows.withColumn("item", F.monotonically_increasing_id()), "items")


def postings(items: DataFrame) -> DataFrame:
    """item, term, tf, len: a row for each distinct word of each of ``numbered`` items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(term, pa.string()),
                                               pa.array(tf, pa.int64()), pa.array(size, pa.int64())],
                                              names=["item", "term", "tf", "len"])

        item, term, tf, size = [], [], [], []
        for b in batches:
            for number, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = words_of(text.as_py().lower())
                count = Counter(words)
                for at in range(0, len(count), SLICE_POSTINGS):
                    part = list(islice(count.items(), at, at + SLICE_POSTINGS))
                    item += [number] * len(part)
                    term += [w for w, _ in part]
                    tf += [n for _, n in part]
                    size += [len(words)] * len(part)
                    if len(item) >= SLICE_POSTINGS:
                        yield batch()
                        item, term, tf, size = [], [], [], []
        yield batch()

    return items.select("item", "text").mapInArrow(run, "item long, term string, tf long, len long")


def build(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
          shard_weight: int = SHARD_WEIGHT) -> Iterator[Index]:
    """The index, shard by shard. Counts, document frequencies and lengths are those of all items."""
    own_items = numbered(items, id_col, text_col)
    terms = stage_table(postings(own_items), "item-terms")
    sizes = terms.groupBy("item").agg(F.first("len").alias("len"), F.count(F.lit(1)).alias("p"))
    n, total, n_postings = sizes.agg(F.count(F.lit(1)), F.sum("len"), F.sum("p")).first()
    if not n:
        return
    n_bytes = own_items.agg(F.sum(F.octet_length("text"))).first()[0]
    n_shards = math.ceil((n_postings + n_bytes / 16) / shard_weight)
    shard = F.pmod(F.xxhash64("item"), F.lit(n_shards))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    saturated = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(total / n)))
    weighed = stage_table(terms.join(df, "term").select("item", "term", (idf * saturated).alias("w"), shard.alias("shard")),
                          "item-weights")
    for k in range(n_shards):
        rows = weighed.filter(F.col("shard") == k).select("item", "term", "w").toArrow()
        texts = own_items.filter(shard == k).select("item", "item_id", "text").toArrow().sort_by("item")
        number, item, w = texts["item"].to_numpy(), rows["item"].to_numpy(), rows["w"].to_numpy()
        there = np.isin(number, item)  # an item without words has no postings
        item = np.searchsorted(number[there], item)
        coded = rows["term"].combine_chunks().dictionary_encode()
        names = coded.dictionary.to_pylist() if len(rows) else []
        t = coded.indices.to_numpy(zero_copy_only=False) if len(rows) else np.zeros(0, np.int64)
        order = np.lexsort((item, t))
        own_score = np.bincount(item, w, int(there.sum()))
        kept = texts.filter(pa.array(there))
        yield Index([(i, *split_item(x)) for i, x in zip(kept["item_id"].to_pylist(), kept["text"].to_pylist())],
                    {x: c for c, x in enumerate(names)}, np.searchsorted(t[order], np.arange(len(names) + 1)), item[order],
                    (w / own_score[item])[order])


def add_hits(docs: DataFrame, items: DataFrame, text_col: str = "text", out: str = "hits",
             threshold: float = THRESHOLD, need: float = OVERLAP, shard_weight: int = SHARD_WEIGHT,
             item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` plus an array of ``hit_type`` structs, best window of each leaked item. No shuffle of ``docs``."""
    hit = hit_type(items.schema[item_id].dataType)
    arrow = pa.list_(pa.struct([(f.name, to_arrow_type(f.dataType)) for f in hit]))
    name = free_name(docs, f"_{out}")
    held, done = docs.withColumn(name, F.array().cast(T.ArrayType(hit))), None
    for index in build(items, item_id, item_text, shard_weight):
        if done is not None:  # the hits so far are written, and the shard before is let go
            held = stage_table(held, "hits")
            done.unpersist()
        shared = docs.sparkSession.sparkContext.broadcast(index)
        new = free_name(held, f"{name}_new")

        def run(b: pa.RecordBatch, shared=shared, new=new) -> dict[str, pa.Array]:
            own = shared.value
            return {new: pa.array([[dict(zip(hit.names, h)) for h in own.hits(t, threshold, need)]
                                   for t in texts_of(b.column(0))], arrow)}

        more = append_columns(held, run, {new: T.ArrayType(hit)}, {"text": text_col})
        held = more.withColumn(name, F.concat(F.col(f"`{name}`"), F.col(f"`{new}`"))).drop(new)
        done = shared
    return held.select(*columns_of(docs.drop(out)), F.col(f"`{name}`").alias(out))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row for each document row and item that it leaks."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return (add_hits(narrow, items, "text", **how)
            .select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*"))


def remove_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that leak an item."""
    out = free_name(docs, "_leaks")
    return add_hits(docs, items, text_col, out, **how).filter(F.size(out) == 0).select(*columns_of(docs))
