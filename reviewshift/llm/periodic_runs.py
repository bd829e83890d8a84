"""Runs of repeated words, found by internal pattern matching.

A run is a stretch of words with smallest period q that no neighbouring word extends; those of at
least ``min_exponent`` periods (4 or more) and ``min_length`` words are found. The words are cut
into dyadic blocks: of 2^k words, beginning at multiples of 2^k. Let 2^k be the power with
q <= 2^k < 2q. A run of four periods holds a whole block of that size, and the block's next
occurrence to the right or to the left lies in the run too; as the block is no shorter than the
period, that occurrence is exactly q words away. So each block asks for its occurrences in the
windows of 2^k words beside it, and the step of that progression is a candidate period. A candidate
is extended to both sides as far as the period goes, and counts if it is long enough.

Prefix doubling names the block at every place and ends in the suffix array, in which all places of
a block are an interval. A wavelet tree over the suffix array answers the range-successor queries
(the next place of that interval behind, or before, this one). The names of all block sizes give
the longest common extensions. All queries of one block size are answered at once in numpy; many
short texts share one array, with a separator of its own behind each, so no match leaves its text.

Time is n log n in the words, also for one repeated word; memory is about 4 log n bytes a word of
the longest text, log n being that of its longest repeat. Defined results: null and empty texts
have no words and no runs. Of runs of equal length the first is the longest, and of those the one
of the smaller period. Texts are worked on whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, let, texts_of

CHUNK_WORDS = 1 << 15  # of texts that share one array (one text at least)
MIN_EXPONENT, MIN_LENGTH = 4, 6
WORD = r"[^\x20\x09-\x0D]+"
words_of = re.compile(WORD).findall


class WaveletTree:
    """Range successor and predecessor over a permutation, as a matrix of bit ranks."""

    def __init__(self, values: np.ndarray):
        self.zeros: list[np.ndarray] = []  # by level, from the highest bit: zeros before each place
        self.bits = max(len(values) - 1, 1).bit_length()
        for bit in reversed(range(self.bits)):
            one = (values >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate(([0], np.cumsum(~one))).astype(np.int32))
            values = np.concatenate((values[~one], values[one]))

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of places lo to hi are less than x."""
        n = np.zeros(len(lo), np.int32)
        for bit, z in zip(reversed(range(self.bits)), self.zeros):
            one = (x >> bit & 1).astype(bool)
            zlo, zhi = z[lo], z[hi]
            n += np.where(one, zhi - zlo, 0)
            lo, hi = np.where(one, z[-1] + lo - zlo, zlo), np.where(one, z[-1] + hi - zhi, zhi)
        return n

    def smallest(self, lo: np.ndarray, hi: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The value of places lo to hi with ``nth`` smaller ones."""
        out = np.zeros(len(lo), np.int32)
        for bit, z in zip(reversed(range(self.bits)), self.zeros):
            zlo, zhi = z[lo], z[hi]
            one = nth >= zhi - zlo
            out |= one.astype(np.int32) << bit
            nth = np.where(one, nth - (zhi - zlo), nth)
            lo, hi = np.where(one, z[-1] + lo - zlo, zlo), np.where(one, z[-1] + hi - zhi, zhi)
        return out

    def beside(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x, a value of places lo to hi: the next greater and the next smaller one, x itself without."""
        at = self.below(lo, hi, x)
        after, before = x.copy(), x.copy()
        more = np.flatnonzero(at + 1 < hi - lo)
        after[more] = self.smallest(lo[more], hi[more], at[more] + 1)
        less = np.flatnonzero(at > 0)
        before[less] = self.smallest(lo[less], hi[less], at[less] - 1)
        return after, before


def block_names(letters: np.ndarray) -> list[np.ndarray]:
    """For each k the names of the stretches of 2^k letters at all places, in their order, until
    all differ. ``letters`` are numbers from 0 on without gaps, the last one unlike all others."""
    names, size = [letters.astype(np.int32)], 1
    while int(names[-1].max()) + 1 < len(letters):
        here = names[-1].astype(np.int64)
        key = here * (len(letters) + 1)
        key[:-size] += here[size:] + 1
        names.append(np.unique(key, return_inverse=True)[1].astype(np.int32))
        size *= 2
    return names


def extension(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, left: bool = False) -> np.ndarray:
    """Number of equal letters from places i and j on (``left``: before them), i < j."""
    n = np.zeros(len(i), np.int64)
    for k in reversed(range(len(names))):
        size = 1 << k
        if left:
            a, b = i - n - size, j - n - size
            fits = a >= 0
            same = fits & (names[k][np.where(fits, a, 0)] == names[k][np.where(fits, b, 0)])
        else:
            same = names[k][i + n] == names[k][j + n]
        n += np.where(same, size, 0)
    return n


def runs_of(letters: np.ndarray, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, length, period) of all runs, sorted; ``letters`` as for ``block_names``."""
    names = block_names(letters)
    order = np.empty(len(letters), np.int32)
    order[names[-1]] = np.arange(len(letters), dtype=np.int32)  # the suffix array
    tree = None
    found = [np.zeros((0, 3), np.int64)]
    for k, name in enumerate(names[:-1]):  # blocks of the last size stand once each
        size = 1 << k
        count = np.bincount(name)
        first = np.cumsum(count) - count
        p = np.arange(0, len(letters), size, dtype=np.int32)
        p = p[count[name[p]] > 1]
        if not len(p):
            continue
        tree = tree or WaveletTree(order)
        lo = first[name[p]]
        after, before = tree.beside(lo, lo + count[name[p]], p)
        i = np.concatenate((p, before)).astype(np.int64)
        period = np.concatenate((after, p)) - i
        near = (period > size // 2) & (period <= size)
        i, period = np.unique(np.stack((i[near], period[near])), axis=1)
        right = extension(names, i, i + period)
        start = i - extension(names, i, i + period, left=True)
        length = i + period + right - start
        own = np.stack((start, length, period), axis=1)
        found.append(own[length >= np.maximum(min_length, min_exponent * period)])
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of_texts(texts: list[list[str]], **how: int) -> list[np.ndarray]:
    """The runs of each of ``texts``, which are lists of words, by one array for all of them."""
    number: dict[str, int] = {}
    sizes = np.array([len(w) for w in texts], np.int64)
    ends = np.cumsum(sizes + 1)
    letters = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    at = 0
    for words in texts:
        letters[at:at + len(words)] = [number.setdefault(w, len(number)) for w in words]
        at += len(words) + 1
    letters[ends - 1] = len(number) + np.arange(len(ends))
    rows = runs_of(letters, **how) if len(letters) else np.zeros((0, 3), np.int64)
    cut = np.searchsorted(rows[:, 0], ends)
    return [rows[a:b] - [z, 0, 0] for a, b, z in zip([0, *cut[:-1].tolist()], cut.tolist(), ends - sizes - 1)]


def collapsed(words: list[str], runs: np.ndarray) -> str:
    """``words`` without those that any run holds behind its first period, joined by one space."""
    if not len(runs):
        return " ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    inside = np.cumsum(step[:-1])
    return " ".join([words[i] for i in np.flatnonzero(inside == 0).tolist()])


def _chunks(texts: list[str]) -> Iterator[list[list[str]]]:
    part, held = [], 0
    for t in texts:
        own = words_of(t)
        if part and held + len(own) > CHUNK_WORDS:
            yield part
            part, held = [], 0
        part.append(own)
        held += len(own) + 1
    if part:
        yield part


RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


def add_runs(docs: DataFrame, text_col: str = "text", runs: str | None = "runs", text_out: str | None = "collapsed",
             digests: bool = False, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> DataFrame:
    """``docs`` plus n_runs, the longest run's start, length, period and exponent_milli (null without
    one) and, as asked for, the array of all runs, the text without repeats, and SHA-256 digests of
    both (runs as ``start,length,period`` and a line feed each). Columns of ``docs`` called like a
    new one are replaced. No shuffle."""
    if min_exponent < 4:
        raise ValueError("runs of fewer than four periods need not hold a block of their period's size")
    new: dict[str, T.DataType] = {n: T.LongType() for n in ("n_runs", "start", "length", "period", "exponent_milli")}
    new |= {runs: T.ArrayType(RUN, False)} if runs else {}
    new |= {text_out: T.StringType()} if text_out else {}
    new |= {"runs_sha256": T.StringType(), "collapsed_sha256": T.StringType()} if digests else {}
    run_type = pa.list_(pa.field("element", pa.struct([pa.field(f.name, pa.int64(), False) for f in RUN]), False))

    def of_batch(b: pa.RecordBatch) -> dict[str, pa.Array]:
        out: dict[str, list] = {n: [] for n in new}
        for part in _chunks(texts_of(b.column(0))):
            for words, own in zip(part, runs_of_texts(part, min_exponent=min_exponent, min_length=min_length)):
                # the rows are sorted, so the first of the greatest length is the one asked for
                best = own[own[:, 1].argmax()].tolist() if len(own) else [None] * 3
                out["n_runs"].append(len(own))
                for n, v in zip(("start", "length", "period"), best):
                    out[n].append(v)
                out["exponent_milli"].append(1000 * best[1] // best[2] if len(own) else None)
                if runs:
                    out[runs].append([dict(zip(RUN.names, r)) for r in own.tolist()])
                if text_out or digests:
                    short = collapsed(words, own)
                    if text_out:
                        out[text_out].append(short)
                    if digests:
                        lines = "".join(f"{s},{n},{q}\n" for s, n, q in own.tolist())
                        out["runs_sha256"].append(hashlib.sha256(lines.encode()).hexdigest())
                        out["collapsed_sha256"].append(hashlib.sha256(short.encode()).hexdigest())
        types = {runs: run_type, text_out: pa.string(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}
        return {n: pa.array(v, types.get(n, pa.int64())) for n, v in out.items()}

    return append_columns(docs, of_batch, new, {"text": text_col})


def looped(text: Column, start: Callable[[Column], Column], period: Callable[[Column], Column]) -> Column:
    """``text`` with each word from number ``start(n)`` on replaced by the one of the first
    ``period(n)`` words from there that stands at its place in a loop; n is the number of words."""
    def loop(words):
        return let(F.struct(start(F.size(words)).alias("a"), period(F.size(words)).alias("p")), lambda at: F.array_join(
            F.transform(words, lambda _, i: F.get(words, F.when(i < at["a"], i).otherwise(
                at["a"] + (i - at["a"]) % at["p"]).cast("int"))), " "))

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), loop)
