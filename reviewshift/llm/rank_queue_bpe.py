"""Byte-level BPE from a rank file, each pre-token merged through a queue of ranks.

The symbols of a pre-token are a linked list over its bytes. A pair of neighbours that the
vocabulary holds waits in the bucket of its rank, by the place where it begins. A hierarchical
bitmap says which buckets hold something: a bit a rank, above it a bit for each word of 256, and so
on up to one word, so the lowest rank is one find-first-set a level, however many ranks there are.
A bucket is worked off from the left. A merge ends the pairs it takes part in: their entries stay
where they are and are skipped when met, as the pair that begins there has another rank by then.
Each merge puts two pairs in at most, so a pre-token of a million bytes costs little more than that
many bytes in short ones; no step looks at the whole pre-token again. Pre-tokens that a worker has
not met share a queue, laid side by side: merges of the lowest rank of them all are merges of the
lowest rank of each.

Defined results: null and empty texts have no tokens and decode to nothing. There are no special
tokens: their strings are text. A pre-token that is a token itself is that token, whatever its
merges would give, as in the library. Texts are worked on whole.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import LOW, PATTERN, low_splitter
from .common import append_columns, texts_of

SHIFT = 8              # a word of the bitmap has two to this power of bits
MASK, BIT = (1 << SHIFT) - 1, [1 << k for k in range(1 << SHIFT)]
CACHE_WORDS = 400_000  # pre-tokens whose ids a worker keeps,
CACHED_CHARS = 200     # none longer than this
QUEUE_CHARS = 500_000  # of pre-tokens that share a queue (one at least)


class RankQueue:
    """Positions in buckets by rank; the lowest rank that holds any comes first."""

    def __init__(self, ranks: int):
        self.bucket: dict[int, list[int]] = {}
        self.levels: list[list[int]] = []  # from one bit a rank up to a single word
        size = max(ranks, 1)
        while not self.levels or size > 1:
            size = -(-size >> SHIFT)
            self.levels.append([0] * size)
        self.down = self.levels[::-1]

    def open(self, rank: int, places: list[int]) -> None:
        """A new bucket; later places of the rank are appended to it."""
        self.bucket[rank] = places
        for level in self.levels:
            bit = BIT[rank & MASK]
            rank >>= SHIFT
            if level[rank]:  # the levels above know
                level[rank] |= bit
                return
            level[rank] = bit

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its bucket, taken out, from the left; None if there is none."""
        if not self.bucket:
            return None
        at = 0
        for level in self.down:
            word = level[at]
            at = (at << SHIFT) + (word & -word).bit_length() - 1
        rank = at
        for level in self.levels:  # the bit is the lowest of its word, on each level
            at >>= SHIFT
            word = level[at] = level[at] & (level[at] - 1)
            if word:
                break
        places = self.bucket.pop(rank)
        if len(places) > 1:
            places.sort()
        return rank, places


class RankedBpe:
    """A vocabulary of byte strings with ranks, which are the ids too."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = 1 + max(ranks.values(), default=0)
        self.token = [b""] * size
        for piece, rank in ranks.items():
            self.token[rank] = piece
        self.decimal = [str(i) for i in range(size)]
        self.longest = max(map(len, ranks), default=0)
        self.byte_pairs = np.full(1 << 16, -1, np.int32)
        for piece, rank in ranks.items():
            if len(piece) == 2:
                self.byte_pairs[piece[0] << 8 | piece[1]] = rank
        self.queue = RankQueue(size)
        self.known: dict[str, tuple[int, ...]] = {}
        self.split_any, self.split_low = regex.compile(PATTERN).findall, low_splitter().findall
        self.high = regex.compile(f"[^\0-{chr(LOW - 1)}]").search

    def merged(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of pre-tokens that share one queue; no pair reaches over the start of another."""
        rank_of, longest = self.ranks.get, self.longest
        bucket, open_bucket, pop = self.queue.bucket, self.queue.open, self.queue.pop
        own = [w for w in words if w not in self.ranks and w]
        data = b"".join(own)
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        starts = np.zeros(len(data) + 1, np.uint8)  # 1: a pre-token begins here, or the data end
        starts[np.cumsum(sizes)] = starts[0] = 1
        ranks = self._first_ranks(data, starts)
        edge = starts.tobytes()
        pair = array("i", ranks.tobytes())              # rank of the pair that begins here
        end = array("i", range(1, len(data) + 1))       # where the symbol that begins here ends
        before = array("i", range(-1, len(data) - 1))   # where the symbol before begins
        while (lowest := pop()) is not None:
            rank, places = lowest
            for k, i in enumerate(places):
                if pair[i] != rank:  # stale: a symbol of the pair has been merged
                    continue
                middle = end[i]
                stop = end[i] = end[middle]
                made = also = pair[middle] = -1
                if not edge[stop]:
                    before[stop] = i
                    if end[stop] - i <= longest:
                        made = rank_of(data[i:end[stop]], -1)
                        if made in bucket:
                            bucket[made].append(i)
                        elif made >= 0:
                            open_bucket(made, [i])
                pair[i] = made
                if not edge[i]:
                    left = before[i]
                    if stop - left <= longest:
                        also = rank_of(data[left:stop], -1)
                        if also in bucket:
                            bucket[also].append(left)
                        elif also >= 0:
                            open_bucket(also, [left])
                    pair[left] = also
                if (-1 < made < rank or -1 < also < rank) and k + 1 < len(places):
                    open_bucket(rank, places[k + 1:])  # a new pair goes first
                    break
        ids: list[int] = []
        cut = [0]
        i = 0
        while i < len(data):
            ids.append(rank_of(data[i:end[i]]))
            i = end[i]
            if edge[i]:
                cut.append(len(ids))
        made_ids = (tuple(ids[a:z]) for a, z in zip(cut, cut[1:]))
        return [(self.ranks[w],) if w in self.ranks else next(made_ids) if w else () for w in words]

    def _first_ranks(self, data: bytes, starts: np.ndarray) -> np.ndarray:
        """Rank of each pair of bytes (-1: none), put into the buckets."""
        ranks = np.full(len(data), -1, np.int32)
        letters = np.frombuffer(data, np.uint8).astype(np.int64)
        ranks[:-1] = self.byte_pairs[letters[:-1] << 8 | letters[1:]]
        ranks[starts[1:] == 1] = -1
        places = np.flatnonzero(ranks >= 0)
        places = places[np.argsort(ranks[places], kind="stable")]
        edges = np.flatnonzero(np.diff(ranks[places])) + 1
        for own in np.split(places, edges) if len(places) else []:
            self.queue.open(int(ranks[own[0]]), own.tolist())
        return ranks

    def split(self, text: str) -> list[str]:
        return self.split_any(text) if self.high(text) else self.split_low(text)

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        each = [self.split(t) for t in texts]
        new = sorted(set(chain.from_iterable(each)).difference(known))
        part, held = [], 0
        for w in new:
            part.append(w)
            held += len(w)
            if held >= QUEUE_CHARS:
                known.update(zip(part, self.merged([w.encode() for w in part])))
                part, held = [], 0
        known.update(zip(part, self.merged([w.encode() for w in part])))
        for words in each:
            yield list(chain.from_iterable(map(known.__getitem__, words)))
        for w in new:
            if len(w) > CACHED_CHARS:
                del known[w]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def written(self, ids: list[int]) -> str:
        """Decimal ids, comma-joined."""
        return ",".join(map(self.decimal.__getitem__, ids))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> RankedBpe:
    """One for each worker and file: a base64 piece and its rank a line."""
    with open(path, "rb") as f:
        lines = (line.split() for line in f)
        return RankedBpe({base64.b64decode(x[0]): int(x[1]) for x in lines if x})


def add_tokens(docs: DataFrame, path: str, text_col: str = "text", ids: str | None = "ids",
               decoded: str | None = None, digests: bool = False) -> DataFrame:
    """``docs`` plus ``n_tokens`` and, as asked for, the token ids, the decoded bytes, and SHA-256
    digests of the decimal ids joined by commas and of the decoded bytes. ``path`` is that of the
    rank file on every executor. Columns of ``docs`` called like a new one are replaced. No shuffle."""
    new: dict[str, T.DataType] = {"n_tokens": T.LongType()}
    new |= {ids: T.ArrayType(T.IntegerType(), False)} if ids else {}
    new |= {decoded: T.BinaryType()} if decoded else {}
    new |= {"ids_sha256": T.StringType(), "decoded_sha256": T.StringType()} if digests else {}
    arrow = {"n_tokens": pa.int64(), ids: pa.list_(pa.field("element", pa.int32(), False)), decoded: pa.binary()}

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        bpe = vocabulary(path)
        out: dict[str, list] = {n: [] for n in new}
        for own in bpe.encode(texts_of(b.column(0))):
            out["n_tokens"].append(len(own))
            if ids:
                out[ids].append(own)
            if decoded or digests:
                back = bpe.decode(own)
                if decoded:
                    out[decoded].append(back)
                if digests:
                    out["ids_sha256"].append(hashlib.sha256(bpe.written(own).encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
        return {n: pa.array(v, arrow.get(n, pa.string())) for n, v in out.items()}

    return append_columns(docs, run, new, {"text": text_col})
