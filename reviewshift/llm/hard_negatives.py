"""Hard negatives of anchors, from an inverted multi-index.

The vectors are cut into two halves with a codebook each; a pair of codewords is a cell, and every
row lies in the cell of its nearest two. For an anchor q the score of a row is the sum of two half
products, and a half product with any row of codeword c is at most q.c + |q| * radius(c). The
multi-sequence heap visits the cells by the sum of the two bounds, the greatest first, without
building their full order. A search ends when it is certified: no cell that is left can hold a row
that belongs to the result.

An anchor is searched twice. First its positives: the ``positives`` best other rows of its label,
certified once the next bound falls below the last of them. Then, for each positive of score p, the
``negatives`` best rows of other labels within the window low * p <= score <= high * p (low and high
in hundredths): certified when the window is full and the next bound falls below its last row, or
when the bound falls below the window. Cells that lie above all windows as a whole are passed over.

The codebooks are fitted to at most ``sample`` rows by id hash, which bears on speed only: every
row is indexed, and the result is exact. The index is a stage table in the order of the cells.
Anchors go over it in blocks of bounded size; a block is all that the driver and a task hold of
them, and its results are written before the next one begins. Tasks keep the best of their rows;
a window over the tasks' rows takes the best of all.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no
part. Short vectors count as filled up with zeros. Equal anchor rows are one anchor; a row with an
anchor's own id is no positive and no negative of it. Other rows that repeat an id count each. A
null id is no anchor and comes last among ties. An anchor without positives, or a window without
rows (as for every negative p), gives no row. Scores beyond 64 bits are the nearest long, and tie.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, stage_path, stage_table
from .topk import EXACT, matrix, scores

SCALE, CODEWORDS, SAMPLE, ROUNDS = 256, 16, 4000, 8
ANCHOR_BLOCK, BLOCK_BYTES = 2000, 16_000_000  # anchors of a block, and bytes of their vectors
CHUNK_BYTES = 64_000_000                      # of vectors that a task searches at once
STEP = 512                                    # rows that are scored at once
Found = tuple[int, bool, int]                 # -score, id is null, id


def indexable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """id, label, v (floor(scale * x) as doubles) of the rows that take part."""
    def down(x: Column) -> Column:  # floor within doubles, whatever the size
        near = F.rint(x * scale)
        return F.when(near > x * scale, near - 1).otherwise(near)

    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"),
                           F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
            .filter(F.col("label").isNotNull() & F.col("v").isNotNull() & good)
            .select("id", "label", F.transform("v", down).alias("v")))


def filled(rows: list, width: int) -> np.ndarray:
    """The vectors of ``rows``, filled up with zeros."""
    return np.array([list(r["v"]) + [0.0] * (width - len(r["v"])) for r in rows], float).reshape(len(rows), width)


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Number of the codeword nearest to each row."""
    if len(book) < 2:
        return np.zeros(len(x), np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num((book * book).sum(axis=1) - 2 * (x @ book.T), nan=0.0).argmin(axis=1)


def codebook(x: np.ndarray, size: int, rounds: int = ROUNDS) -> np.ndarray:
    """``size`` codewords (at most as many as distinct rows) by Lloyd's rounds, from rows evenly spaced in the sample."""
    start = np.unique(x, axis=0) if len(x) else np.zeros((1, x.shape[1]))
    book = start[np.linspace(0, len(start) - 1, min(size, len(start))).astype(int)]
    for _ in range(rounds if len(x) else 0):
        code = nearest(x, book)
        n = np.bincount(code, minlength=len(book))
        with np.errstate(over="ignore", invalid="ignore"):
            total = np.stack([np.bincount(code, x[:, d], len(book)) for d in range(x.shape[1])], axis=1) \
                if x.shape[1] else np.zeros((len(book), 0))
            book = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], book)
    return np.nan_to_num(book)


def multi_sequence(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Pairs (i, j) with first[i] + second[j], the greatest sum first; both inputs descend.

    A pair enters the heap once the pairs before it in its row and in its column are out, so the
    heap holds one pair a row at most."""
    if not len(first) or not len(second):
        return
    heap = [(-(first[0] + second[0]), 0, 0)]
    reached = [0] * (len(first) + 1)  # columns of each row that are out
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, i, j
        reached[i] = j + 1
        if i + 1 < len(first) and reached[i + 1] == j:
            heapq.heappush(heap, (-(first[i + 1] + second[j]), i + 1, j))
        if j + 1 < len(second) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (-(first[i] + second[j + 1]), i, j + 1))


class Positives:
    """The best rows of an anchor's label."""

    def __init__(self, label: str, size: int):
        self.label, self.size, self.top = label, size, math.inf
        self.found: list[Found] = []

    def wanted(self, labels: np.ndarray) -> np.ndarray:
        return labels == self.label

    def least(self) -> float:
        """A row below this score changes nothing any more."""
        return -self.found[-1][0] if len(self.found) == self.size else -math.inf

    def add(self, found: list[Found]) -> None:
        self.found = heapq.nsmallest(self.size, self.found + found)


class Negatives:
    """The best rows of other labels in each of some windows of scores."""

    def __init__(self, label: str, size: int, windows: list[tuple[int, int]]):
        self.label, self.size, self.windows = label, size, windows
        self.held: list[list[Found]] = [[] for _ in windows]
        self.top = max((hi for _, hi in windows), default=-math.inf)

    def wanted(self, labels: np.ndarray) -> np.ndarray:
        return labels != self.label

    def least(self) -> float:
        return min((-own[-1][0] if len(own) == self.size else lo
                    for (lo, hi), own in zip(self.windows, self.held) if lo <= hi), default=math.inf)

    def add(self, found: list[Found]) -> None:
        for k, (lo, hi) in enumerate(self.windows):
            own = [f for f in found if lo <= -f[0] <= hi]
            if own:
                self.held[k] = heapq.nsmallest(self.size, self.held[k] + own)


class Cells:
    """Some rows of the index, by cell, with the radii of their codewords."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, labels: np.ndarray, x: np.ndarray, codes: np.ndarray,
                 books: tuple[np.ndarray, np.ndarray]):
        cell = codes[:, 0] * len(books[1]) + codes[:, 1]
        order = np.argsort(cell, kind="stable")
        self.ids, self.null, self.labels, self.x = ids[order], null[order], labels[order], x[order]
        self.starts = np.searchsorted(cell[order], np.arange(len(books[0]) * len(books[1]) + 1))
        self.books, self.cut = books, books[0].shape[1]
        self.largest = float(np.abs(x).max(initial=0))
        self.radius = []
        for half, (book, own) in enumerate(zip(books, (x[:, :self.cut], x[:, self.cut:]))):
            with np.errstate(over="ignore", invalid="ignore"):
                far = np.sqrt(((own - book[codes[:, half]]) ** 2).sum(axis=1))
            r = np.full(len(book), -1.0)  # no row
            np.maximum.at(r, codes[:, half], np.nan_to_num(far, nan=np.inf))
            self.radius.append(r)
        self.scored = 0

    def bounds(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each half: codewords by descending bound, those bounds, and lower bounds."""
        out = []
        for book, r, own in zip(self.books, self.radius, (q[:self.cut], q[self.cut:])):
            code = np.flatnonzero(r >= 0)
            with np.errstate(over="ignore", invalid="ignore"):
                middle, reach = book[code] @ own, math.sqrt(float(own @ own)) * r[code]
                slack = 0.5 + 1e-9 * (np.abs(middle) + reach)
                hi, lo = middle + reach + slack, middle - reach - slack
            if not (np.isfinite(hi).all() and np.isfinite(lo).all()):  # no bound in doubles: visit them all
                hi, lo = np.full(len(code), np.inf), np.full(len(code), -np.inf)
            order = np.argsort(-hi, kind="stable")
            out.append((code[order], hi[order], lo[order]))
        return out

    def search(self, own_id: int, q: np.ndarray, want: Positives | Negatives) -> None:
        (one, hi1, lo1), (two, hi2, lo2) = self.bounds(q)
        exact = self.largest * float(np.abs(q).max(initial=0)) * max(len(q), 1) < EXACT
        pending, held = [], 0
        least = want.least()
        for bound, i, j in multi_sequence(hi1, hi2):
            if held >= STEP:
                self._score(np.concatenate(pending), own_id, q, exact, want)
                pending, held, least = [], 0, want.least()
            if bound < least:
                break
            at = int(one[i]) * len(self.books[1]) + int(two[j])
            a, z = self.starts[at], self.starts[at + 1]
            if a < z and lo1[i] + lo2[j] <= want.top:
                pending.append(np.arange(a, z))
                held += z - a
        if pending:
            self._score(np.concatenate(pending), own_id, q, exact, want)

    def _score(self, rows: np.ndarray, own_id: int, q: np.ndarray, exact: bool, want: Positives | Negatives) -> None:
        rows = rows[want.wanted(self.labels[rows]) & (self.null[rows] | (self.ids[rows] != own_id))]
        self.scored += len(rows)
        got = np.rint(self.x[rows] @ q).astype(np.int64) if exact else scores(self.x[rows], q)
        near = (got >= want.least()) & (got <= want.top) if exact else np.ones(len(rows), bool)
        rows, got = rows[near], got[near]
        if len(rows):
            want.add(list(zip((-got).tolist(), self.null[rows].tolist(), self.ids[rows].tolist())))


def _chunks(batches: Iterator[pa.RecordBatch], books: tuple[np.ndarray, np.ndarray]) -> Iterator[Cells]:
    """The index rows (id, label, v, codes) of a task, in chunks of about CHUNK_BYTES."""
    width = books[0].shape[1] + books[1].shape[1]
    held: list[pa.RecordBatch] = []

    def cells() -> Cells:
        t = pa.Table.from_batches(held).combine_chunks()
        ids, label, v, codes = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.columns)
        return Cells(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(ids.is_null()),
                     np.array(label.to_pylist(), object), matrix(v, width), matrix(codes, 2).astype(np.int64), books)

    rows = 0
    for b in batches:
        for at in range(0, b.num_rows, STEP):
            held.append(b.slice(at, STEP))
            rows += held[-1].num_rows
            if rows * max(width, 1) * 8 >= CHUNK_BYTES:
                yield cells()
                held, rows = [], 0
    if rows:
        yield cells()


def _best(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best rows of each group, of those that the tasks found (k a task at most)."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("other_id"))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_block(index: DataFrame, books: tuple[np.ndarray, np.ndarray], ids: np.ndarray, q: np.ndarray,
                  wants: Callable[[], list[Positives | Negatives]]) -> DataFrame:
    """anchor_no, part (which window), other_id, score: the best of each task's rows."""
    shared = index.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        own = wants()
        for cells in _chunks(batches, books):
            for n in range(len(ids)):
                cells.search(int(ids[n]), q[n], own[n])
        rows = [(n, part, None if null else i, -s) for n, w in enumerate(own)
                for part, found in enumerate([w.found] if isinstance(w, Positives) else w.held) for s, null, i in found]
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["anchor_no", "part", "other_id", "score"])

    return index.mapInArrow(run, "anchor_no long, part long, other_id long, score long")


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE,
         codewords: int = CODEWORDS, sample: int = SAMPLE, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``is_anchor`` is a condition on ``id``."""
    spark = vectors.sparkSession
    rows = stage_table(indexable(vectors, id_col, vector_col, label_col, scale), "negative-rows")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    drawn = rows.orderBy(F.xxhash64("id"), "id", "v").limit(sample).collect()
    x = filled(drawn, width)
    cut = width // 2
    books = codebook(x[:, :cut], codewords), codebook(x[:, cut:], codewords)

    def coded(b: pa.RecordBatch) -> dict[str, pa.Array]:
        v = matrix(b.column(0), width)
        codes = np.stack((nearest(v[:, :cut], books[0]), nearest(v[:, cut:], books[1])), axis=1).astype(np.int32)
        return {"codes": pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * 2, pa.array(codes.ravel()))}

    index = stage_table(append_columns(rows, coded, {"codes": T.ArrayType(T.IntegerType())}, {"v": "v"})
                        .sortWithinPartitions("codes"), "negative-index")
    anchors = rows.filter(F.col("id").isNotNull() & is_anchor).distinct()
    size = max(1, min(anchor_block, BLOCK_BYTES // max(width * 8, 1)))
    n_blocks = math.ceil(anchors.count() / size)
    anchors = stage_table(anchors.withColumn("block", F.pmod(F.xxhash64("id", "v", "label"), F.lit(max(n_blocks, 1)))),
                          "negative-anchors")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = stage_path(spark, "negatives")
    for block in range(n_blocks):
        own = anchors.filter(F.col("block") == block).orderBy("id", "label", "v").collect()
        _mine_block(index, books, own, width, positives, negatives, low, high).write.parquet(f"{out}/block={block}")
    if not n_blocks:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(out).drop("block")


def _mine_block(index: DataFrame, books: tuple[np.ndarray, np.ndarray], own: list, width: int, positives: int,
                negatives: int, low: int, high: int) -> DataFrame:
    ids = np.array([r["id"] for r in own], np.int64)
    labels = [r["label"] for r in own]
    q = filled(own, width)
    found = _best(_search_block(index, books, ids, q, lambda: [Positives(label, positives) for label in labels]),
                  ["anchor_no"], positives).orderBy("anchor_no", "rank").collect()  # ``positives`` rows an anchor
    scored: list[list[int]] = [[] for _ in own]
    for r in found:
        scored[r["anchor_no"]].append(r["score"])
    # 100 * score within low * p and high * p, in whole numbers
    windows = [[(-(-low * p // 100), high * p // 100) for p in ps] for ps in scored]
    got = _search_block(index, books, ids, q, lambda: [Negatives(label, negatives, w) for label, w in zip(labels, windows)])
    part = [0] * len(own)
    pairs = []
    for r in found:
        n = r["anchor_no"]
        pairs.append((n, part[n], int(ids[n]), r["other_id"], r["score"]))
        part[n] += 1
    held = index.sparkSession.createDataFrame(
        pairs, "anchor_no long, part long, anchor_id long, positive_id long, positive_score long")
    return (_best(got, ["anchor_no", "part"], negatives).join(F.broadcast(held), ["anchor_no", "part"])
            .select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))
