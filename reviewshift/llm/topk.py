"""Exact top-k inner products by pivot-table elimination.

Every vector's distances to a few pivots are computed once and stored with it. For a query q and a
vector x, the largest | d(q, p) - d(x, p) | over the pivots is a lower bound of d(q, x), and
q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2, so it gives an upper bound of the score. Candidates are
evaluated in the order of that bound; once it falls below the k-th best score the rest are out.

Queries go over the table in blocks of about ``query_block``, one after another: a block is
broadcast (its size is bounded), each task keeps the k best of each query over the rows that it
reads, a window takes the k best over the tasks, and they are written before the next block begins. Pivots come from the first ``sample`` rows by id hash,
each the one farthest from those before; they bear on speed only.

Defined results: vectors that are null or hold a null or non-finite component take no part. Short
vectors count as filled up with zeros. A row with a query's own id is no candidate of it; other
rows that repeat an id are candidates each. Equal query rows are one query. A null id is no query,
and among ties comes last. Scores beyond 64 bits are the nearest long, and tie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator, Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, stage_path, stage_table

SCALE, PIVOTS, SAMPLE, STEP = 1024, 32, 2000, 64
QUERY_BLOCK, BLOCK_BYTES = 2000, 16_000_000  # queries of a block, and bytes of their vectors and distances
EXACT = float(1 << 52)  # products up to here are exact in doubles
LONG = (1 << 63) - 1


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of an Arrow list column, filled up with zeros to the longest (``width`` at least)."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), max(width, int(sizes.max(initial=0)))))
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def fitted(x: np.ndarray, width: int) -> np.ndarray:
    """``x`` with columns of zeros up to ``width``."""
    return np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    width = max(x.shape[1], pivots.shape[1])
    x, pivots = fitted(x, width), fitted(pivots, width)
    with np.errstate(over="ignore"):
        cols = [np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots]
    return np.column_stack(cols) if cols else np.zeros((len(x), 0))


def choose_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the row with the largest distance to the nearest one so far."""
    if not len(x):
        return x
    picked, nearest = [0], distances(x, x[:1])[:, 0]
    while len(picked) < min(n, len(x)) and nearest.max() > 0:
        picked.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(x, x[picked[-1:]])[:, 0])
    return x[picked]


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products."""
    if float(np.abs(x).max(initial=0)) < EXACT / max(float(np.abs(q).max(initial=0)) * len(q), 1.0):
        return np.rint(x @ q).astype(np.int64)
    whole = [int(v) for v in q]
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, whole)), -LONG), LONG) for row in x], np.int64)


class Best:
    """The k best candidates of each query of a block, over the batches of a task."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, dist: np.ndarray, k: int):
        self.ids, self.q, self.dist, self.k = ids, q, dist, k
        with np.errstate(over="ignore"):
            self.norm = (q * q).sum(axis=1)
        self.found: list[list[tuple[int, bool, int]]] = [[] for _ in ids]  # (-score, id is null, id)
        self.scored = 0

    def add(self, ids: np.ndarray, null: np.ndarray, x: np.ndarray, dist: np.ndarray) -> None:
        width = max(x.shape[1], self.q.shape[1])
        x, q = fitted(x, width), fitted(self.q, width)
        with np.errstate(over="ignore"):  # an infinite bound leaves a candidate in
            norm = (x * x).sum(axis=1)
        for k in range(len(self.ids)):
            with np.errstate(invalid="ignore", over="ignore"):
                low = np.abs(dist - self.dist[k]).max(axis=1, initial=0.0)
                both = norm + self.norm[k]
                top = (both - low * low) / 2 + 1 + 1e-9 * both
            top = np.where(np.isnan(top), np.inf, top)
            top[(ids == self.ids[k]) & ~null] = -np.inf
            held = self.found[k]
            left = np.flatnonzero(top >= (-held[-1][0] if len(held) == self.k else -np.finfo(float).max))
            left = left[np.argsort(-top[left])]
            for at in range(0, len(left), STEP):
                part = left[at:at + STEP]
                if len(held) == self.k and top[part[0]] < -held[-1][0]:
                    break
                got = scores(x[part], q[k])
                self.scored += len(part)
                held += zip((-got).tolist(), null[part].tolist(), ids[part].tolist())
                held.sort()
                del held[self.k:]


def prepared(vectors: DataFrame, id_col: str, vector_col: str, n_pivots: int = PIVOTS, sample: int = SAMPLE) -> DataFrame:
    """Stage table of id, v (floor(1024 x) as doubles), dist (to the pivots)."""
    v: Column = F.col(vector_col)
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))
            .filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)
                                                      & (F.abs(x) < F.lit(float("inf")))))
            .select("id", F.transform("v", lambda x: _floor(x * SCALE)).alias("v")))
    first = rows.orderBy(F.xxhash64("id"), "id", "v").limit(sample).collect()
    width = max((len(r["v"]) for r in first), default=0)
    pivots = choose_pivots(np.array([list(r["v"]) + [0.0] * (width - len(r["v"])) for r in first]).reshape(len(first), width),
                           n_pivots)

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        d = distances(matrix(b.column(0)), pivots)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.ravel()))
        return {"dist": flat}

    return stage_table(append_columns(rows, run, {"dist": T.ArrayType(T.DoubleType())}, {"v": "v"}), "vectors")


def _floor(x: Column) -> Column:
    """Floor within doubles, whatever the size."""
    down = F.rint(x)
    return F.when(down > x, down - 1).otherwise(down)


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
           query_block: int = QUERY_BLOCK, n_pivots: int = PIVOTS, stats: dict[str, int] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of every row for each query; ``is_query`` is a
    condition on ``id``. Ties go to the smaller id. ``stats`` gets the numbers of pairs of a query and a
    row, and of those whose score was computed; the others were spared by their bound."""
    spark = vectors.sparkSession
    rows = prepared(vectors, id_col, vector_col, n_pivots)
    queries = rows.filter(F.col("id").isNotNull() & is_query).distinct()
    n, width, wide = queries.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.size("dist"))).first()
    size = max(1, min(query_block, BLOCK_BYTES // (8 * ((width or 0) + (wide or 0) + 1))))
    n_blocks = math.ceil(n / size)
    queries = stage_table(queries.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(max(n_blocks, 1)))), "queries")
    pairs, scored = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    order = Window.partitionBy("query_id", "query_no").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    out, schema = stage_path(spark, "best"), "query_id long, rank int, vec_id long, score long"
    # a block is all that the driver and the tasks hold of the queries; its result is written before the next begins
    for block in range(n_blocks):
        own = queries.filter(F.col("block") == block).orderBy("id", "v").collect()
        if not own:
            continue
        found, shared = _block(rows, own, k, pairs, scored)
        (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
         .select("query_id", "rank", "vec_id", "score").write.parquet(f"{out}/block={block}"))
        shared.unpersist()
    if stats is not None:
        stats.update(pairs=pairs.value, scored=scored.value)
    return spark.read.schema(schema).parquet(out).drop("block") if n else spark.createDataFrame([], schema)


def _block(rows: DataFrame, own: list, k: int, pairs: Accumulator, scored: Accumulator) -> tuple[DataFrame, Broadcast]:
    """query_no, query_id, vec_id, score: the k best of each task's rows for the queries ``own``."""
    width = max(len(r["v"]) for r in own)
    held = (np.array([r["id"] for r in own], np.int64),
            np.array([list(r["v"]) + [0.0] * (width - len(r["v"])) for r in own]).reshape(len(own), width),
            np.array([r["dist"] for r in own], float).reshape(len(own), -1))
    shared = rows.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, dist = shared.value
        best = Best(ids, q, dist, k)
        for b in batches:
            if b.num_rows:
                null = np.asarray(b.column(0).is_null())
                pairs.add(b.num_rows * len(ids))
                best.add(b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), null,
                         matrix(b.column(1)), matrix(b.column(2), dist.shape[1]))
        scored.add(best.scored)
        out = [(n, int(ids[n]), None if null else i, -s) for n, held in enumerate(best.found) for s, null, i in held]
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                         names=["query_no", "query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_no long, query_id long, vec_id long, score long"), shared
