"""Helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir

SLICE_BYTES = 4_000_000  # of text that a function of ``append_columns`` gets at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: lineage ends at the table,
    so a lost executor costs no recomputation of what is before it."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever their names (a dot in one is no struct field)."""
    return [F.col(f"`{c}`") for c in df.columns]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _slices(b: pa.RecordBatch, reads: list[int]) -> Iterator[pa.RecordBatch]:
    """``b`` in runs of rows whose columns ``reads`` hold about SLICE_BYTES of text (one row at least)."""
    size = np.zeros(b.num_rows, np.int64)
    for i in reads:
        if pa.types.is_string(b.schema.types[i]) or pa.types.is_large_string(b.schema.types[i]):
            size += pc.fill_null(pc.binary_length(b.column(i)), 0).to_numpy()
    run = np.cumsum(size) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), b.num_rows]
    for at, end in zip(edges, edges[1:]):
        yield b.slice(at, end - at)


def append_columns(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, pa.Array]],
                   new: dict[str, T.DataType], inputs: dict[str, str]) -> DataFrame:
    """All of ``df`` plus the columns that ``fn`` computes from each slice of an Arrow batch.

    ``inputs`` maps the name under which ``fn`` reads a column to its name in ``df``. A column
    of ``df`` that is called like a new one is replaced. No shuffle: rows stay where they are.
    A column that is kept and read goes to Python once, and a slice bounds what ``fn`` unpacks.
    """
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in new}]
    sent = kept + [c for c in dict.fromkeys(inputs.values()) if c not in kept]
    # by place: a Python stage can't read columns with a dot in their name
    wide = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(sent)))
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, t) for n, t in new.items()])
    n_kept, reads, names, at = len(kept), list(inputs), list(new), [sent.index(c) for c in inputs.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            for b in _slices(whole, at):
                got = fn(pa.RecordBatch.from_arrays([b.column(i) for i in at], names=reads))
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(n_kept)] + [got[n] for n in names],
                                                 names=kept + names)

    return wide.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings, a null as the empty text."""
    return [t or "" for t in column.to_pylist()]
