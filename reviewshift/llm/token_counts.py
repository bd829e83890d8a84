"""Token counts of a piece vocabulary without token ids.

A piece never spans a place between two letters that stand beside each other in no piece, so the
pieces of a text are those of its pre-tokens: white space with the letters that follow it, and
each letter of which no longer piece is made. The plan brings the frequencies of a pre-token
together, counts its pieces once, joins that count to the documents' frequencies and sums.

Frequencies travel as one row for each pre-token of a block of documents: the places in the block
of the documents that have it, by how often they do, and the lengths of these runs (none if each
has it once). A pre-token that is in many documents of a block goes to one of ``SALTS`` partitions
with the block's rows, so no task gets all of a frequent word (its pieces are counted once in each
of those at most).

Defined results: null and empty texts have no tokens. Repeated rows are rows of the result. Columns
beside id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SPACE, GUARD = "▁", "\n"
BLOCK_DOCS, BLOCK_CHARS = 30_000, 32_000_000
SALTS, FREQUENT = 64, 16  # frequent: in over a 16th of a block's documents
PLACE, RUN = np.dtype("<u2"), np.dtype([("times", "<u4"), ("size", "<u4")])


def rows_type(id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("piece", T.StringType()), T.StructField("salt", T.IntegerType()),
        T.StructField("block", T.LongType()), T.StructField("places", T.BinaryType()),
        T.StructField("runs", T.BinaryType()), T.StructField("id", id_type), T.StructField("n_bytes", T.LongType())])


class PieceCounter:
    """Pre-tokens and piece counts of a sentencepiece model without normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())
                  if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        joined = {c for p in pieces if len(p) > 1 for c in p}
        if GUARD in joined or any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces) or \
                "".join(self.model.encode("a  b", out_type=str)) != f"{SPACE}a{SPACE}{SPACE}b":
            raise ValueError(f"{path}: its pieces span pre-tokens")
        letters = "".join(re.escape(c) for c in sorted(joined - {SPACE}))
        # white space and what follows; else a letter of its own
        self.split = re.compile(f"[ {SPACE}]*[{letters}]+|[ {SPACE}]+|.", re.DOTALL).findall

    def pre_tokens(self, text: str) -> list[str]:
        return self.split(f" {text}") if text else []  # the model puts a space in front

    def count(self, pre_tokens: list[str]) -> np.ndarray:
        """Pieces of each; the guard in front takes the model's own space and is one piece more."""
        got = self.model.encode([GUARD + p for p in pre_tokens], num_threads=1)
        return np.fromiter(map(len, got), np.int64, len(got)) - 2


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    """One for each worker and file."""
    return PieceCounter(path)


def _cells(values: np.ndarray, sizes: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """Binary cells that hold ``sizes`` of ``values`` each."""
    ends = np.concatenate(([0], np.cumsum(sizes))) * values.itemsize
    valid = None if null is None else pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(sizes), [valid, pa.py_buffer(ends.astype(np.int32).tobytes()),
                                                           pa.py_buffer(values.tobytes())])


def salt_of(block: int) -> int:
    """One of ``SALTS`` by task and by number in it: most tasks have a few blocks, which start at 0."""
    return ((block >> 32) * 31 + (block & 0xFFFFFFFF)) % SALTS


def _by_word_and_times(word: np.ndarray, place: np.ndarray, times: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """The three, sorted by word, then times, then place (below ``n``): as single numbers where 63 bits hold them."""
    base = int(times.max(initial=0)) + 1
    if (int(word.max(initial=0)) + 1) * base * n >= 1 << 63:
        order = np.lexsort((place, times, word))
        return word[order], place[order], times[order]
    key = np.sort((word * base + times) * n + place)
    rest, place = np.divmod(key, n)
    return rest // base, place, rest % base


def _block(pieces: PieceCounter, docs: list[tuple], block: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of one block: one of each document with its id and size, and one of each pre-token."""
    index: dict[str, int] = {}
    spots, sizes = [], []
    for _, text in docs:
        words = pieces.pre_tokens(text)
        spots.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words)))
        sizes.append(len(words))
    names = np.array(sorted(index), object)  # like pre-tokens stand together: they compress better
    number = np.empty(len(index), np.int64)
    number[[index[w] for w in names]] = np.arange(len(index))
    pair = number[np.concatenate(spots)] * len(docs) + np.repeat(np.arange(len(docs)), sizes)
    pair, times = np.unique(pair, return_counts=True)
    word, place, times = _by_word_and_times(pair // len(docs), pair % len(docs), times, len(docs))
    n_docs = np.bincount(word, minlength=len(index))
    edge = np.flatnonzero((word[1:] != word[:-1]) | (times[1:] != times[:-1])) + 1
    first = np.concatenate(([0], edge)) if len(word) else edge
    runs = np.empty(len(first), RUN)
    runs["times"], runs["size"] = times[first], np.diff(np.append(first, len(word)))
    of_run = word[first]
    n_runs = np.bincount(of_run, minlength=len(index))
    once = (n_runs == 1) & (np.bincount(word, times, len(index)) == n_docs)
    n = len(docs)
    yield pa.RecordBatch.from_arrays([
        pa.array([f"{GUARD}{GUARD}{block}:{k}" for k in range(n)]), pa.array(np.zeros(n, np.int32)),
        pa.array(np.full(n, block)), _cells(np.arange(n).astype(PLACE), np.ones(n, np.int64)),
        pa.nulls(n, pa.binary()), pa.array([d[0] for d in docs], schema.field("id").type),
        pa.array([len(d[1].encode("utf-8", "surrogatepass")) for d in docs], pa.int64())], schema=schema)
    for at in range(0, len(names), 100_000):
        own = slice(at, at + 100_000)
        p = slice(*np.searchsorted(word, [at, at + 100_000]))
        r = slice(*np.searchsorted(of_run, [at, at + 100_000]))
        n = len(names[own])
        yield pa.RecordBatch.from_arrays([
            pa.array(names[own], pa.string()),
            pa.array(np.where(n_docs[own] * FREQUENT > len(docs), salt_of(block), -1).astype(np.int32)),
            pa.array(np.full(n, block)), _cells(place[p].astype(PLACE), n_docs[own]),
            _cells(runs[r][~once[of_run[r]]], np.where(once[own], 0, n_runs[own]), once[own]),
            pa.nulls(n, schema.field("id").type), pa.nulls(n, pa.int64())], schema=schema)


def _read(cells: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of binary cells, and how many each holds (a null none)."""
    held = [c or b"" for c in cells.to_pylist()]
    return np.frombuffer(b"".join(held), kind), np.fromiter(map(len, held), np.int64, len(held)) // kind.itemsize


def _sums(pieces: PieceCounter, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The documents among the rows of ``b``, and pieces summed by block and place."""
    names = ["block", "place", "n", "id", "n_bytes"]
    block, sized = b.column(2), b.column(6).is_valid()
    place, each = _read(b.column(3), PLACE)
    runs, n_runs = _read(b.column(4), RUN)
    is_doc = sized.to_numpy(zero_copy_only=False)
    if is_doc.any():
        n = int(is_doc.sum())
        yield pa.RecordBatch.from_arrays([
            block.filter(sized), pa.array(place[np.repeat(is_doc, each)].astype(np.int32)),
            pa.array(np.zeros(n, np.int64)), b.column(5).filter(sized), b.column(6).filter(sized)], names=names)
    # a pre-token's rows stand together, so each is counted once
    words = b.column(0).dictionary_encode()
    n_pieces = np.where(is_doc, 0, pieces.count(words.dictionary.to_pylist())[words.indices.to_numpy()])
    times = np.ones(len(place), np.int64)
    times[np.repeat(n_runs > 0, each)] = np.repeat(runs["times"].astype(np.int64), runs["size"])
    blocks, of_row = np.unique(block.to_numpy(), return_inverse=True)
    key = np.repeat(of_row, each) << 16 | place
    order = np.argsort(key)
    key, n = key[order], (np.repeat(n_pieces, each) * times)[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    yield pa.RecordBatch.from_arrays([
        pa.array(blocks[key[first] >> 16]), pa.array((key[first] & 0xFFFF).astype(np.int32)),
        pa.array(np.add.reduceat(n, first)), pa.nulls(len(first), b.column(5).type), pa.nulls(len(first), pa.int64())], names=names)


def frequencies(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``rows_type``: the documents of each block, and the frequencies of its pre-tokens."""
    rows = rows_type(docs.schema[id_col].dataType)
    schema = to_arrow_schema(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, task = counter(path), TaskContext.get().partitionId()
        held, chars, n = [], 0, 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.append((i, text or ""))
                chars += len(text or "")
                if len(held) >= BLOCK_DOCS or chars >= BLOCK_CHARS:
                    yield from _block(pieces, held, (task << 32) + n, schema)
                    held, chars, n = [], 0, n + 1
        if held:
            yield from _block(pieces, held, (task << 32) + n, schema)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, rows)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens of each row of ``docs``."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from _sums(counter(path), b)

    out = T.StructType([T.StructField("block", T.LongType()), T.StructField("place", T.IntegerType()),
                        T.StructField("n", T.LongType()), T.StructField("id", docs.schema[id_col].dataType),
                        T.StructField("n_bytes", T.LongType())])
    # Both sides of the join would come from one exchange: it is a merge within its partitions.
    posted = (frequencies(docs, path, id_col, text_col).repartition("piece", "salt")
              .sortWithinPartitions("piece")
              .mapInArrow(joined, out))
    return (posted.groupBy("block", "place")
            .agg(F.max("id").alias("id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
            .select("id", "n_bytes", "n_tokens"))
