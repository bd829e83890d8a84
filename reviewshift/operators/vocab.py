"""Vocabularies and fixed-length token-id encodings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as lx
from ..functions import text as tx
from .ranking import top_k

PAD, UNK = 0, 1
PIECE_BYTES = 64 << 20  # of text whose tokens are held at once


def split_texts(texts: pa.StringArray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The tokens of all texts one after another, as ``tx.tokens`` gives them, and each token's row. Arrow's white
    space is that of ``tx.WS``."""
    lists = pc.utf8_split_whitespace(texts)
    row = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    words = lists.flatten()
    there = pc.not_equal(words, "")
    return words.filter(there).dictionary_encode(), row[there.to_numpy(zero_copy_only=False)]


def pieces(b: pa.RecordBatch, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """``b`` in slices of about ``size`` bytes, so that long texts are not split all at once."""
    step = max(1, int(b.num_rows * size / max(b.nbytes, size)))
    return (b.slice(i, step) for i in range(0, b.num_rows, step))


def runs(sizes: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """First row and number of rows of runs whose ``sizes`` add up to about ``size``, by each row's own: a run holds
    less than ``size`` and one row."""
    at = np.cumsum(sizes) // size
    edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(sizes)]
    return ((a, b - a) for a, b in zip(edges, edges[1:]) if b > a)


def token_counts(df: DataFrame, group: list[str], text: str = "review_text_clean", out: list[str] = ["n"],
                 by: str | None = None) -> DataFrame:
    """(group..., token, out...): how often each token occurs in a group; with ``by``, an integer column, ``out[i]``
    counts the tokens of its rows with value i. Tokens are counted batch by batch where the texts lie, so that a row
    a batch and token, not a row a token, is aggregated."""
    k, n = len(group), len(out)
    slim = df.select(*group, (F.col(by).cast("long") if by else F.lit(0).cast("long")).alias("_by"), F.col(text).alias("_text"))
    schema = T.StructType([*slim.schema[:k].fields, T.StructField("token", T.StringType()),
                           *[T.StructField(c, T.LongType()) for c in out]])

    def run(batches):
        for b in (x for whole in batches for x in pieces(whole)):
            number: dict = {}
            values = zip(*(b.column(i).to_pylist() for i in range(k))) if k else iter([()] * b.num_rows)
            of = np.array([number.setdefault(v, len(number)) for v in values], dtype=np.int64)
            slot = pc.fill_null(b.column(k), n).to_numpy(zero_copy_only=False)
            slot = np.where((slot < 0) | (slot >= n), n, slot)  # other values: the token is there, uncounted
            for g in range(len(number)):
                own = np.flatnonzero(of == g)
                words, row = split_texts(b.column(k + 1).take(pa.array(own)))
                v = len(words.dictionary)
                cells = np.bincount(slot[own][row] * v + words.indices.to_numpy(zero_copy_only=False), minlength=(n + 1) * v)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i).take(pa.array(np.full(v, own[0]))) for i in range(k)), words.dictionary,
                     *(pa.array(cells[i * v:(i + 1) * v].astype(np.int64)) for i in range(n))], names=schema.names)

    return slim.mapInArrow(run, schema).groupBy(*group, "token").agg(*[F.sum(c).alias(c) for c in out])


def text_tokens(df: DataFrame, cols: list[str], text: str = "review_text_clean") -> DataFrame:
    """(cols..., token, cnt): the different tokens of each row's text and how often they stand there, in place."""
    slim = df.select(*cols, F.col(text).alias("_text"))
    schema = T.StructType([*slim.schema[:len(cols)].fields, T.StructField("token", T.StringType()), T.StructField("cnt", T.LongType())])

    def run(batches):
        for b in (x for whole in batches for x in pieces(whole)):
            words, row = split_texts(b.column(len(cols)))
            v = max(1, len(words.dictionary))
            pair, count = np.unique(row * v + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
            at = pa.array(pair // v)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i).take(at) for i in range(len(cols))), words.dictionary.take(pa.array(pair % v)),
                 pa.array(count.astype(np.int64))], names=schema.names)

    return slim.mapInArrow(run, schema)


def build_vocab(df: DataFrame, group: list[str], text: str = "review_text_clean",
                max_vocab: int = lx.MAX_VOCAB) -> DataFrame:
    """Per group, <PAD>=0, <UNK>=1, then the max_vocab-2 most frequent
    tokens (ties: token ascending) with ids from 2.

    ``top_k`` ranks in hash buckets first, so no task sorts a group's whole
    word table. The result is bounded by ``max_vocab`` rows per group.
    """
    counts = token_counts(df, group, text)
    top = top_k(counts, group, [F.col("n").desc(), F.col("token")], max_vocab - 2, ["token"], out="_r")
    words = top.select(*group, "token", (F.col("_r") + 1).cast("int").alias("id"))
    specials = df.select(*group).distinct().select(
        *group, F.explode(F.array(F.struct(F.lit("<PAD>").alias("token"), F.lit(PAD).alias("id")),
                                  F.struct(F.lit("<UNK>").alias("token"), F.lit(UNK).alias("id"))))
        .alias("s")).select(*group, "s.token", "s.id")
    return specials.unionByName(words)


def encode_tokens(df: DataFrame, vocab: DataFrame, doc_keys: list[str], group: list[str],
                  text: str = "review_text_clean", max_len: int = lx.MAX_LEN) -> DataFrame:
    """F1 + F2 + J3: first ``max_len`` tokens -> ids (UNK when unknown),
    right-padded with PAD, plus the attention mask and the real length.

    The vocabulary is bounded by ``max_vocab`` rows per group (W5), so the
    lookup is a left join that the planner broadcasts if it is small enough; ids are
    regrouped per document (at most ``max_len`` rows each) in position order.
    """
    pos = df.select(*doc_keys, *group,
                    F.posexplode(F.slice(tx.tokens(text), 1, max_len)).alias("pos", "token"))
    j = pos.join(vocab, group + ["token"], "left") \
        .withColumn("id", F.coalesce(F.col("id"), F.lit(UNK)))
    ids = j.groupBy(*doc_keys, *group).agg(
        F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("_p"))
    base = df.select(*doc_keys, *group)
    out = base.join(ids, doc_keys + group, "left")
    real = F.coalesce(F.transform("_p", lambda s: s["id"]), F.array().cast("array<int>"))
    n = F.size(real)
    return out.select(
        *doc_keys, *group, n.alias("n_tokens"),
        F.concat(real, F.array_repeat(F.lit(PAD), F.lit(max_len) - n)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_len) - n))
        .alias("attention_mask"))


def vocab_lookup(tokens_df: DataFrame, vocab: DataFrame, on: list[str]) -> DataFrame:
    """Token -> id with UNK default (vocab is bounded by max_vocab per group)."""
    return tokens_df.join(vocab, on, "left") \
        .withColumn("id", F.coalesce(F.col("id"), F.lit(UNK)))


__all__ = ["split_texts", "pieces", "runs", "token_counts", "text_tokens", "build_vocab", "encode_tokens", "vocab_lookup", "SparkSession"]
