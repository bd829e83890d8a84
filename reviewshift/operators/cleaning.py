"""Both cleaning paths token by token: a batch's different tokens are cleaned once, where the texts lie.

Every step of the chain (``tx.clean_prefix``, ``tx.normalize_slang``, ``tx.clean_suffix``) works inside a token of a
lower-cased text: no pattern reaches over white space, except to squeeze it, and what a step puts in is white space.
A cleaned text is therefore its cleaned tokens, joined by a space.
"""

from __future__ import annotations

import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from .vocab import pieces, split_texts

CLEAN_BYTES = 4 << 20  # of text whose tokens are held at once

# the patterns of ``tx`` for one token; Python's \w is its WORD
EMOJI = "\U00010000-\U0010FFFF☀-➿"
URL = re.compile(r"https?://\S+|www\.\S+")
TAG = re.compile(rf"[@#]\w+|[{EMOJI}]+")
REPEAT = re.compile(r"([^\n])\1(?:\1+|(?<=[!?.-]))")
BETWEEN = re.compile(r"[^\w.,!?']+")
# such tokens stay as they are, unless one of TOUCHED is in them
PLAIN = "^[a-z0-9_.,!?']+$"
TOUCHED = "|".join([r"www\.", "!!", r"\?\?", r"\.\.", *(c * 3 for c in string.ascii_lowercase + string.digits + "_,'")])


def clean_paths(df: DataFrame, cols: list[str], text: str, lexicon: dict[str, str] | None = None,
                whitelist: tuple[str, ...] | None = None, out: tuple[str, str] = ("baseline", "proposed")) -> DataFrame:
    """``cols`` of ``df`` with the texts cleaned without and with slang normalisation, as ``tx.clean_text`` gives them (no null)."""
    slang = tx.slang_map(lexicon, whitelist)
    k = len(cols)
    low = df.select(*cols, tx.lower(text).alias("_low"))
    schema = T.StructType([*low.schema[:k].fields, *(T.StructField(c, T.StringType()) for c in out)])

    def run(batches):
        keys = pa.array(sorted(slang), pa.string())

        def one(token: str) -> tuple[str, str]:
            pre = REPEAT.sub(r"\1", TAG.sub(" ", URL.sub(" ", token)))
            base = BETWEEN.sub(" ", pre).strip(" ")
            parts = pre.split()
            if not any(k in slang for k in parts):
                return base, base
            return base, BETWEEN.sub(" ", " ".join(slang.get(k, k) or "" for k in parts)).strip(" ")

        for b in (x for whole in batches for x in pieces(whole, CLEAN_BYTES)):
            words, row = split_texts(b.column(k))
            known, code = words.dictionary, words.indices.to_numpy(zero_copy_only=False)
            same = pc.and_(pc.match_substring_regex(known, PLAIN), pc.invert(pc.match_substring_regex(known, TOUCHED)))
            odd = pc.or_(pc.invert(same), pc.is_in(known, value_set=keys))
            new = [one(t) for t in known.filter(odd).to_pylist()]
            texts = [_joined(pc.replace_with_mask(known, odd, pa.array([n[i] for n in new], pa.string())), code, row, b.num_rows)
                     for i in range(2)]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *texts], names=schema.names)
        pa.default_memory_pool().release_unused()  # the worker stays for later tasks

    return low.mapInArrow(run, schema)


def _joined(clean: pa.StringArray, code: np.ndarray, row: np.ndarray, rows: int) -> pa.StringArray:
    """The texts of ``rows`` rows: token ``clean[code[i]]`` belongs to row ``row[i]``; empty ones are left out."""
    there = pc.not_equal(clean, "").to_numpy(zero_copy_only=False)[code]
    if not there.all():
        code, row = code[there], row[there]
    ends = np.r_[0, np.cumsum(np.bincount(row, minlength=rows))].astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), clean.take(pa.array(code))), " ")

