"""M1 / M3 for lexicons that live in tables: one automaton for all keywords.

A text is read once, whatever the number of keywords: the automaton (a trie
with failure links over whole keywords) is at the longest keyword end that the
letters so far allow, and every keyword that ends there is a hit, also inside
or across others. A table of more than ``max_keywords`` is dealt into parts by
hash, and the texts are read once for each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

MAX_KEYWORDS = 1_000_000


def automaton(keywords: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for k in keywords:
        out.add_word(k, k)
    out.make_automaton()
    return out


def keyword_hits(df: DataFrame, keywords: DataFrame, keys: list[str], text: str = "review_text",
                 max_keywords: int = MAX_KEYWORDS) -> DataFrame:
    """keys..., keyword, n: the places of each keyword of ``keywords(keyword)`` in each text, overlapping ones too.
    Texts are lower-cased, as the built-in lists are lower case; null and empty keywords are none, a null text is empty."""
    own = keywords.select("keyword").filter("keyword <> ''").distinct()
    parts = max(1, math.ceil(own.count() / max_keywords))
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("keyword", T.StringType()),
                           T.StructField("n", T.LongType())])
    narrow = df.select(*keys, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    found = []
    for part in range(parts):
        mine = own.filter(F.pmod(F.xxhash64("keyword"), F.lit(parts)) == part)
        listed = [r[0] for r in mine.collect()]  # at most about max_keywords
        shared = df.sparkSession.sparkContext.broadcast(listed)
        hits = narrow.mapInPandas(_search(shared, keys), schema)
        if parts > 1:  # one part's keywords at a time
            hits = cut_lineage(hits, "keyword-hits", spread_out=False)
            shared.unpersist()
        found.append(hits)
    return reduce(DataFrame.unionAll, found)


def _search(shared, keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = automaton(shared.value) if shared.value else None
        for b in batches:
            rows, word, n = [], [], []
            for at, t in enumerate(b["_text"]) if machine is not None else ():
                for k, c in Counter(w for _, w in machine.iter(t)).items():
                    rows.append(at)
                    word.append(k)
                    n.append(c)
            if rows:
                yield b[keys].iloc[rows].assign(keyword=word, n=n)

    return run


def label_by_table(df: DataFrame, keywords: DataFrame, keys: list[str], rating: str = "rating", text: str = "review_text",
                   max_keywords: int = MAX_KEYWORDS) -> DataFrame:
    """keys..., label, n_keywords: M1 with the negative keywords of a table. ``keys`` name each row."""
    hits = keyword_hits(df, keywords, keys, text, max_keywords).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_keywords"))
    r: Column = F.col(rating)
    j = df.select(*keys, rating).join(hits, keys, "left").withColumn("n_keywords", F.coalesce("n_keywords", F.lit(0)))
    label = (F.when(r.isin(1, 2) | (F.col("n_keywords") > 0), "Negatif").when(r == 3, "Netral").otherwise("Positif"))
    return j.select(*keys, label.alias("label"), "n_keywords")
