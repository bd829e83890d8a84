"""Token-level lookups as joins: lexicon replacement (J1), whitelist
semi-join and stop-word anti-join (J2).

The column functions in ``functions.text`` do the same work inline with
map literals; these forms keep the token rows, so a user can see which
token matched, and they accept lexicons that live in tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as lx
from ..functions import text as tx

def token_positions(df: DataFrame, keys: list[str], text: str, lower: bool = True) -> DataFrame:
    """(keys..., pos, token): whitespace tokens with 1-based positions."""
    c = F.lower(F.col(text)) if lower else F.col(text)
    return df.select(*keys, F.posexplode(tx.tokens(c)).alias("_p", "token")) \
        .select(*keys, (F.col("_p") + 1).cast("int").alias("pos"), "token")


def lexicon_table(spark: SparkSession, lexicon: dict[str, str] | None = None,
                  whitelist: tuple[str, ...] | None = None) -> DataFrame:
    """(token, replacement) with whitelisted words removed (they stay as they are)."""
    lexicon = lx.SLANG_DICT if lexicon is None else lexicon
    whitelist = lx.DOMAIN_WHITELIST if whitelist is None else whitelist
    wl = {w.lower() for w in whitelist}
    rows = sorted((k.lower(), v) for k, v in lexicon.items() if k.lower() not in wl)
    schema = T.StructType([T.StructField("token", T.StringType()), T.StructField("replacement", T.StringType())])
    return spark.createDataFrame(rows, schema)


def word_table(spark: SparkSession, words, col: str = "token") -> DataFrame:
    return spark.createDataFrame([(w.lower(),) for w in sorted(set(words))],
                                 T.StructType([T.StructField(col, T.StringType())]))


def lexicon_join(tokens_df: DataFrame, lexicon: DataFrame, token: str = "token") -> DataFrame:
    """Left equi lookup token -> replacement; unmatched tokens keep
    themselves, a replacement of "" marks a deleted token."""
    lex = lexicon.select(F.col("token").alias("_k"), "replacement")
    j = tokens_df.join(lex, F.col(token) == F.col("_k"), "left")
    return j.select(*tokens_df.columns,
                    F.coalesce(F.col("replacement"), F.col(token)).alias("normalized"),
                    F.col("_k").isNotNull().alias("in_lexicon"))


def whitelist_semi(tokens_df: DataFrame, words: DataFrame, token: str = "token") -> DataFrame:
    """The token rows whose token is in ``words`` (left semi join)."""
    w = words.select(F.col(words.columns[0]).alias("_k"))
    return tokens_df.join(w, F.col(token) == F.col("_k"), "left_semi")


def stopword_anti(tokens_df: DataFrame, words: DataFrame, token: str = "token") -> DataFrame:
    """The token rows whose token is not in ``words`` (left anti join)."""
    w = words.select(F.col(words.columns[0]).alias("_k"))
    return tokens_df.join(w, F.col(token) == F.col("_k"), "left_anti")


def label_docs_join(preds: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Pair each prediction with its document's label (inner equi-join
    on the document key; both sides are keyed, so this is one shuffle join
    that AQE may turn into a broadcast when the label side is small)."""
    j = preds.join(truth, keys)
    return j.select(*keys, "train_src", "condition", "label_id", F.col("pred").alias("pred_id"),
                    (F.col("label_id") == F.col("pred")).alias("correct"))


def attention_mask(df: DataFrame, keys: list[str], text: str = "review_text_clean",
                   max_len: int = lx.MAX_LEN) -> DataFrame:
    """1 for each real position of the first ``max_len`` tokens, 0 for
    padding; a per-row expression, no lookup."""
    n = F.least(tx.token_count(text), F.lit(max_len))
    return df.select(*keys, n.cast("int").alias("n_tokens"),
                     F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_len) - n))
                     .alias("attention_mask"))


__all__ = ["token_positions", "lexicon_table", "word_table", "lexicon_join",
           "whitelist_semi", "stopword_anti", "label_docs_join", "attention_mask"]
