"""Domain-shift measurements between review sources.

All statistics are aggregates; the only per-group windows are top-k
limits, which rank in hash buckets first (``ranking.top_k``), so no task
sorts a hot group's whole word table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as lx
from ..functions import text as tx
from ..session import cut_lineage
from .ranking import top_k
from .wordpiece import wordpiece_counts

PLATFORM = "source_platform"


def words(df: DataFrame, text: str = "review_text", group: str = PLATFORM,
          lower: bool = True) -> DataFrame:
    """(group, word): whitespace words of every text (lower-cased)."""
    c = F.lower(F.col(text)) if lower else F.col(text)
    return df.select(group, F.explode(tx.tokens(c)).alias("word"))


def word_counts(df: DataFrame, text: str = "review_text", group: str = PLATFORM) -> DataFrame:
    """A5: (group, word, n) — partial counts are combined map-side."""
    return words(df, text, group).groupBy(group, "word").agg(F.count(F.lit(1)).alias("n"))


def top_k_words(counts: DataFrame, k: int = lx.TOP_K_WORDS, group: str = PLATFORM) -> DataFrame:
    """The k most frequent words per group (ties: word ascending)."""
    return top_k(counts, [group], [F.col("n").desc(), F.col("word")], k, ["word"])


def word_distribution(df: DataFrame, text: str = "review_text", group: str = PLATFORM,
                      k: int = lx.TOP_K_WORDS) -> DataFrame:
    """Top-k words' counts normalised over the kept words -> (group, word, p)."""
    top = top_k_words(word_counts(df, text, group), k, group)
    tot = top.groupBy(group).agg(F.sum("n").alias("_tot"))
    return top.join(F.broadcast(tot), group).select(group, "word", "n",
                                                     (F.col("n") / F.col("_tot")).alias("p"))


def align_distributions(dist: DataFrame, left: str, right: str, group: str = PLATFORM,
                        fill: float = lx.JSD_SMOOTHING) -> DataFrame:
    """Full outer join of two groups' distributions on word; a missing
    side gets ``fill``."""
    a = dist.filter(F.col(group) == left).select("word", F.col("p").alias("p_left"))
    b = dist.filter(F.col(group) == right).select("word", F.col("p").alias("p_right"))
    j = a.join(b, "word", "full")
    return j.select("word", F.coalesce("p_left", F.lit(fill)).alias("p_left"),
                    F.coalesce("p_right", F.lit(fill)).alias("p_right"))


def jensen_shannon(aligned: DataFrame, threshold: float = lx.JSD_SHIFT_THRESHOLD) -> DataFrame:
    """Renormalise both sides, JSD in nats (squared JS distance), one
    aggregate pass for the two sums and one for the divergence."""
    # the two normalising totals are two scalars: computed first, then used
    # as literals (no join, nothing but two numbers pass the driver). The
    # aligned table is written once so both passes read it instead of
    # recomputing everything upstream.
    j = cut_lineage(aligned, "aligned", spread_out=False)
    tot = j.agg(F.sum("p_left").alias("sl"), F.sum("p_right").alias("sr")).first()
    p = F.col("p_left") / F.lit(tot["sl"])
    q = F.col("p_right") / F.lit(tot["sr"])
    m = (p + q) / 2
    term = F.when(p > 0, p * F.log(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log(q / m)).otherwise(0.0)
    out = j.agg((F.sum(term) / 2).alias("jsd"), F.count(F.lit(1)).alias("n_words"))
    return out.select(F.round("jsd", 6).alias("jsd"), "n_words",
                      (F.col("jsd") > threshold).alias("domain_shift"))


def token_lengths(df: DataFrame, text: str = "review_text", group: str = PLATFORM) -> DataFrame:
    return df.select(group, tx.token_count(text).alias("token_count"))


def token_length_describe(df: DataFrame, text: str = "review_text", group: str = PLATFORM,
                          digits: int = 6) -> DataFrame:
    """A3: count, mean, std (ddof 1), min, 25/50/75 % (linear), max per group.
    ``percentile`` keeps a value->count map, so memory is bounded by the
    number of distinct lengths, not rows."""
    t = token_lengths(df, text, group)
    q = F.percentile("token_count", [0.25, 0.5, 0.75])
    agg = t.groupBy(group).agg(
        F.count(F.lit(1)).alias("count"), F.avg("token_count").alias("mean"),
        F.stddev_samp("token_count").alias("std"), F.min("token_count").alias("min"),
        q.alias("_q"), F.max("token_count").alias("max"))
    return agg.select(group, "count", F.round("mean", digits).alias("mean"),
                      F.round("std", digits).alias("std"), "min",
                      *[F.round(F.col("_q")[i], digits).alias(n) for i, n in enumerate(("p25", "p50", "p75"))],
                      "max")


def token_length_boxplot(df: DataFrame, text: str = "review_text", group: str = PLATFORM,
                         digits: int = 6) -> DataFrame:
    """A4: quartiles, 1.5 IQR fences, whiskers (extreme in-fence values) and
    outlier count per group."""
    t = token_lengths(df, text, group)
    qs = t.groupBy(group).agg(F.percentile("token_count", [0.25, 0.5, 0.75]).alias("_q"))
    qs = qs.select(group, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                   F.col("_q")[2].alias("q3"))
    qs = qs.withColumn("lo", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
        .withColumn("hi", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    # one row per group: broadcast
    j = t.join(F.broadcast(qs), group)
    inside = (F.col("token_count") >= F.col("lo")) & (F.col("token_count") <= F.col("hi"))
    out = j.groupBy(group, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("token_count"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("token_count"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))
    return out.select(group, *[F.round(c, digits).alias(c) for c in ("q1", "median", "q3")],
                      "whisker_low", "whisker_high", "n_outliers")


def vocab_oov_rate(df: DataFrame, text: str = "review_text", group: str = PLATFORM,
                   groups: tuple[str, ...] = lx.PLATFORMS, digits: int = 6) -> DataFrame:
    """For each ordered (source, target) pair of ``groups``, the share of
    target tokens and word types not in the source vocabulary."""
    wc = word_counts(df, text, group)
    src = wc.select(F.col(group).alias("source"), "word").withColumn("_in", F.lit(True))
    tgt = wc.select(F.col(group).alias("target"), "word", "n")
    pairs = [F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"))
             for a in groups for b in groups if a != b]
    # the pair list is a parameter-sized literal table
    pair_df = df.sparkSession.range(1).select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    t2 = tgt.join(F.broadcast(pair_df), "target")
    j = t2.join(src, ["source", "word"], "left")
    out = j.groupBy("source", "target").agg(
        F.sum("n").alias("n_tokens"), F.sum(F.when(F.col("_in").isNull(), F.col("n")).otherwise(0))
        .alias("n_oov_tokens"), F.count(F.lit(1)).alias("n_types"),
        F.count_if(F.col("_in").isNull()).alias("n_oov_types"))
    return out.select("source", "target", "n_tokens", "n_oov_tokens", "n_types", "n_oov_types",
                      F.round(F.col("n_oov_tokens") / F.col("n_tokens"), digits).alias("oov_token_rate"),
                      F.round(F.col("n_oov_types") / F.col("n_types"), digits).alias("oov_type_rate"))


# --- A9 fragmentation ratio -----------------------------------------------------------

PIECE_RE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_" + tx.WS + r"]"


def fragmentation_ratio(df: DataFrame, vocab: DataFrame, key: list[str], text: str = "review_text",
                        max_chars: int | None = 100) -> DataFrame:
    """Sub-word pieces / whitespace words per text (0 for no words).

    Pieces come from a BERT-style pre-split (words and single punctuation
    marks) and greedy longest match against ``vocab(piece)``, once for each
    distinct word.
    """
    low = F.lower(F.col(text))
    per_text = df.select(*key, tx.token_count(text).alias("n_words"),
                         F.regexp_extract_all(low, F.lit(PIECE_RE), 0).alias("_w"))
    counted = per_text.select(*key, F.explode("_w").alias("word")) \
        .groupBy(*key, "word").agg(F.count(F.lit(1)).alias("_n"))
    wp = wordpiece_counts(counted.select("word").distinct(), vocab, max_chars)
    sums = counted.join(wp, "word").groupBy(*key).agg(F.sum(F.col("_n") * F.col("n_pieces")).alias("n_pieces"))
    out = per_text.drop("_w").join(sums, key, "left")
    return out.select(*key, "n_words", F.coalesce("n_pieces", F.lit(0)).alias("n_pieces"),
                      F.when(F.col("n_words") > 0, F.coalesce("n_pieces", F.lit(0)) / F.col("n_words"))
                      .otherwise(0.0).alias("fragmentation_ratio"))


def default_piece_vocab(df: DataFrame, text: str = "review_text", max_words: int = lx.MAX_VOCAB) -> DataFrame:
    """A data-derived piece vocabulary: the ``max_words`` most frequent
    words plus every single character as a start and a "##" piece."""
    low = F.lower(F.col(text))
    w = df.select(F.explode(F.regexp_extract_all(low, F.lit(PIECE_RE), 0)).alias("piece"))
    top = w.groupBy("piece").agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.col("n").desc(), F.col("piece")).limit(max_words).select("piece")
    chars = df.select(F.explode(F.split(low, "")).alias("c")).filter(F.col("c") != "").distinct()
    return top.unionByName(chars.select(F.col("c").alias("piece"))) \
        .unionByName(chars.select(F.concat(F.lit("##"), "c").alias("piece"))).distinct()


def kde_density(values: DataFrame, value: str, group: str = PLATFORM, grid: int = 200,
                cut: float = 3.0, digits: int = 6) -> DataFrame:
    """A10: Gaussian KDE per group on ``grid`` points from min - cut*h to
    max + cut*h (Scott bandwidth h = std * n^(-1/5)). Each distinct value adds
    its kernel value, times its rows, to ``grid`` accumulators of one hash aggregate — no join
    between grid and data. A group whose values are all equal (or one) has
    no bandwidth and no rows in the result."""
    st = values.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(value).alias("sd"),
                                   F.min(value).alias("lo"), F.max(value).alias("hi"))
    st = st.withColumn("h", F.col("sd") * F.pow(F.col("n"), -0.2)).filter("h > 0") \
        .withColumn("x0", F.col("lo") - cut * F.col("h")) \
        .withColumn("dx", (F.col("hi") - F.col("lo") + 2 * cut * F.col("h")) / (grid - 1))
    alike = values.groupBy(group, value).agg(F.count(F.lit(1)).alias("_m"))
    j = alike.join(F.broadcast(st), group)  # one row per group
    x = lambda i: F.col("x0") + i * F.col("dx")
    sums = j.groupBy(group, "n", "h", "x0", "dx").agg(
        *[F.sum(F.col("_m") * F.exp(-0.5 * F.pow((x(i) - F.col(value)) / F.col("h"), 2))).alias(f"k{i}")
          for i in range(grid)])
    norm = F.col("n") * F.col("h") * math.sqrt(2 * math.pi)
    arr = F.array(*[F.struct(F.lit(i).alias("i"), x(i).alias("x"), (F.col(f"k{i}") / norm).alias("density"))
                    for i in range(grid)])
    out = sums.select(group, F.explode(arr).alias("g")).select(group, "g.*")
    return out.select(group, "i", F.round("x", digits).alias("x"), F.round("density", digits).alias("density"))


__all__ = ["words", "word_counts", "top_k_words", "word_distribution", "align_distributions",
           "jensen_shannon", "token_length_describe", "token_length_boxplot", "vocab_oov_rate",
           "fragmentation_ratio", "default_piece_vocab", "kde_density", "wordpiece_counts", "T", "Column"]
