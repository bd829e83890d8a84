"""Registered queries: domain shift, vocabularies, encodings, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..operators import shift, sketches, splits, vocab
from ..session import cut_lineage
from . import experiment as ex
from . import sqlgen as sg
from .registry import register

W = sg.with_
M = sg.master_ctes()
TOK = sg.tokens("lower(review_text)")

WC_CTES = M + [
    ("wc", f"SELECT source_platform, word, count(*) AS n FROM "
           f"(SELECT source_platform, unnest({TOK}) AS word FROM master) GROUP BY ALL"),
]


def _topk_cte(k: int) -> tuple[str, str]:
    return ("topk", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_platform ORDER BY n DESC, word) AS rank
               FROM wc) WHERE rank <= {k}""")


DIST_CTES = WC_CTES + [_topk_cte(lx.TOP_K_WORDS), ("dist", """
SELECT source_platform, word, n, n / sum(n) OVER (PARTITION BY source_platform) AS p FROM topk""")]

ALIGN_CTE = ("al", f"""
SELECT coalesce(a.word, b.word) AS word, coalesce(a.p, {lx.JSD_SMOOTHING}) AS p_left,
       coalesce(b.p, {lx.JSD_SMOOTHING}) AS p_right
FROM (SELECT word, p FROM dist WHERE source_platform = 'tokopedia') a
FULL OUTER JOIN (SELECT word, p FROM dist WHERE source_platform = 'shopee') b ON a.word = b.word""")


def _master(spark, sf):
    return ex.master(spark, sf)


def _keyed_master(spark, sf, *cols):
    """The master's keys and ``cols``, written once: sampling reads them several times."""
    return cut_lineage(_master(spark, sf).select("source_platform", *ex.DOC_KEYS, *cols), "keyed-master")


register("word_counts", W(WC_CTES, "SELECT source_platform, word, n FROM wc"))(
    lambda spark, sf: shift.word_counts(_master(spark, sf)))

register("top_k_words", W(WC_CTES + [_topk_cte(50)], "SELECT source_platform, word, n, rank FROM topk"))(
    lambda spark, sf: shift.top_k_words(shift.word_counts(_master(spark, sf)), 50)
    .select("source_platform", "word", "n", F.col("rank").cast("long").alias("rank")))

register("word_distribution", W(DIST_CTES, "SELECT source_platform, word, n, p FROM dist"))(
    lambda spark, sf: shift.word_distribution(_master(spark, sf)))

register("align_distributions", W(DIST_CTES + [ALIGN_CTE], "SELECT word, p_left, p_right FROM al"))(
    lambda spark, sf: shift.align_distributions(shift.word_distribution(_master(spark, sf)),
                                                "tokopedia", "shopee"))

_P = "(p_left / s.sl)"
_Q = "(p_right / s.sr)"
_M = f"(({_P} + {_Q}) / 2)"
register("jensen_shannon", W(DIST_CTES + [ALIGN_CTE, ("s", "SELECT sum(p_left) AS sl, sum(p_right) AS sr FROM al")], f"""
SELECT round(sum({_P} * ln({_P} / {_M}) + {_Q} * ln({_Q} / {_M})) / 2, 6) AS jsd, count(*) AS n_words,
       sum({_P} * ln({_P} / {_M}) + {_Q} * ln({_Q} / {_M})) / 2 > {lx.JSD_SHIFT_THRESHOLD} AS domain_shift
FROM al, s"""))(
    lambda spark, sf: shift.jensen_shannon(shift.align_distributions(
        shift.word_distribution(_master(spark, sf)), "tokopedia", "shopee")))

_TC = sg.token_count("review_text")
register("token_length_describe", W(M, f"""
SELECT source_platform, count(*) AS count, round(avg(tc), 6) AS mean, round(stddev_samp(tc), 6) AS std,
       min(tc) AS min, round(quantile_cont(tc, 0.25), 6) AS p25, round(quantile_cont(tc, 0.5), 6) AS p50,
       round(quantile_cont(tc, 0.75), 6) AS p75, max(tc) AS max
FROM (SELECT source_platform, CAST({_TC} AS INTEGER) AS tc FROM master) GROUP BY ALL"""))(
    lambda spark, sf: shift.token_length_describe(_master(spark, sf)))

register("token_length_boxplot", W(M + [
    ("t", f"SELECT source_platform, CAST({_TC} AS INTEGER) AS tc FROM master"),
    ("qs", """SELECT source_platform, quantile_cont(tc, 0.25) AS q1, quantile_cont(tc, 0.5) AS median,
                     quantile_cont(tc, 0.75) AS q3 FROM t GROUP BY ALL""")], """
SELECT source_platform, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       min(CASE WHEN tc >= q1 - 1.5 * (q3 - q1) AND tc <= q3 + 1.5 * (q3 - q1) THEN tc END) AS whisker_low,
       max(CASE WHEN tc >= q1 - 1.5 * (q3 - q1) AND tc <= q3 + 1.5 * (q3 - q1) THEN tc END) AS whisker_high,
       count_if(NOT (tc >= q1 - 1.5 * (q3 - q1) AND tc <= q3 + 1.5 * (q3 - q1))) AS n_outliers
FROM t JOIN qs USING (source_platform) GROUP BY source_platform, q1, median, q3"""))(
    lambda spark, sf: shift.token_length_boxplot(_master(spark, sf)))

register("vocab_oov_rate", W(WC_CTES, """
SELECT s.source_platform AS source, t.source_platform AS target, CAST(sum(t.n) AS BIGINT) AS n_tokens,
       CAST(sum(CASE WHEN v.word IS NULL THEN t.n ELSE 0 END) AS BIGINT) AS n_oov_tokens,
       count(*) AS n_types, count_if(v.word IS NULL) AS n_oov_types,
       round(sum(CASE WHEN v.word IS NULL THEN t.n ELSE 0 END) / sum(t.n), 6) AS oov_token_rate,
       round(count_if(v.word IS NULL) / count(*), 6) AS oov_type_rate
FROM wc t JOIN (SELECT DISTINCT source_platform FROM wc) s ON s.source_platform <> t.source_platform
LEFT JOIN wc v ON v.source_platform = s.source_platform AND v.word = t.word
GROUP BY ALL"""))(
    lambda spark, sf: shift.vocab_oov_rate(_master(spark, sf)))



def _sketched(spark, sf):
    """Overlap from sketches of the two halves of each platform's reviews, merged, beside the exact counts."""
    m = _master(spark, sf)
    halves = [sketches.vocab_sketches(m.filter(F.pmod(F.col("row_seq"), F.lit(2)) == h)) for h in (0, 1)]
    est = sketches.overlap(sketches.merge_sketches(halves)).select("source", "target", "oov_type_rate", "rate_error")
    exact = shift.vocab_oov_rate(m).select("source", "target", "n_types", "n_oov_types", F.col("oov_type_rate").alias("exact"))
    return exact.join(est, ["source", "target"]).select(
        "source", "target", "n_types", "n_oov_types",
        (F.abs(F.col("oov_type_rate") - F.col("exact")) <= F.col("rate_error") + 2e-6).alias("within_bounds"))


register("vocab_overlap_sketch", W(WC_CTES, """
SELECT s.source_platform AS source, t.source_platform AS target, count(*) AS n_types,
       count_if(v.word IS NULL) AS n_oov_types, true AS within_bounds
FROM wc t JOIN (SELECT DISTINCT source_platform FROM wc) s ON s.source_platform <> t.source_platform
LEFT JOIN wc v ON v.source_platform = s.source_platform AND v.word = t.word
GROUP BY ALL"""))(_sketched)

register("union_vocab", W(DIST_CTES, "SELECT DISTINCT word FROM dist"))(
    lambda spark, sf: shift.word_distribution(_master(spark, sf)).select("word").distinct())


def _shared(spark, sf):
    d = shift.word_distribution(_master(spark, sf))
    a = d.filter(F.col("source_platform") == "tokopedia").select("word")
    b = d.filter(F.col("source_platform") == "shopee").select("word")
    both = a.intersect(b).withColumn("membership", F.lit("both"))
    only_a = a.exceptAll(b).withColumn("membership", F.lit("tokopedia_only"))
    only_b = b.exceptAll(a).withColumn("membership", F.lit("shopee_only"))
    return both.unionByName(only_a).unionByName(only_b)


register("shared_vocab", W(DIST_CTES + [
    ("a", "SELECT word FROM dist WHERE source_platform = 'tokopedia'"),
    ("b", "SELECT word FROM dist WHERE source_platform = 'shopee'")], """
SELECT word, 'both' AS membership FROM (SELECT word FROM a INTERSECT SELECT word FROM b)
UNION ALL SELECT word, 'tokopedia_only' FROM (SELECT word FROM a EXCEPT SELECT word FROM b)
UNION ALL SELECT word, 'shopee_only' FROM (SELECT word FROM b EXCEPT SELECT word FROM a)"""))(_shared)

# --- vocabulary and encodings on the split tables -------------------------------------
S = sg.experiment_ctes()
GROUP = ["source_platform", "condition"]
TOKC = sg.tokens("review_text_clean")
VOCAB_CTES = S + [
    ("tc", f"SELECT source_platform, condition, token, count(*) AS n FROM "
           f"(SELECT source_platform, condition, unnest({TOKC}) AS token FROM splits WHERE split = 'train') "
           f"GROUP BY ALL"),
    ("vocab", f"""
SELECT source_platform, condition, token, CAST(r + 1 AS INTEGER) AS id FROM (
  SELECT *, row_number() OVER (PARTITION BY source_platform, condition ORDER BY n DESC, token) AS r FROM tc)
WHERE r <= {lx.MAX_VOCAB - 2}
UNION ALL SELECT DISTINCT source_platform, condition, '<PAD>', 0 FROM splits WHERE split = 'train'
UNION ALL SELECT DISTINCT source_platform, condition, '<UNK>', 1 FROM splits WHERE split = 'train'"""),
]


def _vocab(spark, sf):
    s = ex.experiment_splits(spark, sf, raw_text=False)
    return s, vocab.build_vocab(s.filter(F.col("split") == "train"), GROUP)


register("build_vocab", W(VOCAB_CTES, "SELECT source_platform, condition, token, id FROM vocab"))(
    lambda spark, sf: _vocab(spark, sf)[1])


def _encoded(spark, sf):
    s, v = _vocab(spark, sf)
    test = s.filter(F.col("split") == "test").withColumnRenamed("row_seq", "review_id")
    return vocab.encode_tokens(test, v, ["review_id"], GROUP)


register("encode_tokens", W(VOCAB_CTES + [
    ("pos", f"""SELECT row_seq AS review_id, source_platform, condition, unnest(t) AS token,
                        generate_subscripts(t, 1) AS pos
                 FROM (SELECT *, {TOKC}[1:{lx.MAX_LEN}] AS t FROM splits WHERE split = 'test')"""),
    ("ids", """SELECT review_id, source_platform, condition,
                      string_agg(CAST(coalesce(v.id, 1) AS VARCHAR), ' ' ORDER BY pos) AS s, count(*) AS n
               FROM pos LEFT JOIN vocab v USING (source_platform, condition, token) GROUP BY ALL"""),
    ("docs", "SELECT row_seq AS review_id, source_platform, condition FROM splits WHERE split = 'test'")], f"""
SELECT d.review_id, d.source_platform, d.condition, CAST(coalesce(n, 0) AS INTEGER) AS n_tokens,
       trim(concat(coalesce(s, ''), repeat(' 0', {lx.MAX_LEN} - CAST(coalesce(n, 0) AS INTEGER)))) AS input_ids,
       trim(concat(repeat('1 ', CAST(coalesce(n, 0) AS INTEGER)),
                   repeat('0 ', {lx.MAX_LEN} - CAST(coalesce(n, 0) AS INTEGER)))) AS attention_mask
FROM docs d LEFT JOIN ids USING (review_id, source_platform, condition)"""))(
    lambda spark, sf: _encoded(spark, sf).select(
        "review_id", "source_platform", "condition", "n_tokens",
        F.array_join("input_ids", " ").alias("input_ids"),
        F.array_join("attention_mask", " ").alias("attention_mask")))

register("vocab_lookup", W(VOCAB_CTES + [
    ("tt", f"SELECT source_platform, condition, unnest({TOKC}) AS token FROM splits WHERE split = 'test'")], """
SELECT source_platform, condition, count(*) AS n_tokens, count_if(v.id IS NULL) AS n_unk
FROM tt LEFT JOIN vocab v USING (source_platform, condition, token) GROUP BY ALL"""))(
    lambda spark, sf: (lambda s, v: vocab.vocab_lookup(
        s.filter(F.col("split") == "test").select(*GROUP, F.explode(splits.tx.tokens("review_text_clean"))
                                                   .alias("token")), v, GROUP + ["token"])
        .groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n_tokens"),
                             F.count_if(F.col("id") == vocab.UNK).alias("n_unk")))(*_vocab(spark, sf)))

# --- samples and folds ----------------------------------------------------------------
register("sample_per_group", W(M + [("tot", "SELECT count(*) AS total FROM master")], f"""
SELECT row_seq AS review_id, source_platform FROM (
  SELECT *, row_number() OVER (PARTITION BY source_platform ORDER BY {sg.md5_key('source_seq', 'row_seq')},
                               source_seq, row_seq) AS rk FROM master) , tot
WHERE rk <= least(5000, total // 2)"""))(
    lambda spark, sf: splits.sample_per_group(_keyed_master(spark, sf))
    .select(F.col("row_seq").alias("review_id"), "source_platform"))

register("kfold_assign", W(S, f"""
SELECT source_platform, condition, sentiment_label, fold, count(*) AS n FROM (
  SELECT *, CAST((row_number() OVER (PARTITION BY source_platform, condition, sentiment_label
                                     ORDER BY {sg.md5_key('source_seq', 'row_seq')}, source_seq, row_seq) - 1)
                 % {lx.CV_FOLDS} AS INTEGER) AS fold
  FROM splits WHERE split = 'train') GROUP BY ALL"""))(
    lambda spark, sf: splits.kfold_assign(ex.experiment_splits(spark, sf, raw_text=False).filter(F.col("split") == "train"),
                                          GROUP)
    .groupBy(*GROUP, "sentiment_label", "fold").agg(F.count(F.lit(1)).alias("n")))


# --- A9 / A10 ---------------------------------------------------------------------------
def _fragmentation(spark, sf):
    m = _keyed_master(spark, sf, "review_text")
    pieces = cut_lineage(shift.default_piece_vocab(m), "pieces", spread_out=False)
    return shift.fragmentation_ratio(splits.sample_per_group(m), pieces, ["source_platform", "row_seq"])


# the same greedy matcher as a recursive walk over the longest piece at each place of a word
FRAG_CTES = M + [
    ("tot", "SELECT count(*) AS total FROM master"),
    ("sampled", f"""
SELECT source_platform, row_seq, {sg.token_count('review_text')} AS n_words,
       regexp_extract_all(lower(review_text), {sg.q(shift.PIECE_RE)}) AS w FROM (
  SELECT *, row_number() OVER (PARTITION BY source_platform ORDER BY {sg.md5_key('source_seq', 'row_seq')},
                               source_seq, row_seq) AS rk FROM master), tot
WHERE rk <= least(5000, total // 2)"""),
    ("pw", f"SELECT unnest(regexp_extract_all(lower(review_text), {sg.q(shift.PIECE_RE)})) AS piece FROM master"),
    ("chars", "SELECT DISTINCT unnest(regexp_extract_all(lower(review_text), '(?s).')) AS c FROM master"),
    ("vocab", f"""
SELECT piece FROM (SELECT piece FROM pw GROUP BY piece ORDER BY count(*) DESC, piece LIMIT {lx.MAX_VOCAB})
UNION SELECT c FROM chars UNION SELECT concat('##', c) FROM chars"""),
    ("occ", "SELECT source_platform, row_seq, unnest(w) AS word FROM sampled"),
    ("types", "SELECT DISTINCT word FROM occ"),
    ("places", "SELECT word, unnest(range(1, length(word) + 1)) AS pos FROM types WHERE length(word) <= 100"),
    ("cuts", "SELECT word, pos, unnest(range(1, length(word) - pos + 2)) AS size FROM places"),
    ("longest", """
SELECT word, pos, max(size) AS size FROM cuts
JOIN vocab ON piece = concat(CASE WHEN pos > 1 THEN '##' ELSE '' END, substring(word, pos, size)) GROUP BY word, pos"""),
    ("walk(word, pos, n)", """
SELECT word, CAST(1 AS BIGINT), 0 FROM types
UNION ALL
SELECT walk.word, walk.pos + l.size, walk.n + 1 FROM walk JOIN longest l ON l.word = walk.word AND l.pos = walk.pos"""),
    ("wp", "SELECT word, coalesce(max(CASE WHEN pos = length(word) + 1 THEN n END), 1) AS n_pieces FROM walk GROUP BY word"),
    ("sums", "SELECT source_platform, row_seq, sum(n_pieces) AS n_pieces FROM occ JOIN wp USING (word) GROUP BY ALL"),
    ("frag", """
SELECT source_platform, CASE WHEN n_words > 0 THEN coalesce(n_pieces, 0) / n_words ELSE 0.0 END AS v
FROM sampled LEFT JOIN sums USING (source_platform, row_seq)"""),
]
KDE_CTES = FRAG_CTES + [
    ("moments", """
SELECT source_platform, count(*) AS m, stddev_samp(v) * pow(count(*), -0.2) AS h, min(v) AS lo, max(v) AS hi
FROM frag GROUP BY ALL"""),
    ("line", """
SELECT source_platform, m, h, i, lo - 3.0 * h + i * ((hi - lo + 6.0 * h) / 199) AS x
FROM moments, (SELECT unnest(range(200)) AS i) WHERE h > 0"""),
]

register("fragmentation_ratio", W(FRAG_CTES, """
SELECT source_platform, round(avg(v), 6) AS mean_fragmentation, count(*) AS n FROM frag GROUP BY ALL""",
                                  recursive=True))(
    lambda spark, sf: _fragmentation(spark, sf).groupBy("source_platform")
    .agg(F.round(F.avg("fragmentation_ratio"), 6).alias("mean_fragmentation"),
         F.count(F.lit(1)).alias("n")))

register("fragmentation_density", W(KDE_CTES, """
SELECT source_platform, CAST(i AS INTEGER) AS i, round(x, 6) AS x,
       round(sum(exp(-0.5 * pow((x - v) / h, 2))) / (any_value(m) * any_value(h) * sqrt(2 * pi())), 6) AS density
FROM line JOIN frag USING (source_platform) GROUP BY source_platform, i, x""", recursive=True))(
    lambda spark, sf: shift.kde_density(_fragmentation(spark, sf), "fragmentation_ratio"))
