"""Registered queries: text functions, predicates, conforming, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import label as lb
from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import curate, keywords, splits
from ..sources import fixtures as fx
from . import experiment as ex
from . import sqlgen as sg
from .registry import register

W = sg.with_
R = sg.reviews_ctes()

# Example stop list for T11 (the study's list lives in an optional package;
# the operator takes any list). Common words of the fixture languages.
EXAMPLE_STOPLIST = ("the", "and", "of", "de", "la", "le", "el", "und", "die", "der",
                    "yang", "dan", "di", "tidak", "sangat")


def _rev(spark, sf):
    return fx.reviews(spark, sf)


def _row_op(key: str, spark_expr, sql_expr: str):
    register(key, W(R, f"SELECT review_id, {sql_expr} AS text_out FROM reviews"))(
        lambda spark, sf: _rev(spark, sf).select("review_id", spark_expr("review_text").alias("text_out")))


# --- T1..T10 single steps ---------------------------------------------------------
_row_op("lower", tx.lower, "lower(review_text)")
_row_op("strip_urls", tx.strip_urls, f"regexp_replace(review_text, {sg.q(tx.URL_RE)}, ' ', 'g')")
_row_op("strip_mentions", tx.strip_mentions,
        f"regexp_replace(review_text, {sg.q(tx.MENTION_RE)}, ' ', 'g')")
_row_op("strip_hashtags", tx.strip_hashtags,
        f"regexp_replace(review_text, {sg.q(tx.HASHTAG_RE)}, ' ', 'g')")
_row_op("strip_emoji", tx.strip_emoji, sg.emoji_out("review_text"))
_row_op("squeeze_punct", tx.squeeze_punct, sg.squeeze_punct("review_text"))
_row_op("normalize_slang", tx.normalize_slang, sg.slang("review_text"))
_row_op("strip_symbols", tx.strip_symbols,
        f"regexp_replace(review_text, {sg.q(tx.SYMBOL_RE)}, ' ', 'g')")
_row_op("squeeze_space", tx.squeeze_space,
        f"trim(regexp_replace(review_text, {sg.q(tx.SPACE_RE)}, ' ', 'g'))")
_row_op("strip_text", tx.strip, sg.strip("review_text"))
_row_op("token_count", lambda c: tx.token_count(c).cast("int"),
        f"CAST({sg.token_count('review_text')} AS INTEGER)")
_row_op("snippet", tx.snippet, "substr(review_text, 1, 80)")
_row_op("is_valid_review", tx.is_valid_review, sg.is_valid_review("review_text"))
_row_op("is_meaningful", tx.is_meaningful, f"coalesce({sg.is_meaningful('review_text')}, false)")

register("collapse_runs", W(R + [("c", "SELECT review_id, string_split(review_text, '') AS _ch FROM reviews")],
                            f"SELECT review_id, {sg.collapse_runs_from_chars('_ch')} AS text_out FROM c"))(
    lambda spark, sf: _rev(spark, sf).select("review_id", tx.collapse_runs("review_text").alias("text_out")))

# --- T11..T14, T18: composed chains -----------------------------------------------
PRE = R + sg.prefix_ctes("reviews", "review_text", "pre")

register("clean_text_baseline", W(PRE, f"SELECT review_id, {sg.clean_text_expr(False)} AS text_out FROM pre"))(
    lambda spark, sf: _rev(spark, sf).select("review_id", tx.clean_text("review_text", False).alias("text_out")))

register("clean_text_proposed", W(PRE, f"SELECT review_id, {sg.clean_text_expr(True)} AS text_out FROM pre"))(
    lambda spark, sf: _rev(spark, sf).select("review_id", tx.clean_text("review_text", True).alias("text_out")))

register("clean_pipeline", W(PRE + [("cl", f"SELECT *, {sg.clean_text_expr(True)} AS _c FROM pre")],
                             f"SELECT review_id, {sg.pipeline_expr('review_text', '_c')} AS text_out FROM cl"))(
    lambda spark, sf: _rev(spark, sf).select("review_id", tx.clean_pipeline("review_text", True).alias("text_out")))

_stop = sorted(set(EXAMPLE_STOPLIST) - set(lx.NEGATION_WORDS) - set(lx.INTENSIFIER_WORDS))
register("remove_stopwords", W(PRE + [("cl", f"SELECT *, {sg.clean_text_expr(False)} AS _c FROM pre")],
                               f"SELECT review_id, array_to_string(list_filter(string_split(_c, ' '), "
                               f"lambda k: k NOT IN {sg.in_list(_stop)}), ' ') AS text_out FROM cl"))(
    lambda spark, sf: _rev(spark, sf).select(
        "review_id", tx.remove_stopwords(tx.clean_text("review_text", False), EXAMPLE_STOPLIST).alias("text_out")))


def _fallback_sql(normalize: bool) -> str:
    pipe = sg.pipeline_expr("review_text", "_c")
    return (f"CASE WHEN coalesce({pipe}, '') = '' THEN {sg.strip('lower(review_text)')} ELSE {pipe} END")


register("clean_with_fallback", W(PRE + [("cl", f"SELECT *, {sg.clean_text_expr(True)} AS _c FROM pre")],
                                  f"SELECT review_id, {_fallback_sql(True)} AS text_out FROM cl"))(
    lambda spark, sf: _rev(spark, sf).select("review_id", tx.clean_with_fallback("review_text", True)
                                             .alias("text_out")))

register("changed_by_cleaning", W(PRE + [("cl", f"""
SELECT source_platform, 'baseline' AS condition, {sg.clean_text_expr(False)} AS _c, review_text FROM pre
UNION ALL
SELECT source_platform, 'proposed' AS condition, {sg.clean_text_expr(True)} AS _c, review_text FROM pre""")],
    f"""SELECT source_platform, condition, count(*) AS n,
       count_if(({_fallback_sql(True)}) <> {sg.strip('lower(review_text)')}) AS n_changed
FROM cl GROUP BY ALL"""))(
    lambda spark, sf: _rev(spark, sf)
    .select("source_platform", F.explode(F.array(
        F.struct(F.lit("baseline").alias("condition"), tx.changed_by_cleaning("review_text", False).alias("ch")),
        F.struct(F.lit("proposed").alias("condition"), tx.changed_by_cleaning("review_text", True).alias("ch"))))
        .alias("x"))
    .groupBy("source_platform", "x.condition")
    .agg(F.count(F.lit(1)).alias("n"), F.count_if("x.ch").alias("n_changed")))

# --- T17 normalize_date ---------------------------------------------------------
register("normalize_date", """
SELECT event_id, strftime(try_cast(CAST(ts AS VARCHAR) AS TIMESTAMP), '%Y-%m-%d') AS date_from_ts,
       strftime(try_cast(props AS TIMESTAMP), '%Y-%m-%d') AS date_from_props
FROM events""")(
    lambda spark, sf: fx.table(spark, sf, "events").select(
        "event_id", tx.normalize_date(F.col("ts").cast("string")).alias("date_from_ts"),
        tx.normalize_date("props").alias("date_from_props")))

# --- P3..P8 ---------------------------------------------------------------------------
register("drop_blank_text", f"SELECT conv_id, turn FROM conversations WHERE {sg.strip('coalesce(text, chr(32))')} <> ''")(
    lambda spark, sf: fx.table(spark, sf, "conversations").filter(~tx.is_blank("text")).select("conv_id", "turn"))

_P4 = f"length({sg.strip('review_text')}) >= {lx.MIN_TEXT_LENGTH}"
register("min_length_filter", W(R, f"SELECT review_id FROM reviews WHERE {_P4}"))(
    lambda spark, sf: _rev(spark, sf).filter(curate.min_length_ok()).select("review_id"))

_P5 = (f"NOT (rating = 3 AND (length({sg.strip('review_text')}) < {lx.NEUTRAL_MIN_CHARS} "
       f"OR {sg.strip('lower(review_text)')} IN {sg.in_list(lx.NEUTRAL_FILLERS)}))")
register("denoise_neutral", W(R, f"SELECT review_id FROM reviews WHERE {_P5}"))(
    lambda spark, sf: _rev(spark, sf).filter(~curate.neutral_noise()).select("review_id"))

register("min_token_filter", W(PRE, f"SELECT review_id FROM pre WHERE "
                                    f"{sg.token_count(sg.clean_text_expr(False))} >= {lx.MIN_TOKEN_COUNT}"))(
    lambda spark, sf: _rev(spark, sf).filter(tx.token_count(tx.clean_text("review_text", False))
                                             >= lx.MIN_TOKEN_COUNT).select("review_id"))

register("platform_slice", W(sg.master_ctes(), "SELECT row_seq AS review_id, label FROM master "
                                               "WHERE source_platform = 'shopee'"))(
    lambda spark, sf: ex.master(spark, sf).filter(F.col("source_platform") == "shopee")
    .select(F.col("row_seq").alias("review_id"), "label"))

register("filter_report", W(R, f"""
SELECT count(*) AS rows_in, count_if(NOT ({_P4})) AS dropped_short,
       count_if(({_P4}) AND NOT ({_P5})) AS dropped_neutral_noise,
       count_if(({_P4}) AND ({_P5})) AS rows_out
FROM reviews"""))(
    lambda spark, sf: curate.filter_report(_rev(spark, sf)))

# --- C1..C8 ------------------------------------------------------------------------


def _docs_partial(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select(F.col("text").alias("review_text"), F.col("source").alias("product_name"),
                    F.col("doc_id").alias("row_seq"), "lang")


register("conform_schema", """
SELECT text AS review_text, 3 AS rating, source AS product_name, 'unknown' AS review_date,
       'anonymous' AS reviewer_name, 'unknown' AS source_platform, doc_id AS row_seq
FROM documents""")(
    lambda spark, sf: curate.conform_schema(_docs_partial(spark, sf)))

_HOLES_SQL = """
SELECT d.doc_id AS row_seq, d.text AS review_text, l.quality AS rating, d.source AS product_name,
       CAST(NULL AS VARCHAR) AS review_date,
       CASE WHEN l.doc_id IS NULL THEN NULL ELSE 'labelled' END AS reviewer_name,
       CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE 'shopee' END AS source_platform
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def _holes(spark, sf):
    d = fx.table(spark, sf, "documents")
    lab = fx.table(spark, sf, "labels")
    j = d.join(lab, "doc_id", "left")
    return j.select(F.col("doc_id").alias("row_seq"), F.col("text").alias("review_text"),
                    F.col("quality").alias("rating"), F.col("source").alias("product_name"),
                    F.lit(None).cast("string").alias("review_date"),
                    F.when(F.col("toxic").isNull(), None).otherwise(F.lit("labelled")).alias("reviewer_name"),
                    F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.lit("shopee")).alias("source_platform"))


register("fill_defaults", W([("h", _HOLES_SQL)], """
SELECT row_seq, review_text, coalesce(rating, 3) AS rating, product_name,
       coalesce(review_date, 'unknown') AS review_date, coalesce(reviewer_name, 'anonymous') AS reviewer_name,
       coalesce(source_platform, 'unknown') AS source_platform FROM h"""))(
    lambda spark, sf: curate.fill_defaults(_holes(spark, sf)))

register("missing_report", W([("h", _HOLES_SQL)], " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count_if({c} IS NULL) AS n_missing FROM h" for c in lx.REQUIRED_COLUMNS)))(
    lambda spark, sf: curate.missing_report(_holes(spark, sf)))

_COERCE = ("CAST(trunc(least(greatest(coalesce(CASE WHEN isnan(try_cast({x} AS DOUBLE)) THEN NULL "
           "ELSE try_cast({x} AS DOUBLE) END, 3.0), 1.0), 5.0)) AS INTEGER)")
register("coerce_rating", f"""
SELECT event_id, {_COERCE.format(x='CAST(value AS VARCHAR)')} AS rating_from_value,
       {_COERCE.format(x='event_type')} AS rating_from_text,
       {_COERCE.format(x="CAST(value - 3 AS VARCHAR)")} AS rating_shifted
FROM events""")(
    lambda spark, sf: fx.table(spark, sf, "events").select(
        "event_id", lb.coerce_rating(F.col("value").cast("string")).alias("rating_from_value"),
        lb.coerce_rating("event_type").alias("rating_from_text"),
        lb.coerce_rating((F.col("value") - 3).cast("string")).alias("rating_shifted")))

register("set_platform", W(R, "SELECT review_id, 'tokopedia' AS source_platform FROM reviews"))(
    lambda spark, sf: _rev(spark, sf).withColumn("source_platform", F.lit("tokopedia"))
    .select("review_id", "source_platform"))

register("split_projection", W(sg.experiment_ctes(), """
SELECT review_text_clean, review_text, rating, sentiment_label, source_platform, condition, split
FROM splits"""))(
    lambda spark, sf: ex.experiment_splits(spark, sf)
    .select(*splits.SPLIT_COLS, "split"))

register("title_case_names", W(sg.reviews_ctes(), f"""
SELECT DISTINCT source_platform, {sg.initcap('source_platform')} AS title FROM reviews"""))(
    lambda spark, sf: _rev(spark, sf).select("source_platform").distinct()
    .select("source_platform", F.initcap("source_platform").alias("title")))

# --- M2, M3, M4 ----------------------------------------------------------------------
register("encode_label", W(sg.master_ctes(), f"""
SELECT row_seq AS review_id, label, {sg.LABEL_ID.replace('sentiment_label', 'label')} AS label_id FROM master"""))(
    lambda spark, sf: ex.master(spark, sf).select(F.col("row_seq").alias("review_id"), "label",
                                                   lb.encode_label("label").alias("label_id")))

register("decode_label", """
SELECT doc_id, CASE toxic + quality WHEN 0 THEN 'Negatif' WHEN 1 THEN 'Netral' WHEN 2 THEN 'Positif' END
       AS label FROM labels""")(
    lambda spark, sf: fx.table(spark, sf, "labels").select(
        "doc_id", lb.decode_label(F.col("toxic") + F.col("quality")).alias("label")))

_KW = "[" + ", ".join(sg.q(k) for k in lx.NEGATIVE_KEYWORDS) + "]"
register("keyword_hits", W(R, f"""
SELECT review_id, array_to_string(list_filter({_KW}, lambda k: contains(lower(review_text), k)), ',')
       AS hits FROM reviews"""))(
    lambda spark, sf: _rev(spark, sf).select("review_id", F.array_join(lb.keyword_hits("review_text"), ",")
                                             .alias("hits")))



def _labels_by_table(spark, sf):
    """M1 with a lexicon table: the longer words of the benchmark."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), 0))
    lexicon = fx.table(spark, sf, "benchmark").select(words.alias("keyword")).distinct()
    return keywords.label_by_table(_rev(spark, sf), lexicon, ["review_id"])


register("label_by_table", W(R + [
    ("kw", "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS keyword FROM benchmark"),
    ("hits", "SELECT review_id, count(*) AS n FROM reviews JOIN kw ON contains(lower(review_text), keyword) GROUP BY ALL")], """
SELECT review_id, CASE WHEN rating IN (1, 2) OR n > 0 THEN 'Negatif' WHEN rating = 3 THEN 'Netral' ELSE 'Positif' END AS label,
       coalesce(n, 0) AS n_keywords
FROM reviews LEFT JOIN hits USING (review_id)"""))(_labels_by_table)

register("label_override_rate", W(R, f"""
SELECT source_platform, rating, count(*) AS n, count_if(({sg.label_case()}) = 'Negatif') AS n_overridden,
       round(avg(CASE WHEN ({sg.label_case()}) = 'Negatif' THEN 1.0 ELSE 0.0 END), 6) AS override_rate
FROM reviews WHERE rating >= 3 GROUP BY ALL"""))(
    lambda spark, sf: curate.label_override_rate(_rev(spark, sf)))

register("dataset_stats", W(sg.master_ctes(), """
SELECT 'rating' AS dimension, CAST(rating AS VARCHAR) AS value, count(*) AS n FROM master GROUP BY rating
UNION ALL SELECT 'label', label, count(*) FROM master GROUP BY label
UNION ALL SELECT 'source_platform', source_platform, count(*) FROM master GROUP BY source_platform
UNION ALL SELECT 'total', 'all', count(*) FROM master"""))(
    lambda spark, sf: curate.dataset_stats(ex.master(spark, sf)))

register("class_median_target", W(sg.master_ctes(), "SELECT target FROM target"))(
    lambda spark, sf: curate.class_median_target(curate.with_label(curate.dedup_first(
        curate.filter_noise(curate.conform_platform(fx.raw_reviews(spark, sf)))))))

register("union_platforms", W(sg.master_ctes(), """
SELECT source_platform, count(*) AS n FROM conformed GROUP BY ALL"""))(
    lambda spark, sf: curate.union_platforms([
        curate.conform_platform(fx.raw_reviews(spark, sf).filter(F.col("source_platform") == p), p)
        for p in lx.PLATFORMS]).groupBy("source_platform").agg(F.count(F.lit(1)).alias("n")))
