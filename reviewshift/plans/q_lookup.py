"""Registered queries: token lookups as joins, label pairing, metric
slices, ordered views and attention masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import lookup, model
from ..operators.ranking import md5_key
from ..session import cut_lineage
from ..sources import fixtures as fx
from . import experiment as ex
from . import sqlgen as sg
from .q_text import EXAMPLE_STOPLIST, PRE
from .registry import register

W = sg.with_
GRID = ex.GRID

# --- T12 both conditions ---------------------------------------------------------------


def _clean_both(spark, sf):
    pre = fx.reviews(spark, sf).select("review_id", tx.clean_prefix("review_text").alias("_pre"))
    paths = F.array(F.struct(F.lit("baseline").alias("condition"), tx.clean_suffix("_pre").alias("t")),
                    F.struct(F.lit("proposed").alias("condition"),
                             tx.clean_suffix(tx.normalize_slang("_pre")).alias("t")))
    return pre.select("review_id", F.explode(paths).alias("p")).select(
        "review_id", "p.condition", F.coalesce("p.t", F.lit("")).alias("text_out"))


register("clean_text", W(PRE, f"""
SELECT review_id, 'baseline' AS condition, coalesce({sg.clean_text_expr(False)}, '') AS text_out FROM pre
UNION ALL
SELECT review_id, 'proposed' AS condition, coalesce({sg.clean_text_expr(True)}, '') AS text_out FROM pre"""))(
    _clean_both)

# --- J1, J2: token rows of the prefix-cleaned text (what slang lookup sees) -------------

POS_CTES = PRE + [("pos", f"""
SELECT review_id, CAST(generate_subscripts(t, 1) AS INTEGER) AS pos, unnest(t) AS token
FROM (SELECT review_id, {sg.tokens('_pre')} AS t FROM pre)""")]


def _positions(spark, sf):
    pre = fx.reviews(spark, sf).select("review_id", tx.clean_prefix("review_text").alias("_pre"))
    return lookup.token_positions(pre, ["review_id"], "_pre", lower=False)


def _values(rows: list[tuple[str, ...]], cols: str) -> str:
    body = ", ".join("(" + ", ".join(sg.q(x) for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) t({cols})"


_wl = {w.lower() for w in lx.DOMAIN_WHITELIST}
_LEX_ROWS = sorted((k.lower(), v) for k, v in lx.SLANG_DICT.items() if k.lower() not in _wl)
_STOP = sorted(set(EXAMPLE_STOPLIST) - set(lx.NEGATION_WORDS) - set(lx.INTENSIFIER_WORDS))

register("lexicon_join", W(POS_CTES + [("lex", _values(_LEX_ROWS, "token, replacement"))], """
SELECT p.review_id, p.pos, p.token, coalesce(l.replacement, p.token) AS normalized,
       l.token IS NOT NULL AS in_lexicon
FROM pos p LEFT JOIN lex l ON p.token = l.token"""))(
    lambda spark, sf: lookup.lexicon_join(_positions(spark, sf), lookup.lexicon_table(spark)))

register("whitelist_semi", W(POS_CTES, f"""
SELECT review_id, pos, token FROM pos WHERE token IN {sg.in_list(sorted(_wl))}"""))(
    lambda spark, sf: lookup.whitelist_semi(_positions(spark, sf), lookup.word_table(spark, _wl)))

register("stopword_anti", W(POS_CTES, f"""
SELECT review_id, pos, token FROM pos WHERE token NOT IN {sg.in_list(_STOP)}"""))(
    lambda spark, sf: lookup.stopword_anti(_positions(spark, sf), lookup.word_table(spark, _STOP)))

# --- J7: labelled documents scored by every model, paired with their labels -------------


def _label_docs(spark, sf):
    s = ex.experiment_splits(spark, sf)
    m, p = model.nb_train(s.filter(F.col("split") == "train"))
    m, p = model.materialize_model(m, p)
    docs = fx.labelled_documents(spark, sf)
    cleaned = cut_lineage(model.fallback_clean_paths(docs, ["doc_id"], "text"), "label-docs-clean")
    scored = model.nb_score(cleaned, m, p, ["doc_id"])
    truth = docs.select("doc_id", model._label_id().alias("label_id"))
    return lookup.label_docs_join(scored, truth, ["doc_id"])


register("label_docs_join", W(sg.experiment_ctes() + sg.nb_ctes() + [("lab_docs", fx.LABELLED_SQL)]
                              + sg.score_ctes("lab_docs", "doc_id", "text"), f"""
SELECT r.doc_id, r.train_src, r.condition, {sg.LABEL_ID} AS label_id, r.pred AS pred_id,
       ({sg.LABEL_ID}) = r.pred AS correct
FROM rscore r JOIN lab_docs d ON r.doc_id = d.doc_id"""))(_label_docs)

# --- A14, A15 as their own tables -------------------------------------------------------
L = sg.loso_ctes()
_KEYS_SQL = (f"{sg.initcap('train_src')} AS train_src, {sg.initcap('test_src')} AS test_src, "
             f"{sg.initcap('condition')} AS condition")

register("accuracy", W(L, f"""
SELECT {_KEYS_SQL}, count(*) AS n,
       round(avg(CASE WHEN label_id = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM preds GROUP BY train_src, test_src, condition"""))(
    lambda spark, sf: ex.title_case(ex.loso_predictions(spark, sf).groupBy(*GRID).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((F.col("label_id") == F.col("pred")).cast("double")), 6).alias("accuracy"))))

_F1_COLS = [f"f1_{c.lower()}" for c in lx.CLASS_NAMES]


def _f1_long(spark, sf):
    loso = ex.loso_matrix(spark, sf)
    long = loso.unpivot(GRID, _F1_COLS, "_col", "f1")
    name = F.create_map(*[F.lit(x) for c, n in zip(_F1_COLS, lx.CLASS_NAMES) for x in (c, n)])
    return long.select(*GRID, F.element_at(name, F.col("_col")).alias("class"), "f1")


register("f1_per_class", W(L, " UNION ALL ".join(
    f"SELECT train_src, test_src, condition, {sg.q(n)} AS class, {c} AS f1 FROM loso"
    for c, n in zip(_F1_COLS, lx.CLASS_NAMES))))(_f1_long)

register("f1_macro", W(L, "SELECT train_src, test_src, condition, f1_macro FROM loso"))(
    lambda spark, sf: ex.loso_matrix(spark, sf).select(*GRID, "f1_macro"))

# --- O1, O2: ordered views of the master table ------------------------------------------
M = sg.master_ctes()


def _sorted_distribution(spark, sf):
    from pyspark.sql import Window
    m = ex.master(spark, sf)
    by_rating = m.groupBy("rating").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("rating").alias("dimension"), F.col("rating").cast("string").alias("value"), "n",
        F.row_number().over(Window.orderBy("rating")).alias("rank"))
    by_label = m.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("label").alias("dimension"), F.col("label").alias("value"), "n",
        F.row_number().over(Window.orderBy(F.col("n").desc(), F.col("label"))).alias("rank"))
    # each side is one row per rating / class: the global windows sort a handful of rows
    return by_rating.unionByName(by_label)


register("sorted_distribution", W(M, """
SELECT 'rating' AS dimension, CAST(rating AS VARCHAR) AS value, n,
       CAST(row_number() OVER (ORDER BY rating) AS INTEGER) AS rank
FROM (SELECT rating, count(*) AS n FROM master GROUP BY rating)
UNION ALL
SELECT 'label' AS dimension, label AS value, n,
       CAST(row_number() OVER (ORDER BY n DESC, label) AS INTEGER) AS rank
FROM (SELECT label, count(*) AS n FROM master GROUP BY label)"""))(_sorted_distribution)

_VIEW_COLS = "row_seq AS review_id, source_platform, rating, label, substr(review_text, 1, 80) AS snippet"


def _view(df):
    return df.select(F.col("row_seq").alias("review_id"), "source_platform", "rating", "label",
                     tx.snippet("review_text").alias("snippet"))


# top-k by a sort key: Spark plans TakeOrderedAndProject (a per-task top-k, then a merge)
register("preview", W(M, f"SELECT {_VIEW_COLS} FROM master ORDER BY label, source_seq, row_seq LIMIT 5"))(
    lambda spark, sf: _view(ex.master(spark, sf).orderBy("label", "source_seq", "row_seq").limit(5)))

register("sample_rows", W(M, f"""
SELECT {_VIEW_COLS} FROM master ORDER BY {sg.md5_key('source_seq', 'row_seq')}, source_seq, row_seq LIMIT 3"""))(
    lambda spark, sf: _view(ex.master(spark, sf).orderBy(md5_key("source_seq", "row_seq"), "source_seq",
                                                         "row_seq").limit(3)))

# --- F2: attention masks of the cleaned reviews (no vocabulary needed) -------------------


def _masks(spark, sf):
    c = ex.splits.dual_path_clean(fx.reviews(spark, sf))
    return lookup.attention_mask(c, ["review_id", "condition"]).select(
        "review_id", "condition", "n_tokens", F.array_join("attention_mask", " ").alias("attention_mask"))


register("attention_mask", W(sg.reviews_ctes() + sg.clean_ctes("reviews"), f"""
SELECT review_id, condition, n AS n_tokens,
       trim(concat(repeat('1 ', n), repeat('0 ', {lx.MAX_LEN} - n))) AS attention_mask
FROM (SELECT review_id, condition,
             CAST(least({sg.token_count('review_text_clean')}, {lx.MAX_LEN}) AS INTEGER) AS n FROM cleaned)"""))(
    _masks)
