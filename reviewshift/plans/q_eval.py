"""Registered queries: models, scoring, metrics, LOSO tables and charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import metrics, model
from ..session import cut_lineage
from ..sources import fixtures as fx
from . import experiment as ex
from . import sqlgen as sg
from .registry import register

W = sg.with_
GRID = ex.GRID
L = sg.loso_ctes()
NAMES = [c.lower() for c in lx.CLASS_NAMES]


def _loso(spark, sf) -> DataFrame:
    return ex.loso_matrix(spark, sf)


def _preds(spark, sf) -> DataFrame:
    return ex.loso_predictions(spark, sf)


# --- A12..A16 ------------------------------------------------------------------------
register("confusion_matrix", W(L, sg.cells_long_select()))(
    lambda spark, sf: ex.title_case(metrics.confusion_cells(_preds(spark, sf), GRID)))

register("confusion_row_pct", W(L + [("cl", sg.cells_long_select())], """
SELECT *, round(CASE WHEN sum(n) OVER (PARTITION BY train_src, test_src, condition, label_id) > 0
                THEN 100.0 * n / sum(n) OVER (PARTITION BY train_src, test_src, condition, label_id)
                ELSE 0.0 END, 6) AS row_pct FROM cl"""))(
    lambda spark, sf: metrics.confusion_row_pct(
        ex.title_case(metrics.confusion_cells(_preds(spark, sf), GRID)), GRID))


def _report_sql() -> str:
    sup = [f"(c{i}0 + c{i}1 + c{i}2)" for i in range(3)]
    prd = [f"(c0{i} + c1{i} + c2{i})" for i in range(3)]
    n = "(" + " + ".join(sup) + ")"
    prec = [f"CASE WHEN {prd[i]} > 0 THEN c{i}{i} / {prd[i]} ELSE 0.0 END" for i in range(3)]
    rec = [f"CASE WHEN {sup[i]} > 0 THEN c{i}{i} / {sup[i]} ELSE 0.0 END" for i in range(3)]
    f1 = [f"CASE WHEN {sup[i]} + {prd[i]} > 0 THEN 2.0 * c{i}{i} / ({sup[i]} + {prd[i]}) ELSE 0.0 END"
          for i in range(3)]
    acc = f"(c00 + c11 + c22) / {n}"
    keys = (f"{sg.initcap('train_src')} AS train_src, {sg.initcap('test_src')} AS test_src, "
            f"{sg.initcap('condition')} AS condition")
    rows = [(sg.q(c), prec[i], rec[i], f1[i], sup[i]) for i, c in enumerate(lx.CLASS_NAMES)]
    rows.append(("'accuracy'", acc, acc, acc, n))
    mean = lambda xs: "((" + ") + (".join(xs) + ")) / 3.0"
    rows.append(("'macro avg'", mean(prec), mean(rec), mean(f1), n))
    wavg = lambda xs: "((" + ") + (".join(f"({xs[i]}) * {sup[i]}" for i in range(3)) + f")) / {n}"
    rows.append(("'weighted avg'", wavg(prec), wavg(rec), wavg(f1), n))
    return " UNION ALL ".join(
        f"SELECT {keys}, {c} AS class, round({p}, 4) AS precision, round({r}, 4) AS recall, "
        f"round({f}, 4) AS f1, CAST({s} AS BIGINT) AS support FROM cells" for c, p, r, f, s in rows)


register("classification_report", W(L, _report_sql()))(
    lambda spark, sf: ex.title_case(metrics.classification_report(
        metrics.confusion_wide(_preds(spark, sf), GRID), GRID)))

register("class_weights", W(sg.experiment_ctes(), f"""
SELECT source_platform, condition, label_id, n_c,
       round(sum(n_c) OVER (PARTITION BY source_platform, condition) / (3.0 * n_c), 6) AS weight
FROM (SELECT source_platform, condition, {sg.LABEL_ID} AS label_id, count(*) AS n_c
      FROM splits WHERE split = 'train' GROUP BY ALL)"""))(
    lambda spark, sf: metrics.class_weights(
        ex.experiment_splits(spark, sf, raw_text=False).filter(F.col("split") == "train")
        .select("source_platform", "condition", model._label_id().alias("label_id")),
        ["source_platform", "condition"]))

# --- A18, A19, J5, J6 --------------------------------------------------------------


def _pairs(loso: DataFrame) -> DataFrame:
    """Baseline vs proposed side by side per (train, test); a pair with
    a missing side is dropped (inner self-join of a stage output: scoring runs once)."""
    loso = cut_lineage(loso, "loso", spread_out=False)
    b = loso.filter(F.col("condition") == "Baseline").select(
        "train_src", "test_src", F.col("accuracy").alias("acc_baseline"), F.col("f1_macro").alias("f1_baseline"))
    p = loso.filter(F.col("condition") == "Proposed").select(
        "train_src", "test_src", F.col("accuracy").alias("acc_proposed"), F.col("f1_macro").alias("f1_proposed"))
    return b.join(p, ["train_src", "test_src"])


PAIRS_SQL = ("pairs", """
SELECT b.train_src, b.test_src, b.accuracy AS acc_baseline, b.f1_macro AS f1_baseline,
       p.accuracy AS acc_proposed, p.f1_macro AS f1_proposed
FROM (SELECT * FROM loso WHERE condition = 'Baseline') b
JOIN (SELECT * FROM loso WHERE condition = 'Proposed') p USING (train_src, test_src)""")

register("baseline_vs_proposed", W(L + [PAIRS_SQL], "SELECT * FROM pairs"))(
    lambda spark, sf: _pairs(_loso(spark, sf)))

register("loso_delta", W(L + [PAIRS_SQL], """
SELECT train_src, test_src, f1_baseline, f1_proposed, round(f1_proposed - f1_baseline, 6) AS delta,
       CASE WHEN f1_proposed - f1_baseline >= 0 THEN 'MENINGKAT' ELSE 'MENURUN (ANOMALI)' END AS tag
FROM pairs"""))(
    lambda spark, sf: _pairs(_loso(spark, sf)).select(
        "train_src", "test_src", "f1_baseline", "f1_proposed",
        F.round(F.col("f1_proposed") - F.col("f1_baseline"), 6).alias("delta"),
        F.when(F.col("f1_proposed") - F.col("f1_baseline") >= 0, "MENINGKAT")
        .otherwise("MENURUN (ANOMALI)").alias("tag")))


def _degradation(loso: DataFrame) -> DataFrame:
    loso = cut_lineage(loso, "loso", spread_out=False)
    ind = loso.filter(F.col("train_src") == F.col("test_src")).select(
        "train_src", "condition", F.col("f1_macro").alias("f1_in_domain"))
    cross = loso.filter(F.col("train_src") != F.col("test_src"))
    j = cross.join(ind, ["train_src", "condition"])
    return j.select("train_src", "test_src", "condition", "f1_in_domain", F.col("f1_macro").alias("f1_cross"),
                    F.round(F.col("f1_macro") - F.col("f1_in_domain"), 6).alias("f1_drop"),
                    F.round(F.when(F.col("f1_in_domain") > 0,
                                   100.0 * (F.col("f1_macro") - F.col("f1_in_domain")) / F.col("f1_in_domain")),
                            4).alias("f1_drop_pct"))


register("domain_degradation", W(L, """
SELECT c.train_src, c.test_src, c.condition, i.f1_macro AS f1_in_domain, c.f1_macro AS f1_cross,
       round(c.f1_macro - i.f1_macro, 6) AS f1_drop,
       round(CASE WHEN i.f1_macro > 0 THEN 100.0 * (c.f1_macro - i.f1_macro) / i.f1_macro END, 4) AS f1_drop_pct
FROM (SELECT * FROM loso WHERE train_src <> test_src) c
JOIN (SELECT * FROM loso WHERE train_src = test_src) i USING (train_src, condition)"""))(
    lambda spark, sf: _degradation(_loso(spark, sf)))


def _grid(spark, sf) -> DataFrame:
    """Every trained model x every test set of the same condition."""
    s = ex.experiment_splits(spark, sf, raw_text=False)
    models = s.filter(F.col("split") == "train").select(F.col("source_platform").alias("train_src"),
                                                         "condition").distinct()
    tests = s.filter(F.col("split") == "test").select(F.col("source_platform").alias("test_src"),
                                                       "condition").distinct()
    return ex.title_case(models.join(tests, "condition").select("condition", "train_src", "test_src"))


register("loso_grid", W(sg.experiment_ctes(), f"""
SELECT {sg.initcap('condition')} AS condition, {sg.initcap('m.train_src')} AS train_src,
       {sg.initcap('t.test_src')} AS test_src
FROM (SELECT DISTINCT source_platform AS train_src, condition FROM splits WHERE split = 'train') m
JOIN (SELECT DISTINCT source_platform AS test_src, condition FROM splits WHERE split = 'test') t
USING (condition)"""))(_grid)

register("evaluate_model", W(L, f"""
SELECT l.*, {', '.join(f'c.c{i}{j}' for i in range(3) for j in range(3))}
FROM loso l JOIN cells c ON l.train_src = {sg.initcap('c.train_src')} AND l.test_src = {sg.initcap('c.test_src')}
 AND l.condition = {sg.initcap('c.condition')}
WHERE l.train_src = l.test_src"""))(
    lambda spark, sf: ex.title_case(metrics.scores_from_cells(metrics.confusion_wide(
        _preds(spark, sf).filter(F.col("train_src") == F.col("test_src")), GRID), GRID, cells=True)
        .withColumn("eval_type", F.lit("In-Domain"))))

# --- charts (V1..V6) ---------------------------------------------------------------------
register("chart_confusion", W(L + [("cl", sg.cells_long_select())], """
SELECT *, round(CASE WHEN sum(n) OVER (PARTITION BY train_src, test_src, condition, label_id) > 0
                THEN 100.0 * n / sum(n) OVER (PARTITION BY train_src, test_src, condition, label_id)
                ELSE 0.0 END, 6) AS row_pct FROM cl WHERE train_src = test_src"""))(
    lambda spark, sf: metrics.confusion_row_pct(
        ex.title_case(metrics.confusion_cells(_preds(spark, sf), GRID)), GRID)
    .filter(F.col("train_src") == F.col("test_src")))

register("chart_f1_pairs", W(L + [PAIRS_SQL], """
SELECT train_src, test_src, CASE WHEN train_src = test_src THEN 'In-Domain' ELSE 'Cross-Platform' END
       AS scenario_type, concat(substr(train_src, 1, 4), '→', substr(test_src, 1, 4)) AS label,
       f1_baseline, f1_proposed, round(f1_proposed - f1_baseline, 6) AS delta FROM pairs"""))(
    lambda spark, sf: _pairs(_loso(spark, sf)).select(
        "train_src", "test_src",
        F.when(F.col("train_src") == F.col("test_src"), "In-Domain").otherwise("Cross-Platform")
        .alias("scenario_type"),
        F.concat(F.substring("train_src", 1, 4), F.lit("→"), F.substring("test_src", 1, 4)).alias("label"),
        "f1_baseline", "f1_proposed", F.round(F.col("f1_proposed") - F.col("f1_baseline"), 6).alias("delta")))

_PL = [p.title() for p in lx.PLATFORMS]
register("chart_shift_heatmap", W(L, """
SELECT condition, train_src, """ + ", ".join(
    f"max(CASE WHEN test_src = '{p}' THEN f1_macro END) AS f1_{p.lower()}" for p in _PL) + """
FROM loso GROUP BY condition, train_src"""))(
    lambda spark, sf: _loso(spark, sf).groupBy("condition", "train_src").agg(
        *[F.max(F.when(F.col("test_src") == p, F.col("f1_macro"))).alias(f"f1_{p.lower()}") for p in _PL]))

register("chart_class_f1", W(L, " UNION ALL ".join(
    f"SELECT train_src, condition, '{c}' AS class, f1_{c.lower()} AS f1 FROM loso WHERE train_src = test_src"
    for c in lx.CLASS_NAMES)))(
    lambda spark, sf: _loso(spark, sf).filter(F.col("train_src") == F.col("test_src")).select(
        "train_src", "condition", F.explode(F.array(*[
            F.struct(F.lit(c).alias("class"), F.col(f"f1_{c.lower()}").alias("f1")) for c in lx.CLASS_NAMES]))
        .alias("x")).select("train_src", "condition", "x.class", "x.f1"))

_PROFILE = [("F1-Macro", "f1_macro"), ("Accuracy", "accuracy"), ("F1-Negatif", "f1_negatif"),
            ("F1-Netral", "f1_netral"), ("F1-Positif", "f1_positif")]


def _profile(spark, sf):
    ind = _loso(spark, sf).filter(F.col("train_src") == F.col("test_src"))
    long = ind.select("train_src", "condition", F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(c).alias("value")) for n, c in _PROFILE])).alias("x")) \
        .select("train_src", "condition", "x.metric", "x.value")
    # the profile chart needs at least two in-domain models (the grid has at most 4, each with a row a metric)
    rows = long.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    return rows.filter(F.col("_n") >= 2 * len(_PROFILE)).drop("_n")


register("chart_model_profile", W(L, " UNION ALL ".join(
    f"SELECT train_src, condition, '{n}' AS metric, {c} AS value FROM loso WHERE train_src = test_src "
    f"AND (SELECT count(*) FROM loso WHERE train_src = test_src) >= 2" for n, c in _PROFILE)))(_profile)

register("chart_acc_vs_f1", W(L, """
SELECT train_src, test_src, condition, accuracy, f1_macro, train_src = test_src AS in_domain,
       concat(substr(train_src, 1, 4), '→', substr(test_src, 1, 4), ' ', substr(condition, 1, 4)) AS label
FROM loso"""))(
    lambda spark, sf: _loso(spark, sf).select(
        "train_src", "test_src", "condition", "accuracy", "f1_macro",
        (F.col("train_src") == F.col("test_src")).alias("in_domain"),
        F.concat(F.substring("train_src", 1, 4), F.lit("→"), F.substring("test_src", 1, 4), F.lit(" "),
                 F.substring("condition", 1, 4)).alias("label")))

register("argmax_class", W(L, f"""
SELECT {sg.initcap('train_src')} AS train_src, {sg.initcap('test_src')} AS test_src,
       {sg.initcap('condition')} AS condition, pred, count(*) AS n FROM preds GROUP BY ALL"""))(
    lambda spark, sf: ex.title_case(_preds(spark, sf).groupBy(*GRID, "pred").agg(F.count(F.lit(1)).alias("n"))))

# --- F4, F6: model tables ------------------------------------------------------------


def _models(spark, sf):
    s = ex.experiment_splits(spark, sf, raw_text=False)
    return s, model.nb_train(s.filter(F.col("split") == "train"))


register("nb_train", W(L, """
SELECT train_src AS source_platform, condition, token, round(ll0, 6) AS ll_negatif, round(ll1, 6) AS ll_netral,
       round(ll2, 6) AS ll_positif FROM mdl"""))(
    lambda spark, sf: _models(spark, sf)[1][0].select(
        "source_platform", "condition", "token",
        *[F.round(F.col("ll")[i], 6).alias(f"ll_{n}") for i, n in enumerate(NAMES)]))

def _train_grid(spark, sf):
    """Sizes and priors of every model, both from one set of splits."""
    train = ex.experiment_splits(spark, sf, raw_text=False).filter(F.col("split") == "train")
    sizes = model.nb_token_counts(train).groupBy("source_platform", "condition").agg(
        F.count(F.lit(1)).alias("vocab_size"), *[F.sum(f"n{i}").alias(f"tokens_{n}") for i, n in enumerate(NAMES)])
    priors = model.nb_priors(train).select(
        "source_platform", "condition", *[F.round(F.col("prior")[i], 6).alias(f"prior_{n}") for i, n in enumerate(NAMES)])
    return sizes.join(priors, ["source_platform", "condition"])


register("train_grid", W(L, """
SELECT t.source_platform, t.condition, CAST(t.v AS BIGINT) AS vocab_size, CAST(t.t0 AS BIGINT) AS tokens_negatif,
       CAST(t.t1 AS BIGINT) AS tokens_netral, CAST(t.t2 AS BIGINT) AS tokens_positif,
       round(p.p0, 6) AS prior_negatif, round(p.p1, 6) AS prior_netral, round(p.p2, 6) AS prior_positif
FROM tot t JOIN pri p ON p.train_src = t.source_platform AND p.condition = t.condition"""))(
    lambda spark, sf: _train_grid(spark, sf))

# --- F7, V7, A17: scoring reviews -------------------------------------------------------


def _scored_reviews(spark, sf):
    s, (m, p) = _models(spark, sf)
    m, p = model.materialize_model(m, p)
    return model.score_reviews(fx.reviews(spark, sf), m, p, ["review_id"])


SC = L + sg.score_ctes()
_PROB = [f"round(exp(sc{i} - _mx) / _z, 4)" for i in range(3)]
register("score_reviews", W(SC, f"""
SELECT review_id, train_src, condition,
       CASE pred WHEN 0 THEN 'Negatif' WHEN 1 THEN 'Netral' ELSE 'Positif' END AS sentiment,
       round(exp(greatest(sc0, sc1, sc2) - _mx) / _z, 4) AS confidence,
       {_PROB[0]} AS p_negatif, {_PROB[1]} AS p_netral, {_PROB[2]} AS p_positif, cleaned AS cleaned_text,
       concat('NaiveBayes trained on ', {sg.initcap('train_src')}, ' [',
              CASE WHEN condition = 'proposed' THEN 'Proposed (Slang Norm)' ELSE 'Baseline (No Norm)' END, ']')
       AS active_model
FROM rscore"""))(_scored_reviews)

register("chart_probabilities", W(SC, " UNION ALL ".join(
    f"SELECT review_id, train_src, condition, '{c}' AS class, round({_PROB[i]} * 100, 2) AS pct FROM rscore"
    for i, c in enumerate(lx.CLASS_NAMES))))(
    lambda spark, sf: _scored_reviews(spark, sf).select(
        "review_id", "train_src", "condition", F.explode(F.array(*[
            F.struct(F.lit(c).alias("class"), F.round(F.col(f"p_{c.lower()}") * 100, 2).alias("pct"))
            for c in lx.CLASS_NAMES])).alias("x")).select("review_id", "train_src", "condition", "x.class", "x.pct"))


def _log_loss(spark, sf):
    s = ex.experiment_splits(spark, sf, raw_text=False)
    train = s.filter(F.col("split") == "train")
    w = metrics.class_weights(train.select("source_platform", "condition", model._label_id().alias("label_id")),
                              ["source_platform", "condition"]).select(
        F.col("source_platform").alias("train_src"), "condition", "label_id", F.col("weight").alias("weight"))
    preds = ex.loso_predictions(spark, sf, s).withColumn("probs", model.softmax(F.col("scores"), None))
    # weights: one row per (model, class) -> broadcast
    j = preds.join(F.broadcast(w), ["train_src", "condition", "label_id"])
    return ex.title_case(metrics.weighted_log_loss(j, GRID))


register("weighted_log_loss", W(L + [("wts", f"""
SELECT source_platform AS train_src, condition, label_id,
       round(sum(n_c) OVER (PARTITION BY source_platform, condition) / (3.0 * n_c), 6) AS weight
FROM (SELECT source_platform, condition, {sg.LABEL_ID} AS label_id, count(*) AS n_c
      FROM splits WHERE split = 'train' GROUP BY ALL)""")], f"""
SELECT {sg.initcap('p.train_src')} AS train_src, {sg.initcap('p.test_src')} AS test_src,
       {sg.initcap('p.condition')} AS condition,
       round(sum(w.weight * -ln(CASE p.label_id WHEN 0 THEN exp(sc0 - m) WHEN 1 THEN exp(sc1 - m)
                                 ELSE exp(sc2 - m) END / (exp(sc0 - m) + exp(sc1 - m) + exp(sc2 - m))))
             / sum(w.weight), 6) AS weighted_log_loss
FROM (SELECT *, greatest(sc0, sc1, sc2) AS m FROM preds) p
JOIN wts w ON w.train_src = p.train_src AND w.condition = p.condition AND w.label_id = p.label_id
GROUP BY ALL"""))(_log_loss)

# --- F8 request validation ------------------------------------------------------------
_REQ = (f"CASE WHEN review_text IS NULL OR {sg.strip('review_text')} = '' THEN 'blank' "
        f"WHEN length(review_text) < {lx.REQUEST_MIN_CHARS} THEN 'too_short' "
        f"WHEN length(review_text) > {lx.REQUEST_MAX_CHARS} THEN 'too_long' ELSE 'ok' END")
register("validate_requests", W(sg.reviews_ctes(), f"""
SELECT review_id, {_REQ} AS status, 'tokopedia' AS target_platform, true AS use_normalization FROM reviews"""))(
    lambda spark, sf: fx.reviews(spark, sf).select(
        "review_id",
        F.when(F.col("review_text").isNull() | (tx.strip("review_text") == ""), "blank")
        .when(F.length("review_text") < lx.REQUEST_MIN_CHARS, "too_short")
        .when(F.length("review_text") > lx.REQUEST_MAX_CHARS, "too_long").otherwise("ok").alias("status"),
        F.lit("tokopedia").alias("target_platform"), F.lit(True).alias("use_normalization")))
