"""Multinomial Naive Bayes as model tables, and scoring by joins.

The model is data, not an object: ``nb_train`` returns
(platform, condition, token, ll) rows with ``ll`` = array of the three
class log-likelihoods, plus a priors table. All (platform, condition)
models are trained in one job by grouping on those columns; scoring the
whole train x test grid is one join on (condition, token).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as lx
from ..functions import text as tx
from ..session import cut_lineage
from .vocab import split_texts, text_tokens, token_counts

N_CLASSES = len(lx.CLASS_NAMES)
MODEL_KEYS = ("source_platform", "condition")
# stands for the document itself among its tokens: its "likelihood" is the prior
PRIOR_TOKEN = ""
HOT_TOKENS = 100_000  # model rows that scoring sends to every task


def _label_id(c: str = "sentiment_label"):
    lid = F.create_map(*[F.lit(x) for kv in lx.LABEL2ID.items() for x in kv])
    return F.try_element_at(lid, F.col(c))


def nb_token_counts(train: DataFrame, keys: tuple[str, ...] = MODEL_KEYS,
                    text: str = "review_text_clean", label: str = "sentiment_label") -> DataFrame:
    """(keys..., token, n0, n1, n2): per-class token counts in ONE shuffle —
    the three counts are added up batch by batch where the texts lie, so a token
    that occurs in a third of all reviews still reaches the reducer as one row per task."""
    labelled = train.withColumn("_label", _label_id(label))
    return token_counts(labelled, list(keys), text, [f"n{i}" for i in range(N_CLASSES)], "_label")


def nb_train(train: DataFrame, keys: tuple[str, ...] = MODEL_KEYS,
             text: str = "review_text_clean", label: str = "sentiment_label",
             alpha: float = 1.0, counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """per model key, loglik(c,t) = ln((n_ct + a) / (n_c + a|V|)) and
    prior(c) = ln(docs_c / docs). Returns (token_table, prior_table).

    ``counts`` may be a materialised ``nb_token_counts`` table; the class
    totals and |V| are then one small aggregate over it.
    """
    k = list(keys)
    per_token = counts if counts is not None else nb_token_counts(train, keys, text, label)
    # one row per model: class token totals and vocabulary size
    totals = per_token.groupBy(*k).agg(
        *[F.sum(f"n{i}").alias(f"t{i}") for i in range(N_CLASSES)],
        F.count(F.lit(1)).alias("v"))
    model = per_token.join(F.broadcast(totals), k).select(
        *k, "token",
        F.array(*[F.log((F.col(f"n{i}") + alpha) / (F.col(f"t{i}") + alpha * F.col("v")))
                  for i in range(N_CLASSES)]).alias("ll"))
    return model, nb_priors(train, keys, label)


def nb_priors(train: DataFrame, keys: tuple[str, ...] = MODEL_KEYS,
              label: str = "sentiment_label") -> DataFrame:
    """(keys..., prior array): ln(docs_c / docs) per model key; a class without
    documents has -infinity, so it is never predicted and gets probability 0."""
    k = list(keys)
    docs = train.groupBy(*k, _label_id(label).alias("label_id")).agg(F.count(F.lit(1)).alias("d"))
    w = Window.partitionBy(*k)
    return docs.withColumn("prior", F.log(F.col("d") / F.sum("d").over(w))) \
        .groupBy(*k).agg(F.array(*[F.coalesce(F.max(F.when(F.col("label_id") == i, F.col("prior"))),
                                              F.lit(float("-inf"))) for i in range(N_CLASSES)]).alias("prior"))


# smoothing values tried round by round by the validation curve
ALPHA_GRID: tuple[float, ...] = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0)


def nb_alpha_curve(train: DataFrame, val: DataFrame, doc_keys: list[str],
                   alphas: tuple[float, ...] = ALPHA_GRID, keys: tuple[str, ...] = MODEL_KEYS,
                   text: str = "review_text_clean", label: str = "sentiment_label") -> DataFrame:
    """In-domain validation predictions of one Naive Bayes model per
    (model key, round), round r using smoothing ``alphas[r-1]``; all rounds
    in one job: the token counts are joined once and smoothed behind the join.
    Output: keys..., doc keys, round, alpha, label_id, pred.
    """
    k = list(keys)
    counts = nb_token_counts(train, keys, text, label)
    totals = counts.groupBy(*k).agg(*[F.sum(f"n{i}").alias(f"t{i}") for i in range(N_CLASSES)],
                                    F.count(F.lit(1)).alias("v"))
    # one model row a token: the rounds are columns of one aggregate behind the join
    hit = text_tokens(val, doc_keys + k, text).join(counts, k + ["token"]).join(F.broadcast(totals), k)
    cells = [(r, i) for r in range(len(alphas)) for i in range(N_CLASSES)]
    loglik = lambda r, i: F.log((F.col(f"n{i}") + alphas[r]) / (F.col(f"t{i}") + alphas[r] * F.col("v")))
    sums = hit.groupBy(*doc_keys, *k).agg(*[F.sum(F.col("cnt") * loglik(r, i)).alias(f"s{r}_{i}") for r, i in cells])
    # priors: one row per model key
    base = val.select(*doc_keys, *k, _label_id(label).alias("label_id")) \
        .join(F.broadcast(nb_priors(train, keys, label)), k)
    scores = lambda r: F.array(*[F.round(F.col("prior")[i] + F.coalesce(F.col(f"s{r}_{i}"), F.lit(0.0)), 6)
                                 for i in range(N_CLASSES)])
    rounds = F.explode(F.array(*[F.struct(F.lit(r + 1).alias("round"), F.lit(float(a)).alias("alpha"),
                                          argmax(scores(r)).alias("pred")) for r, a in enumerate(alphas)]))
    return base.join(sums, doc_keys + k, "left").select(*k, *doc_keys, "label_id", rounds.alias("_g")) \
        .select(*k, *doc_keys, "_g.round", "_g.alpha", "label_id", "_g.pred")


def materialize_model(model: DataFrame, priors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write the token and prior tables once (every scoring join reads them)."""
    return (cut_lineage(model, "nb-model", spread_out=False),
            cut_lineage(priors, "nb-priors", spread_out=False))


def _hot_tables(hot: DataFrame, priors: DataFrame, platforms: list) -> dict:
    """By condition the tokens of ``hot``, with the prior, and their class sums and number for every platform."""
    size = len(platforms) * N_CLASSES
    at = {p: i for i, p in enumerate(platforms)}
    tables: dict = {}
    t = hot.select("condition", "token", "source_platform", "ll").unionByName(priors.select(
        "source_platform", "condition", F.lit(PRIOR_TOKEN).alias("token"), F.col("prior").alias("ll"))).toArrow()  # HOT_TOKENS rows and a few
    for condition, token, platform, ll in zip(*(c.to_pylist() for c in t.columns)):
        own = tables.setdefault(condition, {}).setdefault(token, np.zeros(size + len(platforms)))
        i = at[platform]
        own[i * N_CLASSES:(i + 1) * N_CLASSES] += ll
        own[size + i] += 1
    return {c: (pa.array(t, pa.string()), np.stack([*t.values()])) for c, t in tables.items()}


def _hot_sums(test: DataFrame, shared, docs: list[str], text: str, platforms: list) -> DataFrame:
    """docs..., s (the class sums of every platform, prior and tokens of the broadcast ``_hot_tables``), n (what went
    into them, a platform), tokens, counts (the other tokens): one row a row of ``test``, in place."""
    size = len(platforms) * N_CLASSES
    wide = test.select(*docs, F.col(text).alias("_text"))
    schema = T.StructType([*wide.schema[:len(docs)].fields, *T._parse_datatype_string(
        "s array<double>, n array<double>, tokens array<string>, counts array<long>").fields])

    def run(batches):
        for b in batches:
            k = b.num_rows
            words, row = split_texts(b.column(len(docs)))
            code = words.indices.to_numpy(zero_copy_only=False)
            conditions = b.column(docs.index("condition")).dictionary_encode()
            of = pc.fill_null(conditions.indices, -1).to_numpy(zero_copy_only=False)
            sums, cold = np.zeros((k, size + len(platforms))), np.zeros(len(code), bool)
            for j, c in enumerate(conditions.dictionary.to_pylist()):
                if c not in shared.value:
                    continue
                names, values = shared.value[c]
                spot = pc.fill_null(pc.index_in(words.dictionary, value_set=names), -1).to_numpy(zero_copy_only=False)[code]
                mine = (of == j)[row]
                known = mine & (spot >= 0)
                cold |= mine & (spot < 0)
                for x in range(values.shape[1]):
                    sums[:, x] += np.bincount(row[known], values[spot[known], x], k)
                prior = pc.index_in(pa.scalar(PRIOR_TOKEN), value_set=names).as_py()
                if prior is not None:
                    sums[of == j] += values[prior]
            pair, count = np.unique(row[cold] * max(1, len(words.dictionary)) + code[cold], return_counts=True)
            rest = np.r_[0, np.cumsum(np.bincount(pair // max(1, len(words.dictionary)), minlength=k))].astype(np.int32)
            rows = lambda v, w: pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * w), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(docs)], rows(sums[:, :size], size), rows(sums[:, size:], len(platforms)),
                 pa.ListArray.from_arrays(pa.array(rest), words.dictionary.take(pa.array(pair % max(1, len(words.dictionary))))),
                 pa.ListArray.from_arrays(pa.array(rest), pa.array(count.astype(np.int64)))], names=schema.names)

    return wide.mapInArrow(run, schema)


def nb_score(test: DataFrame, model: DataFrame, priors: DataFrame, doc_keys: list[str],
             text: str = "review_text_clean", model_platform: str = "train_src",
             carry: tuple[str, ...] = (), hot_tokens: int = HOT_TOKENS) -> DataFrame:
    """one scoring of a ``Scorer``."""
    return Scorer(model, priors, model_platform, hot_tokens).score(test, doc_keys, text, carry)


class Scorer:
    """score every test document with every model of its condition.

    What depends on the model alone is prepared once, for any number of ``test`` tables.
    The ``hot_tokens`` likeliest model rows go to all tasks, which add them up
    with the prior where the documents lie; most words of a text are among
    them. Only the other tokens, counted per document, are joined with the
    model by (condition, token), whatever its size, and come back as one row
    of sums a document and task. ``carry`` columns join once, to one row per
    document; the fan-out to models comes last. Output: doc keys, condition,
    train_src, scores array<double> (rounded to 6 so summation order cannot
    flip a tie) and pred (argmax, lowest class id on ties).
    """

    def __init__(self, model: DataFrame, priors: DataFrame, model_platform: str = "train_src", hot_tokens: int = HOT_TOKENS):
        self.model_platform = model_platform
        # one entry per training platform: bounded by the platforms of the study
        platforms = [r[0] for r in priors.select("source_platform").union(model.select("source_platform")).distinct().collect()]
        likely = sum((F.exp(F.col("ll")[i]) for i in range(N_CLASSES)), F.lit(0.0))
        top = (model.select("condition", "token", likely.alias("_p")).orderBy(F.desc("_p"), "token").limit(hot_tokens)
               .select("condition", "token").distinct())
        hot = model.join(F.broadcast(top), ["condition", "token"], "left_semi")
        self.platforms = platforms
        self.slots = [(i, c) for i in range(len(platforms)) for c in range(N_CLASSES)]
        self.hot = model.sparkSession.sparkContext.broadcast(_hot_tables(hot, priors, platforms))
        own = lambda i: F.col("source_platform").eqNullSafe(F.lit(platforms[i]))
        # one row a condition and token, for the join with the other tokens
        self.wide = model.groupBy("condition", "token").agg(
            *[F.coalesce(F.sum(F.when(own(i), F.col("ll")[c])), F.lit(0.0)).alias(f"s{i}_{c}") for i, c in self.slots],
            *[F.count_if(own(i)).cast("double").alias(f"n{i}") for i in range(len(platforms))])

    def keep(self, partitions: int) -> "Scorer":
        """Keeps the model dealt by its join keys, so that scoring after scoring it is not shuffled; ``release`` ends it."""
        self.wide = self.wide.repartition(partitions, "condition", "token").persist()
        return self

    def release(self) -> None:
        self.wide.unpersist()

    def score(self, test: DataFrame, doc_keys: list[str], text: str = "review_text_clean", carry: tuple[str, ...] = (),
              dealt: int | None = None) -> DataFrame:
        """``dealt``: ``test`` is kept in so many partitions by its ``doc_keys``. The sums of a document's conditions then
        go there as one row, and the ``carry`` columns stay where they are."""
        platforms, slots, model_platform = self.platforms, self.slots, self.model_platform
        docs = doc_keys + ["condition"]
        near = cut_lineage(_hot_sums(test, self.hot, docs, text, platforms), "nb-near")
        cold = near.select(*docs, F.explode(F.arrays_zip("tokens", "counts")).alias("_x")) \
            .select(*docs, F.col("_x.tokens").alias("token"), F.col("_x.counts").alias("cnt")).join(self.wide, ["condition", "token"])
        parts = near.select(*docs, *[F.col("s")[i * N_CLASSES + c].alias(f"s{i}_{c}") for i, c in slots],
                            *[F.col("n")[i].alias(f"n{i}") for i in range(len(platforms))]).unionByName(
            cold.select(*docs, *[(F.col("cnt") * F.col(f"s{i}_{c}")).alias(f"s{i}_{c}") for i, c in slots],
                        *[f"n{i}" for i in range(len(platforms))]))
        sums = parts.groupBy(*docs).agg(*[F.sum(f"s{i}_{c}").alias(f"s{i}_{c}") for i, c in slots],
                                        *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(platforms))])
        if carry and dealt:
            own = [c for c in sums.columns if c not in docs]
            every = sums.repartition(dealt, *doc_keys).groupBy(*doc_keys).agg(F.collect_list(F.struct("condition", *own)).alias("_all"))
            sums = test.select(*docs, *carry).join(every, doc_keys).select(*docs, *carry, F.explode(
                F.filter("_all", lambda x: x["condition"] == F.col("condition"))).alias("_x")).select(*docs, *carry, *[f"_x.{c}" for c in own])
        elif carry:
            sums = test.select(*docs, *carry).join(sums, docs)
        each = F.array(*[F.when(F.col(f"n{i}") > 0, F.struct(
            F.lit(p).cast("string").alias(model_platform),
            F.array(*[F.round(f"s{i}_{c}", 6) for c in range(N_CLASSES)]).alias("scores"))) for i, p in enumerate(platforms)])
        out = sums.select(*docs, *carry, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("_s"))
        out = out.select(*docs, f"_s.{model_platform}", *carry, "_s.scores")
        return out.withColumn("pred", argmax(F.col("scores")))


def argmax(arr) -> "F.Column":
    """O3: position (0-based) of the largest value, first one on ties."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def softmax(arr, digits: int | None = 4):
    """Class probabilities exp(x - max) / sum, rounded like the service does."""
    mx = F.array_max(arr)
    ex = F.transform(arr, lambda x: F.exp(x - mx))
    tot = F.aggregate(ex, F.lit(0.0), lambda a, b: a + b)
    if digits is None:
        return F.transform(ex, lambda x: x / tot)
    return F.transform(ex, lambda x: F.round(x / tot, digits))


def fallback_clean_paths(df: DataFrame, key: list[str], text: str = "review_text",
                         conditions: tuple[str, ...] = lx.CONDITIONS) -> DataFrame:
    """T14 for every condition in one scan: (key..., condition, review_text_clean)
    where a rejected text falls back to lower+strip (the scoring service rule)."""
    # what both conditions share is computed once a review, before the fan-out
    pre = df.select(*key, tx.is_meaningful(text).alias("_ok"), tx.strip(tx.lower(text)).alias("_plain"),
                    tx.clean_prefix(text).alias("_pre"))
    branches = {"baseline": tx.clean_suffix("_pre"),
                "proposed": tx.clean_suffix(tx.normalize_slang("_pre", lowered=True))}
    paths = F.array(*[F.struct(F.lit(c).alias("condition"), branches[c].alias("_c")) for c in conditions])
    ex = pre.select(*key, "_ok", "_plain", F.explode(paths).alias("_p"))
    clean = tx.or_plain(tx.finish_pipeline(F.col("_ok"), F.col("_p._c")), F.col("_plain"))
    return ex.select(*key, F.col("_p.condition").alias("condition"), clean.alias("review_text_clean"))


def score_reviews(df: DataFrame, model: DataFrame, priors: DataFrame, key: list[str],
                  text: str = "review_text", digits: int = 4, materialize: bool = True) -> DataFrame:
    """every review scored by every model of the matching condition:
    sentiment, confidence, class probabilities (softmax, rounded), the
    cleaned text and the model name."""
    # the regex cleaning runs once: its output is written, then read by both
    # the token side and the document side of the scoring
    cleaned = cut_lineage(fallback_clean_paths(df, key, text), "scoring-clean") if materialize \
        else fallback_clean_paths(df, key, text)
    return score_cleaned(cleaned, model, priors, key, digits)


def score_cleaned(cleaned: DataFrame, model: DataFrame, priors: DataFrame, key: list[str],
                  digits: int = 4) -> DataFrame:
    """F7 on (key..., condition, review_text_clean) rows from
    ``fallback_clean_paths`` (read twice: tokens and documents)."""
    return sentiments(nb_score(cleaned, model, priors, key, carry=("review_text_clean",)), key, digits)


def sentiments(scored: DataFrame, key: list[str], digits: int = 4) -> DataFrame:
    """F7's columns of scored (key..., condition, review_text_clean) rows."""
    probs = softmax(F.col("scores"), digits=None)
    out = scored.select(*key, "train_src", "condition", "pred", probs.alias("_p"), "review_text_clean")
    names = [c.lower() for c in lx.CLASS_NAMES]
    label = F.element_at(F.array(*[F.lit(c) for c in lx.CLASS_NAMES]), F.col("pred") + 1)
    model_name = F.concat(F.lit("NaiveBayes trained on "), F.initcap("train_src"), F.lit(" ["),
                          F.when(F.col("condition") == "proposed", F.lit("Proposed (Slang Norm)"))
                          .otherwise(F.lit("Baseline (No Norm)")), F.lit("]"))
    return out.select(
        *key, "train_src", "condition", label.alias("sentiment"),
        F.round(F.element_at("_p", F.col("pred") + 1), digits).alias("confidence"),
        *[F.round(F.col("_p")[i], digits).alias(f"p_{n}") for i, n in enumerate(names)],
        F.col("review_text_clean").alias("cleaned_text"), model_name.alias("active_model"))
