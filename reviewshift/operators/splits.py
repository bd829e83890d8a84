"""Dual-path cleaning and deterministic stratified splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from .cleaning import clean_paths
from .ranking import hash_cut, hash_rank, md5_key, with_group

KEYS = ("source_seq", "row_seq")
SPLIT_COLS = ("review_text_clean", "review_text", "rating", "sentiment_label",
              "source_platform", "condition")


def dual_path_clean(df: DataFrame, text: str = "review_text",
                    stoplist: tuple[str, ...] | None = None,
                    lexicon: dict[str, str] | None = None,
                    whitelist: tuple[str, ...] | None = None,
                    conditions: tuple[str, ...] = lx.CONDITIONS, raw_text: bool = True) -> DataFrame:
    """Both cleaning paths in one scan.

    The cheap P2 test runs first, both paths are cleaned token by token where
    the texts lie, then each row fans out into one row per condition.
    Output: input columns + condition + review_text_clean (rejected rows
    removed, as the study drops them); ``raw_text=False`` leaves ``text`` out.
    """
    cols = [c for c in df.columns if raw_text or c != text]
    pre = clean_paths(df.filter(tx.is_meaningful(text)), cols, text, lexicon, whitelist, out=("_baseline", "_proposed"))
    paths = F.array(*[F.struct(F.lit(c).alias("condition"), F.col(f"_{c}").alias("_clean")) for c in conditions])
    out = pre.select(*cols, F.explode(paths).alias("_p"))
    out = out.select(*cols, "_p.condition",
                     tx.remove_stopwords(F.col("_p._clean"), stoplist).alias("review_text_clean"))
    return out.filter(tx.has_tokens("review_text_clean", lx.MIN_TOKEN_COUNT))


def _approx_mode(counts: DataFrame, part: list[str], n_col: str, draws_col: str,
                 out: str, order_col: str = "label_id") -> DataFrame:
    """Largest-remainder integer allocation of ``draws`` over the classes of
    each ``part``: floor(draws*n_c/N) plus one for the classes with the
    largest remainders (exact integer remainders, ties by class id)."""
    w = Window.partitionBy(*part)
    c = counts.withColumn("_tot", F.sum(n_col).over(w).cast("decimal(38,0)"))
    # decimal(38,0): draws * n_c overflows 64 bits at ~1e10 rows per stratum
    num = F.col(draws_col).cast("decimal(38,0)") * F.col(n_col).cast("decimal(38,0)")
    c = c.withColumn("_num", num)
    c = c.withColumn("_floor", F.when(F.col("_tot") > 0, F.expr("_num div _tot")).otherwise(0)
                     .cast("long"))
    c = c.withColumn("_rem", F.when(F.col("_tot") > 0, F.col("_num") % F.col("_tot")).otherwise(0))
    c = c.withColumn("_need", F.col(draws_col) - F.sum("_floor").over(w))
    rk = F.row_number().over(w.orderBy(F.col("_rem").desc(), F.col(order_col)))
    c = c.withColumn(out, F.col("_floor") + F.when(rk <= F.col("_need"), 1).otherwise(0))
    return c.drop("_tot", "_num", "_floor", "_rem", "_need")


def split_allocation(df: DataFrame, strata: list[str], label: str = "sentiment_label",
                     holdout: float = lx.TEST_SIZE + lx.VAL_SIZE,
                     second_test_size: float = lx.VAL_SIZE / (lx.TEST_SIZE + lx.VAL_SIZE)) -> DataFrame:
    """Per (strata, label): n, n_train, n_val, n_test as the study's two
    stratified steps give them (held-out size = ceil(holdout * n))."""
    # exact ceilings with integer arithmetic: ceil(p*n) for p = a/b
    ha, hb = _as_fraction(holdout)
    va, vb = _as_fraction(second_test_size)      # held out of the held-out part
    lid = F.create_map(*[F.lit(x) for kv in lx.LABEL2ID.items() for x in kv])
    counts = df.groupBy(*strata, label).agg(F.count(F.lit(1)).alias("n_c")) \
        .withColumn("label_id", F.try_element_at(lid, F.col(label)))
    w = Window.partitionBy(*strata)
    counts = counts.withColumn("_n", F.sum("n_c").over(w))
    counts = counts.withColumn("_n_train", F.col("_n") - _ceil_share("_n", ha, hb))
    a = _approx_mode(counts, strata, "n_c", "_n_train", "n_train")
    a = a.withColumn("_t", F.col("n_c") - F.col("n_train"))
    a = a.withColumn("_n_temp", F.sum("_t").over(w))
    a = a.withColumn("_n_val", F.col("_n_temp") - _ceil_share("_n_temp", va, vb))
    a = _approx_mode(a, strata, "_t", "_n_val", "n_val")
    a = a.withColumn("n_test", F.col("_t") - F.col("n_val"))
    return a.select(*strata, label, "n_c", "n_train", "n_val", "n_test")


def _as_fraction(x: float) -> tuple[int, int]:
    """The decimal number as written, exactly."""
    from fractions import Fraction
    f = Fraction(repr(x))
    return f.numerator, f.denominator


def _ceil_share(n: str, a: int, b: int) -> Column:
    """ceil(n * a / b) in decimals (a and b have up to 17 digits)."""
    return F.expr(f"cast((cast({n} as decimal(19,0)) * {a}BD + {b - 1}BD) div {b}BD as bigint)")


def stratified_split(df: DataFrame, strata: list[str] | None = None,
                     label: str = "sentiment_label", seed: int = lx.RANDOM_STATE,
                     keys: tuple[str, ...] = KEYS) -> DataFrame:
    """70/15/15 per label inside each stratum, exact sizes, seeded hash order."""
    strata = list(strata or ["source_platform", "condition"])
    alloc = split_allocation(df, strata, label)
    keyed = df.withColumn("_h", md5_key(*keys, seed=seed))
    # allocation has one row per (stratum, class): platforms x conditions x classes
    by = strata + [label]
    ends = alloc.select(*by, "n_train", (F.col("n_train") + F.col("n_val")).alias("n_held"))
    part = hash_cut(keyed, by, "_h", list(keys), ends, ["n_train", "n_held"], out="_part")
    split = F.when(F.col("_part") == 0, "train").when(F.col("_part") == 1, "val").otherwise("test")
    return part.withColumn("split", split).drop("_h", "_part")


def split_projection(df: DataFrame) -> DataFrame:
    """Label -> sentiment_label and the study's split columns (+ keys)."""
    if "sentiment_label" not in df.columns and "label" in df.columns:
        df = df.withColumnRenamed("label", "sentiment_label")
    extra = [c for c in ("split",) + KEYS if c in df.columns]
    return df.select(*[c for c in SPLIT_COLS if c != "review_text" or c in df.columns], *extra)


def sample_per_group(df: DataFrame, group: str = "source_platform", n_max: int = 5000,
                     seed: int = lx.RANDOM_STATE, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """min(n_max, total // 2) seeded-hash rows per group (a smaller group
    is kept whole). A null group is a group."""
    keyed = df.withColumn("_h", md5_key(*keys, seed=seed))
    ranked = hash_rank(keyed, [group], "_h", list(keys), out="_rk")
    # one row per group, total over all groups alongside (groups are few)
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")) \
        .withColumn("_total", F.sum("_n").over(Window.partitionBy()))
    return (with_group(ranked, sizes.select(group, "_total"), [group])
            .filter(F.col("_rk") <= F.least(F.lit(n_max), F.floor(F.col("_total") / 2)))
            .drop("_h", "_rk", "_total"))


def kfold_assign(df: DataFrame, strata: list[str], label: str = "sentiment_label",
                 k: int = lx.CV_FOLDS, seed: int = lx.RANDOM_STATE,
                 keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Stratified fold id = (hash rank - 1) mod k inside each class."""
    keyed = df.withColumn("_h", md5_key(*keys, seed=seed))
    ranked = hash_rank(keyed, list(strata) + [label], "_h", list(keys), out="_rk")
    return ranked.withColumn("fold", ((F.col("_rk") - 1) % k).cast("int")).drop("_h", "_rk")
