"""Conforming, filtering, dedup, labelling and rebalancing of raw reviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import label as lb
from ..functions import lexicon as lx
from ..functions import text as tx
from .ranking import hash_cut, md5_key

ORDER_COLS = ("source_seq", "row_seq")


# --- C1..C5, P3 -----------------------------------------------------------------

def null_na_tokens(df: DataFrame, cols=None, tokens=lx.NA_TOKENS) -> DataFrame:
    """Text fields a pandas reader treats as missing -> null."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    toks = list(tokens)
    return df.select(*[F.when(F.col(c).isin(toks), None).otherwise(F.col(c)).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def conform_schema(df: DataFrame, defaults: dict = lx.COLUMN_DEFAULTS,
                   keep: tuple[str, ...] = ORDER_COLS) -> DataFrame:
    """Add missing required columns with their default, drop extras, fixed order."""
    cols = []
    for c, d in defaults.items():
        cols.append(F.col(c) if c in df.columns else F.lit(d).alias(c))
    cols += [F.col(k) for k in keep if k in df.columns]
    return df.select(*cols)


def fill_defaults(df: DataFrame, defaults: dict = lx.COLUMN_DEFAULTS) -> DataFrame:
    """Null -> per-column default."""
    kind = dict(df.dtypes)
    return df.select(*[F.coalesce(F.col(c), F.lit(defaults[c]).cast(kind[c])).alias(c) if c in defaults
                       else F.col(c) for c in df.columns])


def missing_report(df: DataFrame, cols=lx.REQUIRED_COLUMNS) -> DataFrame:
    """Null count per column, one pass, long form (column, n_missing)."""
    present = [c for c in cols if c in df.columns]
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in present])
    stack = ", ".join(f"'{c}', `{c}`" for c in present)
    return agg.selectExpr(f"stack({len(present)}, {stack}) as (column_name, n_missing)")


def conform_platform(df: DataFrame, platform: str | None = None,
                     defaults: dict = lx.COLUMN_DEFAULTS) -> DataFrame:
    """C1+C2+C4+C5+P3: the per-file conforming step of the study."""
    # the rating first: '4.0', 'abc' and nulls become numbers before defaults are filled in
    df = conform_schema(df, defaults).withColumn("rating", lb.coerce_rating("rating"))
    df = fill_defaults(df, defaults)
    if platform is not None:
        df = df.withColumn("source_platform", F.lit(platform))
    return df.filter(~tx.is_blank("review_text"))


def union_platforms(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL of the platform frames (caller passes non-empty ones)."""
    if not frames:
        raise ValueError("no platform data to merge")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# --- P4, P5, P8 -------------------------------------------------------------------

def min_length_ok(text="review_text", n: int = lx.MIN_TEXT_LENGTH):
    return F.length(tx.strip(text)) >= n


def neutral_noise(rating="rating", text="review_text",
                  min_chars: int = lx.NEUTRAL_MIN_CHARS,
                  fillers: tuple[str, ...] = lx.NEUTRAL_FILLERS):
    """P5 predicate: 3-star review that is short or only a filler word."""
    r = F.col(rating) == 3
    short = F.length(tx.strip(text)) < min_chars
    filler = tx.strip(F.lower(F.col(text))).isin(list(fillers))
    return r & (short | filler)


def filter_noise(df: DataFrame, mode: str = "multi") -> DataFrame:
    """P4 (+ P5 in multi mode)."""
    df = df.filter(min_length_ok())
    if mode == "multi":
        df = df.filter(~neutral_noise())
    return df


# --- D1 ---------------------------------------------------------------------------

def dedup_first(df: DataFrame, key: str = "review_text",
                order: tuple[str, ...] = ORDER_COLS) -> DataFrame:
    """Exact duplicates of ``key``: keep the first row in concat order.

    ``min(struct(order..., rest...))`` is combined map-side (a sort
    aggregate, as the struct is not of fixed width), so a text repeated in a third of all rows shrinks to one
    row per map task before the shuffle (a row_number window would sort
    the whole hot group in one task).
    """
    rest = [c for c in df.columns if c != key and c not in order]
    first = df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_f"))
    return first.select(F.col(key), *[F.col(f"_f.{c}").alias(c) for c in list(order) + rest]) \
        .select(*df.columns)


# --- M1 -----------------------------------------------------------------------

def with_label(df: DataFrame, out: str = "label") -> DataFrame:
    return df.withColumn(out, lb.auto_label("rating", "review_text"))


# --- A2, W2 -----------------------------------------------------------------------

def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_median_target(df: DataFrame, label: str = "label") -> DataFrame:
    """A2: int(median of the class counts) as a one-row table ``target``."""
    return class_counts(df, label).agg(F.percentile("n", 0.5).cast("long").alias("target"))


def downsample_to_median(df: DataFrame, label: str = "label",
                         seed: int = lx.RANDOM_STATE) -> DataFrame:
    """Classes above the median size keep a seeded hash sample of that size. Rows without a
    label are a class of their own."""
    keyed = df.withColumn("_h", md5_key(*ORDER_COLS, seed=seed))
    # one row per class (3 rows): the median over them rides along each row
    counts = class_counts(df, label).withColumn(
        "target", F.percentile("n", 0.5).over(Window.partitionBy()).cast("long"))
    part = hash_cut(keyed, [label], "_h", list(ORDER_COLS), counts, ["target"], out="_part")
    return part.filter(F.col("_part") == 0).drop("_h", "_part")


# --- A1, P8, M4 -----------------------------------------------------------------

def dataset_stats(df: DataFrame) -> DataFrame:
    """A1: counts by rating, by label, by platform and the total, one pass
    (GROUPING SETS -> a single Expand + partial/final hash aggregate)."""
    src = df.select(F.col("rating").cast("string").alias("rating"), "label", "source_platform")
    agg = (src.groupingSets([["rating"], ["label"], ["source_platform"], []],
                            "rating", "label", "source_platform")
           .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid")))
    return agg.select(
        F.when(F.col("gid") == 3, "rating").when(F.col("gid") == 5, "label")
        .when(F.col("gid") == 6, "source_platform").otherwise("total").alias("dimension"),
        F.coalesce("rating", "label", "source_platform", F.lit("all")).alias("value"),
        "n")


def filter_report(df: DataFrame, mode: str = "multi") -> DataFrame:
    """Rows removed by each filter step, one aggregation pass."""
    short = ~min_length_ok()
    noise = min_length_ok() & neutral_noise() if mode == "multi" else F.lit(False)
    return df.agg(F.count(F.lit(1)).alias("rows_in"),
                  F.count_if(short).alias("dropped_short"),
                  F.count_if(noise).alias("dropped_neutral_noise"),
                  F.count_if(~short & ~noise).alias("rows_out"))


def label_override_rate(df: DataFrame) -> DataFrame:
    """M4: share of 3..5-star rows relabelled Negatif, per platform and rating."""
    # the keyword label is projected once (two aggregates read it)
    neg = (lb.auto_label("rating", "review_text") == "Negatif").alias("_neg")
    return (df.filter(F.col("rating") >= 3).select("source_platform", "rating", neg)
            .groupBy("source_platform", "rating")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.count_if("_neg").alias("n_overridden"),
                 F.round(F.avg(F.col("_neg").cast("double")), 6).alias("override_rate")))
