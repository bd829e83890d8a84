"""Deterministic hash ranks that stay distributed for hot groups.

A plain ``row_number() over (partition by label ...)`` puts a whole class
(possibly a third of all rows) into one task. ``hash_rank`` instead
ranks inside (group, hash bucket) — buckets are a hex prefix of the md5
order key, so each window partition holds about 1/16^k of its group —
and adds the sizes of all earlier buckets, taken from a small
(group, bucket) count table. The result equals the global
``row_number() over (partition by group order by md5, ties)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx


def md5_key(*cols, seed: int = lx.RANDOM_STATE) -> Column:
    """md5 hex of 'seed|c1|c2|...'; identical in Spark, DuckDB and Python."""
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                  for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def hash_rank(df: DataFrame, group_cols: list[str], key: str, ties: list[str],
              out: str = "rank", bucket_chars: int = 3) -> DataFrame:
    """1-based bigint rank of each row inside ``group_cols`` ordered by (key, ties).

    ``key`` is a hash in hex, so its first digits deal a group out evenly.
    Null group values are a group of their own.
    """
    return _bucketed_rank(df, group_cols, F.substring(F.col(key), 1, bucket_chars), [key, *ties], out)


def hash_cut(df: DataFrame, group_cols: list[str], key: str, ties: list[str], cuts: DataFrame, ends: list[str],
             out: str = "part", bucket_chars: int = 2) -> DataFrame:
    """How many of the ranks ``ends`` (columns of ``cuts``, a row a group, ascending) lie before a row's ``hash_rank``.

    The rows stay where they are: a bucket that no end cuts through decides for all its rows, so only the few buckets
    with an end inside (one an end and group) are sorted. ``df`` is read three times; it should be a stage output.
    """
    g = list(group_cols)
    keyed = df.withColumn("_bucket", F.substring(F.col(key), 1, bucket_chars))
    sizes = keyed.groupBy(*g, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*g).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    spans = with_group(sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))),
                       cuts.select(*g, *ends), g)
    passed = lambda rank: sum((F.when(rank > F.col(e), 1).otherwise(0) for e in ends), F.lit(0))
    inside = F.lit(False)
    for e in ends:
        inside = inside | ((F.col("_off") < F.col(e)) & (F.col(e) < F.col("_off") + F.col("_n")))
    spans = spans.select(*g, "_bucket", "_off", *ends, passed(F.col("_off") + 1).alias(out), inside.alias("_inside"))
    # groups x 16^bucket_chars rows
    rows = with_group(keyed, spans, g + ["_bucket"])
    local = Window.partitionBy(*g, "_bucket").orderBy(*[F.col(c) for c in (key, *ties)])
    sorted_ = (rows.filter("_inside").withColumn("_rank", F.row_number().over(local) + F.col("_off"))
               .withColumn(out, passed(F.col("_rank"))))
    cols = [*df.columns, out]
    return rows.filter(~F.col("_inside")).select(*cols).unionByName(sorted_.select(*cols))


def range_rank(df: DataFrame, group_cols: list[str], order: str, out: str = "rank",
               buckets: int = 64) -> DataFrame:
    """1-based bigint rank of each row inside ``group_cols`` ordered by the
    numeric column ``order`` (unique in a group).

    Buckets are ranges between approximate quantiles of ``order`` (the
    driver sees ``buckets`` numbers), so no task sorts a whole hot group.
    """
    cuts = sorted(set(df.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.25 / buckets)))
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(order))) if cuts else F.lit(0)
    return _bucketed_rank(df, group_cols, bucket, [order], out)


def with_group(df: DataFrame, sizes: DataFrame, group_cols: list[str]) -> DataFrame:
    """``df`` with the columns of ``sizes``, a table of one row a group (bounded by the groups of the study, so it is
    broadcast). Null group values are a group of their own."""
    named = sizes.select(*[F.col(c).alias(f"_g{group_cols.index(c)}") if c in group_cols else F.col(c)
                           for c in sizes.columns])
    on = F.lit(True)
    for i, c in enumerate(group_cols):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return df.join(F.broadcast(named), on).drop(*[f"_g{i}" for i in range(len(group_cols))])


def _bucketed_rank(df: DataFrame, group_cols: list[str], bucket: Column, order: list[str], out: str) -> DataFrame:
    """Rank inside (group, bucket) plus the sizes of the group's earlier buckets."""
    g = list(group_cols)
    b = df.withColumn("_bucket", bucket)
    local = Window.partitionBy(*g, "_bucket").orderBy(*[F.col(c) for c in order])
    b = b.withColumn("_local", F.row_number().over(local).cast("long"))
    sizes = b.groupBy(*g, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*g).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(g)], F.col("_bucket").alias("_gb"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    on = F.col("_bucket").eqNullSafe(F.col("_gb"))
    for i, c in enumerate(g):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return (b.join(offsets, on).withColumn(out, F.col("_off") + F.col("_local"))
            .drop("_bucket", "_local", "_off", "_gb", *[f"_g{i}" for i in range(len(g))]))


def top_k(df: DataFrame, group_cols: list[str], order: list[Column], k: int, spread: list[str],
          out: str = "rank", buckets: int = 32) -> DataFrame:
    """The first ``k`` rows of each group in ``order``, ranked from 1.

    Rows are dealt into ``buckets`` by a hash of ``spread``; each bucket's
    window keeps its own first k, so the window over a whole group sees at
    most ``buckets * k`` rows, whatever the group's size and whatever k
    (Spark's own partial limit stops at k = 1,000).
    """
    salt = F.pmod(F.xxhash64(*spread), F.lit(buckets))
    near = (df.withColumn("_salt", salt)
            .withColumn(out, F.row_number().over(Window.partitionBy(*group_cols, "_salt").orderBy(*order)))
            .filter(F.col(out) <= k).drop("_salt", out))
    return (near.withColumn(out, F.row_number().over(Window.partitionBy(*group_cols).orderBy(*order)))
            .filter(F.col(out) <= k))
