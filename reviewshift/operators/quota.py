"""Per-shop, per-rating collection quotas (the crawler's stopping rule)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..session import cut_lineage
from .ranking import top_k


def rating_quota(df: DataFrame, shop: str, rating: str, newest: str, tie: str,
                 quota: dict[int, int] = lx.RATING_QUOTA) -> DataFrame:
    """Per (shop, rating) the first quota[rating] rows, newest first.

    ``top_k`` ranks in hash buckets first, so no task sorts a hot shop's
    whole history; the per-rating bound is applied after.
    """
    qmap = F.create_map(*[F.lit(x) for kv in sorted(quota.items()) for x in kv])
    out = top_k(df, [shop, rating], [F.col(newest).desc(), F.col(tie)], max(quota.values()), [tie], out="k")
    return out.filter(F.col("k") <= F.try_element_at(qmap, F.col(rating)))


def quota_fill(collected: DataFrame, shop: str, rating: str,
               quota: dict[int, int] = lx.RATING_QUOTA) -> DataFrame:
    """Collected / quota for every shop and every quota rating (0 when
    nothing was collected). The rating grid is exploded per shop, no join
    between shops and ratings."""
    counts = collected.groupBy(shop, rating).agg(F.count(F.lit(1)).alias("collected"))
    qmap = F.create_map(*[F.lit(x) for kv in sorted(quota.items()) for x in kv])
    grid = collected.select(shop).distinct().select(
        shop, F.explode(F.array(*[F.lit(r) for r in quota])).alias(rating))
    j = grid.join(counts, [shop, rating], "left")
    q = F.try_element_at(qmap, F.col(rating))
    return j.select(shop, rating, F.coalesce("collected", F.lit(0)).alias("collected"), q.alias("quota"),
                    F.round(F.coalesce("collected", F.lit(0)) / q, 6).alias("fill"))


def running_total(fill: DataFrame, shop: str, rating: str,
                  quota: dict[int, int] = lx.RATING_QUOTA) -> DataFrame:
    """Cumulative rows collected in crawl order (shops in order, ratings
    in quota order). Totals run inside ranges of shops, and each range adds
    the sum of the ranges before it, so no task sorts all shops. The window
    without partitions is over one row a range."""
    place = F.create_map(*[F.lit(x) for i, r in enumerate(quota) for x in (r, i)])
    placed = fill.withColumn("_place", F.try_element_at(place, F.col(rating)))
    # written, so that a range keeps its number whoever reads it
    ranges = cut_lineage(placed.repartitionByRange(F.col(shop), F.col("_place"))
                         .withColumn("_range", F.spark_partition_id()), "shop-ranges", spread_out=False)
    inside = Window.partitionBy("_range").orderBy(shop, "_place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy("_range").agg(F.sum("collected").alias("_sum")) \
        .select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    return (ranges.withColumn("running_total", F.sum("collected").over(inside)).join(offsets, "_range")
            .withColumn("running_total", F.col("running_total") + F.col("_before"))
            .drop("_range", "_place", "_before"))
