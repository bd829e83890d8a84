"""Sharding by a hierarchical weighted hash tree, in DataFrame functions.

A document descends three levels: region, rack, shard. On each level every child draws
-ln(u) / weight, u being uniform from a hash of the document's id and the child's path, and the
least draw takes the document. A child's weight is the sum of the shards' weights below it. When
weights change, draws change for the subtrees on the changed paths alone, so rows move only into
or out of those.

``grown`` adds a shard as a region of its own: the draws of all older children stay as they are,
so the new shard takes rows only into itself (law ``key``: id and shard count decide).

Slots number the rows of a shard from 0 without gaps. They are counted in hash buckets with
offsets, so no task sorts a whole shard.

Defined results: null ids are one key like any other. Rows that repeat an id go to the same shard
and get slots of their own. An empty table gives no rows. Columns beside id and text are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

RACKS, SHARDS_PER_RACK, REGIONS = 2, 5, 4  # 4 x 2 x 5 = 40 shards
SLOT_BUCKETS = 64


@dataclass(frozen=True)
class Tree:
    """Weights of the shards: regions of racks of shards. Shards are numbered in this order."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    def grown(self, weight: float = 1.0) -> Tree:
        return Tree((*self.regions, ((weight,),)))

    @property
    def n_shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)


def tree(n_shards: int) -> Tree:
    """The base tree of 40 shards, grown to ``n_shards``. Fewer shards need a tree of their own (``shape`` of
    ``assign``): a smaller one that grew into the base would move rows between its old shards."""
    out = Tree((((1.0,) * SHARDS_PER_RACK,) * RACKS,) * REGIONS)
    if n_shards < out.n_shards:
        raise ValueError(f"give a tree for fewer than {out.n_shards} shards")
    while out.n_shards < n_shards:
        out = out.grown()
    return out


def _draw(key: Column, path: str, parent: Column | None, child: int) -> Column:
    """-ln(u) of one child: the 52 high bits of a hash, as a number above 0 and below 1."""
    parts = [key, F.lit(path), F.lit(child)] + ([] if parent is None else [parent])
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 12)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 52))


def _least(draws: list[tuple[Column, Column, int]]) -> Column:
    """The child of the least draw / weight; a null weight has no child."""
    return F.array_min(F.array(*[F.when(w.isNotNull(), F.struct((d / w).alias("d"), F.lit(k).alias("k")))
                                 for d, w, k in draws]))["k"]


def _by(parent: Column, values: dict[int, float | int | None], kind: str) -> Column:
    """The value for the chosen ``parent``, from a literal array."""
    return F.get(F.array(*[F.lit(values.get(i)).cast(kind) for i in range(max(values) + 1)]), parent)


def with_shard(df: DataFrame, key: Column, shape: Tree, out: str) -> DataFrame:
    """``df`` plus the number of the shard of each row."""
    racks = [r for region in shape.regions for r in region]
    region, rack = f"{out}_region", f"{out}_rack"
    weights = [sum(map(sum, r)) for r in shape.regions]
    df = df.withColumn(region, _least([(_draw(key, "region", None, k), F.lit(w), k) for k, w in enumerate(weights)]))
    widest = max(map(len, shape.regions))
    at = [{i: sum(r[k]) if k < len(r) else None for i, r in enumerate(shape.regions)} for k in range(widest)]
    df = df.withColumn(rack, _least([(_draw(key, "rack", F.col(region), k), _by(F.col(region), at[k], "double"), k)
                                     for k in range(widest)]))
    first_rack = {i: sum(map(len, shape.regions[:i])) for i in range(len(shape.regions))}
    number = _by(F.col(region), first_rack, "int") + F.col(rack)
    df = df.withColumn(rack, number)
    widest = max(map(len, racks))
    at = [{i: r[k] if k < len(r) else None for i, r in enumerate(racks)} for k in range(widest)]
    first = {i: sum(map(len, racks[:i])) for i in range(len(racks))}
    leaf = _least([(_draw(key, "shard", F.col(rack), k), _by(F.col(rack), at[k], "double"), k) for k in range(widest)])
    return df.withColumn(out, (_by(F.col(rack), first, "int") + leaf).cast("int"))


def with_slot(df: DataFrame, group: str, order: list[str], out: str = "slot") -> DataFrame:
    """``df`` plus a number from 0 without gaps in each ``group``; ``df`` is a stage table."""
    bucket = F.pmod(F.xxhash64(*order), F.lit(SLOT_BUCKETS))
    df = df.withColumn("_bucket", bucket)
    sizes = df.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, "_bucket").orderBy(*order)
    return (df.withColumn("_at", F.row_number().over(inside).cast("long")).join(offsets, [group, "_bucket"])
            .withColumn(out, F.col("_at") - 1 + F.col("_offset")).drop("_bucket", "_at", "_offset"))


def assign(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text",
           shape: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard (with one more shard) of each row. ``shape`` is a tree of at
    most ``n_shards`` shards, which is grown to that number; without one it is the base tree."""
    shape = shape or tree(n_shards)
    while shape.n_shards < n_shards:
        shape = shape.grown()
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    placed = with_shard(with_shard(narrow, key, shape, "shard"), key, shape.grown(), "grown_shard")
    # rows alike in all columns spread over the buckets by the task that read them
    rows = stage_table(placed.select("doc_id", "size", "text_crc32", "shard", "grown_shard",
                                     F.spark_partition_id().alias("part")), "sharded")
    return with_slot(rows, "shard", ["doc_id", "text_crc32", "part"]).drop("part")


def expected_share(shape: Tree) -> list[float]:
    """Share of the rows of each shard."""
    flat = [w for region in shape.regions for rack in region for w in rack]
    return [w / math.fsum(flat) for w in flat]
