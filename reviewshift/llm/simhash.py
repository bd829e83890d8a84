"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two 32-bit segments. Two fingerprints that differ in at most two bits
differ in at most one bit in one of the segments, so a probe with the Hamming ball of radius one
around each segment value meets every partner in that segment's table; complete distances decide.

Equal fingerprints are one entry of the tables, whatever the number of their documents. A segment
value shared by more than ``bucket`` different fingerprints is not paired out: the fingerprints
that probe such a value are linked over the balls of radius one around the *whole* fingerprint
instead. Two fingerprints differ in at most two bits exactly if their balls meet, and at most 65
different fingerprints meet in one point, so that way is exact and linear at any bucket size.

Defined results: null and empty texts have fingerprint 0 and are linked like any other. Repeated
rows are rows of the result. Null ids take no part in the choice of a component's smallest id,
which is null where a component has null ids only. Columns beside id and text are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, columns_of, free_name, stage_table

SEGMENTS, SEGMENT_BITS, SEED = 2, 32, 42
CHUNK = 65_536  # hashes whose bits are counted at once


def fingerprint(text: str, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of ``text`` (A-Z lower-cased, ASCII white space)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1]
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, CHUNK):
        pairs = zip(starts[at:at + CHUNK].tolist(), ends[at + k - 1:at + k - 1 + CHUNK].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def add_fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3, out: str = "fp") -> DataFrame:
    """``docs`` plus the fingerprint as a signed long; no shuffle."""

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        prints = [fingerprint(t.as_py() or "", shingle) for t in b.column(0)]
        return {out: pa.array(np.array(prints, np.uint64).view(np.int64))}

    return append_columns(docs, run, {out: T.LongType()}, {"text": text_col})


def _flips(bits: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` of ``bits`` bits, as signed longs."""
    masks = [sum(1 << i for i in on) for r in range(radius + 1) for on in combinations(range(bits), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def link(prints: DataFrame, max_distance: int = 2, bucket: int = 64) -> DataFrame:
    """Links ``a``, ``b`` between the distinct fingerprints ``fp``: every pair within
    ``max_distance`` bits is linked, directly or (in hot buckets) over a shared neighbour that is
    itself within that distance of both."""
    if max_distance not in (0, 2):
        raise ValueError("max_distance must be 0 or 2")
    if max_distance == 0:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).filter("a <> b")
    radius = max_distance // SEGMENTS
    segments = prints.select("fp", F.posexplode(F.array(
        F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")),
        F.shiftrightunsigned("fp", SEGMENT_BITS))).alias("seg", "val"))
    entries = segments.groupBy("seg", "val").agg(F.count(F.lit(1)).alias("n"))
    # a pair one bit apart in the segment is met from the side on which that bit is off
    probes = (segments.select("fp", "seg", "val", F.explode(_longs(_flips(SEGMENT_BITS, radius))).alias("mask"))
              .filter(F.col("val").bitwiseAND(F.col("mask")) == 0)
              .select("fp", "seg", F.col("val").bitwiseOR(F.col("mask")).alias("val")))
    # the planner sizes an exploded table like the rows it comes from (probes has 33 a segment), and so would collect
    # it for a broadcast: these joins are merged by a hint
    sized = segments.join(entries.hint("merge"), ["seg", "val"])
    cold = sized.filter(F.col("n") <= bucket).select("seg", "val", F.col("fp").alias("other"))
    near = (probes.join(cold.hint("merge"), ["seg", "val"]).filter("fp <> other")
            .filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_distance)
            .select(F.greatest("fp", "other").alias("a"), F.least("fp", "other").alias("b")))
    hot = entries.filter(F.col("n") > bucket).select("seg", "val")
    probing_hot = probes.join(hot, ["seg", "val"], "left_semi").select("fp").distinct()
    met = (probing_hot.select("fp", F.explode(_longs(_flips(64, max_distance // 2))).alias("mask"))
           .groupBy(F.col("fp").bitwiseXOR(F.col("mask")).alias("point"))
           .agg(F.collect_list("fp").alias("fps"), F.min("fp").alias("b")))  # at most 65 fingerprints
    over = met.filter(F.size("fps") > 1).select(F.explode("fps").alias("a"), "b").filter("a <> b")
    return near.unionByName(over).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node of its component) for each node of the undirected
    ``links`` (a, b): large-star and small-star rounds until nothing changes. The driver sees a
    count and a checksum a round."""
    links = stage_table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "links")
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        links = stage_table(small, "links")
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(now)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_distance: int = 2, bucket: int = 64, keys: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: id, ``keys`` (further columns to carry), ``fp``, ``root`` (smallest
    fingerprint of the component) and ``component_id`` (smallest id of the component)."""
    names = list(keys or {})
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                         *[c.alias(n) for n, c in (keys or {}).items()])
    prints = stage_table(add_fingerprints(narrow, "text", shingle).drop("text"), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("id").alias("first_id"))
    joined = components(link(nodes.select("fp"), max_distance, bucket))
    rooted = (nodes.join(joined, nodes["fp"] == joined["node"], "left")
              .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    labels = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = rooted.select("fp", "root").join(labels, "root")
    # every fingerprint is met; a left join never collects the side with a row a document
    return prints.join(by_print, "fp", "left").select("id", *names, "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
             max_distance: int = 2) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id (nulls last), of
    rows that repeat it one. All columns stay as they are."""
    # keys without nulls: one shuffle of the texts serves both steps
    th, rid = free_name(docs, "_text_hash"), free_name(docs, "_row_id")
    written = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit(""))
    text_hash = F.xxhash64(F.col(text_col), F.length(text_col))
    found = near_duplicates(docs, id_col, text_col, shingle, max_distance, keys={th: text_hash})
    kept = (found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", th)).alias("k"))
            .select(F.col("k.id").alias("id"), F.col(f"k.{th}").alias(th)).select(written.alias(rid), th))
    own = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))
    once = docs.withColumn(rid, own).withColumn(th, text_hash).dropDuplicates([rid, th])
    return once.join(kept, [rid, th], "left_semi").select(*columns_of(docs))
