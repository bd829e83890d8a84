"""Landed review pages (nested JSON) and shop pages (HTML, URLs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as lx
from ..functions import text as tx

ITEM = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("product", T.StructType([
        T.StructField("productID", T.StringType()), T.StructField("productName", T.StringType()),
        T.StructField("productPageURL", T.StringType())])),
    T.StructField("rating", T.IntegerType()),
    T.StructField("reviewTime", T.StringType()),
    T.StructField("reviewText", T.StringType()),
    T.StructField("reviewerID", T.StringType()),
    T.StructField("reviewerName", T.StringType()),
])
READING_LIST = T.StructType([
    T.StructField("list", T.ArrayType(ITEM)), T.StructField("hasNext", T.BooleanType()),
    T.StructField("shopName", T.StringType()), T.StructField("totalReviews", T.LongType()),
])
RESPONSE = T.StructType([
    T.StructField("data", T.StructType([T.StructField("productrevGetShopReviewReadingList", READING_LIST)])),
])
# a landed page: the request parameters plus the response body
LANDED = T.StructType([
    T.StructField("shop", T.StringType()), T.StructField("requested_rating", T.IntegerType()),
    T.StructField("page", T.LongType()), T.StructField("response", RESPONSE),
])


def flatten_review_pages(pages: DataFrame, platform: str = "tokopedia") -> DataFrame:
    """Landed pages -> RAW rows.

    A page whose envelope lacks data.productrevGetShopReviewReadingList
    yields nothing; every string is stripped; a missing product gives
    empty names; a missing item rating falls back to the requested one;
    rows failing P1 are dropped. Keys: shop, page, item position.
    """
    body = F.col("response.data.productrevGetShopReviewReadingList")
    valid = pages.filter(body.isNotNull())
    items = valid.select("shop", "requested_rating", "page",
                         F.posexplode_outer(body["list"]).alias("pos", "it")).filter(F.col("it").isNotNull())
    s = lambda c: tx.strip(F.coalesce(c, F.lit("")))
    rows = items.select(
        s(F.col("it.reviewText")).alias("review_text"),
        F.coalesce(F.col("it.rating"), F.col("requested_rating")).alias("rating"),
        s(F.col("it.product.productName")).alias("product_name"),
        s(F.col("it.reviewTime")).alias("review_date"),
        s(F.col("it.reviewerName")).alias("reviewer_name"),
        F.lit(platform).alias("source_platform"),
        "shop", "page", "pos")
    return rows.filter(tx.is_valid_review("review_text"))


ENVELOPE = "$.response.data.productrevGetShopReviewReadingList"
PARSED = T.StructType([
    T.StructField("review_text", T.StringType()), T.StructField("rating", T.IntegerType()),
    T.StructField("product_name", T.StringType()), T.StructField("review_date", T.StringType()),
    T.StructField("reviewer_name", T.StringType()), T.StructField("source_platform", T.StringType()),
    T.StructField("shop", T.StringType()), T.StructField("requested_rating", T.IntegerType()),
    T.StructField("page", T.LongType()), T.StructField("pos", T.IntegerType()),
    T.StructField("reason", T.StringType()), T.StructField("raw", T.StringType()),
])


def parse_pages(lines: DataFrame, platform: str = "tokopedia", line: str = "value") -> DataFrame:
    """Landed pages as JSON lines -> PARSED: a row for each item of a page that fits (``reason`` null), and one for
    each page or item that does not, with the reason and its own text (``raw``). A page without items gives no row.

    Lines are parsed once into VARIANT, so a page of any shape is read, and a field of an unexpected type is null in
    its row alone. Reasons: ``not JSON``, ``no envelope``, ``no list``, and for an item ``not an object``.
    """
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    parsed = lines.filter(F.trim(line) != "").select(F.col(line).alias("raw"), F.try_parse_json(line).alias("v"))
    envelope = get(F.col("v"), ENVELOPE, "map<string,variant>")
    pages = parsed.select(
        "raw", get(F.col("v"), "$.shop", "string").alias("shop"),
        get(F.col("v"), "$.requested_rating", "int").alias("requested_rating"),
        get(F.col("v"), "$.page", "bigint").alias("page"),
        get(F.col("v"), ENVELOPE + ".list", "array<variant>").alias("_items"),
        F.when(F.col("v").isNull(), "not JSON").when(envelope.isNull(), "no envelope").alias("_why"))
    pages = pages.withColumn("_why", F.when(F.col("_why").isNull() & F.col("_items").isNull(), "no list").otherwise(F.col("_why")))
    # a page that does not fit is one entry without an item
    entry = "array<struct<pos:int,it:variant>>"
    entries = F.when(F.col("_why").isNotNull(), F.array(F.struct(F.lit(None), F.lit(None))).cast(entry)).otherwise(
        F.transform("_items", lambda it, i: F.struct(i.alias("pos"), it.alias("it"))).cast(entry))
    rows = pages.withColumn("_e", F.explode(entries)).select("*", F.col("_e.pos").alias("pos"), F.col("_e.it").alias("it"))
    rows = rows.withColumn("reason", F.coalesce("_why", F.when(get(F.col("it"), "$", "map<string,variant>").isNull(),
                                                               "not an object")))
    own = lambda path, kind="string": F.when(F.col("reason").isNull(), get(F.col("it"), path, kind))
    s = lambda path: F.when(F.col("reason").isNull(), tx.strip(F.coalesce(own(path), F.lit(""))))
    return rows.select(
        s("$.reviewText").alias("review_text"),
        F.when(F.col("reason").isNull(), F.coalesce(own("$.rating", "int"), F.col("requested_rating"))).alias("rating"),
        s("$.product.productName").alias("product_name"), s("$.reviewTime").alias("review_date"),
        s("$.reviewerName").alias("reviewer_name"), F.lit(platform).alias("source_platform"),
        "shop", "requested_rating", "page", "pos", "reason",
        F.when(F.col("reason").isNotNull(), F.coalesce(F.to_json("it"), F.col("raw"))).alias("raw"))


def reviews_of(parsed: DataFrame) -> DataFrame:
    """The RAW rows of parsed pages that pass P1."""
    return (parsed.filter(F.col("reason").isNull()).drop("reason", "raw", "requested_rating")
            .filter(tx.is_valid_review("review_text")))


def quarantined(parsed: DataFrame) -> DataFrame:
    """shop, requested_rating, page, pos (of an item; null for a page), reason, raw."""
    return parsed.filter(F.col("reason").isNotNull()).select("shop", "requested_rating", "page", "pos", "reason", "raw")


def _python_dot(pattern: str) -> str:
    """Python's ``.`` (anything but newline) spelled for Java regex / RE2."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            out.append(pattern[i:i + 2])
            i += 2
            continue
        out.append("[^\\n]" if ch == "." else ch)
        i += 1
    return "".join(out)


PATTERNS = tuple(_python_dot(p) for p in lx.SHOP_ID_PATTERNS)


def extract_id_from_html(html, patterns: tuple[str, ...] = PATTERNS) -> Column:
    """Group 1 of the first pattern (in order) that matches, else null."""
    h = F.col(html) if isinstance(html, str) else html
    return F.coalesce(*[F.nullif(F.regexp_extract(h, p, 1), F.lit("")) for p in patterns])


def shop_name_from_url(url) -> Column:
    """Strip trailing '/', split on '/', second-to-last piece (null if none)."""
    u = F.col(url) if isinstance(url, str) else url
    return F.try_element_at(F.split(F.regexp_replace(u, "/+$", ""), "/"), F.lit(-2))
