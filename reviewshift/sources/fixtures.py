"""Driver tables -> the review data model.

The decorated ``reviews`` view turns ``documents`` into reviews that hit
every cleaning branch (URLs, hashtags, emoji, digits-only, slang). It is
deterministic: doc_id drives every decoration, and no row is dropped.
Whole texts are used (no prefix cut).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _decorate(doc_id, text):
    d = F.col(doc_id)
    add = lambda m, s: F.when(d % m == 0, F.lit(s)).otherwise(F.lit(""))
    body = F.concat(add(7, "brg dtg cpt bgt wkwk "), F.col(text),
                    add(11, " cek https://toko.example/p?id=1 ya"),
                    add(13, " @admin #promo_2024 mantaaap!!"),
                    add(17, " kecewa, barang rusak"),
                    add(19, " ❤ j&t ok"))
    return (F.when(d % 41 == 0, F.lit("12345"))
            .when(d % 43 == 0, F.lit("oke"))
            .otherwise(body))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """review_id, review_text, rating, product_name, reviewer_name, source_platform."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    return docs.select(
        F.col("doc_id").alias("review_id"),
        _decorate("doc_id", "text").alias("review_text"),
        (F.col("doc_id") % 5 + 1).cast("int").alias("rating"),
        F.col("source").alias("product_name"),
        F.concat(F.lit("user_"), (F.col("doc_id") % 97).cast("string")).alias("reviewer_name"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("tokopedia")).otherwise(F.lit("shopee"))
        .alias("source_platform"),
    )


def platform_order(platform_col="source_platform"):
    """Concat order of the platforms: tokopedia first, then shopee."""
    return F.when(F.col(platform_col) == "tokopedia", F.lit(0)).otherwise(F.lit(1))


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decorated reviews in the RAW schema plus the 'first' order keys."""
    r = reviews(spark, sf_dir)
    return r.select(
        "review_text", "rating", "product_name",
        F.lit("unknown").alias("review_date"),
        "reviewer_name", "source_platform",
        platform_order().alias("source_seq"),
        F.col("review_id").alias("row_seq"),
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a 3-class truth from ``labels``: toxic -> Negatif,
    quality 0 -> Netral, quality 1 -> Positif; platform = doc_id parity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels")
    j = docs.join(lab, "doc_id")
    return j.select(
        "doc_id", "text",
        F.when(F.col("toxic") == 1, "Negatif").when(F.col("quality") == 0, "Netral")
        .otherwise("Positif").alias("sentiment_label"),
        F.when(F.col("doc_id") % 2 == 0, "tokopedia").otherwise("shopee").alias("source_platform"),
    )


# Same view for the DuckDB oracle (whole texts).
REVIEWS_SQL = """
SELECT doc_id AS review_id,
       CASE WHEN doc_id % 41 = 0 THEN '12345'
            WHEN doc_id % 43 = 0 THEN 'oke'
            ELSE concat(
              CASE WHEN doc_id % 7 = 0 THEN 'brg dtg cpt bgt wkwk ' ELSE '' END,
              text,
              CASE WHEN doc_id % 11 = 0 THEN ' cek https://toko.example/p?id=1 ya' ELSE '' END,
              CASE WHEN doc_id % 13 = 0 THEN ' @admin #promo_2024 mantaaap!!' ELSE '' END,
              CASE WHEN doc_id % 17 = 0 THEN ' kecewa, barang rusak' ELSE '' END,
              CASE WHEN doc_id % 19 = 0 THEN ' ❤ j&t ok' ELSE '' END)
       END AS review_text,
       CAST(doc_id % 5 + 1 AS INTEGER) AS rating,
       source AS product_name,
       concat('user_', CAST(doc_id % 97 AS VARCHAR)) AS reviewer_name,
       CASE WHEN doc_id % 2 = 0 THEN 'tokopedia' ELSE 'shopee' END AS source_platform
FROM documents
"""

RAW_SQL = """
SELECT review_text, rating, product_name, 'unknown' AS review_date, reviewer_name,
       source_platform,
       CASE WHEN source_platform = 'tokopedia' THEN 0 ELSE 1 END AS source_seq,
       review_id AS row_seq
FROM reviews
"""

LABELLED_SQL = """
SELECT d.doc_id, d.text,
       CASE WHEN l.toxic = 1 THEN 'Negatif' WHEN l.quality = 0 THEN 'Netral'
            ELSE 'Positif' END AS sentiment_label,
       CASE WHEN d.doc_id % 2 = 0 THEN 'tokopedia' ELSE 'shopee' END AS source_platform
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""


# --- landed review pages (JSON) and shop pages (HTML) built from the tables ---------

def landed_pages(spark: SparkSession, sf_dir: str, page_size: int = 50) -> DataFrame:
    """Review pages as a crawler lands them: one record per (shop, requested
    rating, page) with the nested response; shop = product_name. Some items
    lack a product / rating / reviewer, some pages have no data envelope."""
    from ..operators.ranking import range_rank
    rk = range_rank(reviews(spark, sf_dir), ["product_name", "rating"], "review_id", out="rk")
    rk = rk.withColumn("page", ((F.col("rk") - 1) / page_size).cast("long") + 1)
    rid = F.col("review_id")
    item = F.struct(
        rid.cast("string").alias("id"),
        F.when(rid % 5 == 0, None).otherwise(F.struct(
            F.concat(F.lit("p"), (rid % 50).cast("string")).alias("productID"),
            F.col("product_name").alias("productName"),
            F.concat(F.lit("https://shop.example/"), F.col("product_name")).alias("productPageURL"))).alias("product"),
        F.when(rid % 4 == 0, None).otherwise(F.col("rating")).alias("rating"),
        F.concat(F.lit("2024-01-"), F.lpad((rid % 28 + 1).cast("string"), 2, "0")).alias("reviewTime"),
        F.col("review_text").alias("reviewText"),
        F.concat(F.lit("r"), rid.cast("string")).alias("reviewerID"),
        F.when(rid % 3 == 0, None).otherwise(F.col("reviewer_name")).alias("reviewerName"))
    # a page holds at most page_size items
    pages = rk.groupBy(F.col("product_name").alias("shop"), F.col("rating").alias("requested_rating"), "page") \
        .agg(F.array_sort(F.collect_list(F.struct(rid.alias("o"), item.alias("it")))).alias("_l"))
    last = pages.groupBy("shop", "requested_rating").agg(F.max("page").alias("_last"),
                                                         F.sum(F.size("_l")).alias("_tot"))
    pages = pages.join(last, ["shop", "requested_rating"])
    body = F.struct(F.transform("_l", lambda x: x["it"]).alias("list"),
                    (F.col("page") < F.col("_last")).alias("hasNext"), F.col("shop").alias("shopName"),
                    F.col("_tot").cast("long").alias("totalReviews"))
    data = F.when((F.col("page") + F.col("requested_rating")) % 7 == 3, None) \
        .otherwise(F.struct(body.alias("productrevGetShopReviewReadingList")))
    return pages.select("shop", "requested_rating", "page", F.struct(data.alias("data")).alias("response"))


def shop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` with shop ids embedded in the three forms a shop page uses."""
    p = table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    add = (F.when(pid % 3 == 0, F.concat(F.lit('<script>{"shopID":"'), (pid * 7 + 100).cast("string"),
                                         F.lit('"}</script>')))
           .when(pid % 3 == 1, F.concat(F.lit('<script>ShopPageGetHeaderLayout({\\"shopID\\":\\"'),
                                        (pid + 5000).cast("string"), F.lit('\\"})</script>')))
           .otherwise(F.lit("")))
    add2 = F.when(pid % 5 == 2, F.concat(F.lit(" productrevGetShopReviewReadingList(shopID: 9"),
                                         pid.cast("string"), F.lit(")"))).otherwise(F.lit(""))
    return p.select("page_id", "url", F.concat(F.col("html"), add, add2).alias("html"))


SHOP_PAGES_SQL = """
SELECT page_id, url, concat(html,
  CASE WHEN page_id % 3 = 0 THEN concat('<script>{"shopID":"', CAST(page_id * 7 + 100 AS VARCHAR), '"}</script>')
       WHEN page_id % 3 = 1 THEN concat('<script>ShopPageGetHeaderLayout({\\"shopID\\":\\"',
                                        CAST(page_id + 5000 AS VARCHAR), '\\"})</script>')
       ELSE '' END,
  CASE WHEN page_id % 5 = 2 THEN concat(' productrevGetShopReviewReadingList(shopID: 9', CAST(page_id AS VARCHAR), ')')
       ELSE '' END) AS html
FROM pages"""


def appstore_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """App-store shaped rows: content, score, at (some unparsable), userName."""
    d = table(spark, sf_dir, "documents")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "ts", "user_id")
    j = d.join(e, "doc_id", "left")
    return j.select(F.col("text").alias("content"), (F.col("doc_id") % 5 + 1).cast("int").alias("score"),
                    F.when(F.col("doc_id") % 9 == 0, F.lit("not a date"))
                    .otherwise(F.col("ts").cast("string")).alias("at"),
                    F.when(F.col("doc_id") % 13 == 0, None)
                    .otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("userName"),
                    F.col("doc_id").alias("row_seq"))


def cod_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """App-store shaped rows of a second data set, with dates in words."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("text").alias("content"), (F.col("item_id") % 5 + 1).cast("int").alias("score"),
                    F.concat((F.col("item_id") % 28 + 1).cast("string"), F.lit(" Jan 2024")).alias("at"),
                    F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("userName"),
                    F.col("item_id").alias("row_seq"))


def binary_label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left").select(F.col("text").alias("reviews"),
                                                F.col("quality").cast("double").alias("label"),
                                                F.col("doc_id").alias("row_seq"))


def product_review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("text").alias("comment"), (F.col("turn") % 5 + 1).cast("int").alias("rating"),
                    F.when(F.col("role") == "user", F.concat(F.lit("c"), F.col("conv_id").cast("string")))
                    .alias("username"),
                    (F.col("conv_id") * (1 << 32) + F.col("turn")).alias("row_seq"))
