"""Registered queries: sources, sinks, adapters, landed pages, quotas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..operators import quota
from ..sources import adapters as ad
from ..sources import csv_io as io
from ..sources import fixtures as fx
from ..sources import pages as pg
from . import experiment as ex
from . import sqlgen as sg
from .registry import register

W = sg.with_
RAW_COLS = list(lx.REQUIRED_COLUMNS)


# --- S1, S6, S11, S12, S13, S2, S14, S15 ---------------------------------------------
def _csv_roundtrip(spark, sf):
    """Files of both platforms with ratings as a pandas writer or a scraper leaves them."""
    n, stars = F.col("row_seq"), F.col("rating").cast("string")
    raw = fx.raw_reviews(spark, sf).withColumn("rating", F.when(n % 6 == 0, F.concat(stars, F.lit(".0")))
                                               .when(n % 7 == 0, "abc").when(n % 11 == 0, None).otherwise(stars))
    frames = []
    for seq, platform in enumerate(("tokopedia", "shopee")):
        rows = raw.filter(F.col("source_platform") == platform).select(*RAW_COLS)
        path = io.write_csv(rows, io.scratch_path(spark, "reviews-csv"))
        frames.append(io.read_reviews_csv(spark, path, platform, seq))
    return io.curate.union_platforms(frames).select(*RAW_COLS)


register("read_reviews_csv", W(sg.reviews_ctes(), f"""
SELECT review_text, CASE WHEN review_id % 6 <> 0 AND (review_id % 7 = 0 OR review_id % 11 = 0) THEN 3 ELSE rating END
       AS rating, product_name, 'unknown' AS review_date, reviewer_name, source_platform
FROM reviews WHERE {sg.strip('review_text')} <> ''"""))(_csv_roundtrip)


def _latin1(spark, sf):
    rows = ad.adapt_appstore(fx.appstore_rows(spark, sf))
    path = io.write_csv(rows, io.scratch_path(spark, "latin1-csv"), encoding="ISO-8859-1")
    return io.read_csv(spark, path, encoding="ISO-8859-1", fallback=None)


def _lines(spark, sf):
    urls = fx.table(spark, sf, "pages").select(F.col("url").alias("value"))
    header = spark.range(1).select(F.lit("# shop list").alias("value"))
    blank = spark.range(1).select(F.lit("   ").alias("value"))
    path = io.scratch_path(spark, "lines")
    header.unionByName(blank).unionByName(urls.select(F.concat(F.lit("  "), "value", F.lit("/ ")).alias("value"))) \
        .write.text(path)
    return io.read_line_list(spark, path).select(F.col("line").alias("url"))


register("read_line_list", f"SELECT concat(url, '/') AS url FROM pages WHERE {sg.strip('url')} <> ''")(_lines)


def _csv_sink(spark, sf):
    m = ex.master(spark, sf)
    path = io.write_csv(m.select(*RAW_COLS, "label"), io.scratch_path(spark, "master-csv"))
    return io.read_csv(spark, path).groupBy("source_platform", "label").agg(F.count(F.lit(1)).alias("n"))


register("write_csv_sink", W(sg.master_ctes(), "SELECT source_platform, label, count(*) AS n FROM master GROUP BY ALL"))(
    _csv_sink)


def _splits_written(spark, sf):
    path = io.write_splits(ex.experiment_splits(spark, sf), io.scratch_path(spark, "splits"))
    return spark, path


register("write_splits", W(sg.experiment_ctes(), """
SELECT source_platform, condition, split, count(*) AS n FROM splits GROUP BY ALL"""))(
    lambda spark, sf: (lambda sp: sp[0].read.parquet(sp[1]).groupBy("source_platform", "condition", "split")
                       .agg(F.count(F.lit(1)).alias("n")))(_splits_written(spark, sf)))

register("read_split", W(sg.experiment_ctes(), f"""
SELECT row_seq AS review_id, review_text_clean, {sg.LABEL_ID} AS label_id FROM splits
WHERE source_platform = 'shopee' AND condition = 'proposed' AND split = 'test'"""))(
    lambda spark, sf: (lambda sp: io.read_split(sp[0], sp[1], "shopee", "proposed", "test")
                       .select(F.col("row_seq").alias("review_id"), "review_text_clean", "label_id"))(
        _splits_written(spark, sf)))


def _appended(spark, sf):
    path, rows = io.scratch_path(spark, "batches"), fx.reviews(spark, sf)
    for part in (0, 1):
        io.append_rows(rows.filter(F.col("review_id") % 2 == part), path)
    return spark, path


register("append_batches", W(sg.reviews_ctes(), "SELECT review_id, review_text FROM reviews"))(
    lambda spark, sf: (lambda sp: sp[0].read.parquet(sp[1]).select("review_id", "review_text"))(_appended(spark, sf)))

register("count_rows", W(sg.reviews_ctes(), "SELECT count(*) AS n_rows FROM reviews"))(
    lambda spark, sf: (lambda sp: io.count_rows(*sp))(_appended(spark, sf)))

# --- S3, S4, S5, S7 --------------------------------------------------------------------
APPSTORE_SQL = """
SELECT d.text AS content, CAST(d.doc_id % 5 + 1 AS INTEGER) AS score,
       CASE WHEN d.doc_id % 9 = 0 THEN 'not a date' ELSE CAST(e.ts AS VARCHAR) END AS "at",
       CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE concat('u', CAST(e.user_id AS VARCHAR)) END AS userName,
       d.doc_id AS row_seq
FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id"""
BINARY_SQL = """
SELECT d.text AS reviews, CAST(l.quality AS DOUBLE) AS label, d.doc_id AS row_seq
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
PRODUCT_SQL = """
SELECT text AS comment, CAST(turn % 5 + 1 AS INTEGER) AS rating,
       CASE WHEN role = 'user' THEN concat('c', CAST(conv_id AS VARCHAR)) END AS username,
       conv_id * 4294967296 + turn AS row_seq
FROM conversations"""
ADAPTED_CTES = [
    ("app", APPSTORE_SQL), ("bin", BINARY_SQL), ("prod", PRODUCT_SQL),
    ("a_app", """SELECT content AS review_text, score AS rating, 'shopee_app' AS product_name,
                        strftime(try_cast("at" AS TIMESTAMP), '%Y-%m-%d') AS review_date, userName AS reviewer_name,
                        'shopee' AS source_platform, row_seq FROM app"""),
    ("a_bin", """SELECT reviews AS review_text, CASE WHEN label = 0.0 THEN 1 WHEN label = 1.0 THEN 5 ELSE 3 END
                        AS rating, 'marketplace_generic' AS product_name, 'unknown' AS review_date,
                        'anonymous' AS reviewer_name, 'shopee' AS source_platform, row_seq FROM bin"""),
    ("a_prod", """SELECT comment AS review_text, rating, 'shopee_product' AS product_name, 'unknown' AS review_date,
                         coalesce(username, 'anonymous') AS reviewer_name, 'shopee' AS source_platform, row_seq
                  FROM prod"""),
]

# a character outside ISO-8859-1 is written as '?'
register("adapt_latin1_source", W(ADAPTED_CTES, r"""
SELECT regexp_replace(review_text, '[^\x{00}-\x{FF}]', '?', 'g') AS review_text, CAST(rating AS VARCHAR) AS rating,
       product_name, review_date, reviewer_name, source_platform, CAST(row_seq AS VARCHAR) AS row_seq FROM a_app"""))(
    _latin1)
register("adapt_appstore", W(ADAPTED_CTES, "SELECT * FROM a_app"))(
    lambda spark, sf: ad.adapt_appstore(fx.appstore_rows(spark, sf)))
register("adapt_binary_label", W(ADAPTED_CTES, "SELECT * FROM a_bin"))(
    lambda spark, sf: ad.adapt_binary_label(fx.binary_label_rows(spark, sf)))
register("adapt_product_review", W(ADAPTED_CTES, "SELECT * FROM a_prod"))(
    lambda spark, sf: ad.adapt_product_review(fx.product_review_rows(spark, sf)))

register("union_sources", W(ADAPTED_CTES + [("u", """
SELECT *, 0 AS source_seq FROM a_app UNION ALL SELECT *, 1 FROM a_bin UNION ALL SELECT *, 2 FROM a_prod
UNION ALL SELECT text, CAST(item_id % 5 + 1 AS INTEGER), 'shopee_cod', strftime(DATE '2024-01-01' + CAST(item_id % 28 AS INTEGER), '%Y-%m-%d'),
                 concat('b', item_id), 'shopee', item_id, 3 FROM benchmark""")], f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY review_text ORDER BY source_seq, row_seq) AS rn FROM u
  WHERE review_text IS NOT NULL AND {sg.strip('review_text')} <> '') WHERE rn = 1"""))(
    lambda spark, sf: ad.union_sources(ad.load_sources({
        "app store": lambda: ad.adapt_appstore(fx.appstore_rows(spark, sf)),
        "marketplace": lambda: ad.adapt_binary_label(fx.binary_label_rows(spark, sf)),
        "product reviews": lambda: ad.adapt_product_review(fx.product_review_rows(spark, sf)),
        "cash on delivery": lambda: ad.adapt_appstore(fx.cod_rows(spark, sf), "shopee_cod")})))

# --- S8, S9, S10 -------------------------------------------------------------------------
PAGES_ORACLE = W(sg.reviews_ctes() + [("rk", """
SELECT *, row_number() OVER (PARTITION BY product_name, rating ORDER BY review_id) AS rk FROM reviews"""),
    ("pg", "SELECT *, (rk - 1) // 50 + 1 AS page, (rk - 1) % 50 AS pos FROM rk")], f"""
SELECT {sg.strip('review_text')} AS review_text, rating,
       CASE WHEN review_id % 5 = 0 THEN '' ELSE {sg.strip('product_name')} END AS product_name,
       concat('2024-01-', lpad(CAST(review_id % 28 + 1 AS VARCHAR), 2, '0')) AS review_date,
       CASE WHEN review_id % 3 = 0 THEN '' ELSE {sg.strip('reviewer_name')} END AS reviewer_name,
       'tokopedia' AS source_platform, product_name AS shop, CAST(page AS BIGINT) AS page, CAST(pos AS INTEGER) AS pos
FROM pg WHERE (page + rating) % 7 <> 3 AND {sg.is_valid_review(sg.strip('review_text'))}""")


def _flatten(spark, sf):
    landed = fx.landed_pages(spark, sf)
    # through JSON text and back, as landed files are read
    parsed = landed.select("shop", "requested_rating", "page",
                           F.from_json(F.to_json("response"), pg.RESPONSE).alias("response"))
    return pg.flatten_review_pages(parsed)


register("flatten_review_pages", PAGES_ORACLE)(_flatten)



def _quarantine(spark, sf):
    """The landed pages that do not fit, from their JSON lines."""
    lines = fx.landed_pages(spark, sf).select(F.to_json(F.struct("*")).alias("value"))
    return pg.quarantined(pg.parse_pages(lines)).select("shop", "requested_rating", "page", "pos", "reason")


register("quarantine_pages", W(sg.reviews_ctes() + [("rk", """
SELECT *, row_number() OVER (PARTITION BY product_name, rating ORDER BY review_id) AS rk FROM reviews""")], """
SELECT DISTINCT product_name AS shop, rating AS requested_rating, CAST((rk - 1) // 50 + 1 AS BIGINT) AS page,
       CAST(NULL AS INTEGER) AS pos, 'no envelope' AS reason
FROM rk WHERE ((rk - 1) // 50 + 1 + rating) % 7 = 3"""))(_quarantine)

register("extract_id_from_html", W([("sp", fx.SHOP_PAGES_SQL)], "SELECT page_id, coalesce(" + ", ".join(
    f"nullif(regexp_extract(html, {sg.q(p)}, 1), '')" for p in pg.PATTERNS) + ") AS shop_id FROM sp"))(
    lambda spark, sf: fx.shop_pages(spark, sf).select("page_id", pg.extract_id_from_html("html").alias("shop_id")))

register("shop_name_from_url", """
SELECT page_id, string_split(regexp_replace(url, '/+$', ''), '/')[-2] AS shop_name FROM pages""")(
    lambda spark, sf: fx.table(spark, sf, "pages").select("page_id", pg.shop_name_from_url("url").alias("shop_name")))

# --- W1, A20, W9 on events (user_id = shop, rating from value, ts = review time) ---------
EV_RATING = "CAST(floor(value) AS INTEGER) % 5 + 1"
QMAP = "MAP {" + ", ".join(f"{r}: {q}" for r, q in sorted(lx.RATING_QUOTA.items())) + "}"


def _ev(spark, sf):
    return fx.table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("shop"), (F.floor("value").cast("int") % 5 + 1).alias("rating"), "ts")


register("rating_quota", f"""
SELECT event_id, shop, rating, CAST(k AS INTEGER) AS k FROM (
  SELECT event_id, user_id AS shop, {EV_RATING} AS rating,
         row_number() OVER (PARTITION BY user_id, {EV_RATING} ORDER BY ts DESC, event_id) AS k FROM events)
WHERE k <= {QMAP}[rating]""")(
    lambda spark, sf: quota.rating_quota(_ev(spark, sf), "shop", "rating", "ts", "event_id")
    .select("event_id", "shop", "rating", F.col("k").cast("int").alias("k")))

FILL_SQL = f"""
SELECT s.shop, r.rating, coalesce(c.n, 0) AS collected, {QMAP}[r.rating] AS quota,
       round(coalesce(c.n, 0) / {QMAP}[r.rating], 6) AS fill
FROM (SELECT DISTINCT user_id AS shop FROM events) s
JOIN (SELECT unnest([{', '.join(str(r) for r in lx.RATING_QUOTA)}]) AS rating) r ON true
LEFT JOIN (SELECT shop, rating, count(*) AS n FROM (
    SELECT user_id AS shop, {EV_RATING} AS rating,
           row_number() OVER (PARTITION BY user_id, {EV_RATING} ORDER BY ts DESC, event_id) AS k FROM events)
  WHERE k <= {QMAP}[rating] GROUP BY ALL) c ON c.shop = s.shop AND c.rating = r.rating"""


def _fill(spark, sf):
    kept = quota.rating_quota(_ev(spark, sf), "shop", "rating", "ts", "event_id")
    return quota.quota_fill(kept, "shop", "rating")


register("quota_fill", FILL_SQL)(_fill)

_ORDER = "CASE rating " + " ".join(f"WHEN {r} THEN {i}" for i, r in enumerate(lx.RATING_QUOTA)) + " END"
register("running_total", f"""
SELECT *, CAST(sum(collected) OVER (ORDER BY shop, {_ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_total
FROM ({FILL_SQL})""")(
    lambda spark, sf: quota.running_total(_fill(spark, sf), "shop", "rating"))
