"""Reviews embedded in pages: JSON of any depth inside a script element, walked level by level.

A page's data is parsed to a VARIANT; a recursive query takes the objects and arrays of each level apart, for all pages
at once, until no level is left. Pages whose data can't be read are rows with a status, like all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: FIXED VALUES: the element that holds the data, the mark of a review, and how many a page gives.
DATA = r"""(?is)<script[^>]*\bid=["']?serialized-server-data["']?[^>]*>(.*?)</script>"""
KIND, LIMIT = "Review", 10

_WALK = """
WITH RECURSIVE walk(page, depth, place, node) MAX RECURSION LEVEL {deepest} AS (
  SELECT page, 0, CAST('' AS STRING), node FROM {data}
  UNION ALL
  SELECT w.page, w.depth + 1, concat(w.place, lpad(CAST(e.pos AS STRING), 9, '0')), e.value
  FROM walk w, LATERAL variant_explode(w.node) e
  WHERE left(schema_of_variant(e.value), 6) = 'OBJECT' OR left(schema_of_variant(e.value), 5) = 'ARRAY'
)
SELECT page, depth, place, node FROM walk WHERE try_variant_get(node, '$["$kind"]', 'string') = '{kind}' LIMIT ALL
"""


def page_data(pages: DataFrame) -> DataFrame:
    """page, data (the text of the element, null without one) and node (the VARIANT, null if it is none) of pages (page, html)."""
    found = F.regexp_extract(F.coalesce(F.col("html"), F.lit("")), DATA, 1)
    has = F.coalesce(F.col("html").rlike(DATA), F.lit(False))
    rows = pages.select("page", F.when(has, found).alias("data"))
    return rows.withColumn("node", F.try_parse_json("data"))


def embedded_reviews(pages: DataFrame, limit: int = LIMIT, deepest: int = 10_000) -> DataFrame:
    """page, rank, review_id, title, body, rating, author, created_at, depth of the reviews in pages (page, html).

    A review is an object whose $kind is Review, at any depth, with an id, a text and 1 to 5 stars. Of a page's reviews
    the first `limit` count, level by level and on a level from the front, each id once; members of objects come in the
    order of their names. page must tell pages apart.
    """
    text = lambda path: F.try_variant_get("node", path, "string")
    walk = pages.sparkSession.sql(_WALK.format(deepest=int(deepest), kind=KIND, data="{data}"), data=page_data(pages).where("node is not null").select("page", "node"))
    rows = walk.select(
        "page", "depth", "place", F.trim(text("$.id")).alias("review_id"), text("$.title").alias("title"), F.trim(text("$.contents")).alias("body"), F.try_variant_get("node", "$.rating", "double").alias("rating"), text("$.reviewerName").alias("author"), text("$.date").alias("created_at")
    )
    rows = rows.where("review_id <> '' and body <> '' and rating between 1 and 5")
    first = Window.partitionBy("page", "review_id").orderBy("depth", "place")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    order = Window.partitionBy("page").orderBy("depth", "place")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return rows.select("page", "rank", "review_id", "title", "body", "rating", "author", "created_at", "depth")


def page_status(pages: DataFrame, reviews: DataFrame) -> DataFrame:
    """page, status (`ok`, `no-data`, `invalid-data`, `no-reviews`), retryable and reviews (their number) of every page."""
    counts = reviews.groupBy("page").agg(F.count("*").alias("reviews"))
    rows = page_data(pages).select("page", F.col("data").isNull().alias("_none"), F.col("node").isNull().alias("_bad")).join(counts, "page", "left")
    n = F.coalesce("reviews", F.lit(0))
    status = F.when(F.col("_none"), "no-data").when(F.col("_bad"), "invalid-data").when(n == 0, "no-reviews").otherwise("ok")
    return rows.select("page", status.alias("status"), (status != "ok").alias("retryable"), n.alias("reviews"))
