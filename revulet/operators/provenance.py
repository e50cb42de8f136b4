"""Fingerprints of datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical as json_of
from .reviews import APP, iso



def canonical(reviews: DataFrame) -> DataFrame:
    """source, app_id, review_id, digest: of each review's fields as JSON with sorted keys."""
    plain = F.to_json(
        F.struct(
            F.col("app_id").alias("appId"),
            F.col("app_version").alias("appVersion"),
            "author",
            "body",
            "country",
            iso(F.col("created_at")).alias("createdAt"),
            F.format_string("%.3f", "helpful_count").alias("helpfulCount"),
            "language",
            F.format_string("%.3f", "rating").alias("rating"),
            F.col("review_id").alias("reviewId"),
            "source",
            F.col("source_url").alias("sourceUrl"),
            "title",
            iso(F.col("updated_at")).alias("updatedAt"),
        ),
        {"ignoreNullFields": "false"},
    )
    return reviews.select(*APP, "review_id", F.sha2(plain, 256).alias("digest"))


def content_hash(reviews: DataFrame) -> DataFrame:
    """review_count and content_hash of each application, whatever the order of rows.

    Reviews fall into blocks by the start of their digests; a block's digest is of its sorted digests, the whole one of
    the sorted blocks. So no task holds an application's reviews all at once.
    """
    rows = canonical(reviews).withColumn("block", F.substring("digest", 1, 3))
    blocks = rows.groupBy(*APP, "block").agg(F.count("*").alias("n"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("digest"))), 256).alias("part"))
    return blocks.groupBy(*APP).agg(F.sum("n").alias("review_count"), F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda x: x["part"])), 256).alias("content_hash"))


FIELDS = ("app_id", "app_version", "author", "body", "country", "created_at", "helpful_count", "language", "rating", "reply", "review_id", "source", "source_url", "title", "updated_at")
#: Reviews up to which an application's exact hash is made; more would be one text of unbounded size.
EXACT, HOUR_MS = 2_000, 3_600_000


def canonical_reviews(reviews: DataFrame) -> DataFrame:
    """source, app_id, review_id, created_ms, position, json of deduplicated reviews: all 15 fields, the reply included, as
    canonical JSON."""
    record = F.struct(*FIELDS)
    kind = reviews.select(record.alias("r")).schema["r"].dataType
    return reviews.select(*APP, "review_id", F.unix_millis("created_at").alias("created_ms"), "position", json_of(record, kind).alias("json"))


def dataset_hashes(reviews: DataFrame, exact: int = EXACT) -> DataFrame:
    """source, app_id, review_count, content_hash, tree_hash of deduplicated reviews.

    content_hash is the sha256 of the JSON array of an application's reviews, newest first; null where it has more than
    `exact` of them. tree_hash is of the same order and of any number: reviews fall into the hours they were made in, an
    hour's digest is of its reviews' digests, the application's of its hours'. Any changed field changes both.
    """
    rows = canonical_reviews(reviews)
    totals = rows.groupBy(*APP).agg(F.count("*").alias("review_count"))
    small = rows.join(totals.where(F.col("review_count") <= exact).select(*APP), APP)
    order = F.struct((-F.col("created_ms")).alias("age"), "position", "json")
    listed = F.transform(F.array_sort(F.collect_list(order)), lambda x: x["json"])
    whole = small.groupBy(*APP).agg(F.sha2(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")), 256).alias("content_hash"))
    digests = rows.select(*APP, F.floor(F.col("created_ms") / HOUR_MS).alias("hour"), "created_ms", "position", F.sha2("json", 256).alias("digest"))
    joined = lambda order, name: F.concat_ws(",", F.transform(F.array_sort(F.collect_list(order)), lambda x: x[name]))
    hours = digests.groupBy(*APP, "hour").agg(F.sha2(joined(F.struct((-F.col("created_ms")).alias("age"), "position", "digest"), "digest"), 256).alias("part"))
    tree = hours.groupBy(*APP).agg(F.sha2(joined(F.struct((-F.col("hour")).alias("age"), "part"), "part"), 256).alias("tree_hash"))
    return totals.join(whole, APP, "left").join(tree, APP)
