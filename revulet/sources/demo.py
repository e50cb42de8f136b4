"""A deterministic review set that tells of a regression, for trying things offline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: FIXED VALUES: rating and text of the rows, in turn; published figures rest on them.
ROWS = (
    (1, "The app crashes every time I open the analytics tab after version 4.8."),
    (2, "Sync stopped working after the update and my saved project disappeared."),
    (1, "Subscription price doubled and the restore purchase button does nothing."),
    (2, "Notifications arrive hours late, so reminders are no longer useful."),
    (3, "The new navigation is confusing. I cannot find exports anymore."),
    (4, "Please add CSV export and a weekly email summary for the team."),
    (2, "Login verification code never arrives when I use a custom email domain."),
    (1, "Battery drain is severe and the phone gets hot while syncing."),
    (5, "Clean interface and the new search is much faster. Great update."),
    (4, "Would love filters by version and country in the next release."),
    (2, "The app freezes on launch unless I reinstall it."),
    (3, "Too many permission prompts before I can try the product."),
)
COMPETITOR = (
    "The subscription is too expensive and every useful feature is behind a paywall.",
    "I was charged after cancelling the trial and support would not refund it.",
    "Please add a monthly plan. The annual subscription is too expensive.",
    "The price keeps increasing but basic export still requires another payment.",
)
CAMERA = "Camera uploads rotate every portrait photo sideways after saving."
CRASH = "Since 4.8.0 the app crashes during normal use. "
#: 2026-08-23 09:00 UTC in milliseconds.
ANCHOR_MS = 1_787_475_600_000
APP = {"source": "google-play", "app_id": "com.demo.pulse", "name": "Pulse Notes", "developer": "Northstar Studio"}
OTHER = {"source": "google-play", "app_id": "com.demo.orbit", "name": "Orbit Journal", "developer": "Orbit Labs"}


def _pick(values, index):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index % len(values) + 1).cast("int"))


def demo_rows(places: DataFrame) -> DataFrame:
    """The review of each of places (app_id, id: its place in the application's set, newest first): the first 36 of
    4.8.0, 32 of 4.7.2, the rest of 4.6.9."""
    i = F.col("id")
    now, before = i < 36, (i >= 36) & (i < 68)
    crash = now & (i % 3 == 0)
    camera = now & (i % 7 == 2) & (i % 3 != 0)
    rating, text = _pick([r for r, _ in ROWS], i), _pick([t for _, t in ROWS], i)
    return places.select(
        F.lit(APP["source"]).alias("source"),
        "app_id",
        F.concat(F.lit("demo-"), (i + 1).cast("string")).alias("review_id"),
        F.when(i % len(ROWS) == 8, "A thoughtful update").alias("title"),
        F.when(camera, CAMERA).when(crash, F.concat(F.lit(CRASH), text)).otherwise(text).alias("body"),
        F.when(camera | crash, 1).when(before, F.least(F.lit(5), rating + 1)).otherwise(rating).cast("double").alias("rating"),
        F.lit("en").alias("language"),
        _pick(["US", "GB", "CA", "AU"], i).alias("country"),
        F.when(now, "4.8.0").when(before, "4.7.2").otherwise("4.6.9").alias("app_version"),
        F.concat(F.lit("Sample user "), (i + 1).cast("string")).alias("author"),
        (i * 7 % 43).alias("helpful_count"),
        F.timestamp_millis(F.lit(ANCHOR_MS) - i * 155_520_000).alias("created_at"),
        i.alias("ordinal"),
    )


def demo_reviews(spark: SparkSession, limit: int = 96) -> DataFrame:
    """limit rows (1 to 500) of one application."""
    return demo_rows(spark.range(max(1, min(500, limit))).withColumn("app_id", F.lit(APP["app_id"])))


def demo_competitor_reviews(spark: SparkSession, limit: int = 84) -> DataFrame:
    """The other application: every third row complains of prices; the first 30 are of 7.2.0, the rest of 7.1.4."""
    rows = demo_reviews(spark, limit)
    i = F.col("ordinal")
    swapped = i % 3 == 0
    return rows.withColumns(
        {
            "app_id": F.lit(OTHER["app_id"]),
            "review_id": F.concat(F.lit("competitor-"), (i + 1).cast("string")),
            "body": F.when(swapped, _pick(COMPETITOR, i)).otherwise(F.replace("body", F.lit("4.8.0"), F.lit("7.2.0"))),
            "rating": F.when(swapped, F.lit(1.0)).otherwise(F.col("rating")),
            "app_version": F.when(i < 30, "7.2.0").otherwise("7.1.4"),
        }
    )
