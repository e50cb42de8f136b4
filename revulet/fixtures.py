"""Reviews derived from the `documents` table, for tests and the registered queries (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sentence and the theme that it is written for ('' for none).
TEMPLATES = [
    ("The app crashes whenever the gallery opens since the latest update", "stability"),
    ("Scrolling is slow and the battery is empty by noon", "performance"),
    ("The subscription got expensive and no refund was given", "pricing"),
    ("Login fails and the verification code never comes", "account"),
    ("Sync suddenly stopped and the backup is gone", "sync"),
    ("Every notification arrives an hour late", "notifications"),
    ("The settings are confusing and hard to use", "usability"),
    ("Please add an export to the calendar, would love that", "feature-request"),
    ("Asks for a permission that makes tracking easy", "privacy"),
    ("Seit dem letzten Update hängt die Anmeldung und die Fehlermeldung bleibt", "stability"),
    ("更新后经常闪退，数据丢失", "stability"),
    ("アプリがクラッシュしてログインできない", "stability"),
    ("Portrait photos rotate sideways after saving twice", ""),
    ("Lovely colours and a calm design", ""),
    ("Could you bring a reminder with backup, I wish", "feature-request"),
    ("Moderators banned me and customer support never replied", ""),
]
#: For each of the templates, how it speaks of a release and what its review is about, as a reader would say.
READINGS = [
    ("explicit", "software"),
    ("none", "software"),
    ("none", "product-policy"),
    ("none", "software"),
    ("change", "software"),
    ("none", "software"),
    ("none", "product-policy"),
    ("none", "product-policy"),
    ("none", "product-policy"),
    ("explicit", "software"),
    ("explicit", "software"),
    ("none", "software"),
    ("none", "software"),
    ("none", "unclear"),
    ("none", "product-policy"),
    ("none", "community"),
]
STEP = 1_000_000_000
#: 2024-03-31 00:00 UTC in seconds.
ANCHOR = 1_711_843_200


def _template(i):
    return F.element_at(F.array(*(F.lit(t) for t, _ in TEMPLATES)), i + 1)


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw review records: every document once, those divisible by 11 a second time with a later update and another
    sentence, those divisible by 13 a second time with an equal update."""
    d = F.col("d")
    copies = F.array_compact(F.array(F.lit(0), F.when(d % 11 == 0, 1), F.when(d % 13 == 0, 2)))
    row = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("d"), "text", "lang").withColumn("again", F.explode(copies))
    again = F.col("again")
    version = F.when((d % 3 == 2) & (d < 30), "5.0.0").otherwise(F.element_at(F.array(F.lit("4.10.0"), F.lit("4.8.0"), F.lit("4.7.2"), F.lit(None).cast("string")), (F.expr("d div 6") % 4 + 1).cast("int")))
    rating = F.when((d % 3 == 0) & (version == "4.10.0"), 1 + F.expr("d div 24") % 2).otherwise(1 + d * 7 % 5)
    index = ((d * 5 + F.expr("d div 24") + F.when(again == 1, 3).otherwise(0)) % 16).cast("int")
    made = F.lit(ANCHOR) - d * 5400
    return row.select(
        F.when(d % 2 == 0, "google-play").otherwise("apple-app-store").alias("source"),
        F.concat(F.lit("app-"), (d % 3).cast("string")).alias("appId"),
        d.cast("string").alias("reviewId"),
        F.concat(_template(index), F.lit(". "), F.col("text")).alias("body"),
        rating.cast("double").alias("score"),
        F.col("lang").alias("language"),
        F.element_at(F.array(F.lit("us"), F.lit("gb"), F.lit("ca"), F.lit(None).cast("string")), (d % 4 + 1).cast("int")).alias("country"),
        version.alias("version"),
        F.concat(F.lit("user "), (d % 17).cast("string")).alias("userName"),
        (d * 7 % 43).alias("thumbsUp"),
        F.timestamp_seconds(made).alias("date"),
        F.timestamp_seconds(made + F.when(again == 1, 86400).otherwise(0)).alias("updatedAt"),
        (d + F.when(again > 0, STEP).otherwise(0)).alias("ordinal"),
    )


def expected_themes() -> list[tuple[str, str]]:
    """Sentence and theme of the templates that have one."""
    return [(t, theme) for t, theme in TEMPLATES if theme]
