"""Cohorts: manifests of applications, their verdicts, and roll-ups that carry no review text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.numeric import half_up, share
from .aggregate import low
from .reviews import APP


def expand_manifest(manifest: DataFrame) -> DataFrame:
    """Cases of a manifest: one for each application, or for each of its sources in each storefront."""
    if "storefronts" in manifest.columns:
        rows = manifest.select("limit", F.explode("storefronts").alias("front"), "apps").select("limit", "front", F.explode("apps").alias("app")).select("limit", "front", "app", F.explode("app.sources").alias("src"))
        return rows.select(
            F.concat_ws("-", "app.slug", "src.store", "front.slug").alias("slug"), F.col("app.slug").alias("app_slug"), "app.name", "app.category", "src.store", F.col("front.slug").alias("storefront"), "front.country", "front.language", "src.url", "limit"
        )
    rows = manifest.select("limit", "country", "language", F.explode("apps").alias("app"))
    store = F.when(F.col("app.url").contains("apps.apple.com"), "apple-app-store").otherwise("google-play")
    return rows.select("app.slug", F.col("app.slug").alias("app_slug"), "app.name", "app.category", store.alias("store"), F.lower("country").alias("storefront"), "country", "language", "app.url", "limit")


def validate_manifest(cases: DataFrame, expected: int | None = None) -> list[str]:
    """What is wrong with a manifest's cases: repeated slugs, urls of other stores, another number than expected."""
    wrong = [f"repeated case {r.slug}" for r in cases.groupBy("slug").count().where("count > 1").collect()]
    other = F.when(F.col("store") == "apple-app-store", ~F.col("url").contains("apps.apple.com")).otherwise(~F.col("url").contains("play.google.com"))
    wrong += [f"url of another store in {r.slug}" for r in cases.where(other).select("slug").collect()]
    if expected is not None and (n := cases.count()) != expected:
        wrong.append(f"{n} cases instead of {expected}")
    return wrong


def complaint_coverage(classified: DataFrame, verdicts: DataFrame) -> DataFrame:
    """complaints, matched, rate: low-rated reviews of the current version, and those that a theme covers."""
    rows = classified.join(verdicts.select(*APP, F.col("current_version").alias("app_version")), [*APP, "app_version"]).where(low())
    known = F.lit(False)
    for theme in fixed.THEMES:
        known = known | (F.size(F.col("hits")[theme]) > 0)
    counts = rows.groupBy(*APP).agg(F.count("*").alias("complaints"), F.count(F.when(known, 1)).alias("matched"))
    return counts.withColumn("rate", share(F.col("matched"), F.col("complaints")))


def summary(verdicts: DataFrame) -> DataFrame:
    """level, name, total, passed, failed, insufficient, errors, completed, decidable, decidable_rate: overall, by store
    (source) and by storefront. A case that could not be fetched has status `error`."""
    rows = verdicts if "storefront" in verdicts.columns else verdicts.withColumn("storefront", F.lit("unknown"))
    count = lambda s: F.count(F.when(F.col("status") == s, 1))
    level = F.when(F.grouping("source") == 0, "store").when(F.grouping("storefront") == 0, "storefront").otherwise("all")
    name = F.when(F.grouping("source") == 0, F.col("source")).when(F.grouping("storefront") == 0, F.col("storefront")).otherwise("all")
    out = rows.groupingSets([["source"], ["storefront"], []], "source", "storefront").agg(
        F.count("*").alias("total"), count("pass").alias("passed"), count("fail").alias("failed"), count("insufficient-data").alias("insufficient"), count("error").alias("errors"), level.alias("level"), name.alias("name")
    )
    decidable = F.col("passed") + F.col("failed")
    return out.select(
        "level", "name", "total", "passed", "failed", "insufficient", "errors", (F.col("total") - F.col("errors")).alias("completed"), decidable.alias("decidable"), F.when(F.col("total") == F.col("errors"), 0.0).otherwise(half_up(decidable / F.nullif(F.col("total") - F.col("errors"), F.lit(0)), 3, epsilon=False)).alias("decidable_rate")
    )


def insufficient_reasons(verdicts: DataFrame) -> DataFrame:
    return verdicts.where("status = 'insufficient-data'").groupBy("reason").agg(F.count("*").alias("cases"))


def violation_counts(violations: DataFrame) -> DataFrame:
    """id, cases: violations over all applications."""
    return violations.groupBy("id").agg(F.count("*").alias("cases"))


def triage_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("decision").agg(F.count("*").alias("cases"))


def link_level_counts(verdicts: DataFrame, links: DataFrame) -> DataFrame:
    """level, cases: how the current versions' reviews speak of a release."""
    own = verdicts.select(*APP, F.col("current_version").alias("app_version")).join(links, [*APP, "app_version"], "left")
    return own.groupBy(F.coalesce("level", F.lit("unknown")).alias("level")).agg(F.count("*").alias("cases"))


def scope_sums(verdicts: DataFrame, scopes: DataFrame) -> DataFrame:
    """scope, reviews: low-rated reviews of all current versions."""
    own = verdicts.select(*APP, F.col("current_version").alias("app_version")).join(scopes, [*APP, "app_version"])
    return own.groupBy("scope").agg(F.sum("count").alias("reviews"))
