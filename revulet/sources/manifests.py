"""Cohort manifests: JSON files with applications, and with storefronts for a matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohort
from .store_urls import source_ref

MANIFEST = (
    "schemaVersion int, description string, country string, language string, limit long, minimumApps long, expectedCases long, "
    "storefronts array<struct<slug:string,country:string,language:string>>, "
    "apps array<struct<slug:string,name:string,category:string,url:string,sources:array<struct<store:string,url:string>>>>"
)
LEAST_FLAT, SLUG = 20, "^[a-z0-9-]+$"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifests (a row each) in the JSON files at path."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def cases(manifest: DataFrame) -> DataFrame:
    """expand_manifest() of manifests that may be flat or a matrix; the storefront of a flat one is its country and language."""
    matrix = cohort.expand_manifest(manifest.where("storefronts is not null"))
    flat = cohort.expand_manifest(manifest.where("storefronts is null").drop("storefronts"))
    flat = flat.withColumns({"storefront": F.lower(F.concat_ws("-", "country", "language")), "store": source_ref(F.col("url"))["store"]})
    return matrix.unionByName(flat)


def problems(manifest: DataFrame, least: int = LEAST_FLAT) -> DataFrame:
    """rule, subject: what is wrong with manifests, a row each: versions other than 1, limits out of 20 to 2,000, too few
    applications or storefronts, slugs of other signs or twice, names left out, stores that their urls are not of, another
    number of cases than expected."""
    m = manifest.withColumn("_case_count", F.size("apps"))
    found = lambda rows, rule, subject: rows.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"))
    out = found(m.where("schemaVersion is null or schemaVersion <> 1"), "schema-version", F.col("schemaVersion"))
    out = out.unionByName(found(m.where("limit is null or limit < 20 or limit > 2000"), "limit", F.col("limit")))
    few = F.when(F.col("storefronts").isNull(), F.greatest(F.lit(least), F.coalesce("minimumApps", F.lit(0)))).otherwise(F.coalesce("minimumApps", F.lit(1)))
    out = out.unionByName(found(m.where(F.coalesce(F.size("apps"), F.lit(0)) < few), "too-few-apps", F.size("apps")))
    out = out.unionByName(found(m.where("storefronts is not null and size(storefronts) < 2"), "too-few-storefronts", F.size("storefronts")))
    apps = manifest.select(F.monotonically_increasing_id().alias("m"), "apps", "storefronts").select("m", F.explode("apps").alias("a"), F.col("storefronts").isNotNull().alias("matrix"))
    out = out.unionByName(found(apps.where(~F.coalesce(F.col("a.slug").rlike(SLUG), F.lit(False))), "slug", F.col("a.slug")))
    out = out.unionByName(found(apps.where("trim(coalesce(a.name, '')) = '' or trim(coalesce(a.category, '')) = ''"), "no-name", F.col("a.slug")))
    out = out.unionByName(found(apps.groupBy("m", "a.slug").agg(F.count("*").alias("n")).where("n > 1"), "repeated-slug", F.col("slug")))
    sources = apps.where("matrix").select("a.slug", F.explode("a.sources").alias("s"))
    out = out.unionByName(found(sources.where(~F.coalesce(source_ref(F.col("s.url"))["store"] == F.col("s.store"), F.lit(False))), "store", F.col("slug")))
    numbers = m.where("storefronts is not null and expectedCases is not null").withColumn("n", F.aggregate(F.transform("apps", lambda a: F.size(a["sources"])), F.lit(0), lambda x, y: x + y) * F.size("storefronts"))
    return out.unionByName(found(numbers.where("n <> expectedCases"), "expected-cases", F.col("n")))
