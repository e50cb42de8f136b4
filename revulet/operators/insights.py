"""Insights: at most one finding of each kind for an application, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import whole
from . import aggregate as A
from .reviews import APP, evidence, newest, top

KINDS = ("emerging", "pain", "regression", "opportunity", "baseline")
#: What to do about a finding of each kind.
ADVICE = {
    "emerging": "Follow the cited reviews to what they have in common, and tie its repair to the coming release.",
    "pain": "Order the causes that the cited reviews name by how many they touch and how low they rate, and begin at the top.",
    "regression": "Hold the cited reviews against the changes of this version, and plan tests for what matches.",
    "opportunity": "Ask some of those who want it, or show them a draft, before it is planned.",
    "baseline": "Look again with more reviews or after the next release, by the same method.",
}


def insights(themes: DataFrame, versions: DataFrame, samples: DataFrame) -> DataFrame:
    """ordinal, id, kind, severity, subject, title, statement, recommendation, of the theme, version and sample tables of
    aggregate. subject is the theme or the version that a finding is about.

    The first theme or version in the tables' order that meets a rule stands for it: one aggregation over each table
    finds all of them. An application without any finding gets the baseline.
    """
    problem, request = F.col("intent") == "problem", F.col("intent") == "request"
    place = [(-F.col("priority_score")).alias("a"), (-F.col("count")).alias("b"), F.col("ordinal").alias("c")]
    first = lambda condition, *order: F.min(F.when(condition, F.struct(*order)))
    theme = (*place, "theme", "label", "count", "share", "negative_count", "complaint_count", "complaint_average_rating", "recent_complaint_count", "complaint_trend_percent")
    of_themes = themes.groupBy(*APP).agg(
        first(problem & (F.col("recent_complaint_count") >= 2) & (F.col("complaint_trend_percent") > 20), *theme).alias("growing"),
        first(problem & (F.col("negative_count") >= 2), *theme).alias("painful"),
        first(request & (F.col("count") >= 2), *theme).alias("asked"),
    )
    of_versions = versions.groupBy(*APP).agg(first((F.col("count") >= 3) & (F.col("average_rating") <= 2.8), "rank", "app_version", "count", "average_rating", "negative_share").alias("worse"))
    rows = samples.where("total > 0").select(*APP, "total").join(of_themes, APP, "left").join(of_versions, APP, "left")

    def finding(of: str, kind: str, name: Column, severity: Column, subject: Column, title: list[Column | str], *statement: Column | str) -> Column:
        words = lambda parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
        texts = [subject.alias("subject"), words(title).alias("title"), words(statement).alias("statement"), F.lit(ADVICE[kind]).alias("recommendation")]
        return F.when(F.col(of).isNotNull(), F.struct(F.lit(KINDS.index(kind) + 1).alias("ordinal"), name.alias("id"), F.lit(kind).alias("kind"), severity.alias("severity"), *texts))

    high = lambda c: F.when(c, "high").otherwise("medium")
    percent = lambda c: whole(F.col(c) * 100)
    worst = F.col("painful.negative_count") >= F.greatest(F.lit(4.0), F.col("painful.complaint_count") * F.lit(0.6))
    sign = F.when(F.col("growing.complaint_trend_percent") >= 0, "+").otherwise("")
    found = F.array_compact(
        F.array(
            finding(
                "growing", "emerging", F.concat(F.lit("trend-"), "growing.theme"), high(F.col("growing.complaint_average_rating") <= 2.2), F.col("growing.theme"), ["More complaints about ", F.lower("growing.label")],
                F.col("growing.label"), ": ", F.col("growing.recent_complaint_count"), " recent complaints, ", sign, F.col("growing.complaint_trend_percent"), "% against the window before",
            ),
            finding(
                "painful", "pain", F.concat(F.lit("pain-"), "painful.theme"), high(worst), F.col("painful.theme"), [F.col("painful.label"), " hurts most"],
                F.col("painful.label"), ": ", F.col("painful.negative_count"), " of ", F.col("painful.complaint_count"), " complaints have one or two stars",
            ),
            finding(
                "worse", "regression", F.concat(F.lit("version-"), "worse.app_version"), high(F.col("worse.average_rating") <= 2), F.col("worse.app_version"), ["Version ", F.col("worse.app_version"), " is rated low"],
                "Version ", F.col("worse.app_version"), ": ", F.col("worse.count"), " reviews, ", percent("worse.negative_share"), "% with one or two stars",
            ),
            finding("asked", "opportunity", F.lit("feature-demand"), F.lit("low"), F.col("asked.theme"), ["Something is asked for again and again"], F.col("asked.count"), " reviews ask for something, ", percent("asked.share"), "% of the sample"),
        )
    )
    calm = F.array(finding("total", "baseline", F.lit("baseline"), F.lit("low"), F.lit(None).cast("string"), ["Nothing stands out"], F.col("total"), " reviews show no concentrated risk"))
    return rows.select(*APP, F.explode(F.when(F.size(found) > 0, found).otherwise(calm)).alias("x")).select(*APP, "x.*")


def insight_evidence(found: DataFrame, classified: DataFrame) -> DataFrame:
    """source, app_id, id, kind, rank, evidence: the reviews to cite for each of insights() (classified reviews are what it
    was made of). Problems cite complaints about their theme, requests mentions of theirs, versions their newest negative
    reviews, a baseline the newest reviews."""
    cited = lambda kinds, rows, key: found.where(F.col("kind").isin(*kinds)).select(*APP, "id", "kind", F.col("subject").alias(key)).join(rows, [*APP, key]).select(*APP, "id", "kind", "rank", "evidence")
    out = cited(["emerging", "pain"], A.theme_evidence(classified, complaints=True), "theme")
    out = out.unionByName(cited(["opportunity"], A.theme_evidence(classified), "theme"))
    out = out.unionByName(cited(["regression"], A.version_negative_evidence(classified), "app_version"))
    calm = top(classified, APP, newest(), 3).select(*APP, "rank", evidence().alias("evidence"))
    return out.unionByName(found.where("kind = 'baseline'").select(*APP, "id", "kind").join(calm, APP).select(*APP, "id", "kind", "rank", "evidence"))
