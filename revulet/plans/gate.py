"""The release gate over clean reviews of any number of applications."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import fixed
from ..functions.text import kept_apart
from ..operators import aggregate as A
from ..operators import discover as D
from ..operators import regression as R
from ..operators.reviews import APP, excerpt
from ..storage import cut


def unclassified(classified: DataFrame) -> DataFrame:
    known = F.lit(False)
    for theme in fixed.THEMES:
        known = known | K.has(theme)
    return kept_apart(classified, "hits").where(~known)


def app_totals(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy(*APP).agg(F.count("*").alias("total"), F.max(F.unix_millis("created_at")).alias("anchor"))


def discovered(classified: DataFrame, limit: int = D.LIMIT) -> tuple[DataFrame, DataFrame]:
    """Issues and their reviews of the reviews without a theme; shares and windows refer to all reviews."""
    totals = app_totals(classified)
    return D.discovered_issues(unclassified(classified), totals.select(*APP, "total"), totals.select(*APP, "anchor"), limit)


def actionable_issues(classified: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Known and newly found software issues of each version, with supported and rank.

    New ones are phrases of explicitly release-linked software reviews without a software theme; current (source,
    app_id, app_version) restricts all to these versions.
    """
    rows = classified.where("rating <= 3 and app_version is not null")
    if current is not None:
        rows = rows.join(current.select(*APP, "app_version"), [*APP, "app_version"], "left_semi")
    known = A.known_issues(rows)
    unknown = rows.where((F.col("scope.primary") == "software") & (F.size("scope.software_themes") == 0) & (F.col("link.kind") == "explicit"))
    # Every version is mined for itself, so it stands in for the application.
    of_version = lambda df: df.withColumn("app_id", F.concat_ws("\u0000", "app_id", "app_version"))
    totals = of_version(rows.groupBy(*APP, "app_version").agg(F.count("*").alias("total"))).select(*APP, "total")
    found, _ = D.discovered_issues(of_version(unknown), totals, limit=4)
    parts = F.split("app_id", "\u0000")
    fresh = found.select(
        "source", parts[0].alias("app_id"), parts[1].alias("app_version"), F.concat(F.lit("software-"), "id").alias("id"), F.lit("discovered").alias("kind"), "label", "count", "share", F.col("count").alias("release_linked_count"), F.col("count").alias("explicit_release_count"), (F.col("count") >= 2).alias("supported")
    )
    return known.unionByName(fresh)


def short_bodies(classified: DataFrame) -> DataFrame:
    """classified with whole bodies only where phrases are mined in them, in low-rated reviews that no theme or no software
    theme explains; others keep what evidence shows of them."""
    known = F.lit(False)
    for theme in fixed.THEMES:
        known = known | K.has(theme)
    unexplained = ~known | ((F.col("scope.primary") == "software") & (F.size("scope.software_themes") == 0) & (F.col("link.kind") == "explicit"))
    mined = (F.col("rating") <= 3) & unexplained
    return classified.withColumn("body", F.when(mined, F.col("body")).otherwise(excerpt(F.col("body"))))


@dataclass(frozen=True)
class Gate:
    """The tables of a gate's evaluation; each is a plan of its own."""

    versions: DataFrame
    ready: DataFrame
    compared: DataFrame
    theme_changes: DataFrame
    issue_changes: DataFrame
    violations: DataFrame
    actionable: DataFrame
    verdicts: DataFrame
    #: What the tables are made of: classified reviews, and the reviews of each phrase.
    reviews: DataFrame
    items: DataFrame
    policy: R.Policy


def evaluate(classified: DataFrame, policy: R.Policy | None = None, sources: DataFrame | None = None) -> Gate:
    """The gate for classified reviews (see classify.classify); sources says which samples are partial."""
    policy = policy or R.Policy()
    classified = cut(short_bodies(classified))  # five tables are made of it; the rules run once
    versions = A.version_summary(classified)
    ready = R.readiness(app_totals(classified), versions, policy, sources)
    compared = R.metrics(ready)
    themes = R.theme_changes(compared, A.version_theme_signals(classified))
    issues, items = discovered(classified)
    changes = R.issue_changes(compared, issues, D.issue_versions(items))
    found = R.violations(compared, themes, changes, policy)
    actionable = actionable_issues(classified, ready.select(*APP, F.col("current_version").alias("app_version")).where("app_version is not null"))
    return Gate(versions, ready, compared, themes, changes, found, actionable, R.verdicts(ready, compared, found, actionable), classified, items, policy)
