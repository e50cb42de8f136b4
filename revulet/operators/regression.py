"""The release gate: the newest version against an earlier one under a policy."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.numeric import half_up
from .reviews import APP


@dataclass(frozen=True)
class Policy:
    """Thresholds of the gate; a value out of its range is a ValueError. All comparisons are strict."""

    min_version_reviews: int = fixed.POLICY["min_version_reviews"][0]
    max_rating_drop: float = fixed.POLICY["max_rating_drop"][0]
    max_negative_share_increase: float = fixed.POLICY["max_negative_share_increase"][0]
    max_theme_share_increase: float = fixed.POLICY["max_theme_share_increase"][0]
    #: Bounds the increase of an issue's share.
    max_discovered_issue_share: float = fixed.POLICY["max_discovered_issue_share"][0]
    min_theme_reviews: int = fixed.POLICY["min_theme_reviews"][0]

    def __post_init__(self) -> None:
        for field in fields(self):
            value, (_, least, most, is_whole) = getattr(self, field.name), fixed.POLICY[field.name]
            number = isinstance(value, (int, float)) and not isinstance(value, bool)
            if not number or not least <= value <= most or is_whole and int(value) != value:
                raise ValueError(f"{field.name} must be {'an integer ' if is_whole else ''}between {least} and {most}.")


def chosen_versions(versions: DataFrame, policy: Policy) -> DataFrame:
    """current_ and baseline_ columns (version, count, average_rating, negative_share) and candidate_ ones.

    current is the newest version, also if it has few reviews; baseline the next one with enough, if current has
    enough; candidate the next one. versions is aggregate.version_summary().
    """
    item = F.struct("rank", F.col("app_version").alias("version"), "count", "average_rating", "negative_share")
    later = F.col("rank") > 1
    enough = F.col("count") >= policy.min_version_reviews
    rows = versions.groupBy(*APP).agg(F.min(F.when(F.col("rank") == 1, item)).alias("current"), F.min(F.when(later & enough, item)).alias("baseline"), F.min(F.when(later, item)).alias("candidate"))
    eligible = F.col("current.count") >= policy.min_version_reviews
    names = ("version", "count", "average_rating", "negative_share")
    return rows.select(
        *APP,
        *(F.col(f"current.{n}").alias(f"current_{n}") for n in names),
        *(F.when(eligible, F.col(f"baseline.{n}")).alias(f"baseline_{n}") for n in names),
        *(F.col(f"candidate.{n}").alias(f"candidate_{n}") for n in names[:2]),
    )


def readiness(samples: DataFrame, versions: DataFrame, policy: Policy, sources: DataFrame | None = None) -> DataFrame:
    """chosen_versions() for every application with reviews, with reason: why they can't be compared, or null.

    sources (source, app_id, partial_results, reason) says whose samples are partial.
    """
    rows = samples.select(*APP).join(chosen_versions(versions, policy), APP, "left")
    if sources is not None:
        rows = rows.join(sources.select(*APP, "partial_results"), APP, "left")
        partial = F.coalesce("partial_results", F.lit(False))
    else:
        partial = F.lit(False)
    few = lambda c: F.col(c) < policy.min_version_reviews
    reason = (
        F.when(partial, "partial-source")
        .when(F.col("current_version").isNull(), "no-version")
        .when(few("current_count"), "current-too-small")
        .when(F.col("baseline_version").isNull() & F.col("candidate_version").isNotNull(), "baseline-too-small")
        .when(F.col("baseline_version").isNull(), "no-baseline")
    )
    return rows.withColumn("reason", reason).drop("partial_results")


def metrics(ready: DataFrame) -> DataFrame:
    """rating_drop and negative_share_increase, of rounded values, where versions can be compared."""
    return ready.where("reason is null").withColumns(
        {"rating_drop": half_up(F.col("baseline_average_rating") - F.col("current_average_rating"), 3), "negative_share_increase": half_up(F.col("current_negative_share") - F.col("baseline_negative_share"), 3)}
    )


def theme_changes(compared: DataFrame, signals: DataFrame) -> DataFrame:
    """For each theme of the current version: complaint counts and shares of both and share_increase of rounded shares.
    Themes of the baseline alone don't show."""
    own = compared.select(*APP, F.col("current_version").alias("app_version"), "baseline_version").join(signals, [*APP, "app_version"])
    before = signals.select(*APP, F.col("app_version").alias("baseline_version"), "theme", F.col("complaint_count").alias("baseline_count"), F.col("complaint_share").alias("baseline_share"))
    rows = own.join(before, [*APP, "baseline_version", "theme"], "left")
    return rows.select(
        *APP,
        "ordinal",
        "theme",
        "label",
        "intent",
        F.col("count").alias("mentions"),
        F.col("complaint_count").alias("count"),
        F.coalesce("baseline_count", F.lit(0)).alias("baseline_count"),
        F.col("complaint_share").alias("current_share"),
        F.coalesce("baseline_share", F.lit(0.0)).alias("baseline_share"),
        half_up(F.col("complaint_share") - F.coalesce("baseline_share", F.lit(0.0)), 3).alias("share_increase"),
    )


def issue_changes(compared: DataFrame, issues: DataFrame, by_version: DataFrame) -> DataFrame:
    """For each discovered issue: counts in both versions and share_increase of exact shares."""
    counted = issues.select(*APP, "id", "label", "rank").join(compared.select(*APP, "current_version", "current_count", "baseline_version", F.col("baseline_count").alias("baseline_size")), APP)
    counted = counted.join(by_version.withColumnRenamed("count", "n"), [*APP, "id"], "left").groupBy(*APP, "id", "label", "rank", "current_count", "baseline_size").agg(
        F.coalesce(F.sum(F.when(F.col("app_version") == F.col("current_version"), F.col("n"))), F.lit(0)).alias("now"),
        F.coalesce(F.sum(F.when(F.col("app_version") == F.col("baseline_version"), F.col("n"))), F.lit(0)).alias("before"),
    )
    own, old = F.col("now") / F.col("current_count"), F.col("before") / F.col("baseline_size")
    return counted.select(*APP, "id", "label", "rank", F.col("now").alias("count"), F.col("before").alias("baseline_count"), half_up(own, 3).alias("current_share"), half_up(old, 3).alias("baseline_share"), half_up(own - old, 3).alias("share_increase"))


def violations(compared: DataFrame, themes: DataFrame, issues: DataFrame | None, policy: Policy) -> DataFrame:
    """kind_order, id, severity, value, threshold, unit: what exceeds the policy. compared is metrics()."""

    def rows(df: DataFrame, order: int, name: Column, value: str, threshold: float, unit: str, severity: Column | None = None, tie: Column | None = None) -> DataFrame:
        grade = F.when(F.col(value) >= threshold * 1.75, "high").otherwise("medium") if severity is None else severity
        return df.where(F.col(value) > threshold).select(
            *APP, F.lit(order).alias("kind_order"), name.alias("id"), grade.alias("severity"), F.col(value).alias("value"), F.lit(float(threshold)).alias("threshold"), F.lit(unit).alias("unit"), (F.lit(0) if tie is None else tie).cast("long").alias("tie")
        )

    found = rows(compared, 1, F.lit("rating-drop"), "rating_drop", policy.max_rating_drop, "stars")
    found = found.unionByName(rows(compared, 2, F.lit("negative-share-increase"), "negative_share_increase", policy.max_negative_share_increase, "share"))
    counted = themes.where((F.col("intent") != "request") & (F.col("count") >= policy.min_theme_reviews))
    found = found.unionByName(rows(counted, 3, F.concat(F.lit("theme-"), "theme"), "share_increase", policy.max_theme_share_increase, "share", tie=-F.col("count")))
    if issues is not None:
        fresh = F.when(F.col("baseline_count") == 0, "high").otherwise("medium")
        found = found.unionByName(rows(issues.where(F.col("count") >= policy.min_theme_reviews), 4, F.col("id"), "share_increase", policy.max_discovered_issue_share, "share", fresh, -F.col("count")))
    return found


def verdicts(ready: DataFrame, compared: DataFrame, found: DataFrame, actionable: DataFrame | None = None) -> DataFrame:
    """One row for each application: status, decision, blocking, reason, versions, metrics and counts.

    insufficient-data, fail with any violation, or pass. A failure with a supported issue of the current version
    (actionable: app_version, supported) is a software-regression, any other one needs manual-review.
    """
    counts = found.groupBy(*APP).agg(F.count("*").alias("violations"))
    rows = ready.join(compared.select(*APP, "rating_drop", "negative_share_increase"), APP, "left").join(counts, APP, "left").withColumn("violations", F.coalesce("violations", F.lit(0)))
    if actionable is not None:
        supported = actionable.where("supported").groupBy(*APP, F.col("app_version").alias("current_version")).agg(F.count("*").alias("supported_issues"))
        rows = rows.join(supported, [*APP, "current_version"], "left").withColumn("supported_issues", F.coalesce("supported_issues", F.lit(0)))
    else:
        rows = rows.withColumn("supported_issues", F.lit(0))
    status = F.when(F.col("reason").isNotNull(), "insufficient-data").when(F.col("violations") > 0, "fail").otherwise("pass")
    decision = F.when(F.col("status") != "fail", "observe").when(F.col("supported_issues") > 0, "software-regression").otherwise("manual-review")
    rows = rows.withColumn("status", status).withColumn("decision", decision)
    return rows.select(
        *APP, "status", "decision", (F.col("status") == "fail").alias("blocking"), "reason", "current_version", "current_count", F.coalesce("baseline_version", "candidate_version").alias("baseline_version"), "rating_drop", "negative_share_increase", "violations", "supported_issues"
    )


def exit_code(status: str, fail_on_insufficient: bool = False) -> int:
    return int(status == "fail" or status == "insufficient-data" and fail_on_insufficient)
