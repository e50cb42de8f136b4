"""A report document of each application, assembled of the long tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as K
from ..operators import aggregate as A
from ..operators import compare, provenance
from ..operators import discover as D
from ..operators.insights import insights
from ..operators.regression import Policy
from ..operators.reviews import APP, clean, normalize
from ..sources.registry import Dataset, Registry, Source, default_registry
from ..storage import cut
from . import gate

SCHEMA_VERSION = 1


def lists(rows: DataFrame, name: str, order: list[str], keys: list[str] = APP) -> DataFrame:
    """One row for each group of keys: its rows as an array in order. Callers bound the rows of a group."""
    own = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in own if c not in order)))).alias(name))


def tables(raw: DataFrame, apps: DataFrame | None = None, run_time: datetime | None = None) -> dict[str, DataFrame]:
    """All tables of a report, for any number of applications in raw review records."""
    reviews = cut(K.classify(clean(raw, run_time)))
    themes, versions, samples = A.theme_summary(reviews), A.version_summary(reviews), A.sample_summary(reviews)
    issues, items = gate.discovered(reviews)
    return {
        "reviews": reviews,
        "sample": samples,
        "distribution": A.rating_distribution(reviews),
        "timeline": A.timeline(reviews),
        "countries": A.value_counts(reviews, "country"),
        "languages": A.value_counts(reviews, "language"),
        "themes": themes,
        "theme_evidence": A.theme_evidence(reviews),
        "complaint_evidence": A.theme_evidence(reviews, complaints=True),
        "versions": versions,
        "version_evidence": A.version_negative_evidence(reviews),
        "version_themes": A.version_theme_signals(reviews),
        "release_links": A.version_release_link(reviews),
        "release_link_evidence": A.release_link_evidence(reviews),
        "scopes": A.version_scope_counts(reviews),
        "actionability": A.version_actionability(reviews),
        "scope_evidence": A.scope_evidence(reviews),
        "actionable": gate.actionable_issues(reviews),
        "keywords": A.keywords(reviews, apps),
        "issues": issues,
        "issue_versions": D.issue_versions(items),
        "issue_evidence": D.issue_evidence(items, reviews),
        "insights": insights(themes, versions, samples),
        "provenance": provenance.content_hash(normalize(raw, run_time)),
    }


def _with(rows: DataFrame, keys: list[str], *parts: DataFrame) -> DataFrame:
    for part in parts:
        rows = rows.join(part, keys, "left")
    return rows


def _one(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys and the other columns, which each group has once, as a struct."""
    return rows.select(*keys, F.struct(*(c for c in rows.columns if c not in keys)).alias(name))


def document(found: dict[str, DataFrame], run_time: datetime | None = None) -> DataFrame:
    """source, app_id, report: the tables of each application as one nested value. Only bounded tables go in: themes and
    versions have a fixed number of rows, and what they cite is the best few reviews."""
    theme, version = [*APP, "theme"], [*APP, "app_version"]
    themes = _with(found["themes"].withColumn("order", -F.col("priority_score")), theme, lists(found["theme_evidence"], "evidence", ["rank"], theme), lists(found["complaint_evidence"], "complaint_evidence", ["rank"], theme))
    scope = [*version, "scope"]
    scopes = _with(found["scopes"], scope, lists(found["scope_evidence"].withColumnRenamed("category", "scope"), "evidence", ["rank"], scope))
    signals = found["version_themes"].withColumn("order", -F.col("count"))
    versions = _with(
        found["versions"],
        version,
        lists(found["version_evidence"], "evidence", ["rank"], version),
        lists(signals, "themes", ["order", "ordinal"], version),
        _one(_with(found["release_links"], version, lists(found["release_link_evidence"], "evidence", ["rank"], version)), version, "release_link"),
        _one(_with(found["actionability"], version, lists(scopes, "scopes", ["scope"], version), lists(found["actionable"], "issues", ["id"], version)), version, "actionability"),
    )
    issue = [*APP, "id"]
    issues = _with(found["issues"], issue, lists(found["issue_versions"].withColumn("order", -F.col("count")), "versions", ["order", "app_version"], issue), lists(found["issue_evidence"], "evidence", ["rank"], issue))
    out = _with(
        _one(found["sample"], APP, "sample"),
        APP,
        lists(found["distribution"], "rating_distribution", ["stars"]),
        lists(found["timeline"], "timeline", ["period"]),
        lists(found["countries"], "countries", ["rank"]),
        lists(found["languages"], "languages", ["rank"]),
        lists(themes, "themes", ["order", "count", "ordinal"]),
        lists(versions, "versions", ["rank"]),
        lists(found["keywords"], "keywords", ["rank"]),
        lists(issues, "discovered_issues", ["rank"]),
        lists(found["insights"], "insights", ["ordinal"]),
        found["provenance"].select(*APP, F.struct("review_count", "content_hash").alias("provenance")),
    )
    made = (run_time or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%S.000Z")
    body = [c for c in out.columns if c not in APP]
    return out.select(*APP, F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(made).alias("generated_at"), *body).alias("report"))


def analyze(spark, source: Source, registry: Registry | None = None, options: dict | None = None) -> Dataset:
    """The dataset of a source through the first connector that supports it."""
    options = options or {}
    data = (registry or default_registry()).resolve(source).fetch(spark, source, options)
    if data.reviews.isEmpty():
        raise ValueError("The source returned no reviews.")
    return data


def check(data: Dataset, policy: Policy | None = None, run_time: datetime | None = None) -> gate.Gate:
    """The release gate for a fetched dataset."""
    reviews = K.classify(clean(data.reviews, run_time))
    partial = bool(data.metadata.get("partial_results"))
    sources = reviews.select(*APP).distinct().withColumn("partial_results", F.lit(partial))
    return gate.evaluate(reviews, policy, sources)


def compared(primary: DataFrame, competitor: DataFrame, run_time: datetime | None = None) -> dict[str, DataFrame]:
    """Gaps, opportunities and rating gaps between all applications of two sets of raw records."""
    a, b = clean(primary, run_time), clean(competitor, run_time)
    both = cut(K.with_themes(a.unionByName(b)))
    pairs = a.select(*APP).distinct().join(b.select(F.col("source").alias("other_source"), F.col("app_id").alias("other_app_id")).distinct(), F.concat("source", F.lit(":"), "app_id") != F.concat("other_source", F.lit(":"), "other_app_id"))
    themes, samples = A.theme_summary(both), A.sample_summary(both)
    gaps = compare.theme_gaps(pairs, themes)
    return {"gaps": gaps, "opportunities": compare.opportunities(gaps), "rating_gap": compare.rating_gaps(pairs, samples)}
