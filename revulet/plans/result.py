"""The gate's result document: everything that a release check says of an application, as one nested value."""

from __future__ import annotations

from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import aggregate as A
from ..operators import discover as D
from ..operators.reviews import APP, best_evidence
from .gate import Gate
from .report import lists

SCHEMA_VERSION = 1


def _current(g: Gate) -> DataFrame:
    return g.ready.where("current_version is not null").select(*APP, F.col("current_version").alias("app_version"))


def violation_evidence(g: Gate, count: int = 3) -> DataFrame:
    """source, app_id, id, rank, evidence: what to cite for each violation, from reviews of the current version (the
    newest negative ones for ratings, the complaints of a theme) and from those with a phrase."""
    rows = g.reviews.join(_current(g), [*APP, "app_version"], "left_semi")
    ratings = A.version_negative_evidence(rows, count).withColumn("id", F.explode(F.array(F.lit("rating-drop"), F.lit("negative-share-increase"))))
    themes = A.version_theme_evidence(rows, complaints=True, count=count).withColumn("id", F.concat(F.lit("theme-"), "theme"))
    phrases = D.issue_evidence(g.items, g.reviews, count)
    every = [df.select(*APP, "id", "rank", "evidence") for df in (ratings, themes, phrases)]
    return every[0].unionByName(every[1]).unionByName(every[2]).join(g.violations.select(*APP, "id"), [*APP, "id"], "left_semi")


def issue_evidence(g: Gate, count: int = 3) -> DataFrame:
    """source, app_id, id, rank, evidence of the current versions' known software issues."""
    rows = g.reviews.join(_current(g), [*APP, "app_version"], "left_semi").where((F.col("rating") <= 3) & (F.col("scope.primary") == "software"))
    rows = rows.withColumn("theme", F.explode("scope.software_themes")).withColumn("id", F.concat(F.lit("software-"), "theme"))
    return best_evidence(rows, [*APP, "id"], count, [F.desc(A.link_rank())])


def violations(g: Gate, count: int = 3) -> DataFrame:
    """The gate's violations with title, counts and shares of both versions, and evidence."""
    changed = g.theme_changes.select(*APP, F.concat(F.lit("theme-"), "theme").alias("id"), "label", "count", "baseline_count", "current_share", "baseline_share")
    changed = changed.unionByName(g.issue_changes.select(*changed.columns))
    cited = lists(violation_evidence(g, count), "evidence", ["rank"], [*APP, "id"])
    rows = g.violations.join(changed, [*APP, "id"], "left").join(cited, [*APP, "id"], "left")
    points = F.format_string("%.1f", F.col("value") * 100)
    title = (
        F.when(F.col("kind_order") == 1, F.format_string("Average rating down by %.2f stars", "value"))
        .when(F.col("kind_order") == 2, F.concat(F.lit("One- and two-star reviews up by "), points, F.lit(" points")))
        .when(F.col("kind_order") == 3, F.concat("label", F.lit(": complaints up by "), points, F.lit(" points")))
        .otherwise(F.concat(F.lit("Repeated phrase: "), "label", F.lit(", up by "), points, F.lit(" points")))
    )
    return rows.withColumns({"title": title, "place": -F.col("value")}).drop("tie")


def document(g: Gate, run_time: datetime | None = None) -> DataFrame:
    """source, app_id, result: a row for each application, also for those that can't be compared (metrics are null).

    result has the status and decision, both versions, the policy, metrics, changes of themes and phrases, violations
    and issues with evidence, and what the current version's reviews say of releases (release_link) and of their scope
    (actionability); available is false where the current version has no reviews to say it.
    """
    current = _current(g)
    own = lambda rows: rows.join(current, [*APP, "app_version"], "left_semi").drop("app_version")
    nested = lambda rows, name: rows.select(*APP, F.struct(F.lit(True).alias("available"), *(c for c in rows.columns if c not in APP)).alias(name))
    links = nested(own(A.version_release_link(g.reviews)), "release_link")
    scopes = own(A.version_scope_counts(g.reviews))
    place = F.array_position(F.array(*(F.lit(s) for s in fixed.SCOPES)), F.col("scope"))
    scope = own(A.version_actionability(g.reviews)).join(lists(scopes.withColumn("place", place), "scopes", ["place"]), APP, "left")
    issues = g.actionable.drop("app_version").join(lists(issue_evidence(g), "evidence", ["rank"], [*APP, "id"]), [*APP, "id"], "left")
    ranked = lambda df: df.withColumns({"place": -F.col("share_increase"), "size": -F.col("count")})
    metric = ("version", "count", "average_rating", "negative_share")
    side = lambda p: F.struct(*(F.col(f"{p}_{m}").alias(m) for m in metric)).alias(p)
    metrics = g.compared.select(*APP, F.struct(side("current"), side("baseline"), "rating_drop", "negative_share_increase").alias("metrics"))
    parts = [
        g.verdicts.select(*APP, F.struct(*(F.col(c).alias({"violations": "violation_count"}.get(c, c)) for c in g.verdicts.columns if c not in APP)).alias("verdict")),
        metrics,
        lists(ranked(g.theme_changes), "theme_changes", ["place", "size", "ordinal"]),
        lists(ranked(g.issue_changes), "issue_changes", ["place", "size", "rank"]),
        lists(violations(g), "violations", ["kind_order", "place", "id"]),
        lists(issues.withColumns({"place": F.when(F.col("supported"), 0).otherwise(1), "size": -F.col("count")}), "issues", ["place", "size", "id"]),
        links,
        nested(scope, "actionability"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, APP, "left")
    known = lambda name: F.when(F.col(name).isNotNull(), F.col(name)).otherwise(F.struct(F.lit(False).alias("available"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema[name].dataType.fields[1:]))).alias(name)
    policy = F.struct(*(F.lit(value).alias(name) for name, value in asdict(g.policy).items())).alias("policy")
    made = (run_time or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%S.000Z")
    return out.select(
        *APP,
        F.struct(
            F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(made).alias("evaluated_at"), "verdict.*", policy, "metrics", "theme_changes", "issue_changes", "violations", "issues", known("release_link"), known("actionability")
        ).alias("result"),
    )
