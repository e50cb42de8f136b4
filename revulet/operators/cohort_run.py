"""Cohort runs: the cases of a manifest judged together, where a case that fails is a row and not the end of the job.

The answers to a case's requests are rows as well (slug, page, status, body), from recorded pages or from fetched(),
which turns what goes wrong into a status. Cases are grouped as applications (source is the store, app_id the case), so
one evaluation of the gate judges all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import fixed
from ..functions.numeric import half_up
from ..plans import gate
from . import aggregate as A
from . import regression as R
from .cohort import complaint_coverage
from .reviews import APP, clean

CASE = ("slug", "app_slug", "name", "category", "store", "storefront", "country", "language", "url")
ANSWER = "slug string, page int, status int, body string"
LEVELS, DECISIONS = ("supported", "limited", "none", "unknown"), ("software-regression", "manual-review", "observe")
REASONS = {"partial-source": "source", "no-version": "unavailable", "current-too-small": "current", "baseline-too-small": "baseline", "no-baseline": "baseline"}


def fetched(cases: DataFrame, fetch: Callable[[dict], Iterator[tuple[int, int, str | None]]]) -> DataFrame:
    """ANSWER rows of fetch(case), which yields page, status and body. Whatever it raises is one row with the exception's
    status (502 if it has none) and its text, so other cases of the task go on."""
    names = [c for c in CASE if c in cases.columns]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for case in batch.to_pylist():
                page = 0
                try:
                    for page, status, body in fetch(case):
                        rows.append((case["slug"], page, status, body))
                except Exception as e:  # noqa: BLE001  a case's failure is its result
                    rows.append((case["slug"], page + 1, int(getattr(e, "status", None) or 502), str(e)))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["slug", "page", "status", "body"])

    return cases.select(*names).mapInArrow(run, ANSWER)


@dataclass(frozen=True)
class Outcome:
    """reviews: slug and the raw review's columns, of cases without a failure. failures: slug, message, status,
    retryable, one row for each case that failed."""

    reviews: DataFrame
    failures: DataFrame


def retryable(status: Column) -> Column:
    return status.isin(408, 429) | (status >= 500)


def outcomes(cases: DataFrame, answers: DataFrame, review: str) -> Outcome:
    """The reviews and the failures in answers (ANSWER), whose bodies are JSON arrays of the DDL type review.

    A case fails with its first page that has a status other than 200 and 404 (which is an empty page) or a body that
    can't be read, and with 502 if no page has a review. Pages of other cases are not touched by it.
    """
    entries = F.from_json("body", f"array<{review}>", {"mode": "PERMISSIVE"})
    rows = answers.join(cases.select("slug"), "slug", "left_semi").select("slug", "page", "status", F.when(F.col("status") == 200, entries).alias("entries"), F.col("body"))
    bad = ~F.col("status").isin(200, 404)
    problem = F.when(bad, F.struct(F.concat(F.lit("The store answered "), F.col("status")).alias("message"), F.col("status").alias("status"), retryable(F.col("status")).alias("retryable"))).when(
        (F.col("status") == 200) & F.col("entries").isNull(), F.struct(F.lit("The answer can't be read").alias("message"), F.lit(502).alias("status"), F.lit(False).alias("retryable"))
    )
    judged = rows.withColumn("problem", problem)
    by_case = judged.groupBy("slug").agg(F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("page"))).alias("problem"), F.sum(F.coalesce(F.size("entries"), F.lit(0))).alias("found"))
    nothing = F.struct(F.lit("The sources returned no reviews").alias("message"), F.lit(502).alias("status"), F.lit(True).alias("retryable"))
    failures = cases.select("slug").join(by_case, "slug", "left").withColumn("problem", F.coalesce("problem", F.when(F.coalesce("found", F.lit(0)) <= 0, nothing)))
    failures = failures.where("problem is not null").select("slug", "problem.*")
    fine = rows.join(failures.select("slug"), "slug", "left_anti")
    return Outcome(fine.select("slug", F.explode("entries").alias("r")).select("slug", "r.*"), failures)


def _by_case(df: DataFrame, *columns) -> DataFrame:
    return df.select(F.col("app_id").alias("slug"), *columns)


def results(cases: DataFrame, outcome: Outcome, policy: R.Policy | None = None, run_time: datetime | None = None) -> DataFrame:
    """One nested row for each case: CASE, status (pass, fail, insufficient-data or error), error, versions, metrics,
    release_link, actionability, triage, coverage and violations. It holds texts of reviews as evidence; see privacy.py.
    """
    policy = policy or R.Policy()
    own = cases.select("slug", "store", F.col("country").alias("_country"), F.col("language").alias("_language"))
    raw = outcome.reviews.join(own, "slug").withColumns({"source": F.col("store"), "app_id": F.col("slug")}).drop("slug", "store", "_country", "_language", "appId", "appid")
    found = gate.evaluate(K.classify(clean(raw, run_time)), policy)
    rows = found.reviews
    current = found.ready.where("current_version is not null").select(*APP, F.col("current_version").alias("app_version"))
    of_current = lambda df: df.join(current, [*APP, "app_version"], "left_semi")

    missing = lambda n: F.greatest(F.lit(0), F.lit(policy.min_version_reviews) - n)
    part = lambda name: F.struct(F.col(f"{name}_version").alias("version"), F.coalesce(f"{name}_count", F.lit(0)).alias("count"), missing(F.coalesce(f"{name}_count", F.lit(0))).cast("long").alias("missing_reviews"))
    shown = found.ready.withColumns({"base_version": F.coalesce("baseline_version", "candidate_version"), "base_count": F.coalesce("baseline_count", "candidate_count")})
    versions = _by_case(shown, "current_version", "baseline_version", F.col("current_count").alias("current_reviews"), F.col("baseline_count").alias("baseline_reviews"), F.struct(part("current").alias("current"), part("base").alias("baseline")).alias("version_evidence"))
    verdicts = _by_case(found.verdicts, F.col("status").alias("verdict"), "reason", "rating_drop", "negative_share_increase", "decision", "blocking")
    totals = _by_case(gate.app_totals(rows), F.col("total").alias("fetched_reviews"))

    cited = _by_case(of_current(A.release_link_evidence(rows)), "rank", "evidence").groupBy("slug").agg(F.sort_array(F.collect_list(F.struct("rank", "evidence"))).alias("cited"))
    links = _by_case(of_current(A.version_release_link(rows)), "level", "low_rating_count", "explicit_count", "change_count", "linked_count", "linked_share").join(cited, "slug", "left")
    links = links.select("slug", F.struct("level", "low_rating_count", "explicit_count", "change_count", "linked_count", "linked_share", F.transform("cited", lambda x: x["evidence"]).alias("evidence")).alias("release_link"))

    issues = _by_case(found.actionable, F.struct("id", "kind", "label", "count", "share", "release_linked_count", "explicit_release_count", "supported").alias("issue"))
    issues = issues.groupBy("slug").agg(F.sort_array(F.collect_list("issue")).alias("issues"))
    scopes = _by_case(of_current(A.version_scope_counts(rows)), "scope", "count").groupBy("slug").agg(*(F.coalesce(F.sum(F.when(F.col("scope") == s, F.col("count"))), F.lit(0)).alias(s.replace("-", "_")) for s in fixed.SCOPES))
    software = _by_case(of_current(A.version_actionability(rows)), "low_rating_count", "software_count", "release_linked_software_count", "explicit_release_software_count", "software_share")
    names = [s.replace("-", "_") for s in fixed.SCOPES]
    act = software.join(scopes, "slug").join(issues, "slug", "left")
    act = act.select(
        "slug", F.struct("low_rating_count", F.struct(*names).alias("counts"), "software_count", "software_share", "release_linked_software_count", "explicit_release_software_count", F.coalesce("issues", F.array().cast(issues.schema["issues"].dataType)).alias("actionable_issues")).alias("actionability")
    )
    violations = _by_case(found.violations, "kind_order", "tie", "id", "severity", "value", "threshold").groupBy("slug").agg(F.sort_array(F.collect_list(F.struct("kind_order", "tie", "id", "severity", "value", "threshold"))).alias("violations"))
    covered = _by_case(complaint_coverage(rows, found.verdicts), F.col("complaints").alias("_complaints"), F.col("matched").alias("_matched"))

    out = cases.select(*CASE)
    for table in (outcome.failures, totals, versions, verdicts, links, act, violations, covered):
        out = out.join(table, "slug", "left")
    failed = F.col("message").isNotNull()
    plain = F.transform("violations", lambda v: F.struct(v["id"].alias("id"), v["severity"].alias("severity"), v["value"].alias("value"), v["threshold"].alias("threshold")))
    supported = F.filter("actionability.actionable_issues", lambda x: x["supported"])
    blocking = F.coalesce("blocking", F.lit(False))
    return out.select(
        *CASE,
        F.when(failed, "error").otherwise(F.col("verdict")).alias("status"),
        F.when(failed, F.struct("message", F.col("store").alias("store"), F.col("status").alias("status"), "retryable")).alias("error"),
        F.coalesce("fetched_reviews", F.lit(0)).alias("fetched_reviews"),
        "current_version",
        "baseline_version",
        F.coalesce("current_reviews", F.lit(0)).alias("current_reviews"),
        "baseline_reviews",
        "version_evidence",
        "reason",
        "rating_drop",
        "negative_share_increase",
        "release_link",
        "actionability",
        F.struct(F.coalesce("decision", F.lit("observe")).alias("decision"), blocking.alias("blocking"), F.when(blocking, F.coalesce(F.transform(supported, lambda x: x["id"]), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("issue_ids")).alias("triage"),
        F.struct(F.coalesce("_complaints", F.lit(0)).alias("complaints"), F.coalesce("_matched", F.lit(0)).alias("matched"), _rate(F.coalesce("_matched", F.lit(0)), F.coalesce("_complaints", F.lit(0))).alias("rate")).alias("coverage"),
        F.coalesce(plain, F.array().cast("array<struct<id:string,severity:string,value:double,threshold:double>>")).alias("violations"),
    )


def _rate(part: Column, total: Column) -> Column:
    return F.when(total > 0, half_up(part / F.nullif(total, F.lit(0)), 3, epsilon=False))


def roll_up(rows: DataFrame) -> DataFrame:
    """level (all, store, storefront), name and, of the results() of each: numbers of cases by status, completed (no
    error), decidable (pass or fail), decidable_rate of the completed, complaints with matched and rate, link levels,
    reviews by scope and decisions, where cases in error count for none of these."""
    done = F.col("status") != "error"
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    level = F.coalesce("release_link.level", F.lit("unknown"))
    known = F.when(level.isin(*LEVELS), level).otherwise("unknown")
    where = F.when(F.grouping("store") == 0, "store").when(F.grouping("storefront") == 0, "storefront").otherwise("all")
    name = F.when(F.grouping("store") == 0, F.col("store")).when(F.grouping("storefront") == 0, F.col("storefront")).otherwise("all")
    out = rows.groupingSets([["store"], ["storefront"], []], "store", "storefront").agg(
        where.alias("level"),
        name.alias("name"),
        F.count("*").alias("total"),
        *(count(F.col("status") == s, n) for s, n in (("pass", "passed"), ("fail", "failed"), ("insufficient-data", "insufficient"), ("error", "errors"))),
        F.coalesce(F.sum("coverage.complaints"), F.lit(0)).alias("complaints"),
        F.coalesce(F.sum("coverage.matched"), F.lit(0)).alias("matched"),
        *(count(done & (known == x), f"link_{x}") for x in LEVELS),
        *(F.coalesce(F.sum(F.when(done, F.col(f"actionability.counts.{s.replace('-', '_')}"))), F.lit(0)).alias(f"scope_{s.replace('-', '_')}") for s in fixed.SCOPES),
        *(count(done & (F.col("triage.decision") == x), f"triage_{x.replace('-', '_')}") for x in DECISIONS),
    )
    completed, decidable = F.col("total") - F.col("errors"), F.col("passed") + F.col("failed")
    more = {"completed": completed, "decidable": decidable, "decidable_rate": F.coalesce(_rate(decidable, completed), F.lit(0.0)), "coverage_rate": _rate(F.col("matched"), F.col("complaints"))}
    return out.drop("store", "storefront").withColumns(more)


def ranked_violations(rows: DataFrame) -> DataFrame:
    """id, cases and rank: how many cases have each violation, the most frequent first, then by id."""
    from pyspark.sql import Window

    counts = rows.select(F.explode("violations").alias("v")).groupBy("v.id").agg(F.count("*").alias("cases"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cases"), "id")))


def reasons(rows: DataFrame) -> DataFrame:
    """reason (source, unavailable, current, baseline), cases: why cases have insufficient data; each reason has a row."""
    names = rows.sparkSession.createDataFrame([(x,) for x in ("current", "baseline", "unavailable", "source")], "reason string")
    of = F.element_at(F.create_map(*(x for pair in REASONS.items() for x in map(F.lit, pair))), F.col("reason"))
    counts = rows.where("status = 'insufficient-data'").groupBy(F.coalesce(of, F.lit("unavailable")).alias("reason")).agg(F.count("*").alias("cases"))
    return names.join(counts, "reason", "left").select("reason", F.coalesce("cases", F.lit(0)).alias("cases"))
