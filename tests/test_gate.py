"""Published figures of the demo set, gate semantics, phrases, comparison and cohorts."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from revulet import queries
from revulet.functions import classify as K
from revulet.operators import aggregate as A
from revulet.operators import cohort, compare, discover, evaluate, regression
from revulet.operators.reviews import clean
from revulet.plans import gate
from revulet.sources.demo import demo_competitor_reviews, demo_reviews

RUN = datetime(2026, 9, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def demo(spark):
    return K.classify(clean(demo_reviews(spark), RUN)).cache()


@pytest.fixture(scope="module")
def result(demo):
    return gate.evaluate(demo)


def test_demo_tables(demo):
    rows = A.version_summary(demo).orderBy("rank").collect()
    assert [(r.app_version, r["count"], r.average_rating, r.negative_share) for r in rows] == [("4.8.0", 36, 1.97, 0.722), ("4.7.2", 32, 3.31, 0.281), ("4.6.9", 28, 2.64, 0.536)]
    assert A.sample_summary(demo).collect()[0].average_rating == 2.61
    assert [r["count"] for r in A.rating_distribution(demo).orderBy("stars").collect()] == [26, 24, 20, 13, 13]
    scopes = {r.scope: r["count"] for r in A.version_scope_counts(demo).where("app_version = '4.8.0'").collect()}
    assert scopes == {"software": 21, "product-policy": 6, "community": 0, "support": 0, "unclear": 3}


def test_demo_verdict(result):
    v = result.verdicts.collect()[0]
    assert (v.status, v.decision, v.blocking, v.current_version, v.baseline_version, v.violations) == ("fail", "software-regression", True, "4.8.0", "4.7.2", 4)
    found = {r.id: r for r in result.violations.collect()}
    assert set(found) == {"rating-drop", "negative-share-increase", "theme-stability", "discovered-66e943a4d5da"}
    assert round(found["theme-stability"].value, 2) == 0.26 and found["discovered-66e943a4d5da"].severity == "high"


def test_relaxed_policy_passes(demo):
    policy = regression.Policy(max_rating_drop=4, max_negative_share_increase=1, max_theme_share_increase=1, max_discovered_issue_share=1)
    v = gate.evaluate(demo, policy).verdicts.collect()[0]
    assert (v.status, v.decision, v.blocking) == ("pass", "observe", False)


def test_partial_source_and_small_versions(demo, spark):
    partial = spark.createDataFrame([("google-play", "com.demo.pulse", True)], "source string, app_id string, partial_results boolean")
    totals = gate.app_totals(demo)
    versions = A.version_summary(demo)
    policy = regression.Policy()
    reason = lambda *a: regression.readiness(totals, *a).collect()[0].reason
    assert reason(versions, policy, partial) == "partial-source" and reason(versions, policy) is None
    assert reason(versions, regression.Policy(min_version_reviews=40)) == "current-too-small"
    assert reason(versions.where("rank = 1"), policy) == "no-baseline" and reason(versions.limit(0), policy) == "no-version"
    assert reason(versions.withColumn("count", F.when(F.col("rank") > 1, 3).otherwise(F.col("count"))), policy) == "baseline-too-small"


@pytest.mark.parametrize("wrong", [{"min_version_reviews": 0}, {"min_version_reviews": 2.5}, {"max_rating_drop": 5}, {"max_theme_share_increase": -0.1}, {"min_theme_reviews": True}])
def test_policy_ranges(wrong):
    with pytest.raises(ValueError):
        regression.Policy(**wrong)


def test_cohort_queries_count_discovered_issues(spark, monkeypatch):
    monkeypatch.setattr(queries, "raw_reviews", lambda spark, d: demo_reviews(spark))
    monkeypatch.setattr(queries, "POLICY", regression.Policy(max_rating_drop=4, max_negative_share_increase=1, max_theme_share_increase=1))
    assert [tuple(r) for r in queries.cohort_violation_counts(spark, "").collect()] == [("discovered-66e943a4d5da", 1)]
    assert {(r.total, r.passed, r.failed) for r in queries.cohort_summary(spark, "").collect()} == {(1, 0, 1)}


def test_exit_codes():
    assert [regression.exit_code(s) for s in ("pass", "fail", "insufficient-data")] == [0, 1, 0] and regression.exit_code("insufficient-data", True) == 1


def test_version_order(spark):
    rows = [("a", "x", v, 3.0, "b", datetime(2024, 1, d), d) for d, v in enumerate(["4.8", "4.10.0", "4.8.0", "beta", "10.1"], 1)]
    reviews = spark.createDataFrame(rows, "source string, app_id string, app_version string, rating double, body string, created_at timestamp, position long")
    got = [r.app_version for r in A.version_summary(reviews).orderBy("rank").collect()]
    assert got == ["10.1", "4.10.0", "4.8.0", "4.8", "beta"]


def phrases(spark, bodies):
    raw = spark.createDataFrame([("s", "a", str(i), b, 1.0, "2024-01-01", i) for i, b in enumerate(bodies)], "source string, app_id string, review_id string, body string, rating double, created_at string, ordinal long")
    return K.with_themes(clean(raw, RUN))


def test_phrases(spark):
    rows = phrases(spark, ["Portrait photos rotate sideways today", "My portrait photo rotated sideways again", "All portrait photos rotating sideways", "Great colours", "Kalender zeigt falsche Woche", "Der Kalender zeigt falsche Wochen"])
    issues, items = gate.discovered(rows)
    found = {r.fingerprint: r for r in issues.collect()}
    assert "portrait photo" in found and found["portrait photo"]["count"] == 3 and any("kalend" in f for f in found)
    assert discover.issue_versions(items).count() == 0
    assert gate.discovered(phrases(spark, ["only one portrait photo"]))[0].count() == 0


def test_rows_in_any_order(demo, spark):
    raw = demo_reviews(spark)
    for n in (1, 7):
        rows = K.with_themes(clean(raw.repartition(n), RUN))
        assert sorted(map(str, A.theme_evidence(rows).collect())) == sorted(map(str, A.theme_evidence(demo).collect()))


def test_comparison(spark, demo):
    other = K.with_themes(clean(demo_competitor_reviews(spark), RUN))
    both = A.theme_summary(demo).unionByName(A.theme_summary(other))
    pairs = spark.createDataFrame([("google-play", "com.demo.pulse", "google-play", "com.demo.orbit")], ", ".join(f"{c} string" for c in compare.PAIR))
    gaps = compare.theme_gaps(pairs, both)
    first = gaps.where("rank = 1").collect()[0]
    assert first.theme == "pricing" and first.share_gap > 0.2
    assert compare.opportunities(gaps).where("rank = 1").collect()[0].id == "competitor-pricing"


def test_evaluation(spark):
    rows = spark.createDataFrame([("en", ["a", "b"], ["a"]), ("en", [], []), ("de", ["b"], ["b", "c"])], "language string, predicted array<string>, expected array<string>")
    got = {(r.level, r.name): r for r in evaluate.label_metrics(evaluate.confusion(rows)).collect()}
    assert (got["all", "all"].tp, got["all", "all"].fp, got["all", "all"].fn) == (2, 1, 1) and got["label", "a"].precision == 1.0 and got["label", "c"].recall == 0.0
    exact = {r.language: r.exact_match for r in evaluate.exact_match(rows).collect()}
    assert exact["en"] == 0.5 and exact["de"] == 0.0


def test_cohort(spark, result, demo):
    manifest = spark.createDataFrame([(50, [{"slug": "us-en", "country": "US", "language": "en"}], [{"slug": "one", "name": "One", "category": "x", "sources": [{"store": "google-play", "url": "https://play.google.com/store/apps/details?id=a"}]}])], "limit long, storefronts array<struct<slug:string,country:string,language:string>>, apps array<struct<slug:string,name:string,category:string,sources:array<struct<store:string,url:string>>>>")
    cases = cohort.expand_manifest(manifest)
    assert [r.slug for r in cases.collect()] == ["one-google-play-us-en"] and cohort.validate_manifest(cases, 1) == []
    assert cohort.validate_manifest(cases.withColumn("store", F.lit("apple-app-store")), 2) == ["url of another store in one-google-play-us-en", "1 cases instead of 2"]
    total = {(r.level, r.name): r for r in cohort.summary(result.verdicts).collect()}
    assert total["all", "all"].failed == 1 and total["store", "google-play"].decidable_rate == 1.0
    assert cohort.complaint_coverage(demo, result.verdicts).collect()[0].complaints == 30
    assert not {"body", "author", "review_id"} & set(cohort.summary(result.verdicts).columns)
