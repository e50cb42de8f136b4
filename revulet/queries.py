"""The registered queries over reviews derived from the test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import TEMPLATES, raw_reviews
from .functions import classify as K
from .functions.text import clean_text
from .operators import aggregate as A
from .operators import cohort, compare, discover, evaluate, provenance, regression
from .operators import insights as insight_rules
from .operators.reviews import APP, clean, iso, latest, normalize
from .plans import gate
from .sources.store_urls import source_ref
from .storage import cut

RUN = datetime(2024, 4, 1, tzinfo=timezone.utc)
POLICY = regression.Policy(min_version_reviews=5)
Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}


def query(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(raw_reviews(spark, sf_dir), RUN)


def themed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.with_themes(reviews(spark, sf_dir))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.classify(reviews(spark, sf_dir))


def _hits(column: str, name: str):
    return F.array_join(F.array_sort(column), "|").alias(name)


@query
def normalize_reviews(spark, d):
    rows = normalize(raw_reviews(spark, d), RUN)
    return rows.select(*APP, "review_id", "title", "body", "rating", "language", "country", "app_version", "author", "helpful_count", iso(F.col("created_at")).alias("created"), iso(F.col("updated_at")).alias("updated"), "ordinal")


@query
def clean_pages_text(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", clean_text(F.col("html")).alias("text"))


@query
def parse_page_source_refs(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url")
    i = F.col("page_id").cast("string")
    apple = F.concat(F.lit("https://apps.apple.com/gb/app/x/id"), i)
    google = F.concat(F.lit("https://play.google.com/store/apps/details?id=com.x"), i, F.lit("&gl=us&hl=en"))
    url = F.when(F.col("page_id") % 3 == 0, apple).when(F.col("page_id") % 3 == 1, google).otherwise(F.col("url"))
    return pages.select("page_id", source_ref(url).alias("ref")).select("page_id", "ref.store", "ref.app_id", "ref.country", "ref.language", "ref.canonical_url")


@query
def dedupe_latest(spark, d):
    rows = latest(raw_reviews(spark, d), RUN)
    return rows.select(*APP, "review_id", "body", iso(F.col("updated_at")).alias("updated"), "ordinal", "position")


@query
def sample_summary(spark, d):
    return A.sample_summary(reviews(spark, d))


@query
def rating_distribution(spark, d):
    return A.rating_distribution(reviews(spark, d))


@query
def timeline_monthly(spark, d):
    return A.timeline(reviews(spark, d))


@query
def country_counts(spark, d):
    return A.value_counts(reviews(spark, d), "country")


@query
def language_counts(spark, d):
    return A.value_counts(reviews(spark, d), "language")


@query
def theme_hits(spark, d):
    return themed(spark, d).select("review_id", F.explode(K.themes()).alias("t")).select("review_id", "t.id", F.explode("t.hits").alias("hit"))


@query
def theme_confidence(spark, d):
    return themed(spark, d).select("review_id", F.explode(K.themes()).alias("t")).select("review_id", "t.id", "t.intent", "t.confidence")


@query
def theme_summary(spark, d):
    return A.theme_summary(themed(spark, d)).select(*APP, "theme", "count", "share", "average_rating", "negative_count", "complaint_count", "complaint_share", "complaint_average_rating")


@query
def theme_trend(spark, d):
    return A.theme_summary(themed(spark, d)).select(*APP, "theme", "recent_count", "previous_count", "trend_percent", "recent_complaint_count", "previous_complaint_count", "complaint_trend_percent")


@query
def theme_priority(spark, d):
    return A.theme_summary(themed(spark, d)).select(*APP, "theme", "priority_score")


@query
def request_overlap(spark, d):
    return A.theme_summary(themed(spark, d)).select(*APP, "theme", "request_overlap_count")


@query
def theme_evidence_top4(spark, d):
    return A.theme_evidence(themed(spark, d)).select(*APP, "theme", "rank", "evidence.review_id", "evidence.rating", "evidence.excerpt")


@query
def theme_complaint_evidence(spark, d):
    return A.theme_evidence(themed(spark, d), complaints=True).select(*APP, "theme", "rank", "evidence.review_id")


@query
def version_summary(spark, d):
    return A.version_summary(reviews(spark, d)).select(*APP, "app_version", "count", "average_rating", "negative_share", "last_seen_ms")


@query
def version_order_top12(spark, d):
    rows = reviews(spark, d).withColumn("app_version", F.concat(F.col("review_id").cast("long") % 17, F.lit("."), F.col("review_id").cast("long") % 5, F.when(F.col("review_id").cast("long") % 2 == 0, ".0").otherwise("")))
    return A.version_summary(rows).select(*APP, "app_version", "count", "rank")


@query
def version_negative_evidence(spark, d):
    return A.version_negative_evidence(reviews(spark, d)).select(*APP, "app_version", "rank", "evidence.review_id")


@query
def version_theme_signals(spark, d):
    return A.version_theme_signals(themed(spark, d)).drop("ordinal", "label", "intent")


@query
def version_theme_evidence(spark, d):
    return A.version_theme_evidence(themed(spark, d)).select(*APP, "app_version", "theme", "rank", "evidence.review_id")


@query
def release_link_kind(spark, d):
    rows = K.with_link(reviews(spark, d))
    return rows.select("review_id", "link.kind", _hits("link.explicit_hits", "explicit_hits"), _hits("link.change_hits", "change_hits"))


@query
def version_release_link(spark, d):
    return A.version_release_link(K.with_link(reviews(spark, d)))


@query
def release_link_evidence(spark, d):
    return A.release_link_evidence(K.with_link(reviews(spark, d))).select(*APP, "app_version", "rank", "evidence.review_id")


@query
def review_scope(spark, d):
    rows = classified(spark, d)
    return rows.select("review_id", "scope.primary", _hits("scope.software", "software"), _hits("scope.product_policy", "product_policy"), _hits("scope.community", "community"), _hits("scope.support", "support"), _hits("scope.software_themes", "software_themes"))


@query
def version_scope_counts(spark, d):
    return A.version_scope_counts(classified(spark, d))


@query
def version_actionability(spark, d):
    return A.version_actionability(classified(spark, d))


@query
def scope_evidence(spark, d):
    return A.scope_evidence(classified(spark, d)).select(*APP, "app_version", "category", "rank", "evidence.review_id")


@query
def actionable_known_issues(spark, d):
    return A.known_issues(classified(spark, d))


@query
def actionable_issues(spark, d):
    return gate.actionable_issues(cut(classified(spark, d)))


def _apps(spark):
    return spark.createDataFrame([("google-play", "app-0", "Crashes Later", "Gallery Labs"), ("apple-app-store", "app-1", "Photos", None)], "source string, app_id string, name string, developer string")


@query
def keyword_top20(spark, d):
    return A.keywords(reviews(spark, d), _apps(spark))


def _phrases(spark, d):
    return discover.phrase_features(gate.unclassified(themed(spark, d)))


@query
def phrase_features_df(spark, d):
    return _phrases(spark, d).groupBy(*APP, "feature").agg(F.count("*").alias("df"))


@query
def phrase_candidates(spark, d):
    return discover.candidates(_phrases(spark, d)).select(*APP, "feature", "count", "average_rating", "score")


@query
def discovered_issues(spark, d):
    return gate.discovered(themed(spark, d))[0]


@query
def issue_versions(spark, d):
    return discover.issue_versions(gate.discovered(themed(spark, d))[1])


@query
def issue_evidence(spark, d):
    rows = themed(spark, d)
    return discover.issue_evidence(gate.discovered(rows)[1], rows).select(*APP, "id", "rank", "evidence.review_id")


def _pairs(spark):
    return spark.createDataFrame([("google-play", "app-0", "google-play", "app-1"), ("google-play", "app-1", "apple-app-store", "app-2")], ", ".join(f"{c} string" for c in compare.PAIR))


@query
def app_comparison(spark, d):
    return compare.theme_gaps(_pairs(spark), A.theme_summary(themed(spark, d))).drop("ordinal", "label")


@query
def comparison_opportunities(spark, d):
    return compare.opportunities(compare.theme_gaps(_pairs(spark), A.theme_summary(themed(spark, d)))).drop("ordinal", "label", "theme")


@query
def comparison_rating_gap(spark, d):
    return compare.rating_gaps(_pairs(spark), A.sample_summary(reviews(spark, d)))


@query
def insights(spark, d):
    rows = themed(spark, d)
    return insight_rules.insights(A.theme_summary(rows), A.version_summary(rows), A.sample_summary(rows)).select(*APP, "ordinal", "id", "kind", "severity")


def _gate(spark, d):
    return gate.evaluate(classified(spark, d), POLICY)


def _compared(spark, d):
    rows = themed(spark, d)
    ready = regression.readiness(gate.app_totals(rows), A.version_summary(rows), POLICY)
    return rows, ready, regression.metrics(ready)


@query
def regression_versions(spark, d):
    return _compared(spark, d)[1]


@query
def regression_metrics(spark, d):
    return _compared(spark, d)[2].select(*APP, "rating_drop", "negative_share_increase")


@query
def regression_theme_changes(spark, d):
    rows, _, compared = _compared(spark, d)
    return regression.theme_changes(compared, A.version_theme_signals(rows)).drop("ordinal", "label", "mentions")


@query
def regression_theme_violations(spark, d):
    rows, _, compared = _compared(spark, d)
    return regression.violations(compared, regression.theme_changes(compared, A.version_theme_signals(rows)), None, POLICY).drop("tie")


@query
def regression_issue_changes(spark, d):
    return _gate(spark, d).issue_changes


@query
def regression_violations(spark, d):
    return _gate(spark, d).violations.drop("tie")


@query
def regression_verdict(spark, d):
    return _gate(spark, d).verdicts


@query
def provenance_hash(spark, d):
    return provenance.content_hash(normalize(raw_reviews(spark, d), RUN))


@query
def cohort_summary(spark, d):
    return cohort.summary(_gate(spark, d).verdicts)


@query
def cohort_violation_counts(spark, d):
    return cohort.violation_counts(_gate(spark, d).violations)


@query
def cohort_insufficient_reasons(spark, d):
    return cohort.insufficient_reasons(_gate(spark, d).verdicts)


@query
def cohort_coverage(spark, d):
    return cohort.complaint_coverage(themed(spark, d), _gate(spark, d).verdicts)


@query
def cohort_triage_counts(spark, d):
    return cohort.triage_counts(_gate(spark, d).verdicts)


@query
def cohort_link_levels(spark, d):
    rows = K.with_link(reviews(spark, d))
    return cohort.link_level_counts(_compared(spark, d)[1], A.version_release_link(rows))


@query
def cohort_scope_sums(spark, d):
    return cohort.scope_sums(_compared(spark, d)[1], A.version_scope_counts(classified(spark, d)))


def _examples(spark, d):
    """Predicted and expected themes of reviews whose sentence was written for a theme."""
    tags = spark.createDataFrame([(t, theme) for t, theme in TEMPLATES], "sentence string, expected string")
    rows = themed(spark, d).withColumn("sentence", F.regexp_extract("body", r"^(.*?)\. ", 1)).join(F.broadcast(tags), "sentence")
    predicted = F.transform(K.themes(), lambda t: t["id"])
    return rows.select(F.coalesce("language", F.lit("unknown")).alias("language"), predicted.alias("predicted"), F.when(F.col("expected") == "", F.array().cast("array<string>")).otherwise(F.array("expected")).alias("expected"))


@query
def classifier_confusion(spark, d):
    return evaluate.confusion(_examples(spark, d))


@query
def classifier_micro_metrics(spark, d):
    return evaluate.label_metrics(evaluate.confusion(_examples(spark, d)))


@query
def classifier_exact_match(spark, d):
    return evaluate.exact_match(_examples(spark, d)).withColumn("language", F.coalesce("language", F.lit("all")))


@query
def csv_cells_guarded(spark, d):
    from .plans.render import csv_guard

    marked = F.concat(F.element_at(F.array(*(F.lit(x) for x in ("=", "+", "-", "@", '"', ""))), (F.col("doc_id") % 6 + 1).cast("int")), F.col("text"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", csv_guard(marked).alias("cell"))


def _demo(spark, d):
    """The demo set once for every 96 documents, each time as an application of its own."""
    from .sources.demo import demo_rows

    i = F.col("doc_id")
    places = spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("com.demo.pulse-"), F.floor(i / 96).cast("string")).alias("app_id"), (i % 96).alias("id"))
    return clean(demo_rows(places), RUN)


@query
def demo_versions(spark, d):
    return A.version_summary(_demo(spark, d)).select(*APP, "app_version", "count", "average_rating", "negative_share", "last_seen_ms")


@query
def demo_verdict(spark, d):
    return gate.evaluate(K.classify(_demo(spark, d)), POLICY).verdicts


def queries() -> dict[str, Query]:
    from . import flow_queries  # noqa: F401  registers more

    return dict(_ALL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regression_verdict(spark, sf_dir)
