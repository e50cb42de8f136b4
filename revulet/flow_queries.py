"""Registered queries over derived feeds, labelled sets, cohorts and fingerprints, added to those of queries.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import READINGS, TEMPLATES, raw_reviews
from .operators import aggregate as A
from .operators import cohort_run, compare, daily, gates, privacy, provenance
from .operators import insights as insight_rules
from .operators.reviews import APP, iso, latest
from .queries import POLICY, RUN, query, reviews, themed
from .sources import embedded, feed_source, labelled, manifests
from .storage import new_path
from .streaming import newest

BENCHMARKS = ("theme", "release-link", "actionability")
#: The lines hold every text three times, which takes more disk than the limit as it is.
PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def labelled_lines(spark: SparkSession, d: str) -> DataFrame:
    """benchmark, line: labelled reviews as JSON, by the sentence that opens them. A few are no JSON, have no text or
    a label that no benchmark has."""
    tags = spark.createDataFrame([(t, theme, *r) for (t, theme), r in zip(TEMPLATES, READINGS)], "sentence string, theme string, link string, scope string")
    rows = reviews(spark, d).join(F.broadcast(tags), F.col("body").startswith(F.concat("sentence", F.lit(". "))))
    i = F.col("review_id").cast("long")
    text = F.when(i % 50 == 11, "").otherwise(F.col("body"))
    one = [F.col("review_id").alias("id"), "language", text.alias("text")]
    themes = F.when(F.col("theme") == "", F.array().cast("array<string>")).otherwise(F.array("theme"))
    lines = {
        "theme": F.to_json(F.struct(*one, F.when(i % 50 == 17, F.array(F.lit("weather"))).otherwise(themes).alias("labels"))),
        "release-link": F.to_json(F.struct(*one, F.col("link").alias("label"))),
        "actionability": F.to_json(F.struct(*one, F.col("scope").alias("label"))),
    }
    flat = rows.select(i.alias("i"), F.explode(F.array(*(F.struct(F.lit(b).alias("benchmark"), line.alias("line")) for b, line in lines.items()))).alias("x"))
    return flat.select("x.benchmark", F.when(F.col("i") % 50 == 23, F.expr("substr(x.line, 1, length(x.line) - 1)")).otherwise(F.col("x.line")).alias("value"))


def labelled_sets(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The lines of each benchmark, written to the shared folder and read as labelled sets."""
    path = new_path(spark, "labelled")
    labelled_lines(spark, d).write.partitionBy("benchmark").options(**PACKED).text(path)
    return {b: labelled.read_labelled(spark, f"{path}/benchmark={b}") for b in BENCHMARKS}


def _measured(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for benchmark, rows in labelled_sets(spark, d).items():
        one = gates.predictions(labelled.usable(rows, gates.LABELS[benchmark]), benchmark)
        out = one if out is None else out.unionByName(one)
    return gates.metrics(out)


@query
def labelled_problems(spark, d):
    found = None
    for benchmark, rows in labelled_sets(spark, d).items():
        one = labelled.problems(rows, gates.LABELS[benchmark]).select(F.lit(benchmark).alias("benchmark"), "problem", "id")
        found = one if found is None else found.unionByName(one)
    return found.groupBy("benchmark", "problem").agg(F.count("*").alias("lines"), F.min("id").alias("first_id"))


@query
def evaluation_metrics(spark, d):
    return _measured(spark, d)


@query
def evaluation_gates(spark, d):
    return gates.check(_measured(spark, d), gates.policy_gates(spark))


@query
def evaluation_status(spark, d):
    return gates.status(gates.check(_measured(spark, d), gates.policy_gates(spark))).drop("worst")


# --- cohorts ------------------------------------------------------------------------------------------

FRONTS = [("us-en", "US", "en"), ("de-de", "DE", "de")]
STORES = {"apple-app-store": "https://apps.apple.com/us/app/x/id", "google-play": "https://play.google.com/store/apps/details?id=com.x"}
#: Cases whose first page can't be had or can't be read, and an application that has no reviews.
DOWN, BROKEN, SILENT = "app-1-google-play-us-en", "app-2-apple-app-store-de-de", "app-silent"
REVIEW = "struct<reviewId:string,body:string,score:double,language:string,country:string,version:string,userName:string,thumbsUp:long,date:string,updatedAt:string,ordinal:long>"
PAGE = 50


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """A matrix manifest of the documents' applications in two stores and storefronts, written as JSON and read."""
    number = F.col("doc_id") % 3
    apps = spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("app-"), number.cast("string")).alias("slug"), number.cast("string").alias("n")).distinct()
    apps = apps.unionByName(spark.createDataFrame([(SILENT, "99")], "slug string, n string"))
    sources = F.array(*(F.struct(F.lit(s).alias("store"), F.concat(F.lit(url), "n").alias("url")) for s, url in STORES.items()))
    app = F.struct("slug", F.concat(F.lit("App "), "n").alias("name"), F.lit("test").alias("category"), sources.alias("sources"))
    fronts = F.array(*(F.struct(F.lit(s).alias("slug"), F.lit(c).alias("country"), F.lit(x).alias("language")) for s, c, x in FRONTS))
    one = apps.agg(F.sort_array(F.collect_list(app)).alias("apps")).select(F.lit(1).alias("schemaVersion"), F.lit(2000).alias("limit"), fronts.alias("storefronts"), (F.size("apps") * 4).alias("expectedCases"), "apps")
    path = new_path(spark, "manifest")
    one.write.json(path)
    return manifests.read_manifest(spark, path)


def answers(spark: SparkSession, d: str) -> DataFrame:
    """What the stores answered to each case's requests: pages of at most fifty documents' reviews."""
    doc = F.col("reviewId").cast("long")
    front = F.when(F.expr("cast(reviewId as long) div 6 % 2") == 0, FRONTS[0][0]).otherwise(FRONTS[1][0])
    time = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias(c)
    rows = raw_reviews(spark, d).select(F.concat_ws("-", "appId", "source", front).alias("slug"), (F.floor(doc / (12 * PAGE)) + 1).cast("int").alias("page"), "reviewId", "body", "score", "language", "country", "version", "userName", "thumbsUp", time("date"), time("updatedAt"), "ordinal")
    body = F.to_json(F.collect_list(F.struct(*rows.columns[2:])))
    pages = rows.groupBy("slug", "page").agg(body.alias("body"))
    first = F.col("page") == 1
    down, broken = first & (F.col("slug") == DOWN), first & (F.col("slug") == BROKEN)
    return pages.select("slug", "page", F.when(down, 503).otherwise(200).alias("status"), F.when(broken, F.expr("substr(body, 1, length(body) - 2)")).otherwise(F.col("body")).alias("body"))


def cohort_cases(spark: SparkSession, d: str) -> DataFrame:
    """The results of the manifest's cases, as far as they may leave."""
    cases = manifests.cases(manifest(spark, d))
    rows = cohort_run.results(cases, cohort_run.outcomes(cases, answers(spark, d), REVIEW), POLICY, RUN)
    return privacy.check(rows.select(*privacy.projection(rows.schema, [*privacy.COHORT, "reason"])))


@query
def manifest_cases(spark, d):
    return manifests.cases(manifest(spark, d)).drop("limit")


@query
def cohort_results(spark, d):
    rows = cohort_cases(spark, d)
    listed = lambda c, f: F.concat_ws(",", F.array_sort(F.transform(c, f)))
    return rows.select(
        "slug", "app_slug", "store", "storefront", "status", F.col("error.message").alias("message"), F.coalesce("error.status", F.lit(200)).alias("http_status"), F.coalesce("error.retryable", F.lit(False)).alias("retryable"), "fetched_reviews", "current_version", "baseline_version", "current_reviews",
        F.coalesce("version_evidence.current.missing_reviews", F.lit(0)).alias("current_missing"), F.coalesce("version_evidence.baseline.missing_reviews", F.lit(0)).alias("baseline_missing"), "rating_drop", "negative_share_increase", F.col("release_link.level").alias("link_level"),
        F.coalesce("release_link.linked_count", F.lit(0)).alias("linked_count"), F.coalesce("actionability.software_count", F.lit(0)).alias("software_count"), F.coalesce("actionability.counts.unclear", F.lit(0)).alias("unclear_count"), F.col("triage.decision").alias("decision"), F.concat_ws(",", F.array_sort("triage.issue_ids")).alias("issue_ids"),
        listed("actionability.actionable_issues", lambda x: F.concat_ws(":", x["id"], x["count"].cast("string"), x["supported"].cast("string"))).alias("actionable"),
        F.col("coverage.complaints").alias("complaints"), F.col("coverage.matched").alias("matched"), F.col("coverage.rate").alias("rate"), listed("violations", lambda v: F.concat_ws(":", v["id"], v["severity"])).alias("violations"),
    )


@query
def cohort_roll_up(spark, d):
    return cohort_run.roll_up(cohort_cases(spark, d))


@query
def cohort_violation_ranks(spark, d):
    return cohort_run.ranked_violations(cohort_cases(spark, d))


@query
def cohort_reasons(spark, d):
    return cohort_run.reasons(cohort_cases(spark, d))


@query
def manifest_problems(spark, d):
    """Every page as a manifest of its own, most of them faulty in a way that its id sets."""
    i = F.col("page_id")
    url = F.when(i % 4 == 1, F.col("url")).otherwise(F.concat(F.lit(STORES["google-play"]), i.cast("string")))
    source = lambda store, address: F.struct(F.lit(store).alias("store"), address.alias("url"))
    sources = F.array(source("google-play", url), source("apple-app-store", F.concat(F.lit(STORES["apple-app-store"]), i.cast("string"))))
    app = lambda slug: F.struct(slug.alias("slug"), F.when(i % 9 == 3, " ").otherwise("Name").alias("name"), F.lit("c").alias("category"), sources.alias("sources"))
    slug = F.concat(F.when(i % 7 == 2, F.lit("Page ")).otherwise(F.lit("page-")), i.cast("string"))
    fronts = F.array(*(F.struct(F.lit(s).alias("slug"), F.lit(c).alias("country"), F.lit(x).alias("language")) for s, c, x in FRONTS))
    rows = spark.read.parquet(f"{d}/pages.parquet").select(
        F.when(i % 5 != 4, 1).alias("schemaVersion"), F.when(i % 6 == 5, 10).otherwise(300).alias("limit"), F.when(i % 8 == 7, F.slice(fronts, 1, 1)).otherwise(fronts).alias("storefronts"), F.when(i % 10 == 9, 5).otherwise(F.when(i % 8 == 7, 2).otherwise(4)).alias("expectedCases"), F.array(app(slug)).alias("apps")
    )
    path = new_path(spark, "manifests")
    rows.write.json(path)
    read = spark.read.schema(manifests.MANIFEST).json(path)
    return manifests.problems(read).groupBy("rule", "subject").agg(F.count("*").alias("n"))


# --- fingerprints -------------------------------------------------------------------------------------


@query
def dataset_hashes(spark, d):
    """Hashes of whole datasets with replies to every fifth review."""
    doc = F.col("reviewId").cast("long")
    raw = raw_reviews(spark, d).withColumn("reply", F.when(doc % 5 == 0, F.struct(F.concat(F.lit('Thanks "'), "reviewId", F.lit('"')).alias("body"), F.when(doc % 10 == 0, F.lit("2024-03-31T00:00:00.000Z")).alias("created_at"))))
    rated = raw.withColumns({"score": F.col("score") - F.when(doc % 4 == 1, 0.25).otherwise(0), "thumbsUp": F.col("thumbsUp") + F.when(doc % 6 == 5, 0.1).otherwise(0)})
    return provenance.dataset_hashes(latest(rated, RUN))


# --- reviews embedded in pages ------------------------------------------------------------------------


def embedding_pages(spark: SparkSession, d: str) -> DataFrame:
    """page, html: five documents a page as reviews in its data, at depths that differ, each a second time with another
    text farther down. Some pages have no data or data that is no JSON, some reviews no text or too many stars."""
    i = F.col("doc_id")
    head = lambda text: F.concat(F.lit('{"$kind":"Review","id":"'), i.cast("string"), F.lit('","title":"t","rating":'), (1 + i % 6).cast("string"), F.lit(',"reviewerName":"user '), (i % 17).cast("string"), F.lit('","date":"2024-03-01T00:00:00Z"'), text, F.lit("}"))
    wrapped = lambda one, n: F.concat(F.repeat(F.lit('{"a":['), n), one, F.repeat(F.lit("]}"), n))
    depth = (i % 4).cast("int")
    own = F.when(i % 10 == 9, F.lit("")).otherwise(F.concat(F.lit(',"contents":'), F.expr("substr(to_json(struct(text as x)), 6, length(to_json(struct(text as x))) - 6)")))
    later = F.lit(',"contents":"later"')
    both = F.concat(wrapped(head(own), depth), F.lit(","), wrapped(head(later), depth + 1 + (i % 2).cast("int")))
    page = F.floor(i / 5)
    rows = spark.read.parquet(f"{d}/documents.parquet").where("text is not null").select(page.alias("page"), i.alias("i"), both.alias("both"))
    data = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "both"))), lambda x: x["both"]), ","), F.lit("]"))
    data = F.when(F.col("page") % 20 == 3, F.concat(F.lit("{"), data)).otherwise(data)
    html = F.concat(F.lit("<html><script id="), F.when(F.col("page") % 20 == 5, F.lit("other")).otherwise(F.lit('"serialized-server-data"')), F.lit(' type="json">'), F.regexp_replace(data, "</", "<_"), F.lit("</script></html>"))
    return rows.groupBy("page").agg(html.alias("html"))


@query
def embedded_reviews(spark, d):
    found = embedded.embedded_reviews(embedding_pages(spark, d), limit=3)
    return found.select("page", "rank", "review_id", "rating", "author", "created_at", "depth", F.md5("body").alias("body_md5"))


@query
def embedded_page_status(spark, d):
    pages = embedding_pages(spark, d)
    return embedded.page_status(pages, embedded.embedded_reviews(pages))


# --- the feed as a data source ------------------------------------------------------------------------

#: Applications whose second page is empty, is first answered with 503, is refused, and is no JSON.
HOLE, SLOW, CLOSED, TORN = "1", "2", "3", "4"


def recorded_feed(spark: SparkSession, d: str) -> str:
    """The folder of the feeds' recorded answers: documents as entries, fifty a page, for six applications."""
    i = F.col("doc_id")
    rows = spark.read.parquet(f"{d}/documents.parquet").select((i % 6).cast("string").alias("app"), (F.floor(F.floor(i / 6) / 50) + 1).cast("int").alias("page"), i.alias("i"), "text")
    label = lambda c: F.struct(c.cast("string").alias("label"))
    stars = F.when(F.col("i") % 20 != 7, F.col("i") % 5 + 1)
    entry = F.struct(label(F.col("i")).alias("id"), label(F.lit("t")).alias("title"), label(F.col("text")).alias("content"), label(stars).alias("im:rating"), label(F.lit("1.0")).alias("im:version"), F.struct(label(F.concat(F.lit("user "), (F.col("i") % 17).cast("string"))).alias("name")).alias("author"), label(F.lit("2024-03-01T00:00:00Z")).alias("updated"))
    pages = rows.withColumn("entry", F.to_json(entry)).groupBy("app", "page").agg(F.concat(F.lit('{"feed":{"entry":['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "entry"))), lambda x: x["entry"]), ","), F.lit("]}}")).alias("body"))
    second = lambda app: (F.col("page") == 2) & (F.col("app") == app)
    body = F.when(second(HOLE), '{"feed":{}}').when(second(TORN), F.expr("substr(body, 1, length(body) - 3)")).otherwise(F.col("body"))
    answer = lambda turn, status, text: F.struct(F.lit(turn).alias("turn"), F.lit(status).alias("status"), F.lit("0").alias("retryAfter"), text.alias("body"))
    none = F.lit(None).cast("string")
    turns = F.when(second(SLOW), F.array(answer(1, 503, none), answer(2, 429, none), answer(3, 200, body))).when(second(CLOSED), F.array(answer(1, 403, none))).otherwise(F.array(answer(1, 200, body)))
    lookup = rows.select("app").distinct().select("app", F.lit(0).alias("page"), F.array(answer(1, 200, F.to_json(F.struct(F.array(F.struct(F.when(F.col("app") != HOLE, F.concat(F.lit("Name "), "app")).alias("trackName"), F.lit("Maker").alias("artistName"))).alias("results"))))).alias("turns"))
    path = new_path(spark, "feed")
    lines = pages.select("app", "page", turns.alias("turns")).unionByName(lookup).select("app", "page", F.explode("turns").alias("x"))
    lines.select("app", "page", F.to_json("x").alias("value")).repartition("app", "page").write.partitionBy("app", "page").text(path)
    return path


def feed(spark: SparkSession, path: str, table: str) -> DataFrame:
    spark.dataSource.register(feed_source.AppReviews)
    return spark.read.format("app-reviews").options(path=path, table=table, pause="0", onError="skip").load()


@query
def feed_pages(spark, d):
    return feed(spark, recorded_feed(spark, d), "pages").drop("source")


@query
def feed_completeness(spark, d):
    return feed_source.completeness(feed(spark, recorded_feed(spark, d), "pages"), 10**9)


@query
def feed_reviews(spark, d):
    path = recorded_feed(spark, d)
    complete = feed_source.completeness(feed(spark, path, "pages"), 10**9)
    rows = feed_source.within(feed(spark, path, "reviews"), complete, 10**9)
    return rows.select("app_id", "page", "place", "review_id", "rating", "author", "created_at", F.md5("body").alias("body_md5"))


@query
def feed_apps(spark, d):
    return feed(spark, recorded_feed(spark, d), "apps").select("source", "app_id", "name", "developer")


# --- streams ------------------------------------------------------------------------------------------


@query
def stream_newest_reviews(spark, d):
    """The newest record of each review after a stream has brought all records in four batches, in no order."""
    folder, table = new_path(spark, "arrivals"), new_path(spark, "newest")
    raw = raw_reviews(spark, d)
    raw.repartition(4, F.xxhash64("reviewId", "ordinal")).write.parquet(folder)
    for key, value in newest.STATE_STORE.items():
        spark.conf.set(key, value)
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    newest.follow(stream, table, new_path(spark, "progress"), RUN).awaitTermination()
    rows = newest.table_of(spark, table, newest.record_schema(raw, RUN))
    return rows.select(*APP, "review_id", "body", iso(F.col("updated_at")).alias("updated"), "ordinal", "position")


# --- counts by day, findings, comparison --------------------------------------------------------------


def day_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """detail and sums of all reviews, which came in two parts."""
    path, rows = new_path(spark, "daily"), themed(spark, d)
    half = F.col("review_id").cast("long") % 3 == 0
    for part in (rows.where(half), rows.where(~half)):
        daily.add(spark, path, daily.detail(part))
    return daily.read(spark, path, "detail"), daily.read(spark, path, "sums")


@query
def trend_as_of(spark, d):
    """Trends as of five anchors of each application: its newest review, and 7.3 days earlier each time."""
    detail, sums = day_tables(spark, d)
    newest_ms = detail.groupBy(*APP).agg(F.max("created_ms").alias("newest"))
    anchors = newest_ms.select(*APP, F.explode(F.array(*(F.col("newest") - F.lit(k * 630_720_000) for k in range(5)))).alias("anchor"))
    return daily.windows(detail, sums, anchors)


@query
def timeline_from_days(spark, d):
    return daily.timeline(day_tables(spark, d)[1])


@query
def theme_order(spark, d):
    """The themes of each application by priority, with their ranks."""
    rows = A.theme_summary(themed(spark, d))
    return A.top(rows, APP, [F.desc("priority_score"), F.desc("count"), F.asc("ordinal")], 1 << 30).select(*APP, "theme", "priority_score", "rank")


@query
def insight_evidence(spark, d):
    rows = themed(spark, d)
    found = insight_rules.insights(A.theme_summary(rows), A.version_summary(rows), A.sample_summary(rows))
    return insight_rules.insight_evidence(found, rows).select(*APP, "id", "kind", "rank", "evidence.review_id")


@query
def comparison_opportunities_all(spark, d):
    """Opportunities of every pair of applications that follow each other by name, in a table of pairs."""
    themes = A.theme_summary(themed(spark, d))
    apps = themes.select(*APP).distinct()
    number = F.regexp_extract("app_id", r"(\d+)$", 1).cast("int")
    pairs = apps.select(*APP, F.col("source").alias("other_source"), F.concat(F.lit("app-"), ((number + 1) % 3).cast("string")).alias("other_app_id"))
    return compare.opportunities(compare.theme_gaps(pairs, themes)).drop("ordinal", "label", "theme")


# --- the CSV file -------------------------------------------------------------------------------------


@query
def csv_file_lines(spark, d):
    """The lines of one CSV file with the reviews of all applications, read back as text."""
    from .plans import render

    path = new_path(spark, "reviews") + ".csv"
    render.write_csv_file(reviews(spark, d), path)
    return spark.read.option("lineSep", "\r\n").text(path).select(F.col("value").alias("line"))
