"""The two stores' review feeds.

Pages are fetched in tasks, a page or an application each, through a function that takes a url and returns bytes, so
tests and other networks bring their own. What the feeds answer is parsed with DataFrame functions.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import Connector, ConnectorError, Dataset, Source, checked_limit

#: FIXED VALUES: the feed's pages and their size, pauses and bounds of retries.
APPLE_PAGES, APPLE_PAGE, APPLE_FALLBACK = 10, 50, 10
EMPTY_TRIES, EMPTY_PAUSE_MS = 3, 300
ATTEMPTS, TIMEOUT_S, BACKOFF_MS, MOST_WAIT_S = 3, 20, 250, 10
RETRYABLE = (408, 429)
PAGE_DATA = r'<script[^>]*id="?serialized-server-data"?[^>]*>(.*?)</script>'

Fetch = Callable[[str], bytes]
ENTRY = "struct<id:struct<label:string>,title:struct<label:string>,content:struct<label:string>,`im:rating`:struct<label:string>,`im:version`:struct<label:string>,author:struct<name:struct<label:string>>,updated:struct<label:string>>"


class HttpError(Exception):
    def __init__(self, status: int, retry_after: str | None = None):
        super().__init__(f"HTTP {status}")
        self.status, self.retry_after = status, retry_after


def http(url: str, timeout: float = TIMEOUT_S) -> bytes:
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
            return answer.read()
    except urllib.error.HTTPError as e:
        raise HttpError(e.code, e.headers.get("retry-after")) from e


def timeout_s(value: object = None) -> float:
    """A timeout between 1 and 60 seconds; 20 for anything that is no number."""
    try:
        return max(1.0, min(60.0, float(value)))
    except (TypeError, ValueError):
        return float(TIMEOUT_S)


def retry_wait(attempt: int, retry_after: str | None, now: datetime | None = None) -> float:
    """Seconds before the next attempt: what the store asks for in seconds or as a date, up to ten, else a pause that
    doubles."""
    asked = (retry_after or "").strip()
    if asked.isdigit():
        return min(MOST_WAIT_S, int(asked))
    try:
        return max(0.0, min(MOST_WAIT_S, (parsedate_to_datetime(asked) - (now or datetime.now(timezone.utc))).total_seconds()))
    except (TypeError, ValueError):
        pass
    return BACKOFF_MS * 2 ** (attempt - 1) / 1000


def retried(fetch: Fetch, url: str, store: str, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """fetch(url), again after failures that may pass: 408, 429, 5xx and broken connections; 1 to 5 attempts."""
    attempts = max(1, min(5, attempts))
    for attempt in range(1, attempts + 1):
        try:
            return fetch(url)
        except HttpError as e:
            passing = e.status in RETRYABLE or e.status >= 500
            if not passing or attempt == attempts:
                raise ConnectorError(f"{store} answered {e.status}.", store, e.status, passing) from e
            sleep(retry_wait(attempt, e.retry_after))
        except OSError as e:
            if attempt == attempts:
                raise ConnectorError(f"{store} could not be reached.", store, 502, True) from e
            sleep(retry_wait(attempt, None))
    raise AssertionError


def apple_page_url(source: Source, page: int) -> str:
    return f"https://itunes.apple.com/{(source.country or 'us').lower()}/rss/customerreviews/page={page}/id={source.app_id}/sortby=mostrecent/json"


def apple_entries(body: str | None) -> list[dict]:
    feed = json.loads(body or "{}").get("feed", {}).get("entry", [])
    return feed if isinstance(feed, list) else [feed]


def _pages(spark: SparkSession, source: Source, pages: int, fetch: Fetch, attempts: int) -> DataFrame:
    """page, body: one task for each page; an empty answer is asked for again."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for page in batch.column(0).to_pylist():
                for turn in range(1, EMPTY_TRIES + 1):
                    try:
                        body = retried(fetch, apple_page_url(source, page), "apple-app-store", attempts).decode()
                    except ConnectorError as e:
                        if e.status != 404:
                            raise
                        body = "{}"
                        break
                    if apple_entries(body):
                        break
                    if turn < EMPTY_TRIES:
                        time.sleep(EMPTY_PAUSE_MS * turn / 1000)
                out.append(body)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["page", "body"])

    return spark.range(1, pages + 1, numPartitions=pages).select(F.col("id").alias("page")).mapInArrow(read, "page long, body string")


def apple_reviews(pages: DataFrame, source: Source) -> DataFrame:
    """Raw reviews of feed pages (page, body); entries without rating or text, such as the application's own, are no
    reviews."""
    entries = F.coalesce(
        F.from_json(F.get_json_object("body", "$.feed.entry"), f"array<{ENTRY}>"),
        F.array(F.from_json(F.get_json_object("body", "$.feed.entry"), ENTRY)),
    )
    rows = pages.select("page", F.posexplode(entries).alias("place", "e")).where("e.`im:rating`.label is not null and e.content.label is not null")
    return rows.select(
        F.lit("apple-app-store").alias("source"),
        F.lit(source.app_id).alias("app_id"),
        F.col("e.id.label").alias("review_id"),
        F.col("e.title.label").alias("title"),
        F.col("e.content.label").alias("body"),
        F.col("e.`im:rating`.label").alias("rating"),
        F.lit(source.country or "US").alias("country"),
        F.col("e.`im:version`.label").alias("app_version"),
        F.col("e.author.name.label").alias("author"),
        F.lit(source.canonical_url).cast("string").alias("source_url"),
        F.col("e.updated.label").alias("created_at"),
        (F.col("page") * 1000 + F.col("place")).alias("ordinal"),
        "page",
    )


def completeness(counts: dict[int, int], pages: int, limit: int) -> tuple[str | None, bool]:
    """Why paging stopped and whether the sample is partial, of the number of reviews on each page."""
    total = 0
    for page in range(1, pages + 1):
        n = counts.get(page, 0)
        total += n
        if n == 0:
            return ("empty-feed", True) if page == 1 else ("empty-page", True)
        if total >= limit:
            return "requested-limit", False
        if n < APPLE_PAGE:
            return "end-of-feed", False
    return None, True


def walk_reviews(data: object) -> Iterator[dict]:
    """Objects with $kind Review anywhere in decoded JSON, level by level."""
    level = [data]
    while level:
        below: list[object] = []
        for item in level:
            if isinstance(item, dict):
                if item.get("$kind") == "Review":
                    yield item
                below.extend(item.values())
            elif isinstance(item, list):
                below.extend(item)
        level = below


def page_reviews(page: str, source: Source, limit: int = APPLE_FALLBACK) -> list[dict]:
    """Raw reviews embedded in an application's page: with id, text and 1 to 5 stars, each id once."""
    m = re.search(PAGE_DATA, page, re.S | re.I)
    if m is None:
        return []
    try:
        data = json.loads(m.group(1))
    except ValueError as e:
        raise ConnectorError("The page's data can't be read.", "apple-app-store", 502, True) from e
    found: dict[str, dict] = {}
    for r in walk_reviews(data):
        name, body, rating = r.get("id"), r.get("contents"), r.get("rating")
        if name and body and isinstance(rating, (int, float)) and 1 <= rating <= 5 and str(name) not in found:
            found[str(name)] = {"source": "apple-app-store", "app_id": source.app_id, "review_id": str(name), "title": r.get("title"), "body": body, "rating": float(rating), "author": r.get("reviewerName"), "country": source.country or "US", "created_at": r.get("date"), "source_url": source.canonical_url}
    return list(found.values())[:limit]


PAGE_SCHEMA = "source string, app_id string, review_id string, title string, body string, rating double, author string, country string, created_at string, source_url string, ordinal long"


def apple_connector(fetch: Fetch = http) -> Connector:
    def run(spark: SparkSession, source: Source, options: dict) -> Dataset:
        limit = checked_limit(options.get("limit") or APPLE_PAGES * APPLE_PAGE, APPLE_PAGES * APPLE_PAGE)
        pages = min(APPLE_PAGES, -(-limit // APPLE_PAGE))
        from ..storage import cut

        rows = cut(apple_reviews(_pages(spark, source, pages, fetch, options.get("attempts") or ATTEMPTS), source))
        counts = {r["page"]: r["count"] for r in rows.groupBy("page").count().collect()}
        reason, partial = completeness(counts, pages, limit)
        if reason == "empty-feed":
            found = page_reviews(retried(fetch, source.canonical_url or "", "apple-app-store").decode(), source, min(limit, APPLE_FALLBACK)) if source.canonical_url else []
            rows = spark.createDataFrame([{**r, "ordinal": i} for i, r in enumerate(found)], PAGE_SCHEMA)
        else:
            last = max((p for p in counts if all(q in counts for q in range(1, p + 1))), default=0)
            rows = rows.where(F.col("page") <= last).orderBy("ordinal").limit(limit).drop("page")
        return Dataset({"source": "apple-app-store", "app_id": source.app_id, "name": source.app_id}, rows, {"connector": "apple-app-store", "partial_results": partial, "pagination_stop_reason": reason, "pages_fetched": len(counts), "fallback_used": reason == "empty-feed"})

    return Connector("apple-app-store", "Apple App Store", lambda s: s.store == "apple-app-store", run, "1")


def google_reviews(records: DataFrame, source: Source) -> DataFrame:
    """Raw reviews of records as scrapers of the other store return them (id, userName, date, score, text, replyText …)."""
    return records.withColumns({"source": F.lit("google-play"), "app_id": F.lit(source.app_id), "country": F.lit(source.country).cast("string"), "language": F.lit((source.language or "en").split("-")[0].lower())})


def google_connector(scrape: Callable[[SparkSession, Source, dict], DataFrame] | None = None) -> Connector:
    """The other store has no public feed: scrape(spark, source, options) brings its records."""

    def run(spark: SparkSession, source: Source, options: dict) -> Dataset:
        if scrape is None:
            raise ConnectorError("Records of this store need a scraper.", "google-play", 501)
        limit = checked_limit(options.get("limit"))
        return Dataset({"source": "google-play", "app_id": source.app_id, "name": source.app_id}, google_reviews(scrape(spark, source, options), source).limit(limit), {"connector": "google-play"})

    return Connector("google-play", "Google Play", lambda s: s.store == "google-play", run, "1")
