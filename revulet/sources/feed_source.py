"""The first store's review feed as a data source: spark.read.format("app-reviews") and its stream.

    spark.dataSource.register(AppReviews)
    spark.read.format("app-reviews").option("path", folder).option("table", "reviews").load()

Every page of every application is a partition, which fetches it with retries. Pages come from a folder of recorded
answers, app=<id>/page=<number>/ with a JSON line (turn, status, retryAfter, body) for each time the page was asked for; page 0 is the
application's own record. Tables: `reviews`, `pages` (a log row for each page: entries, kept, attempts, status, error)
and `apps`. Options: attempts (1 to 5), pageSize, country, pause (factor of the waits between attempts), onError
(`raise`, or `skip` pages that fail). The stream has a folder tick=<number>/ for each page that was recorded
later; its offset is the number of ticks taken in, so what a stopped query read last is read again as it was.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .registry import ConnectorError
from .stores import APPLE_PAGE, ATTEMPTS, EMPTY_PAUSE_MS, EMPTY_TRIES, HttpError, apple_entries, retried

STORE = "apple-app-store"
SCHEMAS = {
    "reviews": "source string, app_id string, page int, place int, review_id string, title string, body string, rating string, country string, app_version string, author string, source_url string, created_at string, ordinal long",
    "pages": "source string, app_id string, page int, entries int, kept int, attempts int, status int, retryable boolean, error string",
    "apps": "source string, app_id string, name string, developer string, icon string, url string",
}


@dataclass
class Page(InputPartition):
    """One page of one application, recorded in a folder."""

    app_id: str
    page: int
    folder: str

    def __init__(self, app_id: str, page: int, folder: str):
        self.app_id, self.page, self.folder = app_id, page, folder


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def folders(path: str, name: str) -> list[tuple[str, str]]:
    """Value and path of the folders name=value directly below path."""
    from pyarrow import fs

    system, root = _files(path)
    found = [f for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.Directory and f.base_name.startswith(f"{name}=")]
    return sorted((f.base_name[len(name) + 1 :], f"{path.rstrip('/')}/{f.base_name}") for f in found)


class Recorded:
    """The answers recorded for one page: each call gives the next, the last one stays."""

    def __init__(self, folder: str):
        from pyarrow import fs

        system, root = _files(folder)
        lines = []
        for file in sorted(f.path for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))):
            with system.open_input_stream(file) as stream:
                lines += [json.loads(x) for x in stream.read().decode().splitlines() if x.strip()]
        self.answers, self.calls = sorted(lines, key=lambda x: x.get("turn", 1)), 0

    def __call__(self, url: str) -> bytes:
        if not self.answers:
            raise HttpError(404)
        answer = self.answers[min(self.calls, len(self.answers) - 1)]
        self.calls += 1
        if answer.get("status", 200) != 200:
            raise HttpError(answer["status"], answer.get("retryAfter"))
        return (answer.get("body") or "").encode()


@dataclass
class Settings:
    attempts: int = ATTEMPTS
    page_size: int = APPLE_PAGE
    country: str = "US"
    pause: float = 1.0
    skip: bool = False

    @classmethod
    def of(cls, options) -> Settings:
        skip = options.get("onError", "raise")
        if skip not in ("raise", "skip"):
            raise ValueError("onError is raise or skip.")
        return cls(int(options.get("attempts", ATTEMPTS)), int(options.get("pageSize", APPLE_PAGE)), options.get("country", "US").upper(), float(options.get("pause", 1)), skip == "skip")


def _fetched(part: Page, settings: Settings) -> tuple[list[dict], dict, ConnectorError | None]:
    """A page's entries and its log; an empty answer is asked for again, 404 is an empty page."""
    fetch = Recorded(part.folder)
    sleep = lambda seconds: time.sleep(seconds * settings.pause)
    entries: list[dict] = []
    log = {"status": 200, "retryable": False, "error": None}
    failure = None
    for turn in range(1, EMPTY_TRIES + 1):
        try:
            entries = apple_entries(retried(fetch, part.folder, STORE, settings.attempts, sleep).decode())
        except ConnectorError as e:
            log["status"] = e.status
            if e.status != 404:
                log |= {"retryable": e.retryable, "error": str(e)}
                failure = e
            break
        except ValueError as e:
            failure = ConnectorError("The feed's answer is no JSON.", STORE, 502, False)
            failure.__cause__ = e
            log |= {"status": 502, "error": str(failure)}
            break
        if entries:
            break
        if turn < EMPTY_TRIES:
            sleep(EMPTY_PAUSE_MS * turn / 1000)
    return entries, log | {"attempts": fetch.calls, "entries": len(entries)}, failure


def _label(entry: dict, *path: str) -> str | None:
    for name in path:
        entry = entry.get(name) if isinstance(entry, dict) else None
    return entry.get("label") if isinstance(entry, dict) else None


def _reviews(part: Page, entries: list[dict], country: str) -> Iterator[tuple]:
    for place, e in enumerate(entries):
        rating, body = _label(e, "im:rating"), _label(e, "content")
        if rating and body:
            yield STORE, part.app_id, part.page, place, _label(e, "id"), _label(e, "title"), body, str(rating), country, _label(e, "im:version"), _label(e, "author", "name"), None, _label(e, "updated"), part.page * 1000 + place


class Reader(DataSourceReader):
    def __init__(self, path: str, table: str, settings: Settings):
        self.path, self.table, self.settings = path, table, settings

    def partitions(self) -> list[InputPartition]:
        pages = [Page(app, int(page), folder) for app, own in folders(self.path, "app") for page, folder in folders(own, "page")]
        return [p for p in pages if (p.page == 0) == (self.table == "apps")] or [Page("", -1, "")]

    def read(self, part: Page) -> Iterator[tuple]:
        if part.page < 0:
            return
        if self.table == "apps":
            record = json.loads(retried(Recorded(part.folder), part.folder, STORE, self.settings.attempts, lambda s: time.sleep(s * self.settings.pause)).decode() or "{}")
            found = (record.get("results") or [None])[0]
            if found is None:
                raise ConnectorError("There is no such application.", STORE, 404)
            yield STORE, part.app_id, found.get("trackName") or f"App {part.app_id}", found.get("artistName"), found.get("artworkUrl100"), found.get("trackViewUrl")
            return
        entries, log, failure = _fetched(part, self.settings)
        rows = list(_reviews(part, entries, self.settings.country))
        if self.table == "pages":
            yield STORE, part.app_id, part.page, log["entries"], len(rows), log["attempts"], log["status"], log["retryable"], log["error"]
        elif failure and not self.settings.skip:
            raise failure
        else:
            yield from rows


class Ticks(DataSourceStreamReader):
    """Pages in the order in which they were recorded."""

    def __init__(self, path: str, settings: Settings):
        self.path, self.settings = path, settings

    def initialOffset(self) -> dict:
        return {"ticks": 0}

    def latestOffset(self) -> dict:
        return {"ticks": len(folders(self.path, "tick"))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Page(app, int(page), folder) for _, tick in folders(self.path, "tick")[start["ticks"] : end["ticks"]] for app, own in folders(tick, "app") for page, folder in folders(own, "page")]

    def read(self, part: Page) -> Iterator[tuple]:
        entries, _, failure = _fetched(part, self.settings)
        if failure and not self.settings.skip:
            raise failure
        yield from _reviews(part, entries, self.settings.country)

    def commit(self, end: dict) -> None:
        """Nothing is held for pages taken in."""


class AppReviews(DataSource):
    @classmethod
    def name(cls) -> str:
        return "app-reviews"

    def _table(self) -> str:
        table = self.options.get("table", "reviews")
        if table not in SCHEMAS:
            raise ValueError(f"table is one of {', '.join(SCHEMAS)}.")
        return table

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("app-reviews needs a path.")
        return self.options["path"]

    def schema(self) -> str:
        return SCHEMAS[self._table()]

    def reader(self, schema) -> DataSourceReader:
        return Reader(self._path(), self._table(), Settings.of(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Ticks(self._path(), Settings.of(self.options))


def completeness(pages: DataFrame, limit: int, page_size: int = APPLE_PAGE) -> DataFrame:
    """source, app_id, stop_page, stop_reason, partial_results, pages_fetched, returned_reviews of each application in
    the `pages` table: where reading stops, and why.

    The first page that has no entries stops it (`empty-feed`, or `empty-page` after reviews; partial), else the page
    with which `limit` reviews are there (`requested-limit`), or that has fewer entries than a page (`end-of-feed`). A page
    that failed stops it too (`failed-page`, partial). With none of these all pages were full: no reason, and partial.
    """
    own = Window.partitionBy("source", "app_id").orderBy("page")
    total = F.sum("kept").over(own)
    reason = (
        F.when(F.col("error").isNotNull(), "failed-page")
        .when(F.col("entries") == 0, F.when(total > 0, "empty-page").otherwise("empty-feed"))
        .when(total >= limit, "requested-limit")
        .when(F.col("entries") < page_size, "end-of-feed")
    )
    rows = pages.select("*", total.alias("total"), reason.alias("reason"))
    first = F.when(F.col("reason").isNotNull(), F.col("page"))
    last = rows.groupBy("source", "app_id").agg(F.min(first).alias("stop_page"), F.min_by("reason", first).alias("stop_reason"), F.max("page").alias("last"))
    read = rows.join(last, ["source", "app_id"]).where(F.col("page") <= F.coalesce("stop_page", "last"))
    counts = read.groupBy("source", "app_id", "stop_page", "stop_reason").agg(F.count(F.when(F.col("entries") > 0, 1)).alias("pages_fetched"), F.least(F.max("total"), F.lit(limit)).alias("returned_reviews"))
    fine = F.coalesce(F.col("stop_reason").isin("requested-limit", "end-of-feed"), F.lit(False))
    return counts.select("source", "app_id", "stop_page", "stop_reason", (~fine).alias("partial_results"), "pages_fetched", "returned_reviews")


def within(reviews: DataFrame, complete: DataFrame, limit: int) -> DataFrame:
    """The reviews of the pages up to which completeness() read, `limit` of each application at most."""
    rows = reviews.join(complete.select("source", "app_id", "stop_page"), ["source", "app_id"]).where(F.col("stop_page").isNull() | (F.col("page") <= F.col("stop_page")))
    order = Window.partitionBy("source", "app_id").orderBy("page", "place")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n", "stop_page")
