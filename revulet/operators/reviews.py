"""Normalising, deduplicating and describing review records."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WHITE, clean_text

APP = ["source", "app_id"]
KEY = [*APP, "review_id"]
DAY_MS = 86_400_000


def _first(df: DataFrame, *names: str) -> Column:
    """The first of these columns that has a value; null if the frame has none of them."""
    there = {c.lower(): c for c in df.columns}
    found = [F.col(f"`{there[n.lower()]}`") for n in names if n.lower() in there]
    return F.coalesce(*found) if found else F.lit(None)


def iso(time: Column) -> Column:
    """UTC time with milliseconds, as text."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _keyed(raw: DataFrame, run_time: datetime | None) -> DataFrame:
    """Records of any of the accepted shapes with the fields of reviews, texts as they are."""
    moment = F.lit(run_time or datetime.now(timezone.utc)).cast("timestamp")
    plain = lambda *names: _first(raw, *names).cast("string")
    when = lambda *names: F.coalesce(plain(*names).try_cast("timestamp"), moment)
    number = lambda *names: plain(*names).try_cast("double")
    rating = number("rating", "score")
    fine = rating.isNotNull() & ~F.isnan(rating) & (F.abs(rating) != float("inf"))
    helpful = number("helpful_count", "helpfulCount", "thumbs_up", "thumbsUp")
    reply = _first(raw, "reply")
    if "reply" not in [c.lower() for c in raw.columns] and "replytext" in [c.lower() for c in raw.columns]:
        reply = F.when(F.nullif(_first(raw, "replyText"), F.lit("")).isNotNull(), F.struct(plain("replyText").alias("body"), plain("replyDate").alias("created_at")))
    out = raw.select(
        F.coalesce(plain("source"), F.lit("unknown")).alias("source"),
        F.coalesce(plain("app_id", "appId"), F.lit("unknown")).alias("app_id"),
        plain("review_id", "reviewId", "id").alias("review_id"),
        plain("title").alias("title"),
        plain("body", "text").alias("body"),
        F.when(fine, F.least(F.lit(5.0), F.greatest(F.lit(1.0), rating))).otherwise(F.lit(0.0)).alias("rating"),
        plain("language").alias("language"),
        F.upper(plain("country")).alias("country"),
        plain("app_version", "appVersion", "version").alias("app_version"),
        plain("author", "user_name", "userName").alias("author"),
        F.when(helpful.isNull() | F.isnan(helpful), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), helpful)).alias("helpful_count"),
        reply.cast("struct<body:string,created_at:string>").alias("reply"),
        plain("source_url", "sourceUrl").alias("source_url"),
        when("created_at", "createdAt", "date", "updated_at", "updatedAt").alias("created_at"),
        when("updated_at", "updatedAt", "created_at", "createdAt", "date").alias("updated_at"),
        (F.col("ordinal").cast("long") if "ordinal" in raw.columns else F.monotonically_increasing_id()).alias("ordinal"),
    )
    made = F.substring(F.sha2(F.concat_ws(":", "source", _text("body"), iso(F.col("created_at"))), 256), 1, 24)
    return out.withColumn("review_id", F.coalesce("review_id", made))


def _text(name: str) -> Column:
    return F.coalesce(clean_text(F.col(name)), F.lit(""))


def _cleaned(rows: DataFrame) -> DataFrame:
    some = lambda name: F.nullif(_text(name), F.lit(""))
    return rows.withColumns({"title": _text("title"), "body": _text("body"), "app_version": some("app_version"), "author": F.coalesce(some("author"), F.lit("Anonymous"))})


def normalize(raw: DataFrame, run_time: datetime | None = None) -> DataFrame:
    """Records of any of the accepted shapes as reviews of 15 fields and ordinal.

    Accepted are camel or snake case and the stores' own names (text, score, date, version, userName, thumbsUp, id).
    Texts lose their markup; ratings are held to 1..5, 0 if not a number; dates that can't be read become run_time
    (now, if not given). A missing review id is made of source, body and date. ordinal, the row's place in its source
    and the last tie-break everywhere, is taken over if there, else numbered in file order.
    """
    return _cleaned(_keyed(raw, run_time))


def deduplicate(reviews: DataFrame) -> DataFrame:
    """Of rows with the same (source, app_id, review_id) the one updated last, the first of equals.

    position, the least ordinal of the key, is added: reviews are ordered by created_at, newest first, then position.
    """
    newest = Window.partitionBy(*KEY).orderBy(F.desc("updated_at"), "ordinal")
    first = reviews.groupBy(*KEY).agg(F.min("ordinal").alias("position"))
    return reviews.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n").join(first, KEY)


def latest(raw: DataFrame, run_time: datetime | None = None) -> DataFrame:
    """Normalised and deduplicated reviews. Texts are cleaned behind the exchange, and of the kept rows alone."""
    return _cleaned(deduplicate(_keyed(raw, run_time)))


def has_words(text: Column) -> Column:
    """Whether clean_text() leaves anything of a text; the pattern ends at the first sign that stays."""
    return ~text.rlike(f"^(?:{WHITE}|<[^>]+>)*+$")


def clean(raw: DataFrame, run_time: datetime | None = None) -> DataFrame:
    """Normalised and deduplicated reviews that have a body. What uses no body exchanges none: whether there is one is
    seen before the exchange."""
    rows = deduplicate(_keyed(raw, run_time).withColumn("_filled", has_words(F.col("body"))))
    return _cleaned(rows.where("_filled").drop("_filled"))


def with_anchor(rows: DataFrame, apps: DataFrame) -> DataFrame:
    """rows with all columns of apps but _anchor, and recent and previous: whether they fall in the last 30 days up to
    the application's newest review (apps: a row each, _anchor in ms), or in the 30 days before."""
    age = F.col("_anchor") - F.unix_millis("created_at")
    recent, earlier = age <= 30 * DAY_MS, (age > 30 * DAY_MS) & (age <= 60 * DAY_MS)
    return rows.join(apps, APP).withColumns({"recent": recent, "previous": earlier}).drop("_anchor")


def excerpt(body: Column) -> Column:
    return F.when(F.char_length(body) > 220, F.concat(F.substring(body, 1, 217), F.lit("…"))).otherwise(body)


def evidence() -> Column:
    """What a finding cites of a review."""
    return F.struct("review_id", "rating", excerpt(F.col("body")).alias("excerpt"), "author", "app_version", "created_at", "helpful_count", "source_url")


def evidence_score() -> Column:
    return (F.lit(6) - F.col("rating")) * 10 + F.least(F.col("helpful_count"), F.lit(50.0)) + F.unix_millis("created_at") / F.lit(1e12)


def newest() -> list[Column]:
    return [F.desc("created_at"), F.asc("position")]


def top(df: DataFrame, keys: list[str], order: list[Column], count: int) -> DataFrame:
    """The first rows of each group with their rank; partial limits go before the exchange."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= count)


def best_evidence(df: DataFrame, keys: list[str], count: int, before: list[Column] | None = None) -> DataFrame:
    """keys, rank and evidence of the reviews with the highest evidence scores in each group."""
    order = [*(before or []), F.desc(evidence_score()), *newest()]
    return top(df, keys, order, count).select(*keys, "rank", evidence().alias("evidence"))
