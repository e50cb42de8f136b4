"""Mining of repeated phrases that no theme covers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.numeric import half_up, mean0, share, trend
from ..functions.text import CJK, LETTERS, kept_apart, once, stem, wide
from ..storage import cut
from .reviews import APP, DAY_MS, best_evidence, top

LIMIT, OVERLAP, PHRASE_BOOST = 6, 0.65, 1.35
_STOP = fixed.PHRASE_STOP_WORDS


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def composed(text: Column) -> Column:
    """The text in compatibility composition; ASCII texts, which are that already, stay in the JVM."""
    other = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.coalesce(_nfkc(other), text)


def features(text: Column) -> Column:
    """Features of a lower-case text, in order, as array of (feature, label): stems, pairs of neighbouring stems, and two
    and three letters of CJK runs. A stem's label is the word, a pair's the words."""
    raw = F.regexp_extract_all(text, F.lit(f"[{LETTERS}][{LETTERS}'-]{{2,}}"), F.lit(0))
    pairs = F.transform(raw, lambda t: F.struct(stem(t).alias("feature"), t.alias("label")))
    tokens = F.filter(pairs, lambda t: (F.char_length(t["feature"]) >= 3) & ~t["feature"].isin(*_STOP))
    joined = lambda a, b: F.struct(F.concat_ws(" ", a["feature"], b["feature"]).alias("feature"), F.concat_ws(" ", a["label"], b["label"]).alias("label"))

    def couples(found: Column) -> Column:
        less = F.greatest(F.size(found) - 1, F.lit(0))
        return F.concat(found, F.zip_with(F.slice(found, F.lit(1), less), F.slice(found, F.lit(2), less), joined))

    def grams(run: Column, k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.char_length(run) - k + 1), lambda i: F.substring(run, i, F.lit(k)))

    runs = F.regexp_extract_all(text, F.lit(f"[{CJK}]{{3,}}"), F.lit(0))
    cut_runs = F.flatten(F.transform(runs, lambda r: F.concat(grams(r, 2), grams(r, 3))))
    cjk = F.transform(F.filter(cut_runs, lambda x: ~x.isin(*_STOP)), lambda x: F.struct(x.alias("feature"), x.alias("label")))
    words = once(tokens, couples)
    return F.when(wide(text), F.concat(words, cjk)).otherwise(words)


def phrase_features(reviews: DataFrame) -> DataFrame:
    """A row for each low-rated review and feature: keys, rating, created_at, position, feature, label, place."""
    columns = [*APP, "review_id", "rating", "created_at", "position", "app_version"]
    rows = kept_apart(reviews.where(F.col("rating") <= 3), "body").where("body <> ''")
    rows = kept_apart(rows.select(*columns, composed(F.col("body")).alias("_text")), "_text")
    flat = rows.select(*columns, F.posexplode(features(F.lower("_text"))).alias("place", "x")).select(*columns, "place", "x.feature", "x.label")
    # A review counts once for a feature, with the label it used last.
    one = flat.groupBy(*APP, "review_id", "feature").agg(F.min("place").alias("place"), F.max_by("label", "place").alias("label"), *(F.first(c).alias(c) for c in ("rating", "created_at", "position", "app_version")))
    return one


def candidates(flat: DataFrame) -> DataFrame:
    """Phrases and CJK features in at least two and at most four fifths of an application's documents, with score."""
    totals = flat.select(*APP, "review_id").distinct().groupBy(*APP).agg(F.count("*").alias("documents")).where("documents >= 2")
    rows = flat.where(F.col("feature").contains(" ") | F.col("feature").rlike(f"[{CJK}]")).groupBy(*APP, "feature").agg(
        F.count("*").alias("count"),
        half_up(mean0(F.col("rating")), 2).alias("average_rating"),
        F.min(F.struct((-F.unix_millis("created_at")).alias("t"), "position", "place")).alias("seen"),
    )
    most = F.greatest(F.lit(3), F.ceil(F.col("documents") * F.lit(0.8)))
    kept = rows.join(totals, APP).where((F.col("count") >= 2) & (F.col("count") <= most))
    boost = F.when(F.col("feature").contains(" "), PHRASE_BOOST).otherwise(1.0)
    specific = F.ln((F.col("documents") + 1) / (F.col("count") + 0.5)) + 1
    return kept.withColumn("score", half_up(F.col("count") * (F.lit(6) - F.col("average_rating")) * specific * boost, 3))


def select_distinct(found: DataFrame, flat: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Of each application's candidates, by score, count and appearance, those whose documents overlap with no selected
    one's by OVERLAP or more; at most limit, with rank. A round selects one candidate of every application and drops
    all that it overlaps, so no group is gathered in one place."""
    order = [F.desc("score"), F.desc("count"), F.asc("seen")]
    left = cut(found)
    places = cut(flat.select(*APP, "feature", "review_id").join(found.select(*APP, "feature"), [*APP, "feature"]))
    chosen = None
    for rank in range(1, limit + 1):
        best = cut(top(left, APP, order, 1).drop("rank"))
        if best.isEmpty():
            break
        chosen = best.withColumn("rank", F.lit(rank)) if chosen is None else chosen.unionByName(best.withColumn("rank", F.lit(rank)))
        if rank == limit:
            break
        theirs = places.join(best.select(*APP, "feature"), [*APP, "feature"]).select(*APP, "review_id")
        common = places.join(theirs, [*APP, "review_id"]).groupBy(*APP, "feature").agg(F.count("*").alias("_common"))
        sized = left.join(best.select(*APP, F.col("count").alias("_best")), APP).join(common, [*APP, "feature"], "left")
        near = F.coalesce(F.col("_common"), F.lit(0)) / F.least("count", "_best") >= OVERLAP
        left = cut(sized.where(~near).drop("_common", "_best"))
    return chosen if chosen is not None else left.withColumn("rank", F.lit(0)).limit(0)


def discovered_issues(unclassified: DataFrame, totals: DataFrame, anchors: DataFrame | None = None, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """Issues and their reviews, of reviews that no theme covers.

    totals (source, app_id, total) gives the number that shares refer to; anchors (source, app_id, anchor in ms) the
    end of the recent window, else the newest review with a feature. The first frame has a row for each issue: id,
    label, fingerprint, count, share, average_rating, recent_count, previous_count, trend_percent, score, rank. The
    second has a row for each issue and review.
    """
    flat = cut(phrase_features(unclassified))
    chosen = select_distinct(candidates(flat), flat, limit)
    items = flat.join(chosen.select(*APP, "feature", "rank"), [*APP, "feature"])
    if anchors is None:
        anchors = flat.groupBy(*APP).agg(F.max(F.unix_millis("created_at")).alias("anchor"))
    age = F.col("anchor") - F.unix_millis("created_at")
    dated = items.join(anchors, APP)
    windows = dated.groupBy(*APP, "feature").agg(
        F.count(F.when(age <= 30 * DAY_MS, 1)).alias("recent_count"), F.count(F.when((age > 30 * DAY_MS) & (age <= 60 * DAY_MS), 1)).alias("previous_count")
    )
    seen = F.min(F.struct((-F.unix_millis("created_at")).alias("t"), "position"))
    labels = items.groupBy(*APP, "feature", "label").agg(F.count("*").alias("uses"), seen.alias("first"))
    label = top(labels, [*APP, "feature"], [F.desc("uses"), F.desc(F.char_length("label")), F.asc("first")], 1).select(*APP, "feature", "label")
    out = chosen.join(windows, [*APP, "feature"]).join(label, [*APP, "feature"]).join(totals, APP, "left")
    issue_id = F.concat(F.lit("discovered-"), F.substring(F.sha2("feature", 256), 1, 12))
    issues = out.select(
        *APP,
        issue_id.alias("id"),
        "label",
        F.col("feature").alias("fingerprint"),
        "count",
        share(F.col("count"), F.coalesce("total", F.lit(0))).alias("share"),
        "average_rating",
        "recent_count",
        "previous_count",
        trend(F.col("recent_count"), F.col("previous_count")).alias("trend_percent"),
        "score",
        "rank",
    )
    return issues, items.select(*APP, issue_id.alias("id"), "review_id", "app_version", "rating", "created_at", "position")


def issue_versions(items: DataFrame) -> DataFrame:
    """id, app_version, count: how many of an issue's reviews are of each version."""
    return items.where("app_version is not null").groupBy(*APP, "id", "app_version").agg(F.count("*").alias("count"))


def issue_evidence(items: DataFrame, reviews: DataFrame, count: int = 4) -> DataFrame:
    """The reviews to cite for each issue: source, app_id, id, rank, evidence."""
    rows = reviews.join(items.select(*APP, "review_id", "id"), [*APP, "review_id"])
    return best_evidence(rows, [*APP, "id"], count)
