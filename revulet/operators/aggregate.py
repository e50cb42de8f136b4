"""Aggregates of reviews for each application: samples, themes, versions, months, countries, words.

Inputs are clean reviews (see reviews.clean) and, where themes are counted, classified ones (see classify.classify).
Theme counts are conditional sums in one aggregation over the reviews; a row for each theme is made of its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import fixed
from ..functions.text import kept_apart, strings
from ..functions.numeric import half_up, mean0, share, trend
from .reviews import APP, best_evidence, evidence, iso, newest, top, with_anchor

def low() -> Column:
    return F.col("rating") <= 3


def negative() -> Column:
    return F.col("rating") <= 2


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def sample_summary(reviews: DataFrame) -> DataFrame:
    """total, average_rating (of rated reviews), negative_share, first_review_at, last_review_at for each application."""
    return reviews.groupBy(*APP).agg(
        F.count("*").alias("total"),
        half_up(mean0(F.when(F.col("rating") != 0, F.col("rating"))), 2).alias("average_rating"),
        share(_count(negative()), F.count("*")).alias("negative_share"),
        iso(F.min("created_at")).alias("first_review_at"),
        iso(F.max("created_at")).alias("last_review_at"),
    )


def rating_distribution(reviews: DataFrame) -> DataFrame:
    """stars (1 to 5) and count for each application, also where the count is 0; only whole ratings count."""
    wide = reviews.groupBy(*APP).agg(*(_count(F.col("rating") == k).alias(f"n{k}") for k in range(1, 6)))
    return wide.select(*APP, F.explode(F.array(*(F.struct(F.lit(k).alias("stars"), F.col(f"n{k}").alias("count")) for k in range(1, 6)))).alias("x")).select(*APP, "x.stars", "x.count")


def timeline(reviews: DataFrame, months: int = 12) -> DataFrame:
    """period (yyyy-MM), count, average_rating, negative_count of the last months that have reviews."""
    by_month = reviews.groupBy(*APP, F.date_format("created_at", "yyyy-MM").alias("period")).agg(F.count("*").alias("count"), half_up(mean0(F.col("rating")), 2).alias("average_rating"), _count(negative()).alias("negative_count"))
    return top(by_month, APP, [F.desc("period")], months).drop("rank")


def value_counts(reviews: DataFrame, column: str, limit: int = 8) -> DataFrame:
    """value and count of the most frequent values; null and empty are `unknown`; ties in order of appearance."""
    value = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown"))
    seen = F.min(F.struct(-F.unix_millis("created_at"), F.col("position")))
    counts = reviews.groupBy(*APP, value.alias("value")).agg(F.count("*").alias("count"), seen.alias("_seen"))
    return top(counts, APP, [F.desc("count"), F.asc("_seen")], limit).select(*APP, "value", "count", "rank")


KEYWORD = r"[a-z][a-z'-]{2,}|[\u4e00-\u9fff]{2,6}"


def keywords(reviews: DataFrame, apps: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """term, count: words of most low-rated bodies, without stop words and the application's own terms.

    apps (source, app_id, name, developer) names the terms to leave out. Ties are in order of appearance.
    """
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("body"), F.lit(KEYWORD), F.lit(0)))
    stop = strings(fixed.KEYWORD_STOP_WORDS)
    rows = reviews.where(low()).select(*APP, "created_at", "position", F.array_except(tokens, stop).alias("tokens"))
    if apps is not None:
        own = F.regexp_extract_all(F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("developer", F.lit("")))), F.lit(KEYWORD), F.lit(0))
        rows = rows.join(apps.select(*APP, own.alias("_own")), APP, "left").withColumn("tokens", F.when(F.col("_own").isNull(), F.col("tokens")).otherwise(F.array_except("tokens", "_own")))
    flat = rows.select(*APP, "created_at", "position", F.posexplode("tokens").alias("place", "term"))
    seen = F.min(F.struct(-F.unix_millis("created_at"), F.col("position"), F.col("place")))
    counts = flat.groupBy(*APP, "term").agg(F.count("*").alias("count"), seen.alias("_seen"))
    return top(counts, APP, [F.desc("count"), F.asc("_seen")], limit).select(*APP, "term", "count", "rank")


def _mentioned(classified: DataFrame, keys: list[str], *columns: str, itself: str | None = None) -> DataFrame:
    """keys, ordinal, theme, only_asked and these columns: a row for each review and theme that it mentions, of rows as
    narrow as that. Reviews without a theme have none, so there are about as many rows as reviews. If itself is given,
    each review has one more row, with that as its theme."""
    found = [F.when(K.has(t), F.struct(F.lit(i).alias("ordinal"), F.lit(t).alias("theme"), K.only_requested(t).alias("only_asked"))) for i, t in enumerate(fixed.THEMES)]
    if itself is not None:
        found.append(F.struct(F.lit(-1).alias("ordinal"), F.lit(itself).alias("theme"), F.lit(False).alias("only_asked")))
    return classified.select(*keys, *columns, F.explode(F.array_compact(F.array(*found))).alias("x")).select(*keys, *columns, "x.*")


def _described(rows: DataFrame) -> DataFrame:
    """rows with label and intent of their theme."""
    of = lambda k: F.element_at(F.str_to_map(F.lit("|".join(f"{t}:{about[k]}" for t, about in fixed.THEMES.items())), F.lit("[|]")), F.col("theme"))
    return rows.withColumns({"label": of(0), "intent": of(1)})


def theme_summary(classified: DataFrame) -> DataFrame:
    """A row for each application and theme with its counts, shares, ratings, trends and priority_score.

    Complaints are the low-rated mentions but those that only ask for something. negative_count counts complaints.
    """
    # Totals and anchors of all applications, a row each.
    apps = classified.groupBy(*APP).agg(F.count("*").alias("total"), F.max(F.unix_millis("created_at")).alias("_anchor"))
    dated = with_anchor(_mentioned(classified, APP, "rating", "created_at"), apps)
    over = F.col("only_asked") & low()
    complaint = low() & ~F.col("only_asked")
    rows = dated.groupBy(*APP, "total", "ordinal", "theme").agg(
        F.count("*").alias("count"),
        F.avg("rating").alias("average"),
        _count(complaint & negative()).alias("negative_count"),
        _count(complaint).alias("complaint_count"),
        F.avg(F.when(complaint, F.col("rating"))).alias("complaint_average"),
        _count(over).alias("request_overlap_count"),
        _count(F.col("recent")).alias("recent_count"),
        _count(F.col("previous")).alias("previous_count"),
        _count(complaint & F.col("recent")).alias("recent_complaint_count"),
        _count(complaint & F.col("previous")).alias("previous_complaint_count"),
    )
    rows = _described(rows).withColumns(
        {
            "share": share(F.col("count"), F.col("total")),
            "average_rating": half_up(F.coalesce("average", F.lit(0.0)), 2),
            "complaint_share": share(F.col("complaint_count"), F.col("total")),
            "complaint_average_rating": half_up(F.coalesce("complaint_average", F.lit(0.0)), 2),
            "trend_percent": trend(F.col("recent_count"), F.col("previous_count")),
            "complaint_trend_percent": trend(F.col("recent_complaint_count"), F.col("previous_complaint_count")),
        }
    )
    asked = F.col("intent") == "request"
    pick = lambda a, b: F.when(asked, F.col(a)).otherwise(F.col(b))
    rating = pick("average_rating", "complaint_average_rating")
    weight = pick("count", "complaint_count") * (F.lit(6) - F.when(rating == 0, F.lit(3.0)).otherwise(rating))
    rise = F.greatest(F.lit(0), pick("trend_percent", "complaint_trend_percent")) / F.lit(200)
    return rows.withColumn("priority_score", half_up(weight * (F.lit(1) + rise), 1)).drop("average", "complaint_average", "total")


def theme_evidence(classified: DataFrame, complaints: bool = False, count: int = 4) -> DataFrame:
    """The reviews to cite for each theme, or for its complaints: source, app_id, theme, rank, evidence."""
    return best_evidence(mentions(classified, complaints), [*APP, "theme"], count)


def mentions(classified: DataFrame, complaints: bool = False) -> DataFrame:
    """classified reviews, a row for each theme that they mention."""
    keep = {t: (K.has(t) & low() & ~K.only_requested(t)) if complaints else K.has(t) for t in fixed.THEMES}
    found = F.array_compact(F.array(*(F.when(c, F.lit(t)) for t, c in keep.items())))
    return classified.withColumn("theme", F.explode(found)).drop("hits")


def version_order() -> list[Column]:
    """Versions newest first: by all their numbers, those without numbers last, then by the last review."""
    numbers = F.transform(F.regexp_extract_all("app_version", F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("double"))
    zeros = F.aggregate(F.reverse(numbers), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + F.when(a["on"] & (x == 0), 1).otherwise(0)).alias("n"), (a["on"] & (x == 0)).alias("on")))["n"]
    stripped = F.slice(numbers, F.lit(1), F.size(numbers) - zeros)
    return [F.desc(F.size(numbers) > 0), F.desc(stripped), F.desc("last_seen_ms"), F.asc("first_position")]


def version_summary(reviews: DataFrame, limit: int = 12) -> DataFrame:
    """The newest versions of each application: app_version, count, average_rating (unrated ones count as 0),
    negative_share, last_seen_ms and rank, from the newest on."""
    rows = reviews.where("app_version is not null").groupBy(*APP, "app_version").agg(
        F.count("*").alias("count"),
        half_up(F.avg("rating"), 2).alias("average_rating"),
        share(_count(negative()), F.count("*")).alias("negative_share"),
        F.max(F.unix_millis("created_at")).alias("last_seen_ms"),
        F.min("position").alias("first_position"),
    )
    return top(rows, APP, version_order(), limit).drop("first_position")


def version_negative_evidence(reviews: DataFrame, count: int = 3) -> DataFrame:
    """The newest negative reviews of each version."""
    rows = top(reviews.where(negative() & F.col("app_version").isNotNull()), [*APP, "app_version"], newest(), count)
    return rows.select(*APP, "app_version", "rank", evidence().alias("evidence"))


def version_theme_signals(classified: DataFrame) -> DataFrame:
    """A row for each version and theme: counts and shares. negative_count counts all negative mentions."""
    keys = [*APP, "app_version"]
    versioned = classified.where("app_version is not null")
    totals = versioned.groupBy(*keys).agg(F.count("*").alias("total"))
    over = F.col("only_asked") & low()
    rows = _mentioned(versioned, keys, "rating").groupBy(*keys, "ordinal", "theme").agg(
        F.count("*").alias("count"), _count(negative()).alias("negative_count"), _count(low() & ~F.col("only_asked")).alias("complaint_count"), _count(over).alias("request_overlap_count")
    )
    rows = _described(rows.join(totals, keys))
    return rows.withColumns({"share": share(F.col("count"), F.col("total")), "complaint_share": share(F.col("complaint_count"), F.col("total"))}).drop("total")


def version_theme_evidence(classified: DataFrame, complaints: bool = False, count: int = 3) -> DataFrame:
    return best_evidence(mentions(classified.where("app_version is not null"), complaints), [*APP, "app_version", "theme"], count)


def link_level(explicit: Column, linked: Column) -> Column:
    return F.when((explicit >= 2) | ((explicit >= 1) & (linked >= 2)), "supported").when(linked >= 1, "limited").otherwise("none")


def _linked(kind: str) -> Column:
    return F.coalesce(F.col("link.kind") == kind, F.lit(False))


def version_release_link(classified: DataFrame) -> DataFrame:
    """How the low-rated reviews of each version speak of a release: counts, linked_share and level."""
    rows = classified.where("app_version is not null").groupBy(*APP, "app_version").agg(
        _count(low()).alias("low_rating_count"), _count(low() & _linked("explicit")).alias("explicit_count"), _count(low() & _linked("change")).alias("change_count")
    )
    linked = F.col("explicit_count") + F.col("change_count")
    return rows.withColumns({"linked_count": linked, "linked_share": share(linked, F.col("low_rating_count")), "level": link_level(F.col("explicit_count"), linked)})


def link_rank() -> Column:
    return F.when(_linked("explicit"), 2).when(_linked("change"), 1).otherwise(0)


def release_link_evidence(classified: DataFrame, count: int = 4) -> DataFrame:
    """Linked low-rated reviews of each version, explicit ones first."""
    rows = kept_apart(classified.where(low() & F.col("app_version").isNotNull()), "link").where(F.col("link.kind") != "none")
    return best_evidence(rows, [*APP, "app_version"], count, [F.desc(link_rank())])


def version_scope_counts(classified: DataFrame) -> DataFrame:
    """A row for each version and scope: count and share of its low-rated reviews, also where it is 0."""
    is_scope = lambda s: low() & (F.col("scope.primary") == s)
    wide = classified.where("app_version is not null").groupBy(*APP, "app_version").agg(_count(low()).alias("total"), *(_count(is_scope(s)).alias(s) for s in fixed.SCOPES))
    rows = wide.select(*APP, "app_version", "total", F.explode(F.array(*(F.struct(F.lit(s).alias("scope"), F.col(f"`{s}`").alias("count")) for s in fixed.SCOPES))).alias("x"))
    return rows.select(*APP, "app_version", "x.scope", "x.count", share(F.col("x.count"), F.col("total")).alias("share"))


def version_actionability(classified: DataFrame) -> DataFrame:
    """low_rating_count and the software reviews of each version: all, linked to a release, explicitly so."""
    software = low() & (F.col("scope.primary") == "software")
    rows = classified.where("app_version is not null").groupBy(*APP, "app_version").agg(
        _count(low()).alias("low_rating_count"),
        _count(software).alias("software_count"),
        _count(software & (F.col("link.kind") != "none")).alias("release_linked_software_count"),
        _count(software & _linked("explicit")).alias("explicit_release_software_count"),
    )
    return rows.withColumn("software_share", share(F.col("software_count"), F.col("low_rating_count")))


def scope_evidence(classified: DataFrame, count: int = 3) -> DataFrame:
    rows = classified.where(low() & F.col("app_version").isNotNull()).withColumn("category", F.col("scope.primary"))
    return best_evidence(rows, [*APP, "app_version", "category"], count)


def known_issues(classified: DataFrame) -> DataFrame:
    """Software themes that at least two low-rated software reviews of a version share, and whether releases support them."""
    keys = [*APP, "app_version"]
    software = F.col("scope.primary") == "software"
    wide, names = [], {"count": F.lit(True), "release_linked_count": F.col("link.kind") != "none", "explicit_release_count": _linked("explicit")}
    for t in K.SOFTWARE_THEMES:
        own = software & F.array_contains("scope.software_themes", t)
        wide += [_count(own & condition).alias(f"{t}.{name}") for name, condition in names.items()]
    sums = classified.where(low() & F.col("app_version").isNotNull()).groupBy(*keys).agg(F.count("*").alias("total"), *wide)
    rows = F.array(*(F.struct(F.lit(t).alias("theme"), *(F.col(f"`{t}.{n}`").alias(n) for n in names)) for t in K.SOFTWARE_THEMES))
    out = sums.select(*keys, "total", F.explode(F.filter(rows, lambda x: x["count"] >= 2)).alias("x")).select(*keys, "total", "x.*")
    labels = F.element_at(F.create_map(*(x for t, (label, _, _) in fixed.THEMES.items() for x in (F.lit(t), F.lit(label)))), F.col("theme"))
    return out.select(
        *keys,
        F.concat(F.lit("software-"), "theme").alias("id"),
        F.lit("known-theme").alias("kind"),
        labels.alias("label"),
        "count",
        share(F.col("count"), F.col("total")).alias("share"),
        "release_linked_count",
        "explicit_release_count",
        ((F.col("release_linked_count") >= 2) & (F.col("explicit_release_count") >= 1)).alias("supported"),
    )
