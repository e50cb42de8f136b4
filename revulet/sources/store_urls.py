"""Store addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class UnsupportedStoreUrlError(ValueError):
    """An address that is of neither store."""


def source_ref(url: Column) -> Column:
    """The application that a store address names: (store, app_id, country, language, canonical_url); null if none.

    Apple: apps. or itunes.apple.com with /id and digits in the path; a first path segment of two letters is the
    country. Google: play.google.com/store/apps/details with id; gl is the country, hl the language.
    """
    part = lambda name, *key: F.try_parse_url(url, F.lit(name), *(F.lit(k) for k in key))
    host, path = F.lower(part("HOST")), F.coalesce(part("PATH"), F.lit(""))
    web = F.lower(part("PROTOCOL")).isin("http", "https")
    number = F.regexp_extract(path, r"/id(\d+)(?:/|$)", 1)
    first = F.regexp_extract(path, r"^/([A-Za-z]{2})(?:/|$)", 1)
    country = F.when(first != "", F.upper(first))
    apple = F.struct(
        F.lit("apple-app-store").alias("store"),
        number.alias("app_id"),
        country.alias("country"),
        F.lit(None).cast("string").alias("language"),
        F.concat(F.lit("https://apps.apple.com/"), F.lower(F.coalesce(country, F.lit("us"))), F.lit("/app/id"), number).alias("canonical_url"),
    )
    query = lambda key: F.try_url_decode(part("QUERY", key))
    name = query("id")
    google = F.struct(
        F.lit("google-play").alias("store"),
        name.alias("app_id"),
        F.upper(query("gl")).alias("country"),
        query("hl").alias("language"),
        F.concat(F.lit("https://play.google.com/store/apps/details?id="), F.url_encode(name)).alias("canonical_url"),
    )
    return F.when(web & host.isin("apps.apple.com", "itunes.apple.com") & (number != ""), apple).when(web & (host == "play.google.com") & (path == "/store/apps/details") & (F.trim(F.coalesce(name, F.lit(""))) != ""), google)
