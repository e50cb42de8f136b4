"""Comparison of two applications by theme."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_up
from .reviews import APP, top

PAIR = ["source", "app_id", "other_source", "other_app_id"]


def _sides(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    own = pairs.join(rows.select(*APP, *columns), APP)
    other = pairs.join(rows.select(F.col("source").alias("other_source"), F.col("app_id").alias("other_app_id"), *columns), ["other_source", "other_app_id"])
    return own, other


def theme_gaps(pairs: DataFrame, themes: DataFrame) -> DataFrame:
    """For each pair (source, app_id, other_source, other_app_id) and theme that either has: counts, shares and
    share_gap (the other's share less the own), with rank by its size."""
    own, other = _sides(pairs, themes, ["ordinal", "theme", "label", "count", "share"])
    named = lambda df, p: df.select(*PAIR, "ordinal", "theme", "label", F.col("count").alias(f"{p}_count"), F.col("share").alias(f"{p}_share"))
    rows = named(own, "primary").join(named(other, "competitor"), [*PAIR, "ordinal", "theme", "label"], "full_outer").fillna(0, [f"{p}_{n}" for p in ("primary", "competitor") for n in ("count", "share")])
    rows = rows.withColumn("share_gap", half_up(F.col("competitor_share") - F.col("primary_share"), 3))
    return top(rows, PAIR, [F.desc(F.abs("share_gap")), F.asc("ordinal")], 1 << 30)


def opportunities(gaps: DataFrame, limit: int = 4) -> DataFrame:
    """The largest gaps where the other application has two mentions or more and three points more of share."""
    rows = gaps.where((F.col("competitor_count") >= 2) & (F.col("share_gap") >= 0.03)).drop("rank")
    return top(rows, PAIR, [F.desc(F.abs("share_gap")), F.asc("ordinal")], limit).withColumn("id", F.concat(F.lit("competitor-"), "theme"))


def rating_gaps(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """rating_gap: the own average rating less the other's."""
    own, other = _sides(pairs, samples, ["average_rating"])
    both = own.withColumnRenamed("average_rating", "primary_rating").join(other.withColumnRenamed("average_rating", "competitor_rating"), PAIR)
    return both.withColumn("rating_gap", half_up(F.col("primary_rating") - F.col("competitor_rating"), 2))
