"""Counts by day that are kept up to date: windows of 30 and 60 days for any anchor, and the timeline, without reading all
reviews again.

A folder holds two tables, both partitioned by batch: what was added at once. `detail` has a narrow row for each review
and for each theme that it mentions, and is partitioned by month, too; `sums` has a row for each batch, application, theme
and day, which add up. Adding reviews writes the files of its own batch alone. Files are as many as batches and months,
however few reviews a day has. A window takes whole days from the sums and cuts the days at its edges out of the detail,
so it is exact to the millisecond.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import half_up, trend
from . import aggregate as A
from .reviews import APP, DAY_MS, top

#: The theme of the rows that stand for reviews themselves.
ALL = ""
DETAIL = "source string, app_id string, theme string, created_ms long, rating double, complaint boolean, day date"
SUMS = "source string, app_id string, theme string, n long, rating_sum double, negative long, complaints long, day date"
WINDOW = 30 * DAY_MS


def detail(classified: DataFrame) -> DataFrame:
    """DETAIL rows of classified reviews (see classify.with_themes)."""
    rows = A._mentioned(classified, APP, "rating", "created_at", itself=ALL)
    complaint = (F.col("theme") != ALL) & A.low() & ~F.col("only_asked")
    return rows.select(*APP, "theme", F.unix_millis("created_at").alias("created_ms"), "rating", complaint.alias("complaint"), F.to_date("created_at").alias("day"))


def sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*APP, "theme", "day").agg(F.count("*").alias("n"), F.sum("rating").alias("rating_sum"), A._count(A.negative()).alias("negative"), A._count(F.col("complaint")).alias("complaints"))


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The table detail or sums of a folder."""
    return spark.read.schema(DETAIL if table == "detail" else SUMS).parquet(f"{path}/{table}").drop("batch", "month")


def add(spark: SparkSession, path: str, fresh: DataFrame) -> list:
    """Adds DETAIL rows to the folder and returns their days; files that are there are left as they are.

    fresh is evaluated once, for the detail; its sums and days are taken from the files of that."""
    batch = uuid.uuid4().hex
    detail_path, sums_path = (f"{path}/{table}/batch={batch}" for table in ("detail", "sums"))
    fresh.withColumn("month", F.date_format("day", "yyyy-MM")).hint("rebalance", "month").write.partitionBy("month").parquet(detail_path)
    sums(spark.read.schema(DETAIL).parquet(detail_path)).hint("rebalance").write.parquet(sums_path)
    return [r.day for r in spark.read.schema(SUMS).parquet(sums_path).select("day").distinct().orderBy("day").collect()]


def windows(detail_rows: DataFrame, day_sums: DataFrame, anchors: DataFrame) -> DataFrame:
    """For each row of anchors (source, app_id, anchor: ms) and theme mentioned by then: count up to the anchor, and
    recent_count, previous_count, trend_percent and the same of complaints, in the 30 days up to the anchor and the 30
    before. anchors is small: a few rows for each application."""
    day_of = lambda ms: F.to_date(F.timestamp_millis(ms))
    low, middle = F.col("anchor") - 2 * WINDOW, F.col("anchor") - WINDOW
    edges = F.array_distinct(F.array(day_of(F.col("anchor")), day_of(middle), day_of(low)))
    own = anchors.select(*APP, F.col("anchor").cast("long").alias("anchor")).withColumn("edges", edges)
    begin = F.unix_millis(F.col("day").cast("timestamp"))
    whole = day_sums.join(own, APP).where((F.col("day") < day_of(F.col("anchor"))) & ~F.array_contains("edges", F.col("day")))
    recent, previous = begin >= middle, (begin >= low) & (begin < middle)
    add_up = lambda condition, column: F.sum(F.when(condition, F.col(column)).otherwise(0))
    parts = whole.groupBy(*APP, "anchor", "theme").agg(
        F.sum("n").alias("count"), add_up(recent, "n").alias("recent_count"), add_up(previous, "n").alias("previous_count"), add_up(recent, "complaints").alias("recent_complaint_count"), add_up(previous, "complaints").alias("previous_complaint_count")
    )
    at = F.col("created_ms")
    cut = detail_rows.join(own.withColumn("day", F.explode("edges")), [*APP, "day"]).where(at <= F.col("anchor"))
    recent, previous, bad = at >= middle, (at >= low) & (at < middle), F.col("complaint")
    edge = cut.groupBy(*APP, "anchor", "theme").agg(
        F.count("*").alias("count"), A._count(recent).alias("recent_count"), A._count(previous).alias("previous_count"), A._count(recent & bad).alias("recent_complaint_count"), A._count(previous & bad).alias("previous_complaint_count")
    )
    names = ("count", "recent_count", "previous_count", "recent_complaint_count", "previous_complaint_count")
    both = parts.unionByName(edge).groupBy(*APP, "anchor", "theme").agg(*(F.sum(n).alias(n) for n in names)).where(F.col("theme") != ALL)
    return both.withColumns({"trend_percent": trend(F.col("recent_count"), F.col("previous_count")), "complaint_trend_percent": trend(F.col("recent_complaint_count"), F.col("previous_complaint_count"))})


def timeline(day_sums: DataFrame, months: int = 12) -> DataFrame:
    """As aggregate.timeline(), from the sums."""
    by_month = day_sums.where(F.col("theme") == ALL).groupBy(*APP, F.date_format("day", "yyyy-MM").alias("period")).agg(F.sum("n").alias("count"), half_up(F.sum("rating_sum") / F.sum("n"), 2).alias("average_rating"), F.sum("negative").alias("negative_count"))
    return top(by_month, APP, [F.desc("period")], months).drop("rank")
