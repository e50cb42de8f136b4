"""Reviews as a stream of files, and windowed counts. The newest record of each review is kept by newest.py."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.reviews import APP, normalize


def read_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "json") -> DataFrame:
    return spark.readStream.format(kind).schema(schema).load(path)


def windowed_counts(stream: DataFrame, window: str = "30 days", late: str = "7 days", run_time: datetime | None = None) -> DataFrame:
    """Reviews and negative reviews of each application in windows of created_at; records later than `late` are left out."""
    rows = normalize(stream.withColumn("ordinal", F.lit(0).cast("long")), run_time).withWatermark("created_at", late)
    return rows.groupBy(*APP, F.window("created_at", window).alias("window")).agg(F.count("*").alias("count"), F.count(F.when(F.col("rating") <= 2, 1)).alias("negative_count"))
