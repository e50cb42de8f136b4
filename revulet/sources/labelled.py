"""Labelled sets: JSON lines with id, language, text and labels (an array) or label (one)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "id string, language string, text string, labels array<string>, label string, sourceCase string, _line string"


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """id, language, text, expected (the labels), source_case, problem of every line of JSON-lines files.

    problem says what keeps a line from being used: `not-json`, `no-id`, `no-text`, `no-label`; null for usable ones.
    An empty array of labels is a label set like any other. Empty lines are skipped.
    """
    rows = spark.read.schema(LINE).option("columnNameOfCorruptRecord", "_line").json(path)
    expected = F.coalesce("labels", F.when(F.col("label").isNotNull(), F.array("label")))
    problem = F.when(F.col("_line").isNotNull(), "not-json").when(F.coalesce("id", F.lit("")) == "", "no-id").when(F.coalesce("text", F.lit("")) == "", "no-text").when(expected.isNull(), "no-label")
    return rows.select("id", F.coalesce("language", F.lit("unknown")).alias("language"), "text", expected.alias("expected"), F.col("sourceCase").alias("source_case"), problem.alias("problem"))


def problems(rows: DataFrame, labels: list[str]) -> DataFrame:
    """id, problem: unusable lines, labels that are not among labels (`unknown-label`) and repeated ids (`repeated-id`)."""
    known = F.array(*map(F.lit, labels))
    bad = rows.where("problem is not null").select("id", "problem")
    usable = rows.where("problem is null")
    unknown = usable.where(F.size(F.array_except("expected", known)) > 0).select("id", F.lit("unknown-label").alias("problem"))
    again = usable.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated-id").alias("problem"))
    return bad.unionByName(unknown).unionByName(again)


def usable(rows: DataFrame, labels: list[str]) -> DataFrame:
    """The lines without a problem of their own whose labels are all known."""
    known = F.array(*map(F.lit, labels))
    return rows.where(F.col("problem").isNull() & (F.size(F.array_except("expected", known)) == 0)).drop("problem")
