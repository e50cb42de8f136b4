"""Evaluation of classifiers against labelled texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_up


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(1.0)).otherwise(half_up(a / F.nullif(b, F.lit(0)), 4, epsilon=False))


def confusion(predicted: DataFrame) -> DataFrame:
    """language, label, tp, fp, fn of rows (language, predicted, expected), two arrays of labels."""
    sides = predicted.select("language", F.explode(F.array_union("predicted", "expected")).alias("label"), "predicted", "expected")
    said, true = F.array_contains("predicted", F.col("label")), F.array_contains("expected", F.col("label"))
    count = lambda c: F.count(F.when(c, 1))
    return sides.groupBy("language", "label").agg(count(said & true).alias("tp"), count(said & ~true).alias("fp"), count(~said & true).alias("fn"))


def label_metrics(counts: DataFrame) -> DataFrame:
    """level, name, tp, fp, fn, precision, recall, f1 for each label, each language and all; an empty ratio is 1."""
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    level = F.when(F.grouping("label") == 0, "label").when(F.grouping("language") == 0, "language").otherwise("all")
    name = F.when(F.grouping("label") == 0, F.col("label")).when(F.grouping("language") == 0, F.col("language")).otherwise("all")
    rows = counts.groupingSets([["label"], ["language"], []], "label", "language").agg(*sums, level.alias("level"), name.alias("name")).select("level", "name", "tp", "fp", "fn")
    precision, recall = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return rows.withColumns({"precision": precision, "recall": recall, "f1": _ratio(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn"))})


def exact_match(predicted: DataFrame) -> DataFrame:
    """language (null for all), examples, exact, exact_match: where both sets of labels are equal."""
    same = F.array_sort(F.array_distinct("predicted")) == F.array_sort(F.array_distinct("expected"))
    rows = predicted.groupingSets([["language"], []], "language").agg(F.count("*").alias("examples"), F.count(F.when(same, 1)).alias("exact"))
    return rows.withColumn("exact_match", _ratio(F.col("exact"), F.col("examples")))
