"""Threshold gates over the metrics of classifiers.

Metrics and gates are both rows, so any number of benchmarks, languages and labels is judged by one join: a gate meets
the metric rows of its benchmark, scope and metric, for one language or label or for every one (`*`), and fails where
the value is below its least, or where there is no such row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import fixed
from ..functions.numeric import half_up

EVERY = "*"
GATE = "benchmark string, scope string, language string, label string, metric string, least double"
#: The labels of each benchmark.
LABELS = {"theme": list(fixed.THEMES), "release-link": ["explicit", "change", "none"], "actionability": list(fixed.SCOPES)}
METRICS = ("examples", "languages", "precision", "recall", "f1", "exact")


def policy_gates(spark: SparkSession, policies: dict | None = None) -> DataFrame:
    """GATE rows of policies: {benchmark: {scope: {language or label: {metric: least}}}}; the published ones if not given."""
    rows = []
    for benchmark, scopes in (policies or fixed.EVALUATION_POLICIES).items():
        for scope, names in scopes.items():
            for name, least in names.items():
                language, label = (name, None) if scope == "language" else (None, name) if scope == "label" else (None, None)
                for metric, value in least.items():
                    if scope not in ("overall", "language", "label") or metric not in METRICS:
                        raise ValueError(f"No metric {metric} of scope {scope}.")
                    rows.append((benchmark, scope, language, label, metric, float(value)))
    return spark.createDataFrame(rows, GATE)


def predictions(examples: DataFrame, benchmark: str) -> DataFrame:
    """examples (language, text, expected) with predicted, the labels that the benchmark's classifier gives, and benchmark."""
    rows = K.classify(examples.withColumns({"title": F.lit(""), "body": F.col("text")}))
    said = {"theme": F.transform(K.themes(), lambda t: t["id"]), "release-link": F.array("link.kind"), "actionability": F.array("scope.primary")}[benchmark]
    return rows.select(F.lit(benchmark).alias("benchmark"), "language", F.array_distinct("expected").alias("expected"), said.alias("predicted"))


def _ratio(a: Column, b: Column) -> Column:
    """a / b, unrounded; 1 where b is nothing."""
    return F.when(b == 0, F.lit(1.0)).otherwise(a / F.nullif(b, F.lit(0)))


def metrics(predicted: DataFrame) -> DataFrame:
    """benchmark, scope (overall, language, label), language, label, metric, value of predictions().

    Precision, recall and f1 are over all label decisions of the scope, exact is the share of examples whose label sets
    agree, examples their number (of a label: those that expect it), languages the number of languages. A label of the
    benchmark that no example has counts nothing: its ratios are 1. Ratios are rounded half up to three digits; f1 is
    taken of unrounded ratios, and is 1 where both are 0.

    The predictions are read once: they are counted by language and label, and all scopes are sums of these counts.
    """
    every = F.create_map(*(x for b, labels in LABELS.items() for x in (F.lit(b), F.array(*map(F.lit, labels)))))
    own = F.coalesce(F.try_element_at(every, F.col("benchmark")), F.array().cast("array<string>"))
    count = lambda c: F.count(F.when(c, 1))
    # Each example has a row without a label for itself, and one for each label that is said or expected.
    none = F.lit(None).cast("string")
    found = F.coalesce(F.array_compact(F.array_union("predicted", "expected")), F.array().cast("array<string>"))
    sides = predicted.select("benchmark", "language", F.explode(F.concat(F.array(none), found)).alias("label"), "predicted", "expected")
    itself = F.col("label").isNull()
    said, true = F.array_contains("predicted", F.col("label")), F.array_contains("expected", F.col("label"))
    same = F.array_sort("predicted") == F.array_sort("expected")
    cells = sides.groupBy("benchmark", "language", "label").agg(
        count(itself).alias("examples"), count(itself & same).alias("same"), count(said & true).alias("tp"), count(said & ~true).alias("fp"), count(~said & true).alias("fn")
    )
    # The benchmark's own labels join as rows that count nothing.
    numbers = ("examples", "same", "tp", "fp", "fn")
    known = F.transform(own, lambda x: F.struct(x.alias("label"), *(F.lit(0).cast("long").alias(n) for n in numbers), F.lit(None).cast("string").alias("seen")))
    counted = F.array(F.struct("label", *numbers, F.when(itself, F.col("language")).alias("seen")))
    cells = cells.select("benchmark", "language", F.inline(F.when(itself, F.concat(counted, known)).otherwise(counted)))
    rows = cells.groupingSets([["benchmark", "language"], ["benchmark"], ["benchmark", "label"]], "benchmark", "language", "label").agg(
        *(F.sum(n).alias(n) for n in numbers), F.count("seen").alias("languages"), F.grouping("language").alias("_all_languages"), F.grouping("label").alias("_all_labels")
    )
    of_label = F.col("_all_labels") == 0
    rows = rows.where((F.col("_all_labels") == 1) | F.array_contains(own, F.col("label")))
    scope = F.when(of_label, "label").when(F.col("_all_languages") == 0, "language").otherwise("overall")
    rows = rows.select("benchmark", scope.alias("scope"), "language", "label", F.when(of_label, F.col("tp") + F.col("fn")).otherwise(F.col("examples")).alias("examples"), F.when(~of_label, F.col("languages")).alias("languages"), F.when(~of_label, F.col("same")).alias("same"), "tp", "fp", "fn")
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    values = {
        "examples": F.col("examples").cast("double"),
        "languages": F.col("languages").cast("double"),
        "precision": half_up(precision, 3, epsilon=False),
        "recall": half_up(recall, 3, epsilon=False),
        "f1": half_up(_ratio(2 * precision * recall, precision + recall), 3, epsilon=False),
        "exact": half_up(F.col("same") / F.col("examples"), 3, epsilon=False),
    }
    listed = F.array(*(F.struct(F.lit(name).alias("metric"), value.alias("value")) for name, value in values.items()))
    flat = rows.select("benchmark", "scope", "language", "label", F.explode(listed).alias("m"))
    return flat.select("benchmark", "scope", "language", "label", "m.metric", "m.value").where("value is not null")


def check(measured: DataFrame, gates: DataFrame) -> DataFrame:
    """benchmark, scope, language, label, metric, least, value, passed: a row for each gate and metric row that it meets,
    and one with a null value, not passed, for each gate that meets none."""
    g, m = gates.alias("g"), measured.alias("m")
    fits = (F.col("g.language") == EVERY) | F.col("g.language").eqNullSafe(F.col("m.language"))
    fits = fits & ((F.col("g.label") == EVERY) | F.col("g.label").eqNullSafe(F.col("m.label")))
    keys = (F.col("g.benchmark") == F.col("m.benchmark")) & (F.col("g.scope") == F.col("m.scope")) & (F.col("g.metric") == F.col("m.metric"))
    rows = g.join(m, keys & fits, "left")
    return rows.select("g.benchmark", "g.scope", F.coalesce("m.language", "g.language").alias("language"), F.coalesce("m.label", "g.label").alias("label"), "g.metric", "g.least", "m.value", F.coalesce(F.col("m.value") >= F.col("g.least"), F.lit(False)).alias("passed"))


def status(checked: DataFrame) -> DataFrame:
    """benchmark, gates, failed, status (pass or fail) and worst, the failed gate whose value is farthest below its least."""
    short = F.when(~F.col("passed"), F.struct((F.col("least") - F.coalesce("value", F.lit(0.0))).alias("by"), F.concat_ws(" ", "scope", "language", "label", "metric").alias("gate")))
    rows = checked.groupBy("benchmark").agg(F.count("*").alias("gates"), F.count(F.when(~F.col("passed"), 1)).alias("failed"), F.max(short)["gate"].alias("worst"))
    return rows.select("benchmark", "gates", "failed", F.when(F.col("failed") > 0, "fail").otherwise("pass").alias("status"), "worst")
