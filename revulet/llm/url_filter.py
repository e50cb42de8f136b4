"""URL filters by a sort-merge range join. DataFrame functions only.

A host's labels are turned round and each ends with a dot (`www.example.net` is `net.example.www.`), so that a rule's
host is a prefix of the key of every host below it: a rule is an interval of the sorted keys, and intervals nest or
are apart. A sweep sorts rules and URLs together and carries, from row to row, the last rule that began with the rules
that enclose it; those of them that are still prefixes of a URL's key are the stack of active rules there. A first
sweep finds the active hosts, a second one, over `host key/path` for each of them, the longest rule.

Ranges are dealt out by key and row, so rows of one host spread over many tasks; what a task carries in comes from the
tasks before it, one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, with A-Z in lower case; path: from there up to ?, # or the
    end. Both are empty for null and without ://."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)


def host_key(host: Column) -> Column:
    """The labels turned round, each with a dot behind it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _enclosing(rules: DataFrame, tmp: C.Scratch, name: str) -> DataFrame:
    """key, chain: for each row of rules (key, prefixes, value) the values of all keys among its prefixes, shortest
    first; its own is the last."""
    rules = tmp.written(rules, name)
    wanted = rules.select(F.col("key").alias("_of"), F.explode("prefixes").alias("_prefix"))
    pairs = wanted.join(rules.select(F.col("key").alias("_prefix"), F.struct(F.length("key").alias("size"), "key", "value").alias("entry")), "_prefix")
    return pairs.groupBy(F.col("_of").alias("key")).agg(F.array_sort(F.collect_list("entry")).alias("chain"))


def _sweep(marks: DataFrame, rows: DataFrame, tmp: C.Scratch, name: str) -> DataFrame:
    """rows (key, row, ...) with stack: the entries of marks (key, chain) whose keys are prefixes of the row's key.

    Of the marks at or before a key, the last one has the key's longest prefix among its own prefixes.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    events = marks.withColumn("kind", F.lit(0)).unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    ranged = events.repartitionByRange(parts, "key", "kind", "row").withColumn("part", F.spark_partition_id())
    ranged = tmp.written(ranged, name)
    last = ranged.where("kind = 0").groupBy("part").agg(F.max_by("chain", "key").alias("chain"))
    every = spark.range(ranged.select(F.coalesce(F.max("part"), F.lit(0))).first()[0] + 1).select(F.col("id").cast("int").alias("part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.join(last, "part", "left").select("part", F.last("chain", ignorenulls=True).over(before).alias("chain"), F.lit(-1).alias("kind"))
    run = Window.partitionBy("part").orderBy("kind_first", "key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ranged.unionByName(carried, allowMissingColumns=True).withColumn("kind_first", F.col("kind") >= 0).withColumn("chain", F.last("chain", ignorenulls=True).over(run))
    active = F.filter("chain", lambda entry: F.col("key").startswith(entry["key"]))
    stack = F.coalesce(active, F.array().cast(marks.schema["chain"].dataType))
    return swept.where("kind = 1").select(*rows.columns, stack.alias("stack"))


def _usable(rules: DataFrame) -> DataFrame:
    """host, path, verdict of the rules that can fit, one for each host and path; block before allow."""
    host = F.translate(F.col("host").cast("string"), UPPER, LOWER)
    path = F.col("path").cast("string")
    plain = rules.select(host.alias("host"), path.alias("path"), F.col("verdict").cast("string").alias("verdict"))
    plain = plain.where("host <> '' and (path = '' or path like '/%') and verdict is not null")
    return plain.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url).

    A rule of rules (host, path, verdict) fits its host and all hosts below it, where the URL's path starts with its
    path. The rule with the most characters in host and path wins, of equally long ones that with the longer host;
    rule is its host and path, verdict its verdict. Where none fits, rule is null and verdict is default. Of rules
    with equal host and path the verdict that sorts last counts (block before allow). Rules with a null, an empty host
    or a path that is neither empty nor begins with / take no part. A null URL has an empty host and path. Repeated
    rows are judged each; other columns are ignored; an empty table gives none.
    """
    with C.Scratch() as tmp:
        rules = tmp.written(_usable(rules), "rules")
        host, path = host_and_path(F.col("url").cast("string"))
        rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
        rows = rows.select("*", host_key(F.col("host")).alias("key"), F.monotonically_increasing_id().alias("row"))

        own = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("sizes")).withColumn("key", host_key(F.col("host")))
        labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.")
        prefixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))
        hosts = _enclosing(own.select("key", prefixes.alias("prefixes"), F.struct("host").alias("value")), tmp, "hosts")
        found = tmp.written(_sweep(hosts, rows, tmp, "by-host"), "found")

        def below(at: Column, tail: Column) -> Column:
            return F.concat(at, F.lit("/"), tail)

        paths = rules.join(own.select("host", "key", "sizes"), "host")
        prefixes = F.transform(F.filter("sizes", lambda n: n <= F.length("path")), lambda n: below(F.col("key"), F.substring(F.col("path"), F.lit(1), n)))
        marks = paths.select(prefixes.alias("prefixes"), below(F.col("key"), F.col("path")).alias("key"), F.struct("host", "path", "verdict").alias("value"))
        busy = found.select("page_id", "host", "path", "row", F.explode("stack").alias("entry"))
        busy = busy.select("page_id", "host", "path", "row", below(F.col("entry.key"), F.col("path")).alias("key"))
        swept = _sweep(_enclosing(marks, tmp, "paths"), busy, tmp, "by-path")

        longest = F.element_at("stack", -1)["value"]
        fits = swept.select("page_id", "host", "path", "row", F.when(F.size("stack") > 0, longest).alias("fit"))
        weight = F.when(F.col("fit").isNotNull(), F.struct(F.length("fit.host") + F.length("fit.path"), F.length("fit.host")))
        best = fits.groupBy("row", "page_id", "host", "path").agg(F.max_by("fit", weight).alias("fit"))
        none = F.lit(None).cast("struct<host:string,path:string,verdict:string>")
        idle = found.where(F.size("stack") == 0).select("row", "page_id", "host", "path", none.alias("fit"))
        out = best.unionByName(idle).select("page_id", "host", "path", F.concat("fit.host", "fit.path").alias("rule"), F.coalesce("fit.verdict", F.lit(default)).alias("verdict"))
        return C.written(out, "judged")
