"""Rows that joins make, and disk, for groups of many copies."""

import os

import numpy as np

from revulet.llm import near_dedup, suffix_dedup


def executions(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    found = store.executionsList()
    return store, [found.apply(i).executionId() for i in range(found.size())]


def join_rows(spark, since):
    """Rows out of the joins of all executions after the first `since` ones."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, ids = executions(spark)
    total = 0
    for i in ids[since:]:
        values, nodes = store.executionMetrics(i), store.planGraph(i).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if "Join" in node.name():
                metrics = node.metrics()
                for metric in (metrics.apply(k) for k in range(metrics.size())):
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        total += int(values.apply(metric.accumulatorId()).replace(",", "").split("\n")[-1])
    return total


def test_links_of_a_class_are_read_once(spark):
    """Labels used to be spread along all links, twice each, in every round."""
    rng = np.random.default_rng(7)
    links = {(int(min(p)), int(max(p))) for p in rng.integers(0, 400, (6000, 2)) if p[0] != p[1]}
    edges = spark.createDataFrame(sorted(links), "a long, b long").localCheckpoint()
    since = len(executions(spark)[1])
    got = {r.doc_id: r.label for r in near_dedup.components(edges).collect()}
    assert set(got.values()) == {0} and len(got) == 400
    assert join_rows(spark, since) < 3 * len(links)


def shuffled(spark):
    """The files of exchanges that are on disk, with their sizes."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f"{d}/{f}": os.path.getsize(f"{d}/{f}") for top in dirs for d, _, files in os.walk(str(top)) for f in files if f.startswith("shuffle_")}


def test_exchanges_of_texts_go_when_a_table_is_written(spark):
    """The exchanges of texts behind the working tables used to stay until the driver's memory was cleared."""
    rng = np.random.default_rng(3)
    texts = [rng.bytes(20_000).hex() for _ in range(40)]
    docs = spark.createDataFrame([(i, t + texts[i - 1][:1000]) for i, t in enumerate(texts)], "doc_id long, text string")
    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffled(spark)
    was = spark.conf.get(key)
    found = suffix_dedup.suffix_dedup(docs, texts=False)
    assert sum(n for f, n in shuffled(spark).items() if f not in before) < 200_000
    assert spark.conf.get(key) == was
    assert {r.n_removed for r in found.select("n_removed").collect()} == {2000}
