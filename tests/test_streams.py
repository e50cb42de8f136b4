"""Streams: the feed's later pages, each row once over restarts and failures; newest records from batches out of order."""

import json
from datetime import datetime, timezone

import pytest

from revulet.operators.reviews import latest
from revulet.sources import feed_source
from revulet.sources.stores import retry_wait, timeout_s
from revulet.streaming import newest

RUN = datetime(2024, 4, 1, tzinfo=timezone.utc)


def record(root, app, page, *answers):
    folder = root / f"app={app}" / f"page={page}"
    folder.mkdir(parents=True)
    (folder / "part-0.txt").write_text("\n".join(json.dumps({"turn": i, "status": 200} | a) for i, a in enumerate(answers)))


def feed_page(*ids, rating=5):
    return {"body": json.dumps({"feed": {"entry": [{"id": {"label": str(i)}, "content": {"label": f"text {i}"}, "im:rating": {"label": str(rating)}, "updated": {"label": "2024-03-01T00:00:00Z"}} for i in ids]}})}


@pytest.fixture
def source(spark):
    spark.dataSource.register(feed_source.AppReviews)
    return lambda path, **options: spark.read.format("app-reviews").options(path=str(path), pause="0", **options).load()


def test_feed_reader(source, tmp_path):
    record(tmp_path, "a", 1, {"status": 429, "retryAfter": "1"}, {"status": 500}, feed_page(*range(50)))
    record(tmp_path, "a", 2, {"body": '{"feed":{}}'}, feed_page(*range(50, 57)))
    record(tmp_path, "a", 0, {"body": '{"results":[{"trackName":"A","artistName":"Maker"}]}'})
    record(tmp_path, "b", 1, {"status": 404})
    record(tmp_path, "c", 1, {"status": 403})
    record(tmp_path, "d", 1, {"body": json.dumps({"feed": {"entry": {"id": {"label": "x"}, "title": {"label": "the application"}}}})})
    log = {(r.app_id, r.page): r for r in source(tmp_path, table="pages").collect()}
    assert [(k, r.entries, r.kept, r.attempts, r.status) for k, r in sorted(log.items())] == [(("a", 1), 50, 50, 3, 200), (("a", 2), 7, 7, 2, 200), (("b", 1), 0, 0, 1, 404), (("c", 1), 0, 0, 1, 403), (("d", 1), 1, 0, 1, 200)]
    assert log["c", 1].error and log["b", 1].error is None
    done = {r.app_id: (r.stop_page, r.stop_reason, r.partial_results, r.returned_reviews) for r in feed_source.completeness(source(tmp_path, table="pages"), 500).collect()}
    assert done == {"a": (2, "end-of-feed", False, 57), "b": (1, "empty-feed", True, 0), "c": (1, "failed-page", True, 0), "d": (1, "end-of-feed", False, 0)}
    few = feed_source.completeness(source(tmp_path, table="pages"), 20)
    assert {r.stop_reason for r in few.where("app_id = 'a'").collect()} == {"requested-limit"}
    kept = feed_source.within(source(tmp_path, onError="skip"), few, 20)
    assert [r.review_id for r in kept.orderBy("place").collect()] == [str(i) for i in range(20)]
    assert [(r.app_id, r.name, r.developer) for r in source(tmp_path, table="apps").collect()] == [("a", "A", "Maker")]
    with pytest.raises(Exception, match="answered 403"):
        source(tmp_path).collect()
    with pytest.raises(Exception, match="table is one of"):
        source(tmp_path, table="other").collect()
    assert source(tmp_path / "nothing").count() == 0


def test_waits_and_timeouts():
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    assert retry_wait(3, None) == 1 and retry_wait(1, "4") == 4 and retry_wait(1, "400") == 10 and retry_wait(2, "soon") == 0.5
    assert retry_wait(1, "Mon, 01 Jan 2024 00:00:07 GMT", now) == 7 and retry_wait(1, "Sun, 31 Dec 2023 00:00:00 GMT", now) == 0
    assert [timeout_s(x) for x in (None, 0, 30, 900, "x")] == [20, 1, 30, 60, 20]


def test_feed_stream_gives_each_row_once(spark, tmp_path):
    spark.dataSource.register(feed_source.AppReviews)
    ticks, out, seen = tmp_path / "ticks", tmp_path / "out", []

    def run(fail=False):
        stream = spark.readStream.format("app-reviews").options(path=str(ticks), pause="0").load()

        def apply(batch, number):
            ids = [r.review_id for r in batch.collect()]
            seen.append((number, ids))
            if fail:
                raise RuntimeError("killed")
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()

    record(ticks / "tick=000001", "a", 1, feed_page(1, 2, 3))
    record(ticks / "tick=000002", "b", 1, {"status": 503}, feed_page(4))
    run()
    record(ticks / "tick=000003", "a", 1, feed_page(5, 6))
    with pytest.raises(Exception, match="killed"):
        run(fail=True)
    record(ticks / "tick=000004", "a", 1, feed_page(7))
    run()
    run()
    got = sorted(r.review_id for r in spark.read.parquet(str(out)).collect())
    assert got == [str(i) for i in range(1, 8)]
    killed = [ids for n, ids in seen if sum(m == n for m, _ in seen) == 2]
    assert len(killed) == 2 and sorted(killed[0]) == sorted(killed[1]) == ["5", "6"]


RAW = "source string, appId string, reviewId string, body string, score double, updatedAt string, ordinal long"


def test_newest_records_from_batches_out_of_order(spark, tmp_path):
    for key, value in newest.STATE_STORE.items():
        spark.conf.set(key, value)
    day = lambda n: f"2024-03-{n:02d}T00:00:00Z"
    batches = [
        [("s", "a", "1", "second <b>x</b>", 2.0, day(5), 3), ("s", "a", "2", "only", 3.0, day(1), 4), ("s", "b", "1", "tie late", 1.0, day(9), 9)],
        [("s", "a", "1", "first", 1.0, day(2), 1), ("s", "b", "1", "tie early", 1.0, day(9), 7), ("s", "a", "3", "x", 5.0, None, 5)],
        [("s", "a", "1", "third", 5.0, day(7), 8), ("s", "a", "1", "third again", 5.0, day(7), 10), ("s", "a", "2", "older", 3.0, "2024-02-01T00:00:00Z", 11)],
        [("s", "a", "9", "new", 5.0, day(1), 12)],
    ]
    folder = tmp_path / "in"
    folder.mkdir()
    for n, rows in enumerate(batches):
        (folder / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("source", "appId", "reviewId", "body", "score", "updatedAt", "ordinal"), r))) for r in rows))
        stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).json(str(folder))
        query = newest.follow(stream, str(tmp_path / "table"), str(tmp_path / "checkpoint"), RUN)  # a new query for each: state outlives it
        query.awaitTermination()
    raw = spark.read.schema(RAW).json(str(folder))
    schema = newest.record_schema(raw, RUN)
    order = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    got = newest.table_of(spark, str(tmp_path / "table"), schema)
    assert order(got) == order(latest(raw, RUN))
    assert {(r.app_id, r.review_id): r.body for r in got.collect()} == {("a", "1"): "third", ("a", "2"): "only", ("a", "3"): "x", ("a", "9"): "new", ("b", "1"): "tie early"}
    log = spark.read.schema(newest.CHANGE + ", batch int").parquet(str(tmp_path / "table"))
    assert {r.batch: r["count"] for r in log.groupBy("batch").count().collect()} == {0: 3, 1: 3, 2: 1, 3: 1}
    assert log.where("record is null").count() == 1  # an older record changed no more than the first place
    newest.compact(spark, str(tmp_path / "table"), str(tmp_path / "short"))
    assert order(newest.table_of(spark, str(tmp_path / "short"), schema)) == order(got)



def test_one_csv_file_by_two_phases(spark, tmp_path):
    from pyspark.sql import functions as F

    from revulet.operators.reviews import clean
    from revulet.plans import render
    from revulet.sources import csv_file
    from revulet.sources.demo import demo_reviews

    rows = clean(demo_reviews(spark), RUN).withColumn("title", F.concat(F.lit('=1,"'), "review_id"))
    path = tmp_path / "reviews.csv"
    render.write_csv_file(rows.repartition(5), str(path))
    assert path.read_bytes() == render.csv_text(rows).encode() and [p.name for p in tmp_path.iterdir()] == ["reviews.csv"]
    with pytest.raises(Exception, match="is there already"):
        render.write_csv_file(rows, str(path))
    bad = rows.withColumn("title", F.when(F.col("ordinal") == 90, F.raise_error(F.lit("broken row"))).otherwise(F.col("title")))
    before = path.read_bytes()
    for target, overwrite in ((path, True), (tmp_path / "other.csv", False)):
        with pytest.raises(Exception, match="broken row"):
            csv_file.save(bad.select("title", "body").repartition(3), str(target), overwrite)
    assert path.read_bytes() == before and [p.name for p in tmp_path.iterdir()] == ["reviews.csv"]
    render.write_csv_file(rows.limit(0), str(path), overwrite=True)
    assert path.read_bytes() == render.csv_text(rows.limit(0)).encode()
