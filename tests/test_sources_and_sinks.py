"""Addresses, connectors with injected answers, renderers, command line and streams."""

import json
import sys
from datetime import datetime, timezone

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from revulet.__main__ import main
from revulet.functions.classify import classify
from revulet.operators.reviews import clean
from revulet.plans import gate, render, report, result
from revulet.sources import registry, stores
from revulet.sources.demo import demo_competitor_reviews, demo_reviews
from revulet.sources.store_urls import source_ref
from revulet.streaming import reviews as streams

cloudpickle.register_pickle_by_value(sys.modules[__name__])
RUN = datetime(2026, 9, 1, tzinfo=timezone.utc)
SOURCE = registry.Source("apple-app-store", "7", "US", None, "https://apps.apple.com/us/app/id7")


def ref(spark, url):
    return spark.createDataFrame([(url,)], "u string").select(source_ref(F.col("u")).alias("r")).collect()[0].r


def test_addresses(spark):
    a = ref(spark, "https://apps.apple.com/de/app/some-name/id123?mt=8")
    assert (a.store, a.app_id, a.country) == ("apple-app-store", "123", "DE")
    g = ref(spark, "http://play.google.com/store/apps/details?id=com.x&gl=us&hl=pt-BR")
    assert (g.store, g.app_id, g.country, g.language) == ("google-play", "com.x", "US", "pt-BR")
    for bad in ("ftp://apps.apple.com/id1", "https://example.com/id1", "https://play.google.com/store/apps?id=x", "https://play.google.com/store/apps/details?id=", "https://apps.apple.com/de/app/id12x", "no address", None):
        assert ref(spark, bad) is None


def test_registry():
    make = lambda name: registry.Connector(name, "N", lambda s: s.store == "x", lambda *a: None)
    r = registry.Registry([make("a")])
    assert r.register(make("b")) is r and [c["id"] for c in r.list()] == ["a", "b"] and r.resolve(registry.Source("x", "1")).id == "a"
    assert r.unregister("a") and not r.unregister("a") and r.get("a") is None
    with pytest.raises(registry.ConnectorDefinitionError):
        r.register(make("b"))
    with pytest.raises(registry.ConnectorDefinitionError):
        make("Not an id")
    with pytest.raises(registry.ConnectorNotFoundError):
        r.resolve(registry.Source("y", "1"))
    assert [c["id"] for c in registry.default_registry(True).list()] == ["apple-app-store", "google-play", "demo"]


def entry(i):
    label = lambda x: {"label": x}
    return {"id": label(str(i)), "title": label("T"), "content": label(f"text {i}"), "im:rating": label("4"), "im:version": label("1.0"), "author": {"name": label("A")}, "updated": label("2024-01-01T00:00:00-07:00")}


def test_apple_feed(spark):
    def fetch(url):
        page = int(url.split("page=")[1].split("/")[0])
        found = [{"id": {"label": "app"}}] * (page == 1) + [entry(page * 100 + i) for i in range(50 if page == 1 else 7)]
        return json.dumps({"feed": {"entry": found}}).encode()

    data = stores.apple_connector(fetch).fetch(spark, SOURCE, {"limit": 100})
    assert data.metadata["pagination_stop_reason"] == "end-of-feed" and not data.metadata["partial_results"]
    rows = clean(data.reviews, RUN).collect()
    assert len(rows) == 57 and rows[0].rating == 4.0 and rows[0].created_at == datetime(2024, 1, 1, 7)


def test_completeness():
    assert stores.completeness({1: 50, 2: 50}, 2, 100) == ("requested-limit", False)
    assert stores.completeness({1: 50}, 3, 150) == ("empty-page", True) and stores.completeness({}, 1, 10) == ("empty-feed", True)
    assert stores.completeness({1: 50, 2: 50}, 2, 120) == (None, True)


def test_page_walk():
    data = {"a": [{"b": {"$kind": "Review", "id": 1, "contents": "x", "rating": 5}}], "c": {"$kind": "Review", "id": 1, "contents": "again", "rating": 2}, "d": {"$kind": "Review", "id": 2, "contents": "", "rating": 2}}
    page = f'<script id="serialized-server-data" type="x">{json.dumps(data)}</script>'
    assert [r["body"] for r in stores.page_reviews(page, SOURCE)] == ["again"]
    assert stores.page_reviews("<html>", SOURCE) == []
    with pytest.raises(registry.ConnectorError):
        stores.page_reviews('<script id="serialized-server-data">{</script>', SOURCE)


def test_retries():
    waits, answers = [], [stores.HttpError(503), stores.HttpError(429, "2"), b"ok"]

    def fetch(url):
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert stores.retried(fetch, "u", "s", 3, waits.append) == b"ok" and waits == [0.25, 2]
    with pytest.raises(registry.ConnectorError) as e:
        stores.retried(lambda u: (_ for _ in ()).throw(stores.HttpError(403)), "u", "s", 3, waits.append)
    assert e.value.status == 403 and not e.value.retryable


def test_csv(spark, tmp_path):
    rows = clean(demo_reviews(spark, 3).withColumn("body", F.when(F.col("ordinal") == 0, '=1+"x"').otherwise(F.col("body"))), RUN)
    text = render.csv_text(rows)
    lines = text.split("\r\n")
    assert text.startswith("\ufeff\"source\"") and len(lines) == 5 and "\"'=1+\"\"x\"\"\"" in lines[1] and '"1"' in lines[1]
    render.write_csv(rows, str(tmp_path / "out"))
    with pytest.raises(Exception):
        render.write_csv(rows, str(tmp_path / "out"))


def test_formats_and_files(tmp_path):
    assert render.resolve_format(None, "a.html") == "html" and render.resolve_format("markdown") == "md" and render.resolve_format(None, None) == "json"
    with pytest.raises(ValueError):
        render.resolve_format("pdf")
    path = tmp_path / "a" / "b.txt"
    render.write_text("x", str(path))
    with pytest.raises(FileExistsError):
        render.write_text("y", str(path))
    render.write_text("z", str(path), force=True)
    assert path.read_text() == "z"
    assert render.escape_markdown("a|b @x <i>") == "a\\|b @\u200bx &lt;i&gt;"


def test_report(spark):
    found = report.tables(demo_reviews(spark), run_time=RUN)
    row = report.document(found, RUN).collect()[0]
    data = json.loads(render.report_json(row))
    assert data["schema_version"] == 1 and data["sample"]["total"] == 96 and [v["app_version"] for v in data["versions"]] == ["4.8.0", "4.7.2", "4.6.9"]
    assert "camera uploads" in render.report_markdown(row) and "<table>" in render.report_html(row)
    newest = data["versions"][0]
    assert len(newest["evidence"]) == 3 and len(newest["release_link"]["evidence"] or []) == min(4, newest["release_link"]["linked_count"])
    assert sum(s["count"] for s in newest["actionability"]["scopes"]) == newest["actionability"]["low_rating_count"] == 30 and newest["themes"][0]["count"] >= newest["themes"][-1]["count"]
    assert all(1 <= len(t["evidence"]) <= 4 for t in data["themes"]) and data["discovered_issues"][0]["versions"] and data["discovered_issues"][0]["evidence"][0]["evidence"]["review_id"]
    again = report.tables(demo_reviews(spark).repartition(5), run_time=RUN)["provenance"].collect()
    assert again[0].content_hash == data["provenance"]["content_hash"]


def test_comparison_in_a_report(spark):
    made = report.compared(demo_reviews(spark), demo_competitor_reviews(spark), RUN)
    row = report.document(report.tables(demo_reviews(spark), run_time=RUN), RUN).collect()[0]
    gaps = [g for g in made["gaps"].collect() if g.app_id == row.app_id]
    assert gaps and "## Against" in render.report_markdown(row, gaps)


def test_check_result(spark):
    g = gate.evaluate(classify(clean(demo_reviews(spark), RUN)))
    row = result.document(g, RUN).collect()[0]
    r = row.result
    assert (r.schema_version, r.status, r.decision, r.policy.min_version_reviews) == (1, "fail", "software-regression", 10) and r.metrics.current.version == "4.8.0" and r.metrics.baseline.average_rating == 3.31
    assert [v.id for v in r.violations] == ["rating-drop", "negative-share-increase", "theme-stability", "discovered-66e943a4d5da"]
    assert all(len(v.evidence) == 3 and [e["rank"] for e in v.evidence] == [1, 2, 3] for v in r.violations) and all(e.evidence.app_version == "4.8.0" for v in r.violations[:3] for e in v.evidence)
    assert [s.scope for s in r.actionability.scopes] == ["software", "product-policy", "community", "support", "unclear"] and [s["count"] for s in r.actionability.scopes] == [21, 6, 0, 0, 3]
    assert r.release_link.available and r.issues[0].supported and r.issues[0].evidence
    text = render.gate_markdown(g)
    assert "complaints up by" in text and "stars · 4.8.0" in text and "| software | product-policy |" in text
    few = result.document(gate.evaluate(classify(clean(demo_reviews(spark, 6).withColumn("app_version", F.lit(None).cast("string")), RUN))), RUN).collect()[0].result
    assert few.status == "insufficient-data" and few.metrics is None and few.violations is None and not few.release_link.available and few.release_link.level is None


def test_command_line(spark, tmp_path, capsys):
    assert main(["connectors"]) == 0 and "apple-app-store" in capsys.readouterr().out
    assert main(["inspect", "https://example.com/x"]) == 2 and main(["nonsense"]) == 2
    assert main(["check", "demo", "--max-rating-drop", "9"]) == 2
    out = tmp_path / "r.csv"
    assert main(["analyze", "demo", "--output", str(out)]) == 0 and out.read_bytes().startswith(b"\xef\xbb\xbf")
    assert main(["analyze", "demo", "--output", str(out)]) == 2


def test_windowed_counts(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = spark.createDataFrame([], "review_id string, body string, rating double, created_at string, updated_at string, ordinal long").schema

    def drop(name, rows):
        (source / name).write_text("\n".join(json.dumps(dict(zip(schema.names, r, strict=True))) for r in rows))

    drop("a.json", [("1", "old", 1.0, "2024-01-01", "2024-01-01", 0), ("2", "two", 2.0, "2024-01-01", "2024-01-01", 1)])
    drop("b.json", [("1", "new", 5.0, "2024-01-01", "2024-03-01", 2), ("2", "late", 2.0, "2024-01-01", "2023-01-01", 3)])
    counts = streams.windowed_counts(streams.read_stream(spark, str(source), schema), run_time=RUN)
    query = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("counts").agg(F.sum("count")).collect()[0][0] == 4
