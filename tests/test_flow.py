"""Labelled sets and gates, manifests and cohort runs with failing cases, and what may leave of their results."""

import json
import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from revulet import flow_queries as flow
from revulet.operators import cohort_run, gates, privacy
from revulet.operators.regression import Policy
from revulet.sources import labelled, manifests

RUN = datetime(2024, 4, 1, tzinfo=timezone.utc)


def test_labelled_lines(spark, tmp_path):
    lines = ['{"id": "a", "language": "en", "text": "It crashes", "labels": ["stability"]}', "", '{"id": "b", "text": "Fine", "labels": []}', '{"id": "c", "text": "x", "label": "none"}', '{"id": "d", "te', '{"id": "e", "text": ""  , "label": "none"}', '{"id": "f", "text": "x"}', '{"text": "x", "label": "none"}', '{"id": "a", "text": "again", "labels": ["weather"]}']
    (tmp_path / "set.jsonl").write_text("\n".join(lines))
    rows = labelled.read_labelled(spark, str(tmp_path)).orderBy("text").collect()
    assert sorted((r.id or "", r.problem) for r in rows if r.problem) == [("", "no-id"), ("", "not-json"), ("e", "no-text"), ("f", "no-label")]
    assert {r.id: r.expected for r in rows if r.problem is None and r.id in "bc"} == {"b": [], "c": ["none"]}
    frame = labelled.read_labelled(spark, str(tmp_path))
    found = sorted((r.id or "", r.problem) for r in labelled.problems(frame, ["stability", "none"]).collect())
    assert ("a", "repeated-id") in found and ("a", "unknown-label") in found and ("f", "no-label") in found and ("", "no-id") in found
    assert {r.text for r in labelled.usable(frame, ["stability", "none"]).collect()} == {"It crashes", "Fine", "x"}
    assert labelled.read_labelled(spark, str(tmp_path)).where("language = 'unknown'").count() >= 3


def test_labelled_sets_are_packed(spark, small):
    rows = flow.labelled_sets(spark, small)["theme"]
    files = rows.inputFiles()
    packed = sum(os.path.getsize(f.removeprefix("file://")) for f in files)
    plain = rows.where("problem is null").selectExpr("sum(octet_length(text))").collect()[0][0]
    assert files and all(f.endswith(".gz") for f in files) and packed * 2 < plain


PREDICTED = "benchmark string, language string, expected array<string>, predicted array<string>"


def test_metrics_and_gates(spark):
    rows = [("release-link", "en", ["explicit"], ["explicit"]), ("release-link", "en", ["none"], ["change"]), ("release-link", "de", ["none"], ["none"]), ("theme", "en", ["sync", "account"], ["sync"]), ("theme", "en", [], [])]
    measured = gates.metrics(spark.createDataFrame(rows, PREDICTED))
    value = {(r.benchmark, r.scope, r.language, r.label, r.metric): r.value for r in measured.collect()}
    link = lambda metric, scope="overall", language=None, label=None: value["release-link", scope, language, label, metric]
    assert (link("examples"), link("languages"), link("precision"), link("recall"), link("exact")) == (3, 2, 0.667, 0.667, 0.667)
    assert link("exact", "language", "en") == 0.5 and link("recall", "label", label="none") == 0.5 and link("precision", "label", label="change") == 0
    # Nothing said and nothing expected of a label is no error, and a precision and recall of 0 have an f1 of 1.
    assert value["theme", "label", None, "pricing", "precision"] == 1 and link("f1", "label", label="change") == 0 and value["theme", "overall", None, None, "f1"] == 0.667
    wrong = gates.metrics(spark.createDataFrame([("release-link", "en", ["none"], ["change"])], PREDICTED))
    assert wrong.where("scope = 'overall' and metric = 'f1'").collect()[0].value == 1
    policy = {"release-link": {"overall": {"": {"examples": 3, "precision": 0.7}}, "language": {"de": {"exact": 1}, "fr": {"examples": 1}}, "label": {"*": {"recall": 0.5}}}}
    checked = gates.check(measured, gates.policy_gates(spark, policy))
    failed = sorted((r.scope, r.language or r.label or "", r.metric, r.value) for r in checked.where("not passed").collect())
    assert failed == [("language", "fr", "examples", None), ("overall", "", "precision", 0.667)]
    assert checked.where("scope = 'label'").count() == 3
    state = gates.status(checked).collect()[0]
    assert (state.benchmark, state.gates, state.failed, state.status, state.worst) == ("release-link", 7, 2, "fail", "language fr examples")
    with pytest.raises(ValueError):
        gates.policy_gates(spark, {"theme": {"overall": {"": {"speed": 1}}}})


def test_metrics_read_each_prediction_once(spark):
    made = spark.sparkContext.accumulator(0)

    def classifier(said):
        made.add(1)
        return said

    rows = [("theme", "en", ["sync"], ["sync"]), ("theme", None, [], ["account"]), ("release-link", "de", ["none"], ["change"]), ("other", "de", ["x"], ["x"])]
    classified = F.udf(classifier, "array<string>").asNondeterministic()
    predicted = spark.createDataFrame(rows, PREDICTED).withColumn("predicted", classified("predicted"))
    policy = {"theme": {"overall": {"": {"examples": 2, "languages": 2}}, "label": {"*": {"precision": 0.5}}}}
    state = gates.status(gates.check(gates.metrics(predicted), gates.policy_gates(spark, policy))).collect()
    assert made.value == len(rows)
    # All labels of the benchmark but account have a precision of 1; no language is none.
    assert [(r.gates, r.failed) for r in state] == [(2 + len(gates.LABELS["theme"]), 2)]
    value = {(r.benchmark, r.scope, r.language, r.label, r.metric): r.value for r in gates.metrics(predicted).collect()}
    assert value["theme", "overall", None, None, "exact"] == 0.5 and value["theme", "language", None, None, "precision"] == 0 and value["theme", "label", None, "account", "examples"] == 0
    assert value["other", "overall", None, None, "recall"] == 1 and not any(k[:2] == ("other", "label") for k in value)
    assert {k[3] for k in value if k[:2] == ("release-link", "label")} == set(gates.LABELS["release-link"])


APPS = [{"slug": f"app-{i}", "name": f"App {i}", "category": "x", "url": f"https://play.google.com/store/apps/details?id=a{i}"} for i in range(20)]


def written_manifest(spark, tmp_path, name, **fields):
    (tmp_path / f"{name}.json").write_text(json.dumps({"schemaVersion": 1, "limit": 300, "country": "US", "language": "en", "apps": APPS} | fields, indent=1))
    return manifests.read_manifest(spark, str(tmp_path / f"{name}.json"))


def test_manifests(spark, tmp_path):
    flat = written_manifest(spark, tmp_path, "flat")
    assert manifests.problems(flat).count() == 0
    first = manifests.cases(flat).orderBy("slug").collect()[0]
    assert (first.slug, first.store, first.storefront) == ("app-0", "google-play", "us-en") and manifests.cases(flat).count() == 20
    bad = written_manifest(spark, tmp_path, "bad", schemaVersion=2, limit=5, apps=[*APPS[:2], APPS[0] | {"name": " "}])
    assert {r.rule for r in manifests.problems(bad).collect()} == {"schema-version", "limit", "too-few-apps", "no-name", "repeated-slug"}
    fronts = [{"slug": "us-en", "country": "US", "language": "en"}, {"slug": "de-de", "country": "DE", "language": "de"}]
    sources = [{"store": "google-play", "url": "https://play.google.com/store/apps/details?id=a"}, {"store": "apple-app-store", "url": "https://apps.apple.com/us/app/x/id1"}]
    matrix = written_manifest(spark, tmp_path, "matrix", storefronts=fronts, expectedCases=4, apps=[{"slug": "one", "name": "One", "category": "x", "sources": sources}])
    assert manifests.problems(matrix).count() == 0 and {r.slug for r in manifests.cases(matrix).collect()} == {f"one-{s['store']}-{f['slug']}" for s in sources for f in fronts}
    wrong = written_manifest(spark, tmp_path, "wrong", storefronts=fronts[:1], expectedCases=4, apps=[{"slug": "one", "name": "One", "category": "x", "sources": [sources[0], sources[1] | {"store": "google-play"}]}])
    assert {r.rule for r in manifests.problems(wrong).collect()} == {"too-few-storefronts", "store", "expected-cases"}


def test_a_failing_case_is_a_row(spark):
    cases = spark.createDataFrame([(s, s, s, "x", "google-play", "us-en", "US", "en", "u") for s in ("good", "refused", "broken", "gone", "torn", "silent")], ", ".join(f"{c} string" for c in cohort_run.CASE))

    def fetch(case):
        own = [{"reviewId": str(i), "body": f"It crashes, secret {i}", "score": 1.0 if i < 8 else 5.0, "version": "2.0" if i < 8 else "1.0", "userName": "secret author", "date": f"2024-03-{i + 1:02d}T00:00:00Z", "ordinal": i} for i in range(16)]
        if case["slug"] == "silent":
            return
        yield 1, 200, json.dumps(own[:8])
        if case["slug"] == "refused":
            refused = ValueError("slow down")
            refused.status = 429
            raise refused
        if case["slug"] == "torn":
            raise ValueError("torn")
        yield 2, {"gone": 404}.get(case["slug"], 200), "[{" if case["slug"] == "broken" else json.dumps(own[8:])

    answers = cohort_run.fetched(cases.repartition(2), fetch)
    outcome = cohort_run.outcomes(cases, answers, flow.REVIEW)
    failed = {r.slug: (r.status, r.retryable) for r in outcome.failures.collect()}
    assert failed == {"refused": (429, True), "broken": (502, False), "torn": (502, True), "silent": (502, True)}
    rows = cohort_run.results(cases, outcome, Policy(min_version_reviews=5), RUN)
    got = {r.slug: r for r in rows.collect()}
    assert {s: r.status for s, r in got.items()} == {"good": "fail", "gone": "insufficient-data"} | dict.fromkeys(failed, "error")
    assert got["good"].fetched_reviews == 16 and got["good"].rating_drop == 4 and got["gone"].fetched_reviews == 8 and got["good"].error is None
    assert "secret" in str(rows.select("release_link").collect()) or got["good"].release_link.linked_count == 0
    total = {(r.level, r.name): r for r in cohort_run.roll_up(rows).collect()}["all", "all"]
    assert (total.total, total.errors, total.completed, total.decidable, total.decidable_rate, total.complaints) == (6, 4, 2, 1, 0.5, 16)
    assert {r.reason: r.cases for r in cohort_run.reasons(rows).collect()} == {"current": 0, "baseline": 1, "unavailable": 0, "source": 0}
    safe = rows.select(*privacy.projection(rows.schema))
    assert "secret" not in str(privacy.check(safe).collect()) and "label" not in safe.schema.simpleString()
    with pytest.raises(privacy.PrivacyError, match="release_link can hold text of"):
        privacy.check(rows)


SCHEMA = "slug string, body string, n int, inner struct<id:string,list:array<struct<code:string,label:string>>>, other struct<author:string>"


def test_privacy(spark):
    df = spark.createDataFrame([("s", "text", 1, ("i", [("c", "secret")]), ("me",)), ("t", None, 2, None, None)], SCHEMA)
    out = df.select(*privacy.projection(df.schema, ["slug", "inner.list.code", "n"]))
    assert out.schema.simpleString() == "struct<slug:string,inner:struct<list:array<struct<code:string>>>,n:int>"
    assert [r.inner for r in out.orderBy("n").collect()][1] is None and privacy.check(out) is out
    for path in ("body", "inner.list.label", "other.author", "other", "inner", "inner.nothing", "n.x", "nothing"):
        with pytest.raises(privacy.PrivacyError):
            privacy.projection(df.schema, [path])
    derived = df.select(
        F.when(F.col("body").contains("x"), "yes").otherwise("no").alias("flag"), F.length("body").alias("size"), F.concat("slug", F.upper("body")).alias("shout"), F.sha2("body", 256).alias("digest"), F.explode(F.split("body", " ")).alias("word"), F.struct("slug", "body")["slug"].alias("name")
    )
    assert {c: s & privacy.DENIED for c, s in privacy.carried(derived).items()} == {"flag": set(), "size": set(), "shout": {"body"}, "digest": set(), "word": {"body"}, "name": set()}
    both = df.select("slug").union(df.select("body"))
    with pytest.raises(privacy.PrivacyError):
        privacy.check(both)
    with pytest.raises(privacy.PrivacyError):
        privacy.check(df.groupBy("n").agg(F.max_by("body", "n").alias("last")))


def test_aggregate_only_file(spark, tmp_path):
    df = spark.createDataFrame([("s", "text", 1, ("i", [("c", "secret")]), ("me",))], SCHEMA)
    privacy.write_aggregate(df, str(tmp_path / "out"), ["slug", "inner.id"])
    assert [json.loads(x.value) for x in spark.read.text(str(tmp_path / "out")).collect()] == [{"slug": "s", "inner": {"id": "i"}}]


def test_days_give_any_window_and_only_their_own_files_change(spark, tmp_path):
    import os
    from datetime import timedelta

    from revulet.functions import classify as K
    from revulet.operators import aggregate as A
    from revulet.operators import daily
    from revulet.operators.reviews import APP, clean

    start = datetime(2024, 1, 1, 5, 30, tzinfo=timezone.utc)
    texts = ["It crashes all the time", "Sync is gone and login fails", "Please add an export, I wish", "Nice"]
    raw = [("s", f"a{i % 2}", str(i), texts[i % 4], float(1 + i % 5), start + timedelta(hours=7 * i, milliseconds=i), i) for i in range(260)]
    rows = K.with_themes(clean(spark.createDataFrame(raw, "source string, app_id string, review_id string, body string, rating double, created_at timestamp, ordinal long"), RUN))
    path = str(tmp_path / "days")
    late = F.col("created_at") >= F.lit(start + timedelta(days=70))
    daily.add(spark, path, daily.detail(rows.where(~late)))
    before = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, files in os.walk(path) for f in files if f.endswith(".parquet")}
    days = daily.add(spark, path, daily.detail(rows.where(late)))
    after = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, files in os.walk(path) for f in files if f.endswith(".parquet")}
    gone = before.keys() - after.keys()
    assert all(after[f] == before[f] for f in before if f in after) and len(gone) <= 1 and len(days) == 6
    detail, sums = daily.read(spark, path, "detail"), daily.read(spark, path, "sums")
    for back in (0, 0.4, 11, 29.99, 55):
        anchor = int((start + timedelta(hours=7 * 259) - timedelta(days=back)).timestamp() * 1000)
        anchors = rows.select(*APP).distinct().withColumn("anchor", F.lit(anchor))
        got = {(r.app_id, r.theme): r for r in daily.windows(detail, sums, anchors).collect()}
        seen = rows.where(F.unix_millis("created_at") <= anchor)
        newest = {r.app_id: r.a for r in seen.groupBy("app_id").agg(F.max(F.unix_millis("created_at")).alias("a")).collect()}
        mentions = A._mentioned(seen, APP, "rating", "created_at").select("app_id", "theme", "rating", "only_asked", F.unix_millis("created_at").alias("t")).collect()
        month = 30 * 86_400_000
        for key in {(m.app_id, m.theme) for m in mentions}:
            own = [(anchor - m.t, m.rating <= 3 and not m.only_asked) for m in mentions if (m.app_id, m.theme) == key]
            want = (len(own), sum(a <= month for a, _ in own), sum(month < a <= 2 * month for a, _ in own), sum(c and a <= month for a, c in own), sum(c and month < a <= 2 * month for a, c in own))
            r = got.pop(key)
            assert (r["count"], r.recent_count, r.previous_count, r.recent_complaint_count, r.previous_complaint_count) == want
        assert not got and newest
    order = lambda df: sorted(map(str, df.collect()))
    assert order(daily.timeline(sums)) == order(A.timeline(rows))
    assert daily.add(spark, path, daily.detail(rows.limit(0))) == []


def test_embedded_reviews_at_any_depth(spark):
    from revulet.sources import embedded

    review = lambda i, **more: {"$kind": "Review", "id": i, "contents": f"text {i}", "rating": 5} | more
    deep = review("deep")
    for _ in range(150):
        deep = {"x": [deep]}
    data = {"a": [review("1"), {"b": review("2", rating="4")}], "c": review("1", contents="again"), "z": [review("3", rating=6), review("4", contents=" "), review(5), review("") | {"inner": review("6")}], "deep": deep}
    page = lambda text: f'<html><SCRIPT type="x" id=serialized-server-data>{text}</script><p>'
    rows = [("p", page(json.dumps(data))), ("bad", page("{")), ("none", "<html>"), ("null", None), ("empty", page("[]")), ("many", page(json.dumps([review(str(i)) for i in range(30)])))]
    pages = spark.createDataFrame(rows, "page string, html string")
    spark.conf.set("spark.sql.cteRecursionRowLimit", 20)
    try:
        found = embedded.embedded_reviews(pages).collect()
        state = {r.page: (r.status, r.retryable, r.reviews) for r in embedded.page_status(pages, embedded.embedded_reviews(pages)).collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    got = {p: [(r.review_id, r.body) for r in sorted(found, key=lambda r: r.rank) if r.page == p] for p, _ in rows}
    # Level by level; of one id the first, here that in c, which is nearer to the root than those in a.
    assert got["p"] == [("1", "again"), ("5", "text 5"), ("2", "text 2"), ("6", "text 6"), ("deep", "text deep")]
    assert [r.depth for r in found if r.review_id == "deep"] == [301] and len(got["many"]) == 10 and got["many"][9][0] == "9"
    assert state == {"p": ("ok", False, 5), "bad": ("invalid-data", True, 0), "none": ("no-data", True, 0), "null": ("no-data", True, 0), "empty": ("no-reviews", True, 0), "many": ("ok", False, 10)}


def test_canonical_json(spark):
    from revulet.functions.canonical import canonical

    values = [0.0, -0.0, 5.0, 4.5, 0.1, 1e7, 12345678.5, 1e20, 1e21, 1.5e300, 1e-6, 1e-7, 2.5e-7, 123456.789, -3.25, 0.000123]
    want = ["0", "0", "5", "4.5", "0.1", "10000000", "12345678.5", "100000000000000000000", "1e+21", "1.5e+300", "0.000001", "1e-7", "2.5e-7", "123456.789", "-3.25", "0.000123"]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(canonical(F.col("v"), df.schema["v"].dataType)).collect()] == want
    strings = ['a"b\\c', "\n\t\r\b\f", "\x0b\x1f\x00", "é漢🙂 /", "\\u000B", ""]
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    assert [r[0] for r in df.select(canonical(F.col("s"), df.schema["s"].dataType)).collect()] == ['"a\\"b\\\\c"', '"\\n\\t\\r\\b\\f"', '"\\u000b\\u001f\\u0000"', '"é漢🙂 /"', '"\\\\u000B"', '""']
    df = spark.createDataFrame([((2, [1, None], {"b": 1.0, "a": None}, True, None),)], "r struct<z_y:int,list:array<int>,m:map<string,double>,ok:boolean,none:string>")
    assert df.select(canonical(F.col("r"), df.schema["r"].dataType)).collect()[0][0] == '{"list":[1,null],"m":{"a":null,"b":1},"none":null,"ok":true,"zY":2}'


def test_a_changed_reply_changes_the_hashes(spark):
    import hashlib

    from revulet.operators import provenance
    from revulet.operators.reviews import latest

    shape = "source string, app_id string, review_id string, body string, rating double, created_at string, reply struct<body:string,created_at:string>, ordinal long"
    rows = [("s", "a", str(i), f"text {i}", 4.5, f"2024-03-{1 + i % 3:02d}T00:00:00Z", (f"re {i}", None) if i % 2 else None, i) for i in range(7)]
    hashes = lambda rows, **k: provenance.dataset_hashes(latest(spark.createDataFrame(rows, shape).repartition(3), RUN), **k).collect()[0]
    one = hashes(rows)
    assert one == hashes(rows[::-1]) and one.review_count == 7
    changed = [r if r[2] != "3" else (*r[:6], ("re 4", None), r[7]) for r in rows]
    assert hashes(changed).content_hash != one.content_hash and hashes(changed).tree_hash != one.tree_hash
    assert hashes(rows, exact=6).content_hash is None and hashes(rows, exact=6).tree_hash == one.tree_hash
    order = sorted(rows, key=lambda r: (-int(r[5][8:10]), r[7]))
    records = [
        {"appId": "a", "appVersion": None, "author": "Anonymous", "body": r[3], "country": None, "createdAt": r[5].replace("Z", ".000Z"), "helpfulCount": 0, "language": None, "rating": 4.5, "reply": {"body": r[6][0], "createdAt": None} if r[6] else None, "reviewId": r[2], "source": "s", "sourceUrl": None, "title": "", "updatedAt": r[5].replace("Z", ".000Z")}
        for r in order
    ]
    assert one.content_hash == hashlib.sha256(json.dumps(records, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def test_days_are_written_in_one_pass_and_few_files(spark, tmp_path):
    from datetime import date, timedelta

    from revulet.operators import daily

    made, path = spark.sparkContext.accumulator(0), str(tmp_path / "days")

    def rated(rating):
        made.add(1)
        return rating

    days = [date(2024, 1, 1) + timedelta(days=k) for k in range(90)]
    ms = lambda day: (day - date(1970, 1, 1)).days * 86_400_000
    rows = [("s", "a", theme, ms(day) + 5, float(1 + day.day % 5), theme != daily.ALL, day) for day in days for theme in (daily.ALL, "sync")]
    fresh = spark.createDataFrame(rows, daily.DETAIL).withColumn("rating", F.udf(rated, "double").asNondeterministic()("rating"))
    assert daily.add(spark, path, fresh) == days
    assert made.value == len(rows)
    files = [f for f in (tmp_path / "days").rglob("*.parquet") if f.is_file()]
    assert len(files) <= 4
    # The same days come once more: the sums of both parts count, and nothing that was there is written again.
    assert daily.add(spark, path, fresh.where("day >= '2024-03-01'")) == days[60:]
    assert all(f.is_file() for f in files) and len(list((tmp_path / "days").rglob("*.parquet"))) <= 6
    assert daily.read(spark, path, "detail").columns == [c.split()[0] for c in daily.DETAIL.split(", ")]
    got = {r.period: r["count"] for r in daily.timeline(daily.read(spark, path, "sums")).collect()}
    assert got == {"2024-01": 31, "2024-02": 29, "2024-03": 60}
    anchors = spark.createDataFrame([("s", "a", ms(days[-1]) + 4)], "source string, app_id string, anchor long")
    r = daily.windows(daily.read(spark, path, "detail"), daily.read(spark, path, "sums"), anchors).collect()[0]
    assert (r.theme, r["count"], r.recent_count, r.previous_count) == ("sync", 60 + 29 * 2, 1 + 29 * 2, 30)
