"""Normalising, classifying and stemming on literal rows."""

import re
from datetime import datetime, timezone

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from revulet.functions import classify as K
from revulet.functions import fixed
from revulet.functions.numeric import half_up, trend
from revulet.functions.prefilter import needed, opened, run_of, shared_stems
from revulet.functions.text import BOUNDARY, CJK, clean_text, contains_word, portable, stem
from revulet.operators.reviews import clean, deduplicate, has_words, normalize

RUN = datetime(2026, 1, 1, tzinfo=timezone.utc)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


def test_half_up(spark):
    for value, digits, want in ((2.5, 0, 3), (-2.5, 0, -2), (0.125, 2, 0.13), (1.005, 2, 1.01), (0.18, 3, 0.18)):
        assert one(spark, half_up(F.lit(value), digits)) == want
    assert one(spark, trend(F.lit(3), F.lit(0))) == 100 and one(spark, trend(F.lit(0), F.lit(0))) == 0 and one(spark, trend(F.lit(1), F.lit(2))) == -50


def test_clean_text_and_white_space(spark):
    assert one(spark, clean_text(F.lit("<b>a</b>\u00a0 b\u3000 c\ufeff\n"))) == "a b c"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "<b>", "<br/>", " ", "\u00a0", "\n", "x", "<>", "< a"]), max_size=7))
def test_bodies_without_words(spark, parts):
    text = F.lit("".join(parts))
    assert one(spark, has_words(text)) == (one(spark, clean_text(text)) != "")


def test_rules_by_needed_words(spark):
    """The prefiltered rules find what the bare patterns find."""
    rules = [r for n in ("SOFTWARE", "COMMUNITY", "SUPPORT", "POLICY", "EXPLICIT", "CHANGE") for r in getattr(fixed, f"{n}_RULES")]
    texts = ["", "Since the latest UPDATE it crashes", "app 4.8.1 freezing; v2.10 after 3.2", "\u017Fuddenly no longer work\u017F", "depuis la dernière mise à jour", "nach dem Update nicht mehr", "ne s'ouvre plus", "更新后闪退，客服没有回复", "この最新のバージョン以降 3.2 から", "used  to work,\ncan't log in anymore", "scammers and BOTS", "Sin respuesta desde 2.0", "\u212Aeeps breaking", "a regression", "every update", "the last 3 updates"]
    texts += [w for _, pattern in rules for w in (needed(pattern) or ())]
    rows = K.with_plain(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, body string").withColumn("title", F.lit("")))
    bare = F.array_compact(F.array(*(F.when(F.col("_plain").rlike(portable(p)), F.lit(i)) for i, p in rules)))
    wrong = rows.select("body", K.rule_hits(rules).alias("got"), bare.alias("want")).where("got <> want").collect()
    assert wrong == []


def test_rules_in_long_texts(spark):
    """Strings are looked for by runs of letters and their shared parts; within words, in long texts and after odd letters, too."""
    rules = [r for n in ("SOFTWARE", "COMMUNITY", "SUPPORT", "POLICY", "EXPLICIT", "CHANGE") for r in getattr(fixed, f"{n}_RULES")]
    prose = ["lorem ipsum dolor, sit amet. " * 40, "Ärger über Ödnis und naïve façades; " * 40, "\u017Feit \u0130stanbul \u212Aein " * 40]
    said = ["It crashes", "xcrash crashx", "since the", "update", "can't log in any-more, no  longer works", "l\u00e4sst sich nicht \u00f6ffnen", "v\u00e9rification de l\u2019\u00e2ge", "4.8.1 nach 4.8.1", "更新后闪退", "プライバシーポリシー", "PAY TO win", "ne marche plus"]
    texts = [a + b + c for a in prose for b in said for c in ("", " " + a)]
    rows = K.with_plain(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, body string").withColumn("title", F.lit("")))
    bare = F.array_compact(F.array(*(F.when(F.col("_plain").rlike(portable(p)), F.lit(i)) for i, p in rules)))
    found = rows.select("body", K.rule_hits(rules).alias("got"), bare.alias("want")).collect()
    assert [r for r in found if r.got != r.want] == [] and sum(len(r.got) > 0 for r in found) > 40
    assert (run_of("since the update"), run_of(" update"), run_of("apr\u00e8s "), run_of("4.2")) == ("update", "update", "apr\u00e8s", "")
    assert shared_stems(["no longer works", "longer", "a crash", "4.2", "pay"]) == {"longer": ["no longer works", "longer"], "crash": ["a crash"], "": ["4.2"], "pay": ["pay"]}
    assert opened(r"\b(?:ab|[cé]d?)x").startswith(r"(?=[ACac\x{80}-\x{10FFFF}])(?iu)") and opened(r"\d+a") == portable(r"\d+a") and opened(r"(?:a)?\s*b") == portable(r"(?:a)?\s*b")


def test_needed():
    assert set(needed(r"\b(?:since|after)\s+(?:the\s+)?update\b")) == {"since the update", "since update", "after the update", "after update"}
    assert needed(r"\bused\s+to\b") == ("used to",) and needed(r"[a-z]+") is None and needed(r"(?:ab|[a-z])c?") is None
    assert set(needed(r"st[uü]rzt|\d+ friert")) == {"sturzt", "stürzt", " friert"}


def test_words_of_other_scripts_have_their_signs():
    assert all(re.search(f"[ß{CJK}]", w) for w in K.INSIDE)


def test_ascii_boundaries(spark):
    tests = [("bloqué par", "bloqué", False), ("déplante", "plante", True), ("a plante b", "plante", True), ("implante", "plante", False)]
    for text, word, want in tests:
        assert one(spark, F.lit(text).rlike(f"(?iu){BOUNDARY}{word}{BOUNDARY}")) == want


def test_words(spark):
    cases = [("it crashes", "crash", True), ("crashings", "crash", False), ("bugs", "bug", False), ("a bug", "bug", True), ("éslow", "slow", False), ("log   in now", "log in", True), ("wird heiß!", "wird heiß", True), ("经常闪退。", "闪退", True), ("unlogged in", "log in", False)]
    for text, word, want in cases:
        assert one(spark, contains_word(F.lit(text), word)) == want


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["crash", "crashed", "slow", "slowed", "lag", "lags", "sign", "in", "log", "won't", "open", "ui", "push", "闪退", "heiß", "wird", "-", "'", "abo", "abos", "preise"]), max_size=9))
def test_token_lookup_equals_patterns(spark, parts):
    text = F.lower(F.lit(" ".join(parts)))
    row = spark.range(1).select(F.lit(" ".join(parts)).alias("body"), F.lit("").alias("title"))
    hits = K.with_themes(row).select("hits").collect()[0].hits.asDict()
    for theme in ("stability", "account", "pricing"):
        words = fixed.THEMES[theme][2]
        want = spark.range(1).select(F.array_compact(F.array(*(F.when(contains_word(text, w), F.lit(w)) for w in words))).alias("x")).collect()[0].x
        assert hits[theme] == want


def test_stem(spark):
    for word, want in {"batteries": "battery", "running": "run", "created": "create", "crashes": "crash", "photos": "photo", "'quoted'": "quot", "sing": "sing", "press": "pres"}.items():
        assert one(spark, stem(F.lit(word))) == want


def test_normalize(spark):
    rows = [
        ("s", "a", None, "<i>x</i>", None, "9", "us", " ", "2024-01-02T03:04:05+01:00", -3.0, 0),
        ("s", "a", "r", None, "T", "nan", None, "1.2", "junk", None, 1),
    ]
    raw = spark.createDataFrame(rows, "source string, appId string, id string, text string, title string, score string, country string, version string, date string, thumbsUp double, ordinal long")
    a, b = normalize(raw, RUN).orderBy("ordinal").collect()
    assert (a.body, a.rating, a.country, a.app_version, a.helpful_count, a.author) == ("x", 5.0, "US", None, 0.0, "Anonymous")
    assert len(a.review_id) == 24 and a.created_at == datetime(2024, 1, 2, 2, 4, 5)
    assert (b.body, b.rating, b.app_version, b.review_id) == ("", 0.0, "1.2", "r") and b.created_at == datetime(2026, 1, 1)


def test_deduplicate_keeps_newest_and_first(spark):
    rows = [("r1", "old", "2024-01-01", "2024-01-01", 0), ("r1", "new", "2024-01-01", "2024-02-01", 1), ("r2", "first", "2024-01-03", "2024-01-03", 2), ("r2", "second", "2024-01-03", "2024-01-03", 3), ("r3", " ", "2024-01-03", "2024-01-03", 4)]
    raw = spark.createDataFrame(rows, "review_id string, body string, created_at string, updated_at string, ordinal long")
    for n in (1, 7):
        got = {r.review_id: (r.body, r.position) for r in deduplicate(normalize(raw.repartition(n), RUN)).collect()}
        assert got == {"r1": ("new", 0), "r2": ("first", 2), "r3": ("", 4)}
    assert clean(raw, RUN).count() == 2


def classified(spark, *bodies):
    raw = spark.createDataFrame([(str(i), b, i) for i, b in enumerate(bodies)], "review_id string, body string, ordinal long")
    return K.classify(clean(raw, RUN)).orderBy("ordinal").collect()


def test_scopes_and_links(spark):
    rows = classified(
        spark,
        "Since the latest update the app crashes on start",
        "Scammers everywhere and moderators ban honest people",
        "Customer support never replied to my ticket",
        "Far too expensive, the subscription doubled",
        "My account is fine, I guess",
        "Suddenly sync is broken",
        "Please add a reminder and backup",
        "Nice",
    )
    assert [r.scope.primary for r in rows] == ["software", "community", "support", "product-policy", "unclear", "software", "product-policy", "unclear"]
    assert [r.link.kind for r in rows] == ["explicit", "none", "none", "none", "none", "change", "none", "none"]
    assert rows[0].scope.actionable and rows[0].scope.software_themes == ["stability"]
    assert rows[6].scope.software_themes == [] and rows[5].scope.software_themes == ["stability", "sync"]
