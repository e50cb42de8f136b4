"""Rows that share a doc_id, with equal and with different texts: as many rows come out as went in, each judged by its
own text. And the bounds that long or deep inputs must keep."""

import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from revulet.llm import decontaminate, html_text, language_id, near_dedup, substring_dedup, suffix_dedup

from test_edge_cases import jaccard, words

SCHEMA = "doc_id long, text string, n_chars long"
PASSAGE, BASE = words(31, 70), words(32, 90)
ROWS = [
    (1, PASSAGE + " " + words(33, 40)),
    (1, words(34, 20) + " " + PASSAGE),
    (2, BASE),
    (2, BASE),
    (3, BASE),
    (3, words(35, 500) + " " + PASSAGE),
    (3, "short"),
    (4, None),
    (4, PASSAGE),
    (4, PASSAGE),
    (5, ""),
    (None, PASSAGE),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None) for i, t in ROWS], SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in ("_row", "first", "group", "number", "carried")})


def with_id():
    return [(i, t) for i, t in ROWS if i is not None]


def test_substring_dedup(docs):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs).collect())
    first = {}
    for i, t in with_id():
        w = (t or "").split()
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, i), i)
    want = Counter()
    for i, t in with_id():
        w = (t or "").split()
        gone = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        want[i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()] += 1
    assert got == want and sum(n for (i, _, g, _), n in got.items() if i == 3 and g) == 2
    left = substring_dedup.without_repeats(docs)
    assert left.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in left.collect())
    assert kept == Counter([(1, ROWS[0][1]), (1, ROWS[1][1]), (2, BASE), (2, BASE), (3, words(35, 500)), (3, "short"), (4, None), (5, ""), (None, PASSAGE)])


def test_suffix_dedup(docs):
    length = 100
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(docs, length, 16).collect())
    bodies = [(i, (t or "").encode()) for i, t in with_id()]
    count = Counter(b[k : k + length] for _, b in bodies for k in range(len(b) - length + 1))
    want = Counter()
    for i, b in bodies:
        gone = {p for k in range(len(b) - length + 1) if count[b[k : k + length]] > 1 for p in range(k, k + length)}
        want[i, len(b), len(gone)] += 1
    assert got == want


def test_later_copies_go_by_doc_id(docs):
    """Rows of one doc_id count in the order of their MD5, whatever the order of the table's rows."""
    length = 100
    got = Counter((r.doc_id, r.n_bytes, r.n_later) for r in suffix_dedup.suffix_dedup(docs.orderBy(F.desc("doc_id")), length, 16).collect())
    bodies = sorted((i, hashlib.md5(t.encode()).hexdigest() if t is not None else "", (t or "").encode()) for i, t in with_id())
    seen, want = {}, Counter()
    for at, (_, _, b) in enumerate(bodies):
        for k in range(len(b) - length + 1):
            seen.setdefault(b[k : k + length], at)
    for at, (i, _, b) in enumerate(bodies):
        want[i, len(b), len({p for k in range(len(b) - length + 1) if seen[b[k : k + length]] < at for p in range(k, k + length)})] += 1
    assert got == want


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(7, " ".join(PASSAGE.split()[:30])), (8, "short")], "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(docs, items).collect())
    want = Counter()
    for i, t in with_id():
        n = len((t or "").split())
        hit, found = (30, 1) if PASSAGE in (t or "") else (1, 1) if t == "short" else (0, 0)
        want[i, n, hit, found, hit > 0] += 1
    assert got == want
    clean = decontaminate.keep_clean(docs, items)
    assert clean.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter([(2, BASE), (2, BASE), (3, BASE), (4, None), (5, ""), (None, PASSAGE)])


def test_near_duplicates(docs):
    rows = with_id()
    of = list(range(len(rows)))
    for i, (_, t) in enumerate(rows):
        for j, (_, u) in enumerate(rows[:i]):
            if t and u and jaccard(t, u) >= 0.8:
                of = [min(of[i], of[j]) if x == max(of[i], of[j]) else x for x in of]
    least = {c: min(rows[k][0] for k in range(len(rows)) if of[k] == c) for c in of}
    got = Counter(map(tuple, near_dedup.near_duplicates(docs).select("doc_id", "class_id").collect()))
    assert got == Counter((i, least[of[k]]) for k, (i, _) in enumerate(rows))
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    texts = Counter((r.doc_id, r.text) for r in kept.collect())
    assert texts == Counter([(1, ROWS[0][1]), (1, ROWS[1][1]), (2, BASE), (3, ROWS[5][1]), (3, "short"), (4, None), (4, PASSAGE), (5, ""), (None, PASSAGE)])


@pytest.mark.parametrize("depth", [10, 450, 10_000])
def test_hidden_text_stays_hidden_at_any_depth(depth):
    deep = "<div>" * depth
    assert html_text.extract(deep + "<div hidden>secret<p>more</div>shown") == "shown"
    assert html_text.extract(deep + "a<b>b<i style='display:none'>secret<u>x</u></i>c</b>") == "abc"
    assert html_text.extract(deep + "<script>secret</script><img><br>end").strip() == "end"


def test_a_text_of_many_trigrams_takes_bounded_memory():
    rng = np.random.default_rng(2)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9FA0, 300_000)))
    row, code = language_id._trigrams([text])
    assert len(np.unique(code)) > 250_000
    tracemalloc.start()
    bundle = language_id.bundles(row, code, 1, 256)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    some = slice(0, 3000)
    plain = language_id.ngram_vectors(code[some], 256).astype(int).sum(axis=0)
    assert (language_id.bundles(row[some], code[some], 1, 256)[0] == plain).all() and np.isfinite(bundle).all()


def test_bundles_by_a_plain_loop():
    """Every letter's vector, turned and multiplied, one trigram after the other."""
    texts = ["Abc abd, ABC!", None, "", "12 3", "ähnlich äh", "x"]
    row, code = language_id._trigrams(texts)
    got = language_id.bundles(row, code, len(texts), 128)
    for i, text in enumerate(texts):
        letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        padded = " " + " ".join(letters.split()) + " "
        want = np.zeros(128)
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            if b != " ":
                own = [language_id._letter_vectors(np.array([0 if x == " " else ord(x)], np.int64), 128)[0] for x in (a, b, c)]
                want += np.roll(own[0], 2) * np.roll(own[1], 1) * own[2]
        assert (got[i] == want).all()
