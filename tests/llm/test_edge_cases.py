"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from revulet.llm import decontaminate, html_text, language_id, near_dedup, packing, quality, substring_dedup, suffix_dedup, token_counts, top_k

#: Names that operators use inside.
CLASHING = ["place", "anchor", "copy", "gone", "n", "n_words", "rank", "band", "bucket", "term", "position", "features", "label", "score", "class_id", "rep", "start", "size", "one", "two", "least", "digest", "later", "hub", "degree", "next", "kept"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    a, b, passage, long = words(1, 200), words(2, 150), words(3, 80), words(4, 30_000)
    near = a.split()
    near[100] = "changed"
    return [
        (1, a),
        (2, a),
        (3, " ".join(near)),
        (4, b + " " + passage),
        (5, passage + "\n" + words(5, 60)),
        (6, ""),
        (7, None),
        (8, "two words"),
        (9, long),
        (10, "ab " * 400),
        (11, "ÄÖ é 漢字   x"),
        (12, "\x00<|endoftext|> A.B.C"),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "de" if i % 2 else None, None, None) for i, t in texts]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return frame.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("hot", [1000, 2])
def test_substring_dedup(docs, none, texts, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs, window=50).collect()}
    first = {}
    for i, t in texts:
        w = (t or "").encode().split()
        for k in range(len(w) - 49):
            first[tuple(w[k : k + 50])] = min(first.get(tuple(w[k : k + 50]), i), i)
    for i, t in texts:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    assert got[2].n_removed == 200 and got[5].n_removed == 80 and got[1].n_removed == 0
    assert substring_dedup.substring_dedup(none).count() == 0
    left = substring_dedup.without_repeats(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, _ in texts} - {2}


@pytest.mark.parametrize("period", [7, 13, 21, 31])
def test_cover_reaches_every_difference(period):
    chosen = substring_dedup.cover(period)
    assert {(a - b) % period for a in chosen for b in chosen} == set(range(period))


@pytest.mark.parametrize("most", [1 << 20, 900])
def test_suffix_dedup(docs, none, texts, most):
    length = 100
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs, length, 16, most).collect()}
    count = Counter(b[k : k + length] for _, t in texts for b in [(t or "").encode()] for k in range(len(b) - length + 1))
    for i, t in texts:
        b = (t or "").encode()
        step = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                step[k] += 1
                step[k + length] -= 1
        gone = np.cumsum(step[: len(b)]) > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256, bytes(got[i].kept)) == (len(b), gone.sum(), spans, hashlib.sha256(kept).hexdigest(), kept)
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_passages_are_judged_by_bytes_and_lose_their_first_copies(spark):
    """A passage of over 50 words stays if it has fewer than 400 bytes; of 400 or more, the first copy goes as well."""
    rows, want = [], {}
    for k, n in enumerate((399, 400, 401)):
        passage = words(20 + k, 100)[:n]
        assert len(passage.split()) > 50
        for side, edge in enumerate("XY"):  # no byte beside the passage is the same in both
            rows.append((2 * k + side, f"{words(30 + 2 * k + side, 80)} {edge}{passage}{edge} {words(40 + 2 * k + side, 80)}"))
            want[2 * k + side] = (n, 1) if n >= 400 else (0, 0)
    found = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in found.collect()} == want


@pytest.mark.parametrize("most", [1 << 20, 900])
def test_bytes_of_later_copies(spark, docs, texts, most):
    """n_later: the bytes in strings that a smaller doc_id has, too; not those of first copies and of one text alone."""
    length, passage, own = 100, words(50, 40), words(51, 40)
    more = [(20, f"{words(52, 60)} {passage} {words(53, 30)}"), (21, f"{passage} {own} {words(54, 9)} {own}"), (22, f"{words(55, 20)} {passage} {own}"), (23, f"{words(56, 20)} {passage} {own}")]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r.doc_id: r.n_later for r in suffix_dedup.suffix_dedup(both, length, 16, most, False).collect()}
    bodies = {i: (t or "").encode() for i, t in texts + more}
    first = {}
    for i, b in bodies.items():
        for k in range(len(b) - length + 1):
            first[b[k : k + length]] = min(i, first.get(b[k : k + length], i))
    want = {i: len({p for k in range(len(b) - length + 1) if first[b[k : k + length]] < i for p in range(k, k + length)}) for i, b in bodies.items()}
    assert got == want and got[1] == got[20] == 0 and got[2] == len(bodies[2])
    assert len(passage) <= got[21] < len(passage) + 9 and got[22] >= len(passage + own)


def test_interval_expansion_against_counting():
    rng = np.random.default_rng(7)
    for _ in range(150):
        text = np.append(rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(1, 150))), 0)
        length = int(rng.integers(1, 12))
        strings = [tuple(text[i : i + length]) for i in range(len(text) - length + 1)]
        count = Counter(strings)
        assert [count[s] > 1 for s in strings] == list(suffix_dedup.repeated(text, length)[: len(strings)])


def test_token_counts(docs, none, texts, spark):
    lengths = {r.doc_id: r.n_tokens for r in token_counts.token_lengths(docs).collect()}
    assert lengths[6] == lengths[7] == 0 and all(lengths[i] > 0 for i, t in texts if t)
    counts = spark.createDataFrame([(0, 2), (3, 1), (600, 4), (601, 1)], "n_tokens long, docs long")
    every = [0] * 2 + [3] + [600] * 4 + [601]
    for r in token_counts.limits(counts).collect():
        limit = r.context_limit
        assert r.docs_within == sum(x <= limit for x in every) and r.docs_beyond == sum(x > limit for x in every)
        assert r.tokens_within == sum(x for x in every if x <= limit) and r.tokens_truncated == sum(min(x, limit) for x in every) and r.tokens_total == sum(every)
    assert token_counts.at_limit(counts, 10).collect()[0].tokens_truncated == 53
    assert token_counts.length_at_quantile(counts, 0.5).collect()[0].n_tokens == 600
    assert token_counts.token_counts(none).count() == 0


def test_packing_is_a_partition_of_all_ids(docs, none, texts):
    import zlib

    from revulet.llm.tokens import default_vocabulary, encoder

    rows = packing.pack(docs).collect()
    encode = encoder(default_vocabulary(), special=True)
    for i, t in texts:
        ids = np.array([*encode(t), 0], "<u4")
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in mine] == list(np.cumsum([0, *(r.length for r in mine)])[:-1]) and sum(r.length for r in mine) == len(ids) == mine[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine)
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append(r)
    for parts in windows.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == list(np.cumsum([0, *(r.length for r in parts)])[:-1])
        fill = sum(r.length for r in parts)
        assert fill == 1024 or fill & (fill - 1) == 0
    assert packing.pack(none).count() == 0


def test_sum_of_squares_takes_the_least_level():
    packer = packing.Packer(8, 0)
    for doc, size in enumerate([3, 5, 2, 6, 4, 4, 3, 3, 7, 1]):
        before = packer.level.copy()
        list(packer.add(doc, np.arange(size, dtype="<u4")))

        def total(at, before=before, size=size):
            level = before.copy()
            if at:
                level[at] -= 1
            if at + size < 8:
                level[at + size] += 1
            return (level**2).sum()

        options = [at for at in range(0, 8 - size + 1) if at == 0 or before[at]]
        assert (packer.level[:8] ** 2).sum() == min(map(total, options))


def test_packing_keeps_few_windows_open_and_pieces_in_place():
    rng = np.random.default_rng(5)
    packer, closed, placed = packing.Packer(64, 0), [], {}
    sizes = [int(x) for x in rng.integers(1, 150, 3000)]
    for doc, size in enumerate(sizes):
        closed += packer.add(doc, np.arange(size, dtype="<u4"))
        assert packer.level.sum() == sum(map(len, packer.open)) <= packing.OPEN
    online = packer.next
    placed = {(p[0], p[1]) for windows in packer.open for window in windows for p in window}
    last = list(packer.finish())
    assert packer.next - online <= packing.OPEN + 6
    assert sum((r[0], r[1]) in placed for r in last) >= len(placed) - 6  # pieces begin where they were cut before
    lengths, fills = {}, {}
    for doc, start, length, _, total, sequence, offset in closed + last:
        lengths.setdefault(doc, []).append((start, length))
        assert offset == fills.get(sequence, 0) and total == sizes[doc]
        fills[sequence] = offset + length
    for doc, size in enumerate(sizes):
        at = 0
        for start, length in sorted(lengths[doc]):
            assert start == at and length > 0
            at += length
        assert at == size
    assert all(x == 64 or x & (x - 1) == 0 for x in fills.values()) and sum(x < 64 for x in fills.values()) <= 6


def test_ids_of_the_vocabulary_file_as_it_is():
    from tokenizers import Tokenizer

    from revulet.llm.tokens import Encoder, default_vocabulary

    plain, own = Tokenizer.from_file(default_vocabulary()), Encoder(default_vocabulary(), special=True)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>  x", "<|endoftext", "漢<|endoftext|>\n\n é", words(9, 300)):
        assert own(text) == plain.encode(text, add_special_tokens=False).ids


def test_vocabularies_agree():
    from revulet.llm.tokens import Encoder, default_vocabulary

    fast = Encoder(default_vocabulary())
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(default_vocabulary())
    slow.encode_special_tokens = True
    for text in ("Hello  world\n\n x", "ÄÖ é 漢字   x 12345", "a's don't  \t", "🙂🙂 <|endoftext|>", words(9, 300)):
        assert fast(text) == slow.encode(text, add_special_tokens=False).ids


def test_decontamination(spark, docs, none, texts):
    text = dict(texts)
    items = spark.createDataFrame([(1, " ".join(text[4].split()[10:40]).upper()), (2, "TWO words!"), (3, None), (4, "..."), (5, "never seen words " * 5), (6, words(77, 12) + " " + " ".join(text[9].split()[500:512]))], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    assert (got[4].n_hit, got[4].n_items) == (30, 1) and got[4].items_sha256 == hashlib.sha256(b"1").hexdigest()
    assert got[8].n_hit == 2 and got[9].n_hit == 12 and got[7].n_words == 0 and not got[1].contaminated
    assert got[1].items_sha256 == hashlib.sha256(b"").hexdigest() and len(got) == len(texts)
    assert decontaminate.contamination(none, items).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.contamination(docs, empty).collect())
    clean = decontaminate.keep_clean(docs, items)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in texts} - {4, 8, 9}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha one two beta gamma"), (2, "alpha " + "x " * 30 + "beta gamma"), (3, "gamma beta")], "doc_id long, text string")
    windows, _ = decontaminate.test_windows(spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"))
    index = decontaminate.build_index(docs, windows.select(F.explode("terms").alias("term")))
    assert {r.doc_id for r in decontaminate.proximity_matches(index, windows, 5).collect()} == {1}
    assert decontaminate.phrase_matches(index, windows).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i * 50, [float(x) for x in rng.normal(size=6)], "x") for i in range(60)]
    rows += [(7, rows[4][1], "x"), (8, rows[4][1], "x"), (9, None, "x"), (11, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (13, [float("nan")] * 6, "x"), (None, [0.0] * 6, "x"), (100000, [1.0, 2.0], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(3)
    got = [tuple(r) for r in top_k.top_k(frame).orderBy("query_id", "rank").collect()]
    good = [(i, np.floor(1024 * np.array(v))) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for i, q in sorted(good, key=lambda x: x[0]):
        if i % 100 == 0:
            best = sorted((-(int(q @ v)), j) for j, v in good if j != i and len(v) == len(q))[:10]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == want
    assert top_k.top_k(frame.limit(0)).count() == 0


def test_top_k_reads_lists_as_far_as_it_must_and_scores_exactly(spark):
    rng = np.random.default_rng(8)
    heavy = rng.pareto(1.1, size=(3000, 12))
    near = np.array([[94906267.0, 1.0 + i % 3] for i in range(50)]) / 1024  # inner products beyond 2**53
    large = rng.integers(-(10**6), 10**6, (300, 5)).astype(float)
    for vectors in (heavy, near, large, np.zeros((30, 4)), rng.integers(-2, 3, (400, 3)).astype(float)):
        frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        entries = spark.sparkContext.accumulator(0)
        got = [tuple(r) for r in top_k.top_k(frame, every=25, entries=entries).orderBy("query_id", "rank").collect()]
        whole = [[int(x) for x in np.floor(1024 * v)] for v in vectors]
        want = []
        for q in range(0, len(whole), 25):
            best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in enumerate(whole) if i != q)[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
        assert got == want
        most = sum(sum(map(bool, v)) for v in whole[::25]) * len(whole)
        assert entries.value <= most and (vectors is not heavy or 0 < entries.value < most / 2)
    with pytest.raises(Exception, match="too large"):
        top_k.top_k(spark.createDataFrame([(0, [1e9]), (1, [1e9])], "vec_id long, embedding array<double>")).collect()


def test_top_k_over_several_blocks_of_queries_and_parts(spark, monkeypatch):
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(900, 7))
    frame = spark.createDataFrame([(i // 2 if i % 50 == 1 else i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    want = [tuple(r) for r in top_k.top_k(frame, every=3).orderBy("query_id", "rank", "vec_id").collect()]
    for name, value in (("QUERY_BLOCK", 70), ("PART", 100)):
        monkeypatch.setattr(top_k, name, value)
    assert [tuple(r) for r in top_k.top_k(frame, every=3).orderBy("query_id", "rank", "vec_id").collect()] == want


def test_quality(spark, none):
    junk = [(i, "word | " * 30, 0) for i in range(0, 80)]
    prose = [(i, words(i, 40).capitalize() + ".", 1) for i in range(80, 200)]
    extra = [(500, "", None), (501, None, None)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in junk + prose + extra], "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASHING})
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in junk + prose] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert all(got[i].predicted == q for i, _, q in junk + prose) and all(0 <= r.score <= 1 for r in got.values()) and len(got) == 202
    kept = quality.keep_accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _, q in prose} | {500, 501}
    assert quality.quality(none, labels).count() == 0
    assert all(r.score == 0.5 for r in quality.quality(docs, labels.limit(0)).collect())


def test_held_out_quality(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    rows = quality.quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert rows and np.mean([r.predicted == r.quality for r in rows]) >= 0.9


def test_language_id(spark, docs, none, texts, small):
    got = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    assert len(got) == len(texts) and got[6].lang_pred == got[7].lang_pred == "und" and got[7].score == 0 and got[1].lang_pred == "de"
    assert language_id.language_id(none).count() == 0
    table = spark.read.parquet(f"{small}/documents.parquet")
    rows = language_id.language_id(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.9


def jaccard(a, b, width=5):
    def units(text):
        w = text.encode().split()
        return Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else Counter([tuple(w)])

    x, y = units(a), units(b)
    return sum((x & y).values()) / sum((x | y).values())


def test_near_duplicates_against_all_pairs(spark, none):
    rng = np.random.default_rng(5)
    texts = []
    for family in range(25):
        base = words(100 + family, int(rng.integers(60, 200))).split()
        for _ in range(int(rng.integers(1, 7))):
            new = list(base)
            for _ in range(int(rng.integers(0, 5))):
                new[int(rng.integers(0, len(new)))] = "edit" + str(rng.integers(0, 1000))
            texts.append(" ".join(new))
    texts += ["", None, "short one", "short one", texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASHING})
    of = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] and texts[j] and jaccard(texts[i], texts[j]) >= 0.8:
                old, new = max(of[i], of[j]), min(of[i], of[j])
                of = [new if x == old else x for x in of]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == dict(enumerate(of))
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(of)
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_in_buckets_of_many_classes(spark):
    """Texts with a long passage in common fall into the same buckets; every two of them have a near copy far away."""
    rng = np.random.default_rng(11)
    passage, texts = words(900, 120).split(), []
    for one in range(40):
        own = words(1000 + one, 60).split()
        for _ in range(2):
            new = list(own)
            new[int(rng.integers(5, 55))] = "edit" + str(rng.integers(0, 10**6))
            texts.append(" ".join(passage + new))
    texts = [texts[i] for i in rng.permutation(len(texts))]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    own = near_dedup.bands(near_dedup.signatures(*near_dedup.shingles(data, offsets), len(texts), 4), 4, 1)
    of = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (own[i] == own[j]).any() and jaccard(texts[i], texts[j]) >= 0.8:
                old, new = max(of[i], of[j]), min(of[i], of[j])
                of = [new if x == old else x for x in of]
    assert len(set(of)) < 45
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs, count=4, rows=1).collect()} == dict(enumerate(of))


def test_darts_estimate_similarity():
    a, b = words(1, 400), words(1, 400).replace(" ", "  ", 3)
    c = " ".join(words(1, 400).split()[:330] + words(2, 70).split())
    data = np.frombuffer((a + b + c).encode(), np.uint8)
    offsets = np.cumsum([0, len(a.encode()), len(b.encode()), len(c.encode())])
    row, unit = near_dedup.shingles(data, offsets)
    signature = near_dedup.signatures(row, unit, 3, 512)
    assert (signature[0] == signature[1]).all()
    assert abs((signature[0] == signature[2]).mean() - jaccard(a, c)) < 0.08


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 105), (7, 3)]
    got = {r.doc_id: r.label for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 105: 100}


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var a="</p>";</script></head><body hidden2>
<nav><ul><li><a href="/a">A</a><li>B<ol start=3><li>c<li>d</ol></ul></nav><!-- gone --><div hidden>no</div><span style="display: none">no</span>
<p>one<p>two <b>bold</b>!<br>line<table><caption>Cap</caption><tr><td>k<td>long cell<tr><th>kkkk<td>v</table>
<pre> a
  b</pre>1 < 2 &lt; 3<template>no</template></body></html>"""


def test_html(spark):
    want = "- A\n- B\n\n  3. c\n  4. d\n\none\n\ntwo bold!\nline\n\nCap\nk     long cell\nkkkk  v\n\n a\n  b\n\n1 < 2 < 3"
    rows = [(1, PAGE, "x"), (1, PAGE, "x"), (2, None, "x"), (3, "", "x"), (4, "<" * 500, "x"), (5, "<div>" * 3000 + "deep", "x"), (6, "<p>a</td></table></p>b<script>open", "x"), (7, 'a<a title="x>y">b</a><img alt=no>c', "x")]
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == 8 and text[1] == want and text[2] == text[3] == "" and text[4] == "<" * 500 and text[5] == "deep" and text[6].split() == ["a", "b"] and text[7] == "abc"
    assert {r.title for r in got if r.page_id == 1} == {"T & x"}
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_html_shown_elements():
    page = """a<math><mi>x</mi><annotation>no</annotation></math><svg><title>no</title><desc>no</desc><path d="m"/><text>label</text></svg>
<select><option>one<option>two</select><map name=m>mapped<area></map><xmp><b> &amp;</xmp>end<datalist><option>no</datalist>"""
    text = html_text.extract(page)
    assert [x for x in ("x", "label", "one", "two", "mapped", "<b> &amp;", "end") if x not in text] == [] and "no" not in text
