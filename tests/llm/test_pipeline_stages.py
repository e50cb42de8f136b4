"""Every stage of the pipeline against a brute-force version, on the smallest table and on planted rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from revulet.llm import quality
from revulet.llm.common import written
from revulet.llm.tokens import default_vocabulary, encoder

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, small):
    """The whole table, and planted rows: a copy, a near copy, a long passage in common, a benchmark item, no text."""
    table = spark.read.parquet(f"{small}/documents.parquet").select(*(c.split()[0] for c in SCHEMA.split(", ")))
    prose = [r.text for r in table.orderBy("doc_id").collect() if r.text and len(r.text.split()) > 150 and len(r.text.split(" ")) > 150]
    one, two, three = prose[0], prose[1], prose[2]
    near = one.split(" ")
    near[70] = "altered"
    item = spark.read.parquet(f"{small}/benchmark.parquet").orderBy("item_id").first().text
    planted = [one, " ".join(near), " ".join([*(f"own{i}" for i in range(60)), *two.split()[10:130]]), three[: len(three) // 2] + " " + item + " " + three[len(three) // 2 :], "", None, "two words"]
    rows = [(10**6 + i, t, "en", "planted", None if t is None else len(t)) for i, t in enumerate(planted)]
    return written(table.union(spark.createDataFrame(rows, SCHEMA)), "planted")


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_quality_stage(spark, small, docs):
    """Votes of all labelled texts, sorted in full, one document at a time."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect() if r.quality is not None}
    before = texts(docs)
    row = {i: quality.features(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0].astype(float) for i, t in before.items()}
    learnt = sorted(i for i in labels if i in row and zlib.crc32(str(i).encode()) % 5)
    idf = np.log((1 + len(learnt)) / (1 + sum(row[i] > 0 for i in learnt))) + 1
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    _, _, space = np.linalg.svd(np.array([unit(row[i] * idf) for i in learnt]), full_matrices=False)
    latent = {i: unit(space[: quality.LATENT] @ unit(v * idf)) for i, v in row.items()}
    want, close = set(), set()
    for i in before:
        votes = sorted(((max(float(latent[i] @ latent[j]), 0) ** quality.SHARPNESS, labels[j]) for j in learnt), reverse=True)[: quality.NEIGHBOURS]
        total = sum(w for w, _ in votes)
        score = sum(w * y for w, y in votes) / total if total and latent[i].any() else np.mean([labels[j] for j in learnt])
        if score >= 0.3:
            want.add(i)
        if abs(score - 0.3) < 0.01:
            close.add(i)
    after = STAGES["quality"](spark, docs, small)
    got = texts(after)
    assert after.columns == docs.columns and set(got) - close == want - close and len(want) < len(before)
    assert all(got[i] == before[i] for i in got)


def test_near_duplicate_stage(spark, small, docs):
    before = texts(docs)

    def units(text):
        w = (text or "").encode().split()
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])

    sets = {i: units(t) for i, t in before.items()}
    sizes = {i: sum(s.values()) for i, s in sets.items()}
    label = {i: i for i in before}
    for i in before:
        for j in before:
            if i < j and sizes[i] and min(sizes[i], sizes[j]) >= 0.8 * max(sizes[i], sizes[j]):
                common = sum((sets[i] & sets[j]).values())
                if common >= 0.8 * (sizes[i] + sizes[j] - common) and label[i] != label[j]:
                    old, new = max(label[i], label[j]), min(label[i], label[j])
                    label = {k: new if x == old else x for k, x in label.items()}
    after = STAGES["near_duplicates"](spark, docs, small)
    assert after.columns == docs.columns and texts(after) == {i: t for i, t in before.items() if label[i] == i}
    assert {10**6, 10**6 + 1}.isdisjoint(texts(after))


def test_substring_stage(spark, small, docs):
    before = texts(docs)
    own = {i: (t or "").encode().split() for i, t in before.items()}
    first = {}
    for i in sorted(own):
        for k in range(len(own[i]) - 49):
            first.setdefault(tuple(own[i][k : k + 50]), i)
    want = {}
    for i, w in own.items():
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        if not gone:
            want[i] = before[i]
        elif len(gone) < len(w):
            want[i] = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
    after = STAGES["substrings"](spark, docs, small)
    assert after.columns == docs.columns and texts(after) == want and 10**6 not in want and 60 <= len(want[10**6 + 2].split()) < 180
    assert all(r.n_chars == len(r.text) for r in after.collect() if r.text is not None and r.text != before[r.doc_id])


def test_decontamination_stage(spark, small, docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    words = lambda t: word.findall((t or "").translate(lower))
    windows = set()
    for r in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(len(w) - 9, 1))} if w else set()
    sizes = {len(x) for x in windows}
    before = texts(docs)
    want = {i: t for i, t in before.items() if not any(tuple(w[k : k + n]) in windows for w in [words(t)] for n in sizes for k in range(len(w) - n + 1))}
    after = STAGES["decontamination"](spark, docs, small)
    assert after.columns == docs.columns and texts(after) == want and 10**6 + 3 not in want and 10**6 + 5 in want


def test_packing_stage(spark, small, docs):
    """Every id of every document is in one piece, and windows are full or a power of two."""
    encode, rows = encoder(default_vocabulary(), special=True), STAGES["packing"](spark, docs, small).collect()
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    before = texts(docs)
    assert set(pieces) == set(before)
    for i, t in before.items():
        ids, at = np.array([*encode(t), 0], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in windows.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 1024 or at & (at - 1) == 0


def test_run_applies_the_stages_in_order(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name in ("quality", "near_duplicates", "substrings", "decontamination"):
        docs = written(STAGES[name](spark, docs, small), name)
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    rows = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in rows} == ids and len(rows) >= len(ids) > 100
