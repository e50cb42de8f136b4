"""URL filters, token alignment and whitening against plain versions, with every odd kind of row."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from revulet.llm import queries, token_alignment, url_filter, whitening

CLASHING = ["key", "row", "kind", "part", "chain", "stack", "rule", "index", "x", "dims", "n", "chunk", "codes", "known", "component", "deviation"]


def with_clashes(frame):
    return frame.withColumns({c: F.lit("x") for c in CLASHING})


# --- URL filters --------------------------------------------------------------------------------------


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    return host, tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]


def judged(page_id, url, rules, default="allow"):
    host, path = url_parts(url)
    fits = [(len(h + p), len(h), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (page_id, host, path, max(fits)[2], max(fits)[3]) if fits else (page_id, host, path, None, default)


RULES = "host string, path string, verdict string"
PAGES = "page_id long, url string"
ODD_URLS = [None, "", "no scheme", "http://", "http:///de/", "HTTP://A.B.com/x", "x://net", "x://net?q", "x://.net/", "x://net./", "x://a..net/p#f", "x://nett/", "x://ä.NET/é?ü", "a://b://c.net/", "x://net\n.net/a\nb", "x://u:p@com:80/de/", "x://" + "a." * 300 + "net/" + "p" * 5000]


@pytest.mark.parametrize("seed", [1, 2])
def test_url_filters(spark, seed):
    r = random.Random(seed)
    labels, steps = ["a", "b", "-", "net", "com"], ["", "/", "/e", "/en", "/en/", "/en/x", "/de/", "/é"]
    host = lambda: ".".join(r.choices(labels, k=r.randint(1, 4)))
    given = [(host(), r.choice(steps), r.choice(["block", "allow"])) for _ in range(60)]
    rules = {}
    for h, p, v in given:
        rules[h, p] = max(v, rules.get((h, p), v))
    odd_rules = [(None, "/", "block"), ("a", None, "block"), ("b", "/", None), ("", "/", "block"), ("com", "en", "block"), ("NET", "/zz", "block")]
    rules["net", "/zz"] = "block"
    urls = [f"http://{host()}{r.choice(steps)}{r.choice(['', '/', 'x', 'zz', '?q=/en/', '#f'])}" for _ in range(400)] + ODD_URLS
    rows = [(i, u) for i, u in enumerate(urls)]
    rows += [rows[0]] * 300 + [(0, urls[1]), (None, urls[2])]
    pages = with_clashes(spark.createDataFrame(rows, PAGES).repartition(3))
    got = url_filter.judge(pages, with_clashes(spark.createDataFrame(given + odd_rules, RULES)))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert Counter(map(tuple, got.collect())) == Counter(judged(i, u, rules) for i, u in rows)
    assert url_filter.judge(pages.limit(0), spark.createDataFrame(given, RULES)).count() == 0
    none = url_filter.judge(pages, spark.createDataFrame([], RULES), "block")
    assert {(x.rule, x.verdict) for x in none.collect()} == {(None, "block")} and none.count() == len(rows)


def test_url_filters_use_no_python(spark, small):
    plan = queries.op11_url_filters(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- token alignment ----------------------------------------------------------------------------------


def tokens_of(text):
    """Ids and bytes of both tokenizers, from the libraries."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(tokens_of, "a"):
        tokens_of.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        tokens_of.a.encode_special_tokens = True
        tokens_of.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        plain = [c for c in range(256) if 0x21 <= c <= 0x7E or 0xA1 <= c <= 0xAC or c >= 0xAE]
        odd = [c for c in range(256) if c not in plain]
        tokens_of.byte = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(odd)}
    if not text:
        return [], []
    a = [(i, bytes(tokens_of.byte[c] for c in tokens_of.a.id_to_token(i))) for i in tokens_of.a.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in tokens_of.b.encode(text):
        piece = tokens_of.b.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") else piece.replace("\u2581", " ").encode()))
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def aligned(rows):
    """All results by plain loops over tokens."""
    out, linked = [], []
    for doc_id, text in rows:
        spans = []
        for side in tokens_of(text):
            at, own = 0, []
            for i, piece in side:
                own.append((at, at + len(piece), i))
                at += len(piece)
            spans.append(own)
        a, b = spans
        ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        parts, start = [], 0
        for end in ends:
            parts.append("|".join(",".join(str(i) for s, e, i in side if start <= s and e <= end) for side in (a, b)))
            start = end
        own = [(i, j) for s, e, i in a for t, f, j in b if s < f and t < e]
        linked.append(own)
        out.append([doc_id, len(a), len(b), len(ends), len(own), hashlib.sha256(";".join(parts).encode()).hexdigest() if a else ""])
    count = Counter(p for own in linked for p in own)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return [(*x[:5], sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own), x[5]) for x, own in zip(out, linked)]


@pytest.mark.parametrize("chunk", [1 << 22, 64])
def test_token_alignment(spark, small, chunk, monkeypatch):
    monkeypatch.setattr(token_alignment, "CHUNK_BYTES", chunk)
    texts = ["", None, " ", "a", "two words", "  two   spaces\n\nlines\t", "<|endoftext|><s></s><unk>", "Ünïcödé 漢字かな 🙂🙃 \u0301e", "\u2581low block", "a\u2581b", "\x00\x01", "internationalisation " * 20, "ﬁ ﬀ ½ ①", "x" * 3000, "the cat " * 400]
    real = [r.text[:400] for r in spark.read.parquet(f"{small}/documents.parquet").where("text is not null").orderBy("doc_id").limit(25).collect()]
    rows = [(i, t) for i, t in enumerate(texts + real)]
    rows += [rows[4], rows[4], (4, "another text"), (None, "no id")]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = token_alignment.alignment(docs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(aligned(rows))
    assert token_alignment.alignment(docs.limit(0)).count() == 0
    assert [tuple(r) for r in token_alignment.alignment(docs.where("text is null")).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_pointers_end_at_the_last_token_of_a_component():
    r = np.random.default_rng(3)
    for _ in range(200):
        n = int(r.integers(1, 60))
        a, b = (np.append(np.flatnonzero(r.random(n - 1) < p) + 1, n) for p in r.random(2))
        link_a, link_b, ends_a, ends_b = token_alignment.links(a, b)
        in_a, in_b = token_alignment.groups(token_alignment.successors(link_a, link_b, ends_a, ends_b), len(a))
        common = np.intersect1d(a, b)
        assert (in_a == np.searchsorted(common, a)).all() and (in_b == np.searchsorted(common, b)).all()


# --- whitening ----------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def whitened(rows, components=16):
    used = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in used})
    n, sums = len(fit), [sum(column) for column in zip(*fit)]
    centred = np.array([[(n * v - s) / n for v, s in zip(x, sums)] for x in fit])
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1], vector[:, ::-1]
    out = {}
    for i, x in used:
        apart = [n * v - s for v, s in zip(x, sums)]
        for k in range(min(components, len(x))):
            out.setdefault((i, k + 1), []).append((n, sum(v * v for v in apart), abs(float(np.array(apart) / n @ vector[:, k])) / value[k] ** 0.5, value[k] / value.sum()))
    return out


def compare(got, want):
    rows = {}
    for r in got.collect():
        rows.setdefault((r.vec_id, r.component), []).append((r.n, int(r.deviation), abs(r.whitened), r.explained))
        assert 0 <= r.identity_error < 1e-9
    assert rows.keys() == want.keys()
    for key, own in want.items():
        assert np.allclose(sorted(rows[key]), sorted(own), rtol=1e-7, atol=1e-9) and sorted(x[:2] for x in rows[key]) == sorted(x[:2] for x in own)


@pytest.mark.parametrize(("dims", "cells"), [(5, 1 << 18), (20, 64)])
def test_whitening(spark, dims, cells, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_CELLS", cells)
    r = np.random.default_rng(dims)
    mixed = r.normal(size=(150, dims)) @ r.normal(size=(dims, dims))
    rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(mixed)]
    odd = [(900, None), (901, []), (902, [None] * dims), (903, [float("nan")] * dims), (904, [float("inf")] * dims)]
    rows += [rows[0]] * 40 + [(700, rows[0][1]), (0, rows[1][1]), (None, rows[2][1])] + odd
    vectors = with_clashes(spark.createDataFrame([(*x, None) for x in rows], VECTORS).repartition(4))
    compare(whitening.whiten(vectors), whitened(rows))
    assert whitening.whiten(vectors.limit(0)).count() == 0


def test_whitening_without_variance(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (3, [4.0, 4.0]), (4, [5.0, 4.0]), (5, [])]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(spark.createDataFrame([(*x, None) for x in rows], VECTORS)).collect()}
    assert got.keys() == {(i, k) for i in (1, 2) for k in (1, 2, 3)} | {(i, k) for i in (3, 4) for k in (1, 2)}
    assert all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, 0, 0, 0) for (i, _), r in got.items() if i < 3)
    assert abs(got[3, 1].whitened) == pytest.approx(1) and got[3, 2].whitened == 0 and got[3, 1].explained == 1


def test_whitening_over_a_table(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    compare(queries.op13_whitening(spark, small), whitened(rows))
