"""Removal of repeated byte strings by threshold-bounded interval expansion on Burrows-Wheeler transforms.

Every string of LENGTH bytes belongs to the segment around its minimiser, the least hash among its grams of GRAM bytes;
equal strings have equal minimisers. Segments are counted by content, so copies meet as one row, and only those whose
minimiser another segment has go on. They are dealt out by minimiser and put into blocks of bounded size. A block's
transform is searched breadth-first: starting with the interval of the empty string, intervals are extended backwards
by one character a round, and the boundaries that a round reaches first have a common prefix of just that length. After
LENGTH rounds, the boundaries never reached join suffixes that share LENGTH characters or more: the repeated strings.
A minimiser with more text than a block may hold is dealt out again by the strings themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH, GRAM = 400, 32
#: Characters of one block, and of one minimiser's segments at most.
BLOCK = 1 << 21
_SECOND = C.Powers(0xA0761D6478BD642F)
_BYTES = C.mix(C.BYTES ^ np.uint64(0xE7037ED1A0B428DB))


def minimisers(grams: np.ndarray, width: int) -> np.ndarray:
    """For each window of width grams the place of its least one, the first of equals."""
    n = len(grams)
    bits = np.uint64(max(24, n.bit_length()))
    key = (grams >> bits << bits) | np.arange(n, dtype=np.uint64)
    pad = -n % width
    rows = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - width + 1], ahead[width - 1 : n])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _segments(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in C.steps(batches):
        data, offsets = C.utf8(batch.column(1))
        ids = C.longs(batch.column(0))
        starts, ends, base, docs, least, middle = [], [], [], [], [], []
        symbols = C.BYTES[data]
        count = len(data) - gram + 1
        at = np.arange(max(count, 0))
        grams = C.span_hash(symbols, at, at + gram, C._BYTE) if count > 0 else np.zeros(0, np.uint64)
        for i in np.flatnonzero(np.diff(offsets) >= length):
            low, high = offsets[i], offsets[i + 1]
            places = minimisers(grams[low : high - gram + 1], length - gram + 1)
            first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
            last = np.concatenate([first[1:], [len(places)]]) - 1
            starts.append(low + first)
            ends.append(low + last + length)
            base.append(np.full(len(first), low))
            docs.append(np.full(len(first), ids[i]))
            least.append(grams[low + places[first]])
            middle.append(places[first] - first)
        if not starts:
            continue
        start, end = np.concatenate(starts), np.concatenate(ends)
        one, two = C.span_hash(symbols, start, end, C._BYTE), C.span_hash(_BYTES[data], start, end, _SECOND)
        columns = [np.concatenate(docs), (start - np.concatenate(base)), (end - start), np.concatenate(middle), C.signed(np.concatenate(least)), C.signed(one), C.signed(two)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "start", "size", "middle", "least", "one", "two"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each listed segment: least, one, two, middle, piece, first (its document)."""
    for batch in C.steps(batches):
        data, offsets = C.utf8(batch.column(0))
        body = data.tobytes()
        ids = C.longs(batch.column(2))
        rows = [(r["least"], r["one"], r["two"], r["middle"], body[offsets[i] + r["start"] : offsets[i] + r["start"] + r["size"]], ids[i]) for i, found in enumerate(batch.column(1).to_pylist()) for r in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()), strict=True)], names=["least", "one", "two", "middle", "piece", "first"])


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of text (symbols below 512) in the order of their first depth symbols or more."""
    n = len(text)
    packed = np.zeros(n, np.int64)
    step = 7
    for k in range(step):
        packed <<= 9
        packed[: max(n - k, 0)] |= text[k:]
    order = np.argsort(packed, kind="stable")
    while True:
        sorted_key = packed[order]
        new = np.ones(n, bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        number = np.cumsum(new)
        if step >= depth or number[-1] == n:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = number
        # Only suffixes that still have equals are sorted anew, within their places.
        tied = ~new
        tied[:-1] |= ~new[1:]
        where = np.flatnonzero(tied)
        packed = rank * (n + 1)
        packed[: max(n - step, 0)] += rank[step:]
        mine = order[where]
        order[where] = mine[np.argsort(packed[mine], kind="stable")]
        step *= 2


def repeated(text: np.ndarray, length: int, owner: np.ndarray | None = None) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """For each place of text, whether the length symbols from there also start elsewhere; if places have owners, also
    whether they start at a place of a lesser owner.

    Breadth-first backward extension. Common prefixes of neighbours in suffix order appear by increasing value, and
    the search stops at length.
    """
    n = len(text)
    order = suffix_order(text, length + 1)
    before = text[order - 1]  # the transform; text is taken as a circle
    by = np.argsort(before, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by] = np.arange(n)
    reached = np.zeros(n + 1, bool)
    reached[[0, n]] = True
    places = {int(c): np.flatnonzero(before == c) for c in np.unique(before)}
    begin, total = {}, 0
    for c in sorted(places):
        begin[c] = total
        total += len(places[c])
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        if not len(low):
            break
        size = high - low
        single = size == 1
        left, right = [lf[low[single]]], [lf[low[single]] + 1]
        small = (size > 1) & (size <= 48)
        if small.any():
            counts = size[small]
            of = np.repeat(np.arange(len(counts)), counts)
            at = low[small][of] + np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
            to = lf[at]
            rank = np.argsort(of * n + to)  # by interval; places in the transform's order go by character first
            to, key = to[rank], of[rank] * 512 + before[at[rank]]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            last = np.concatenate([first[1:], [len(to)]]) - 1
            left.append(to[first])
            right.append(to[last] + 1)
        large = size > 48
        if large.any():
            for c, where in places.items():
                a, b = np.searchsorted(where, low[large]), np.searchsorted(where, high[large])
                some = b > a
                left.append(begin[c] + a[some])
                right.append(begin[c] + b[some])
        low, high = np.concatenate(left), np.concatenate(right)
        fresh = ~reached[high]
        low, high = low[fresh], high[fresh]
        # Intervals of one round are of strings of one length, so no two end at the same boundary.
        reached[high] = True
    shared = ~reached
    out = np.zeros(n, bool)
    equal = shared[:n] | shared[1:]
    out[order] = equal
    if owner is None:
        return out
    earlier, at = np.zeros(n, bool), np.flatnonzero(equal)
    if len(at):
        heads, place = np.flatnonzero(reached[at]), order[at]
        mine = owner[place]
        earlier[place] = np.repeat(np.minimum.reduceat(mine, heads), np.diff(np.append(heads, len(at)))) < mine
    return out, earlier


def _trimmed(rows: list[tuple], length: int, gram: int) -> list[tuple]:
    """one, two, text, bytes skipped, first of the segments, without strings that cannot occur in another one.

    A string holds the minimiser and, to the right of its start or to the left of its end, half of what is left of its
    length. If no other segment with this minimiser has the same half, the strings that hold it go.
    """
    half = (length + gram) // 2
    sizes = np.array([len(r[4]) for r in rows])
    middle = np.array([r[3] for r in rows])
    least = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
    symbols, base = C.BYTES[data], np.cumsum(sizes) - sizes
    shared = []
    for low in (middle, middle + gram - half):  # the minimiser opens the right half and closes the left one
        inside = np.flatnonzero((low >= 0) & (low + half <= sizes))
        start = base[inside] + low[inside]
        key = C.mix(C.span_hash(symbols, start, start + half, C._BYTE) ^ least[inside])
        _, at, count = np.unique(key, return_inverse=True, return_counts=True)
        out = np.zeros(len(rows), bool)
        out[inside] = count[at] > 1
        shared.append(out)
    right, left = shared
    first = np.where(left, 0, np.maximum(0, middle + half - length))
    last = np.where(right, sizes - length, np.minimum(sizes - length, middle + gram - half))
    keep = (right | left) & (last >= first)
    return [(rows[i][1], rows[i][2], rows[i][4][first[i] : last[i] + length], int(first[i]), rows[i][5]) for i in np.flatnonzero(keep)]


def _expand(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Repeated strings of segments that come sorted by minimiser: one, two, from, to (places in the segment), and
    whether they also start in a smaller document than the segment's first."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        rows = _trimmed(rows, length, gram)
        sizes = np.array([len(r[2]) for r in rows], np.int64)
        text = np.frombuffer(b"\0".join(r[2] for r in rows) + b"\0", np.uint8).astype(np.int64) + 1
        starts = np.cumsum(sizes + 1) - sizes - 1
        text[starts + sizes] = 0
        owner = np.repeat(np.array([r[4] for r in rows], np.int64), sizes + 1)
        found, earlier = repeated(text, length, owner) if rows else (np.zeros(0, bool), np.zeros(0, bool))
        kind = found + earlier.astype(np.int8)  # 2: in a smaller document, too
        out = []
        for (one, two, _, skipped, _), start, size in zip(rows, starts, sizes, strict=True):
            mine = kind[start : start + size - length + 1]
            cuts = np.flatnonzero(np.diff(mine, prepend=0, append=0)).tolist()
            out += [(one, two, a + skipped, b + skipped, bool(mine[a] == 2)) for a, b in pairwise(cuts) if mine[a]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out, strict=True)) or [[]] * 5, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], names=["one", "two", "from", "to", "earlier"])

    block: list[tuple] = []
    bucket: list[tuple] = []
    held = 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if bucket and bucket[0][0] != row[0]:
                size = sum(len(r[4]) + 1 for r in bucket)
                if block and held + size > BLOCK:
                    yield solve(block)
                    block, held = [], 0
                block.extend(bucket)
                held, bucket = held + size, []
            bucket.append(row)
    for rows in ([*block, *bucket],) if held + sum(len(r[4]) + 1 for r in bucket) <= BLOCK else (block, bucket):
        if rows:
            yield solve(rows)


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """All strings of length bytes of segments: their hashes, the segment, its first document and the place in it."""
    for batch in C.steps(batches, "piece"):
        data, offsets = C.utf8(batch.column(4))
        count = np.maximum(np.diff(offsets) - length + 1, 0)
        row = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = offsets[:-1][row] + place
        a, b = C.span_hash(C.BYTES[data], at, at + length, C._BYTE), C.span_hash(_BYTES[data], at, at + length, _SECOND)
        keys = [batch.column(i).to_numpy(zero_copy_only=False)[row] for i in (1, 2, 5)]
        yield pa.RecordBatch.from_arrays([pa.array(C.signed(a)), pa.array(C.signed(b)), *map(pa.array, keys), pa.array(place.astype(np.int32))], names=["a", "b", "one", "two", "first", "from"])


def _covered(low: np.ndarray, high: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of n bytes are in a string that starts from low up to high."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, low, 1)
    np.add.at(step, high - 1 + length, -1)
    return np.cumsum(step[:n]) > 0


def _finish(batches: Iterator[pa.RecordBatch], length: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, copies, later, runs in zip(*(batch.column(i) for i in range(5)), strict=True):
            body = (text.as_py() or "").encode()
            n = len(body)
            gone, n_later = np.zeros(n, bool), 0
            if runs.is_valid and len(runs):
                low, high, earlier = (x.to_numpy(zero_copy_only=False) for x in runs.values.flatten())
                gone = _covered(low, high, n, length)
                n_later = int(_covered(low[earlier], high[earlier], n, length).sum()) if earlier.any() else 0
            if copies.as_py() and n >= length:
                gone[:] = True
                n_later = n if later.as_py() else n_later
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            kept = np.frombuffer(body, np.uint8)[~gone].tobytes() if gone.any() else body
            out.append((doc.as_py(), n, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if texts else None, n_later))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out, strict=True)) or [[]] * 7, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "n_later"])


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = BLOCK, texts: bool = True) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, n_later.

    Texts are UTF-8 bytes. Removed is each byte in a string of `length` bytes that also starts anywhere else, in the
    same text or another one, judged on the input; so of equal texts of that length none is left. Null and empty texts
    have no bytes. kept is the bytes left, which may end within a character (null unless texts). n_later is the part of
    n_removed in strings that also start in a text of a smaller doc_id: what would go if first copies stayed. Rows
    without doc_id are left out; rows of one doc_id are texts each by itself, the lesser MD5 first; other columns are
    ignored.
    """
    if gram >= length:
        raise ValueError("gram must be shorter than length")
    if again := C.numbered(docs, C.Scratch(), F.col("doc_id").cast("long"), F.md5(F.col("text").cast("string"))):
        return C.own_ids(*again, suffix_dedup(C.as_documents(*again), length, gram, most, texts))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    digest = rows.select("doc_id", F.md5("text").alias("digest"))
    groups = C.counted_apart(digest, ["digest"], F.min("doc_id").alias("first")).where("n > 1")
    copied = digest.join(groups, "digest").select("doc_id", F.lit(True).alias("copied"), (F.col("doc_id") > F.col("first")).alias("later"))
    marked = rows.join(copied, "doc_id", "left")
    own = marked.where("later is null or not later").select("doc_id", "text")
    segments = C.written_alone(own.mapInArrow(lambda it: _segments(it, length, gram), "doc_id long, start int, size int, middle int, least long, one long, two long"), "segments")
    content = segments.groupBy("one", "two").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start", "size", "middle", "least")).alias("rep"))
    content = C.written_alone(content.select("one", "two", "n", "rep.*"), "contents")
    # One exchange for counts and join: what is written as pieces then comes by minimiser, which compresses it well.
    sharing = content.groupBy("least").agg(F.count("*").alias("contents"), F.sum(F.col("size").cast("long") + 1).alias("held")).where("contents > 1")
    wanted = content.join(sharing.select("least", "held"), "least")
    listed = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("least", "one", "two", "start", "size", "middle")).alias("found"))
    pieces = own.join(listed, "doc_id").select("text", "found", "doc_id").mapInArrow(_pieces, "least long, one long, two long, middle int, piece binary, first long")
    crowded = sharing.where(F.col("held") > most).select("least")
    pieces = C.written_alone(pieces.join(crowded.withColumn("crowded", F.lit(True)), "least", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False))), "pieces")
    usual = pieces.where("not crowded").select("least", "one", "two", "middle", "piece", "first")
    found = usual.repartition("least").sortWithinPartitions("least").mapInArrow(lambda it: _expand(it, length, gram), "one long, two long, from int, to int, earlier boolean")
    strings = pieces.where("crowded").select("least", "one", "two", "middle", "piece", "first").mapInArrow(lambda it: _strings(it, length), "a long, b long, one long, two long, first long, from int")
    again = C.counted_apart(strings, ["a", "b"], F.min("first").alias("least")).where("n > 1").select("a", "b", "least")
    found = found.union(strings.join(again, ["a", "b"]).select("one", "two", "from", (F.col("from") + 1).alias("to"), (F.col("least") < F.col("first")).alias("earlier")))
    # All strings of a content that occurs twice are repeated, whatever else holds them.
    often = content.where("n > 1").select("one", "two", F.lit(0).alias("from"), (F.col("size") - length + 1).alias("to"), F.lit(False).alias("earlier"), F.col("doc_id").alias("first"))
    places = segments.select("doc_id", "start", "one", "two").join(found.withColumn("first", F.lit(None).cast("long")).union(often), ["one", "two"])
    earlier = F.col("earlier") | F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    runs = places.groupBy("doc_id").agg(F.collect_list(F.struct((F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("to")).alias("to"), earlier.alias("earlier"))).alias("runs"))
    return marked.join(runs, "doc_id", "left").select("doc_id", "text", "copied", "later", "runs").mapInArrow(lambda it: _finish(it, length, texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, n_later long")
