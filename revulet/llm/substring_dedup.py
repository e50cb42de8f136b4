"""Substring dedup by difference-cover anchors.

A set D of residues modulo V is a difference cover when every residue is a difference of two members. Then any two
places i, j of two documents have a shift d < V with (i + d) mod V and (j + d) mod V both in D: two equal runs of
WINDOW words share an anchor of WINDOW - V + 1 words that starts at a cover place of both. Only anchors are hashed and
exchanged (a fifth of all places), those in two documents or more are extended to whole windows, and windows are
compared by 96-bit hashes of all their words. A window's first document owns it: the others' words in it go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 50
PERIOD = 31
#: Documents from which on an anchor is hot, and how many of the hottest every task has (8 bytes each).
HOT, HOTTEST = 1000, 100_000


@lru_cache
def cover(period: int) -> tuple[int, ...]:
    """A small difference cover modulo period: depth-first search for the least size that works."""
    size = 1
    while size * (size - 1) + 1 < period:
        size += 1

    def search(chosen: list[int], seen: frozenset[int], size: int) -> list[int] | None:
        if len(chosen) == size:
            return chosen if len(seen) == period else None
        left = size - len(chosen)
        room = sum(2 * (len(chosen) + k) for k in range(left))
        if len(seen) + room < period:
            return None
        for x in range(chosen[-1] + 1, period):
            more = {(x - y) % period for y in chosen} | {(y - x) % period for y in chosen}
            if found := search([*chosen, x], seen | more, size):
                return found
        return None

    while not (found := search([0], frozenset([0]), size)):
        size += 1
    return tuple(found)


def _anchors(batches: Iterator[pa.RecordBatch], window: int, period: int, distinct: bool) -> Iterator[pa.RecordBatch]:
    """Anchors with doc_id and place, or only the distinct anchors of each text."""
    chosen = np.zeros(period, bool)
    chosen[list(cover(period))] = True
    for batch in C.steps(batches):
        data, offsets = C.utf8(batch.column(1))
        ids = C.longs(batch.column(0))
        starts, ends, index = C.words(data, offsets)
        row, place, anchor = C.windows(C.byte_hash(data, starts, ends), index, window - period + 1)
        keep = chosen[place % period] & (np.diff(index)[row] >= window)
        row, place, anchor = row[keep], place[keep], anchor[keep]
        if distinct:
            order = np.lexsort((anchor, row))
            row, anchor = row[order], anchor[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(C.signed(anchor[new]))], names=["anchor"])
        else:
            yield pa.RecordBatch.from_arrays([pa.array(C.signed(anchor)), pa.array(ids[row]), pa.array(place.astype(np.int32))], names=["anchor", "doc_id", "place"])


def _candidates(data: np.ndarray, offsets: np.ndarray, found: pa.ListArray, window: int, period: int, two: bool):
    """Row, place and hashes of the windows that hold a shared anchor at one of the period starts that alignment
    allows; found has the places of each row's shared anchors."""
    starts, ends, index = C.words(data, offsets)
    row, place, *hashes = C.windows(C.byte_hash(data, starts, ends), index, window, two=two)
    where = np.diff(found.offsets.to_numpy()) if len(found) else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(where)), where)
    at = index[:-1][of] + found.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    at = at[at < index[1:][of]]  # places of other texts with this doc_id can lie beyond the end
    count = np.zeros(len(starts) + 1, np.int64)
    np.add.at(count, at + 1, 1)
    count = np.cumsum(count)
    start = index[:-1][row] + place
    keep = count[np.minimum(start + period, len(starts))] > count[start]
    return row[keep], place[keep], *(h[keep] for h in hashes)


def _windows(batches: Iterator[pa.RecordBatch], window: int, period: int) -> Iterator[pa.RecordBatch]:
    for batch in C.steps(batches):
        row, _, one, two = _candidates(*C.utf8(batch.column(1)), batch.column(2), window, period, True)
        two = (two >> np.uint64(32)).astype(np.uint32).view(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(C.signed(one)), pa.array(two), pa.array(C.longs(batch.column(0))[row])], names=["one", "two", "doc_id"])


def _disowned(batch: pa.RecordBatch, window: int, period: int) -> dict[int, np.ndarray]:
    """By row, the places of windows that hold a shared anchor and that the row does not own."""
    touched = np.flatnonzero(pa.compute.fill_null(pa.compute.list_value_length(batch.column(3)), 0).to_numpy() > 0)
    part = batch.take(pa.array(touched))
    row, place, one = _candidates(*C.utf8(part.column(1)), part.column(3), window, period, False)
    of = np.repeat(np.arange(len(touched)), pa.compute.fill_null(pa.compute.list_value_length(part.column(4)), 0).to_numpy())
    tagged = lambda key, at: C.mix(key) + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    owned = tagged(part.column(4).flatten().to_numpy(zero_copy_only=False).view(np.uint64), of)
    gone = ~np.isin(tagged(one, row), owned)
    row, place = row[gone], place[gone]
    cut = np.searchsorted(row, np.arange(len(touched) + 1))
    return {int(t): place[cut[i] : cut[i + 1]] for i, t in enumerate(touched) if cut[i] < cut[i + 1]}


def _finish(batches: Iterator[pa.RecordBatch], window: int, period: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in C.steps(batches):
        out, gone_of = [], _disowned(batch, window, period)
        for at, (doc, text, copy) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
            own = (text or "").encode().split()  # bytes.split() parts at exactly the six ASCII white-space bytes
            n, kept = len(own), own
            if copy and n >= window:
                kept = []
            elif at in gone_of:
                gone = C.covered(gone_of[at], window, n)
                kept = [own[i] for i in np.flatnonzero(~gone)]
            joined = b" ".join(kept)
            out.append((doc, n, n - len(kept), hashlib.sha256(joined).hexdigest(), (text if len(kept) == n else joined.decode()) if texts else None))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out, strict=True)) or [()] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]).append_column("carried", batch.column(5))


def substring_dedup(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, texts: bool = True, carried: Column | None = None) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256, kept, and the long `carried`.

    Removed is each word in a run of `window` words that also starts in a document with a smaller doc_id, judged on
    the input. Null and empty texts have no words and stay, as do texts shorter than the window. Of equal texts only
    that with the smallest doc_id counts as first. Rows of one doc_id lose nothing to one another; those without a
    doc_id are left out. Other columns are ignored. kept is the words left, joined by one space, or the text as it is if none are removed (always
    null unless texts); kept_sha256 is of the words left, joined by one space.
    """
    # What is carried goes through the exchange of texts, which all steps share only if they need the same columns.
    extra = [] if carried is None else [carried.alias("carried")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra).where("doc_id is not null")
    # Whole copies: all but the first lose all their words, so only the first offers anchors and windows. Every step
    # that needs texts reads them from the one exchange by doc_id.
    digest = rows.select("doc_id", F.md5("text").alias("digest"))
    first = C.counted_apart(digest, ["digest"], F.min("doc_id").alias("first")).where("n > 1")
    # A doc_id has one digest, unless its rows differ.
    copies = digest.join(first, "digest").where("doc_id > first").groupBy("doc_id").agg(F.collect_set("digest").alias("digests"))
    copy = F.when(F.col("digests").isNotNull() & F.array_contains("digests", F.md5("text")), True)
    marked = rows.join(copies, "doc_id", "left").withColumn("copy", copy).drop("digests")
    own = marked.where("copy is null").select("doc_id", "text")
    anchors = own.mapInArrow(lambda it: _anchors(it, window, period, False), "anchor long, doc_id long, place int")
    # Both counts below read the same exchange; the filter, which the joins imply, is said once for both.
    distinct = own.mapInArrow(lambda it: _anchors(it, window, period, True), "anchor long").where("anchor is not null")
    shared = distinct.groupBy("anchor").agg(F.count("*").alias("docs")).where("docs > 1")
    # The anchors of most documents are known to be shared. They are so few that every task has them all, and their
    # places are dealt out by themselves; of those left, none has more than one of HOTTEST parts of all rows.
    hot = F.broadcast(shared.where(F.col("docs") >= HOT).orderBy(F.desc("docs"), "anchor").limit(HOTTEST).select("anchor", F.lit(True).alias("hot")))
    # A hot anchor's places go below zero.
    place = F.when(F.col("hot"), -1 - F.col("place")).otherwise(F.col("place"))
    dealt = anchors.join(hot, "anchor", "left").select("doc_id", place.alias("place"), F.when(F.col("hot"), F.xxhash64("doc_id", "place")).otherwise(F.col("anchor")).alias("anchor"))
    kept = dealt.join(shared, "anchor", "left").where("place < 0 or docs is not null").select("doc_id", F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("place"))
    places = kept.groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    candidates = own.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(lambda it: _windows(it, window, period), "one long, two int, doc_id long")
    # The first document of each window owns it, and a document loses those that it doesn't own. So what goes back to
    # documents is a row for each different window, and no row of a window that thousands share meets the others.
    owned = candidates.groupBy("one", "two").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.collect_list("one").alias("owned"))
    rows = marked.join(places, "doc_id", "left").join(owned, "doc_id", "left").select("doc_id", "text", "copy", F.when(F.col("copy").isNull(), F.col("places")).alias("places"), "owned", "carried" if extra else F.lit(None).cast("long").alias("carried"))
    return rows.mapInArrow(lambda it: _finish(it, window, period, texts), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, carried long")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs (doc_id, text, n_chars and any others) with the texts that substring_dedup() leaves.

    Rows that lose all their words go; n_chars, where there, follows the text. Rows without doc_id stay as they are.
    """
    key, columns = "doc_id", docs.columns
    if again := C.numbered(docs, C.Scratch()):
        docs, key = again
    found = substring_dedup(docs, window, carried=F.col(key).cast("long") if again else None)
    left = found.select(found["carried" if again else "doc_id"].alias("_id"), "n_words", "n_removed", "kept")
    removed, n_words, kept = left["n_removed"], left["n_words"], left["kept"]
    # Texts come with the operator's rows; of docs only the other columns are exchanged, and texts without doc_id.
    others = docs.withColumn("text", F.when(F.col("doc_id").isNull(), F.col("text")))
    rows = others.join(left, others[key] == left["_id"], "left").where(removed.isNull() | (removed == 0) | (removed < n_words))
    new = {"text": F.when(removed.isNull(), others["text"]).otherwise(kept).alias("text")}
    if "n_chars" in columns:
        new["n_chars"] = F.when(removed > 0, F.char_length(kept)).otherwise(others["n_chars"]).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return rows.select(*(new.get(c, others[c]) for c in columns))
